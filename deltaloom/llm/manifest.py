"""Merkle manifest of a dataset: leaves, subroots of sources, one root, and every row's proof.

A leaf is the SHA-256 of a row's fields.  Leaves of a source stand in order; every run of ``FANOUT``
consecutive digests is hashed to one, level by level, until one is left: the source's subroot.  The
subroots, in order, are hashed likewise to the root.

A tree is built in tiers of aligned blocks of ``FANOUT ** LEVELS`` digests.  A block is one group of
bounded size: its digests are one contiguous matrix of 64-byte hex strings, a level is that matrix
reshaped by the fanout and hashed row by row, and a digest's siblings are found by index arithmetic.
The blocks' tops are the leaves of the next tier, of 1 / 2,187 of the rows, until each tree is one
block.  Then paths travel down: a block gets its own path to the root and gives each of its digests
theirs.  A digest's place in its tree is its place in a range-sorted table plus the rows of its tree
in earlier ranges, so no tree passes through one task, however many rows its source has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.llm.storage import Scratch, crc32_of_id

FANOUT = 3
#: Levels of a block: it has FANOUT ** LEVELS digests.
LEVELS = 7
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = "S64"

BLOCK = "tree string, block long, top string"
PATH = "tree string, pos long, subroot string, before array<string>, after array<string>"
PROOF = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def hashed(rows: np.ndarray) -> np.ndarray:
    """The digest of each row of a matrix of hex digests; missing ones at a row's end are empty."""
    joined = np.ascontiguousarray(rows).view(f"S{64 * rows.shape[1]}").reshape(-1)
    return np.array([hashlib.sha256(x).hexdigest().encode() for x in joined.tolist()], HEX)


def runs_of(level: np.ndarray) -> np.ndarray:
    """A level reshaped to runs; the last run may have empty places."""
    full = np.zeros(-(-len(level) // FANOUT) * FANOUT, HEX)
    full[: len(level)] = level
    return full.reshape(-1, FANOUT)


def levels_of(leaves: np.ndarray, n_levels: int | None) -> list[np.ndarray]:
    """The levels of a block from its leaves up: so many steps, or until one digest is left."""
    out = [leaves]
    while len(out) <= n_levels if n_levels is not None else len(out[-1]) > 1:
        out.append(hashed(runs_of(out[-1])))
    return out


def around(levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step up: every leaf's place in its run, and the run."""
    at, steps = np.arange(len(levels[0])), []
    for level in levels[:-1]:
        steps.append((at % FANOUT, runs_of(level)[at // FANOUT]))
        at = at // FANOUT
    return steps


def placed(rows: DataFrame, order: Sequence[Column], scratch: Scratch) -> DataFrame:
    """``rows`` (tree and more) with pos, the place in the tree by ``order``, and n_tree, the rows of the tree.

    The table is sorted by ranges and written with each row's place in its range; the ranges' counts, a
    row for each tree and range, give what stands before.  Rows that are equal in every respect are
    dealt to ranges by their place in the input, so that they are split as well.
    """
    keys = [F.col("tree").asc_nulls_first(), *order, F.col("row").asc()]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = scratch.written(ranged.drop("row").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")
    parts = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("n_tree"))
    parts = scratch.written(parts, "parts").select(F.col("tree").alias("tree_"), F.col("part").alias("part_"), "shift", "n_tree")
    met = ranged["tree"].eqNullSafe(parts["tree_"]) & (ranged["part"] == parts["part_"])
    return ranged.join(parts, met).withColumn("pos", F.col("at") + F.col("shift")).drop("tree_", "part_", "part", "at", "shift")


def in_blocks(rows: DataFrame) -> DataFrame:
    """With block, and steps: all levels of a block where the tree has several blocks, else null (until one digest is left)."""
    full = FANOUT**LEVELS
    return rows.withColumns({"block": F.floor(F.col("pos") / full).cast("long"), "steps": F.when(F.col("n_tree") > full, F.lit(LEVELS))}).drop("n_tree")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), HEX)


def _top(table: pa.Table) -> pa.Table:
    """A block's digests to its top."""
    table = _sorted(table)
    levels = levels_of(_digests(table["digest"]), table["steps"][0].as_py())
    return pa.table({"tree": table["tree"].slice(0, 1), "block": table["block"].slice(0, 1), "top": pa.array([levels[-1][0].decode()])})


def _paths(table: pa.Table, above: pa.Table) -> pa.Table:
    """A block's digests, and the path of its top, to the path of each digest: the siblings before and after it, step by step."""
    table = _sorted(table)
    own = _digests(table["digest"])
    before, after = [[] for _ in own], [[] for _ in own]
    for place, run in around(levels_of(own, table["steps"][0].as_py())):
        for i, (k, row) in enumerate(zip(place.tolist(), run.tolist())):
            before[i].append(b"".join(row[:k]).decode())
            after[i].append(b"".join(row[k + 1 :]).decode())
    rest = {c: above[c][0].as_py() if len(above) else [] for c in ("before", "after")}  # there is nothing above the root
    inherited = above["subroot"][0].as_py() if len(above) else None
    lists = {c: pa.array([x + rest[c] for x in steps], pa.list_(pa.string())) for c, steps in (("before", before), ("after", after))}
    subroot = table["digest"] if table["is_subroot"][0].as_py() else pa.array([inherited] * len(own), pa.string())
    return pa.table({"tree": table["name"], "pos": table["top_of"], "subroot": subroot, **lists})


def _proofs(table: pa.Table, above: pa.Table) -> pa.Table:
    """A block's leaves and changed leaves, and the path of its top, to each leaf's proof digest and folded root."""
    table = _sorted(table)
    own, now = _digests(table["digest"]), _digests(table["changed"])
    steps = around(levels_of(own, table["steps"][0].as_py()))
    proof: list[list[bytes]] = [[] for _ in own]
    every = np.arange(len(own))
    for place, run in steps:
        others = run[:, :-1].copy()  # the run without the place of the leaf's own digest
        for k in range(FANOUT - 1):
            behind = place <= k
            others[behind, k] = run[behind, k + 1]
        for i, x in enumerate(others.view(f"S{64 * (FANOUT - 1)}").reshape(-1).tolist()):
            proof[i].append(x)
        run = run.copy()
        run[every, place] = now
        now = hashed(run)
    before, after = (above[c][0].as_py() for c in ("before", "after"))
    rest = "".join(b + a for b, a in zip(before, after)).encode()
    folded: dict[bytes, str] = {}
    for x in set(now.tolist()):
        digest = x
        for b, a in zip(before, after):
            digest = hashlib.sha256(b.encode() + digest + a.encode()).hexdigest().encode()
        folded[x] = digest.decode()
    return pa.table({
        "doc_id": table["doc_id"],
        "leaf": table["digest"],
        "subroot": pa.array([above["subroot"][0].as_py()] * len(own)),
        "proof_sha256": pa.array([hashlib.sha256(b"".join(p) + rest).hexdigest() for p in proof]),
        "folded_root": pa.array([folded[x] for x in now.tolist()]),
    })


def _tops(rows: DataFrame) -> DataFrame:
    return rows.select("tree", "block", "pos", "digest", "steps").groupBy("tree", "block").applyInArrow(_top, BLOCK)


def _down(rows: DataFrame, above: DataFrame, give, schema: str, columns: Sequence[str]) -> DataFrame:
    """Blocks of ``rows``, each with the one row of ``above`` that is its top's path."""
    left = rows.select("tree", "block", "pos", "digest", "steps", *columns).groupBy("tree", "block")
    return left.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(give, schema)


def manifest(documents: DataFrame, changed: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, tree: str = "source", id_column: str = "doc_id") -> tuple[DataFrame, str | None]:
    """(doc_id, leaf, subroot, proof_sha256, folded_root) of every row, and the root (None without rows).

    ``changed`` gives fields as they are found later; folded_root is the root that the row's leaf of
    those fields has with the siblings of the manifest.

    Defined results: a null field is ``-``; a null source is a tree of its own, the first; rows of a
    tree with equal ids are ordered by their leaves, null ids come first, rows equal in all fields have
    equal leaves next to each other; a tree of one row has its leaf as subroot; an empty table gives no
    rows and no root; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "manifest")
    now = {f: (changed or {}).get(f, F.col(f"`{f}`")) for f in fields}
    rows = documents.select(
        F.col(f"`{tree}`").cast("string").alias("tree"), F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        leaf_of([F.col(f"`{f}`") for f in fields]).alias("digest"), leaf_of([now[f] for f in fields]).alias("changed"),
    )
    rows = scratch.written(rows, "leaves")
    rows = scratch.written(in_blocks(placed(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("changed").asc()], scratch)), "blocks")
    tiers = [rows]  # of the sources' trees
    tops = scratch.written(_tops(rows), "tops")
    while not tops.where("block > 0").isEmpty():
        up = tops.select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"))
        sizes = up.groupBy("tree").agg(F.count("*").alias("n_tree")).withColumnRenamed("tree", "tree_")
        up = up.join(sizes, F.col("tree").eqNullSafe(F.col("tree_"))).drop("tree_")
        tiers.append(scratch.written(in_blocks(up), "tier"))
        tops = scratch.written(_tops(tiers[-1]), "tops")

    # the tree of the subroots, in order of the sources; its digests keep the names of their trees
    one = tops.select(F.lit("").alias("tree"), F.col("top").alias("digest"), F.col("tree").alias("name"))
    one = scratch.written(in_blocks(placed(one, [F.col("name").asc_nulls_first()], scratch)), "subroots")
    over = [one]
    tops = scratch.written(_tops(one), "tops")
    while not tops.where("block > 0").isEmpty():
        n = tops.count()
        over.append(scratch.written(in_blocks(tops.select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"), F.lit(n).cast("long").alias("n_tree"))), "tier"))
        tops = scratch.written(_tops(over[-1]), "tops")
    root = tops.first()

    # down again: the digests of each tier are the tops of blocks of the tier below
    paths = documents.sparkSession.createDataFrame([], PATH)
    for k, tier in [*reversed(list(enumerate(over))), *((-1, t) for t in reversed(tiers[1:]))]:
        named = {"name": F.col("name" if k == 0 else "tree"), "top_of": F.lit(0).cast("long") if k == 0 else F.col("pos"), "is_subroot": F.lit(k == 0)}
        paths = scratch.written(_down(tier.withColumns(named), paths, _paths, PATH, list(named)), "paths")
    proofs = _down(rows, paths, _proofs, PROOF, ["doc_id", "changed"])
    return scratch.result(proofs, "proofs"), root["top"] if root else None


def tampered_text(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """The text without its line ends where 2 divides the CRC-32 of the id."""
    return F.when(F.pmod(crc32_of_id(id_column), F.lit(2)) == 0, F.regexp_replace(text_column, "\n", "")).otherwise(F.col(text_column))


def verified(documents: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """The manifest's rows with root, and verified: whether the changed fields still fold to the root.

    Defined results: as ``manifest``; a null id is not tampered with.
    """
    rows, root = manifest(documents, changed)
    root = F.lit(root).cast("string")
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL: levels as recursive queries, CRC-32 bit by bit."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (text if f == "text" else f for f in FIELDS)) + ")"
    codes = "list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({codes}, lambda a, v: list_reduce([xor(a, v), 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"

    def levels(name: str, base: str) -> str:
        return f"""{name} AS (SELECT tree, 0 AS lv, pos, digest, n FROM {base}
        UNION ALL SELECT tree, lv + 1, pos // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {FANOUT - 1}) // {FANOUT} FROM {name} WHERE n > 1 GROUP BY tree, lv, pos // {FANOUT}, n)"""

    def siblings(name: str, levels: str, own: str) -> str:
        at = f"o.pos // ({FANOUT} ** l.lv)::BIGINT"
        side = lambda sign: f"coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos {sign} {at}), '')"
        return f"""{name} AS (SELECT o.id, l.lv, {side("<")} AS before, {side(">")} AS after FROM {own} o
        JOIN {levels} l ON l.tree IS NOT DISTINCT FROM o.tree AND l.n > 1 AND l.pos // {FANOUT} = {at} // {FANOUT} GROUP BY o.id, l.lv)"""

    return f"""WITH RECURSIVE t AS (SELECT *, CASE WHEN {crc} & 1 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents),
      d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, source AS tree, {leaf("text")} AS digest, {leaf("now")} AS changed FROM t),
      p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, changed) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
      {levels("a", "p")},
      q AS MATERIALIZED (SELECT '' AS tree, tree AS name, digest, row_number() OVER o - 1 AS pos, count(*) OVER () AS n, row_number() OVER o AS id FROM a WHERE n = 1 WINDOW o AS (ORDER BY tree NULLS FIRST)),
      {levels("b", "q")},
      {siblings("x", "a", "p")},
      {siblings("y", "b", "q")},
      z AS (SELECT id, lv, before, after FROM x UNION ALL SELECT p.id, 1000 + y.lv, before, after FROM p JOIN q ON p.tree IS NOT DISTINCT FROM q.name JOIN y ON y.id = q.id),
      proof AS MATERIALIZED (SELECT id, list(before ORDER BY lv) AS bs, list(after ORDER BY lv) AS fs, sha256(string_agg(before || after, '' ORDER BY lv)) AS proof FROM z GROUP BY id),
      fold AS (SELECT p.id, changed AS h, 1 AS i, bs, fs FROM p LEFT JOIN proof USING (id)
        UNION ALL SELECT id, sha256(bs[i] || h || fs[i]), i + 1, bs, fs FROM fold WHERE i <= len(bs)),
      root AS (SELECT digest AS root FROM b WHERE n = 1)
    SELECT p.doc_id, p.digest AS leaf, q.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, h AS folded_root, h = root AS verified
    FROM p JOIN q ON p.tree IS NOT DISTINCT FROM q.name LEFT JOIN proof ON proof.id = p.id JOIN fold ON fold.id = p.id AND fold.i = coalesce(len(fold.bs), 0) + 1, root"""
