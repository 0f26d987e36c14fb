"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Token counts are summed to cells (source, language, topic); the cells' weights are raked to the
target marginals of the three dimensions in turn, until no marginal is off by more than
``TOLERANCE``; a document is kept with the calibrated probability of its cell.  Only cells are
iterated on: up to ``ARRAYS`` of them as arrays of one row, in one expression; more as a table that
is written after each round.  Documents are read twice and never shuffled, unless there are more
than ``SMALL`` cells.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.storage import SMALL, written

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are the observed token shares to this power, made to sum to 1; or given by value.
TARGETS = {"source": 0.5, "lang": 0.5, "topic": 0.7}
#: Raking ends with the round in which every marginal was within this share of all tokens, or after so many rounds.
TOLERANCE, ROUNDS = 1e-9, 200
#: Share of all tokens to keep.
KEEP = 0.6
SEED = "mix"
MISSING = "(none)"
#: Cells that are raked as arrays of one row, at most.
ARRAYS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text contains: legal lines, tables, contact data, or prose."""
    return F.when(text.contains("rights reserved"), "legal").when(text.contains(" | "), "table").when(text.contains("@"), "contact").otherwise("prose")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that the id and the seed determine: 52 bits of an MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_cells(documents: DataFrame, topic: Column | None, text_column: str) -> DataFrame:
    """The documents with the columns cell_source, cell_lang, cell_topic and n_tokens."""
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text_column)) if topic is None else topic}
    named = {f"cell_{d}": F.coalesce(c.cast("string"), F.lit(MISSING)) for d, c in values.items()}
    return documents.withColumns(named | {"n_tokens": n_words(F.col(text_column))})


def target_shares(cells: DataFrame, dimension: str, target: float | dict[str, float]) -> DataFrame:
    """(value, share) for each value of a dimension; shares sum to 1.

    A number is the power of the observed share.  A dict gives shares by value; values it does not
    name share what it leaves in proportion to what is observed.
    """
    column = f"cell_{dimension}"
    seen = cells.groupBy(column).agg(F.sum("t").alias("t")).where("t > 0")
    if isinstance(target, dict):
        named = F.create_map(*[x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))]) if target else F.lit(None).cast("map<string,double>")
        left = max(0.0, 1.0 - sum(target.values()))
        rest = seen.where(named[F.col(column)].isNull()).agg(F.sum("t")).first()[0] or 1
        raw = F.coalesce(named[F.col(column)], F.col("t") * F.lit(left / rest))
    else:
        raw = F.pow(F.col("t").cast("double"), F.lit(float(target)))
    seen = seen.select(column, raw.alias("raw"))
    total = seen.agg(F.sum("raw")).first()[0] or 1.0
    return seen.select(column, (F.col("raw") / F.lit(float(total))).alias(f"share_{dimension}"))


def _sized(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= SMALL else small


def raked(documents: DataFrame, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS) -> tuple[DataFrame, float, float]:
    """Cells with t (tokens) and w (raked tokens, of the same total); the total; and how far off a marginal was in the last round.

    ``documents`` has the columns of ``with_cells``.  off is the largest difference of a marginal from
    its target, each before its step, as a share of the total.
    """
    columns = [f"cell_{d}" for d in DIMENSIONS]
    cells = written(documents.groupBy(*columns).agg(F.sum("n_tokens").alias("t")), "cells")
    total, n = cells.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count("*")).first()
    total, start, sizes = float(total), cells, {}
    for d in DIMENSIONS:
        shares = written(target_shares(cells, d, targets[d]), "shares")
        sizes[d] = shares.count()
        start = start.join(_sized(shares, sizes[d]), f"cell_{d}", "left")
    now = start.withColumn("w", F.col("t").cast("double"))
    if n <= ARRAYS:
        one = written(raked_arrays(now, total, rounds), "cells")
        off = one.agg(F.max("off")).first()[0] or 0.0
        return one.select(F.explode("cells").alias("c")).select(*[f"c.{x}" for x in (*columns, "t", "w")]), total, off
    off = 1.0
    now = written(now, "cells")
    for _ in range(rounds):
        now = now.withColumn("off", F.lit(0.0))
        for d in DIMENSIONS:
            sums = now.groupBy(f"cell_{d}").agg(F.sum("w").alias("sum"))
            goal = F.coalesce(f"share_{d}", F.lit(0.0)) * F.lit(total)
            step = F.when(F.col("sum") > 0, F.col("w") * goal / F.col("sum")).otherwise(0.0)
            now = now.join(_sized(sums, sizes[d]), f"cell_{d}").withColumn("off", F.greatest("off", F.abs(F.col("sum") - goal) / F.lit(total or 1.0))).withColumn("w", step).drop("sum")
        now = written(now, "cells")
        off = now.agg(F.max("off")).first()[0] or 0.0
        if off <= TOLERANCE:
            break
    return now.select(*columns, "t", "w"), total, off


def raked_arrays(cells: DataFrame, total: float, rounds: int) -> DataFrame:
    """One row: cells (array of structs with t and w) and off; raking as a fold over half steps.

    A half step sums the weights of each value of one dimension, or scales the weights by those sums;
    the members of a value and the value of a cell are arrays of numbers.
    """
    entry = F.struct(*[f"cell_{d}" for d in DIMENSIONS], "t", *[F.coalesce(f"share_{d}", F.lit(0.0)).alias(f"share_{d}") for d in DIMENSIONS])
    row = cells.agg(F.sort_array(F.collect_list(entry)).alias("cells"))  # at most ARRAYS cells
    for k, d in enumerate(DIMENSIONS):
        row = row.withColumn(f"values{k}", F.array_sort(F.array_distinct(F.transform("cells", lambda c: c[f"cell_{d}"]))))
        row = row.withColumn(f"value_of{k}", F.transform("cells", lambda c: F.array_position(F.col(f"values{k}"), c[f"cell_{d}"]).cast("int") - 1))
        # numbers of the cells of each value, and its goal
        numbered = F.transform(F.col(f"value_of{k}"), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        row = row.withColumn(f"numbered{k}", numbered)
        row = row.withColumn(f"members{k}", F.transform(f"values{k}", lambda _, v: F.transform(F.filter(F.col(f"numbered{k}"), lambda x: x["v"] == v), lambda x: x["i"])))
        row = row.withColumn(f"goals{k}", F.transform(f"members{k}", lambda m: F.col("cells")[m[0]][f"share_{d}"] * F.lit(total)))

    def sums(w: Column, k: int) -> Column:
        return F.transform(F.col(f"members{k}"), lambda m: F.aggregate(m, F.lit(0.0), lambda a, i: a + w[i]))

    def scaled(w: Column, s: Column, k: int) -> Column:
        at = lambda x, i: F.when(s[F.col(f"value_of{k}")[i]] > 0, x * F.col(f"goals{k}")[F.col(f"value_of{k}")[i]] / s[F.col(f"value_of{k}")[i]]).otherwise(0.0)
        return F.transform(w, at)

    def off(s: Column, k: int) -> Column:
        each = F.transform(s, lambda x, i: F.abs(x - F.col(f"goals{k}")[i]) / F.lit(total or 1.0))
        return F.coalesce(F.array_max(each), F.lit(0.0))

    def half_step(state: Column, at: Column) -> Column:
        phase = F.pmod(at, F.lit(6))
        done = (phase == 0) & (state["last"] <= TOLERANCE)
        w, s, now = state["w"], state["s"], state["now"]
        for k in range(3):
            w = F.when(phase == 2 * k + 1, scaled(state["w"], state["s"], k)).otherwise(w)
            s = F.when(phase == 2 * k, sums(state["w"], k)).otherwise(s)
            now = F.when(phase == 2 * k + 1, F.greatest(state["now"] if k else F.lit(0.0), off(state["s"], k))).otherwise(now)
        last = F.when(phase == 5, F.greatest(state["now"], off(state["s"], 2))).otherwise(state["last"])
        stopped = state["stopped"] | done
        keep = lambda new, old: F.when(stopped, old).otherwise(new)
        return F.struct(keep(w, state["w"]).alias("w"), keep(s, state["s"]).alias("s"), keep(now, state["now"]).alias("now"), keep(last, state["last"]).alias("last"), stopped.alias("stopped"))

    start = F.struct(F.transform("cells", lambda c: c["t"].cast("double")).alias("w"), F.array().cast("array<double>").alias("s"), F.lit(0.0).alias("now"), F.lit(1.0).alias("last"), F.lit(False).alias("stopped"))
    row = row.withColumn("end", F.aggregate(F.sequence(F.lit(0), F.lit(6 * rounds - 1)), start, half_step))
    made = F.transform("cells", lambda c, i: F.struct(*[c[f"cell_{d}"].alias(f"cell_{d}") for d in DIMENSIONS], c["t"].alias("t"), F.col("end.w")[i].alias("w")))
    return row.select(made.alias("cells"), F.col("end.last").alias("off"))


def probabilities(cells: DataFrame, total: float, keep: float) -> DataFrame:
    """Cells with weight (w / t, 1 for cells without tokens) and p: least of 1 and a multiple of the weight.

    The multiple makes the expected tokens that stay ``keep`` of all: cells whose p is 1 are taken
    out and the rest is scaled anew until no more cells reach 1.
    """
    cells = written(cells.withColumn("weight", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1.0)), "cells")
    factor = keep
    while True:
        full = F.col("weight") * F.lit(factor) >= 1
        at = cells.agg(F.sum(F.when(full, F.col("t")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = (keep * total - float(at[0] or 0)) / at[1] if at[1] and at[1] > 0 else factor
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("weight") * F.lit(factor)))


def mixed(
    documents: DataFrame,
    targets: dict[str, float | dict[str, float]] | None = None,
    keep: float = KEEP,
    rounds: int = ROUNDS,
    seed: str = SEED,
    topic: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    strict: bool = False,
) -> DataFrame:
    """Each document with its columns and cell_source, cell_lang, cell_topic, n_tokens, weight, p, kept and residual.

    residual, the same in every row, is how far off a marginal was when raking ended, as a share of all
    tokens.  Targets can be out of reach: a value that occurs only together with another can't have a
    larger share than that one.  Then raking ends after ``rounds`` rounds with the last dimension's
    (topic's) marginals met and others not, the residual is over ``TOLERANCE`` and a warning is given;
    with ``strict`` it is an error.

    Defined results: null sources and languages are the value ``(none)``; null and empty texts have
    no tokens; a cell without tokens has weight 1; repeated rows are each weighed, and kept or not
    together; a null id is an empty one; an empty table gives an empty table; columns of the input
    with the names of added ones are replaced.
    """
    rows = with_cells(documents, topic, text_column)
    cells, total, off = raked(rows, targets or TARGETS, rounds)
    if off > TOLERANCE and total:
        said = f"the targets are not met: after {rounds} rounds a marginal is off by {off:.3g} of all tokens"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    cells = written(probabilities(cells, total, keep).drop("t", "w"), "cells")
    columns = [f"cell_{d}" for d in DIMENSIONS]
    rows = rows.drop("weight", "p", "kept", "residual")
    rows = rows.join(_sized(cells, cells.count()), columns)
    return rows.withColumns({"kept": uniform(F.col(id_column), seed) < F.col("p"), "residual": F.lit(off if total else 0.0)})


def sampled(documents: DataFrame, **options) -> DataFrame:
    """The documents that mixing keeps, with their own columns.

    Defined results: as ``mixed``; a cell whose p is 1 stays whole; an empty table gives an empty
    table; columns may have any names.
    """
    own = documents.columns
    rows = documents.select("doc_id", "text", "source", "lang", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    return mixed(rows, **options).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def oracle_sql(keep: float = KEEP, rounds: int = ROUNDS, seed: str = SEED, targets: dict[str, float] | None = None) -> str:
    """The same query in DuckDB's SQL: raking as a recursive query, and the multiple of the weights in closed form.

    In order of weight, cells are taken out as long as the multiple that is right for the rest makes them 1.
    """
    powers = targets or TARGETS
    steps, now = "", "r"
    for k, d in enumerate(DIMENSIONS):
        goal = f"coalesce(share_{d}, 0) * total"
        rest = ", ".join(["cell_source", "cell_lang", "cell_topic", "t", "total", "n", *[f"share_{x}" for x in DIMENSIONS]])
        before = "0" if k == 0 else "off"
        where = f" WHERE n < {rounds} AND off > {TOLERANCE}" if k == 0 else ""
        steps = f"""SELECT {rest}, greatest({before}, max(abs(sum - goal) / total) OVER ()) AS off, CASE WHEN sum > 0 THEN w * goal / sum ELSE 0 END AS w
          FROM (SELECT *, {goal} AS goal, sum(w) OVER (PARTITION BY cell_{d}) AS sum FROM ({now if k else 'SELECT * FROM r' + where}))"""
        now = steps
    shares = [f"g_{d} AS (SELECT cell_{d}, pow(t, {powers[d]}) / sum(pow(t, {powers[d]})) OVER () AS share_{d} FROM (SELECT cell_{d}, sum(t) AS t FROM c GROUP BY 1) WHERE t > 0)" for d in DIMENSIONS]
    return f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS cell_source, coalesce(lang, '(none)') AS cell_lang,
        CASE WHEN contains(text, 'rights reserved') THEN 'legal' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS cell_topic,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::BIGINT AS n_tokens FROM documents),
      c AS MATERIALIZED (SELECT cell_source, cell_lang, cell_topic, sum(n_tokens)::DOUBLE AS t FROM docs GROUP BY ALL),
      {", ".join(shares)},
      r AS (SELECT cell_source, cell_lang, cell_topic, t, sum(t) OVER () AS total, 0 AS n, share_source, share_lang, share_topic, 1.0::DOUBLE AS off, t AS w
        FROM c LEFT JOIN g_source USING (cell_source) LEFT JOIN g_lang USING (cell_lang) LEFT JOIN g_topic USING (cell_topic)
        UNION ALL SELECT cell_source, cell_lang, cell_topic, t, total, n + 1, share_source, share_lang, share_topic, off, w FROM ({now})),
      e AS MATERIALIZED (SELECT *, CASE WHEN t > 0 THEN w / t ELSE 1 END AS weight FROM r WHERE n = (SELECT max(n) FROM r)),
      k AS (SELECT weight, row_number() OVER o AS i, ({keep} * total - (sum(t) OVER o - t)) / nullif(sum(w) OVER () - (sum(w) OVER o - w), 0) AS f FROM e
        WINDOW o AS (ORDER BY weight DESC, cell_source, cell_lang, cell_topic ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      f AS (SELECT arg_min(f, i) AS f FROM k WHERE weight * f < 1),
      p AS MATERIALIZED (SELECT cell_source, cell_lang, cell_topic, weight, CASE WHEN f IS NULL THEN 1 ELSE least(1, weight * f) END AS p FROM e, f)
    SELECT doc_id, cell_source, cell_lang, cell_topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS p,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / 4503599627370496.0 < p AS kept
    FROM docs JOIN p USING (cell_source, cell_lang, cell_topic)"""
