"""Commit history as tables: ranges, first-parent chains, transitions and what they net to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import identity


def first_parents(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(sha, depth): from each head along ``parent`` to the end of the chain, or to the first commit met again.

    Pointers are doubled, and chains and pointers written, until a round adds no row.
    """
    from deltaloom.state.cache import checkpointed

    chain = checkpointed(heads.select("head", F.col("head").alias("sha"), F.lit(0).alias("depth")).distinct())
    jump = checkpointed(commits.where("parent IS NOT NULL").select("sha", F.col("parent").alias("to")))
    reach = 1
    while True:
        step = chain.join(jump, "sha").select("head", F.col("to").alias("sha"), (F.col("depth") + reach).alias("depth"))
        # in a loop only later visits are dropped: the first has the least depth
        step = checkpointed(step.join(chain.select("head", "sha"), ["head", "sha"], "left_anti").groupBy("head", "sha").agg(F.min("depth").alias("depth")))
        if not step.limit(1).count():
            return chain.select("sha", "depth")
        chain = checkpointed(chain.unionByName(step))
        jump = checkpointed(jump.join(jump.select(F.col("sha").alias("to"), F.col("to").alias("far")), "to").select("sha", F.col("far").alias("to")))
        reach *= 2


def transitions(versions: DataFrame) -> DataFrame:
    """Per path: transitions of its content over positions, and whether first and last differ (net change).

    ``versions`` has path, position and oid; a revert has transitions though nothing changed on the whole.
    """
    w = Window.partitionBy("path").orderBy("position")
    steps = versions.withColumn("before", F.lag("oid").over(w))
    grouped = steps.groupBy("path").agg(F.count_if(~F.col("before").eqNullSafe(F.col("oid"))).alias("transitions"), F.min_by("oid", "position").alias("first"), F.max_by("oid", "position").alias("last"))
    return grouped.select("path", "transitions", (~F.col("first").eqNullSafe(F.col("last"))).alias("net"))


def ancestors(parents: DataFrame, start: DataFrame) -> DataFrame:
    """Commits reachable from ``start`` (sha) over parents (sha, parent and, if known, its position), however far.

    One parent of each commit, the first, is its trunk.  Each round takes whole trunks by doubled
    pointers and then the other parents of what is new, so the rounds are as many as side branches nest.
    """
    from deltaloom.state.cache import checkpointed

    edges = checkpointed(parents.where("parent IS NOT NULL"))
    order = F.struct("position", "parent") if "position" in parents.columns else F.col("parent")
    jumps = [checkpointed(edges.groupBy("sha").agg(F.min_by("parent", order).alias("to")))]
    n = jumps[0].count()
    # a pointer of 2^k commits leads nowhere past the longest trunk; n is for loops
    while 2 ** len(jumps) <= n:
        last = jumps[-1]
        far = checkpointed(last.join(last.select(F.col("sha").alias("to"), F.col("to").alias("far")), "to").select("sha", F.col("far").alias("to")))
        if not far.limit(1).count():
            break
        jumps.append(far)
    seen, front = None, start.select("sha").distinct()
    while True:
        for jump in reversed(jumps):
            front = checkpointed(front.unionByName(front.join(jump, "sha").select(F.col("to").alias("sha"))).distinct())
        front = front if seen is None else checkpointed(front.join(seen, "sha", "left_anti"))
        seen = front if seen is None else checkpointed(seen.unionByName(front))
        front = front.join(edges, "sha").select(F.col("parent").alias("sha")).distinct().join(seen, "sha", "left_anti")
        front = checkpointed(front)
        if not front.limit(1).count():
            return seen


def commit_range(parents: DataFrame, base: DataFrame, target: DataFrame, most: int = 250) -> tuple[DataFrame, str]:
    """Commits reachable from the target and not from the base, and an outcome: ANALYZE, NO_CHANGE, DIVERGED or BACKLOG_LIMIT."""
    new, old = ancestors(parents, target), ancestors(parents, base)
    missing = base.join(new, "sha", "left_anti").limit(1).count()
    rows = new.join(old, "sha", "left_anti")
    n = rows.limit(most + 1).count()
    outcome = "DIVERGED" if missing else "NO_CHANGE" if n == 0 else "BACKLOG_LIMIT" if n > most else "ANALYZE"
    return rows, outcome


def in_scope(deltas: DataFrame, scope: list[str], column: str = "path") -> DataFrame:
    """Rows whose path is a scope root or below one; roots are few, so they are an OR of literals and are pushed down."""
    if not scope:
        return deltas
    path = F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    condition = F.lit(False)
    for root in scope:
        condition = condition | (path == root.rstrip("/")) | path.startswith(root.rstrip("/") + "/")
    return deltas.where(condition)


def longest_root(paths: DataFrame, roots: dict[str, str], column: str = "path") -> DataFrame:
    """Paths with the schema of the longest root that they are under."""
    schema = F.lit(None).cast("string")
    for root, name in sorted(roots.items(), key=lambda x: len(x[0])):
        schema = F.when((F.col(column) == root) | F.col(column).startswith(root + "/"), name).otherwise(schema)
    return paths.withColumn("default_schema", schema)


def operation_of(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in ("A", "added", "D", "removed", "M", "modified", "R", "relocated", "C", "relocated")])[F.substring(status, 1, 1)], F.lit("unknown"))


def _given(value: Column) -> Column:
    """Null for a mode or id of zeros: there is no file on that side."""
    return F.when(~value.rlike("^0*$"), value)


def file_rows(changed: DataFrame) -> DataFrame:
    """Changes (as of ``git.changes``) with operation, and modes and blobs null where there is no file."""
    given = {c: _given(F.col(o)) for c, o in (("old_mode", "old_mode"), ("new_mode", "new_mode"), ("old_blob", "old_oid"), ("new_blob", "new_oid"))}
    return changed.withColumns({"operation": operation_of(F.col("status"))} | given)


def commit_files(commits: DataFrame, changed: DataFrame, chain: DataFrame) -> DataFrame:
    """Commits (sha, parents, ...) with delta_kind, integration_role (by ``chain``, the first parents of the target) and files, in order.

    A commit that changes nothing has an empty list.  A commit's files are one array: a commit is the unit that is read.
    """
    entry = F.struct("position", "path_display", "path_b64", "operation", "old_mode", "new_mode", "old_blob", "new_blob")
    listed = file_rows(changed).groupBy("sha").agg(F.sort_array(F.collect_list(entry)).alias("files"))
    none = F.array().cast("array<" + "struct<position:int,path_display:string,path_b64:string,operation:string,old_mode:string,new_mode:string,old_blob:string,new_blob:string>>")
    rows = commits.join(listed, "sha", "left").join(chain.select("sha").distinct().withColumn("on_chain", F.lit(True)), "sha", "left")
    role = F.when(F.col("on_chain"), "target_first_parent_chain").otherwise("other_reachable")
    return rows.withColumns({"files": F.coalesce("files", none), "delta_kind": F.when(F.size("parents") > 0, "first_parent").otherwise("root"), "integration_role": role}).drop("on_chain")


def events(changed: DataFrame) -> DataFrame:
    """One row for each file that a commit of the range changed: event_id, commit_sha, parent_sha, path_b64, operation."""
    event = identity.stable_id("event", commit=F.col("sha"), path=F.col("path_b64"), position=F.col("position"), old_blob=F.col("old_oid"), new_blob=F.col("new_oid"))
    return changed.select(event.alias("event_id"), F.col("sha").alias("commit_sha"), F.col("parent").alias("parent_sha"), "path_b64", operation_of(F.col("status")).alias("operation"))


def artifacts(changed: DataFrame, net: DataFrame, inventories: DataFrame, incomplete: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Each path that the range touched, or that is incomplete, with its net change and what both snapshots' inventories say of it.

    ``net`` has path_b64, status, modes and oids; ``inventories`` of both sides has path_b64 and diagnostics (lists);
    ``incomplete`` path_b64, ``contexts`` the paths of files of statements that tables have taken.
    net_operation is ``unchanged`` where later commits undid earlier ones.
    """
    touched = changed.select("path_b64").union(incomplete.select("path_b64").join(inventories.select("path_b64"), "path_b64", "left_semi")).distinct()
    said = inventories.groupBy("path_b64").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("diagnostics")))).alias("diagnostics"))  # two inventories a path
    sides = file_rows(net).select("path_b64", "operation", "old_mode", "new_mode", "old_blob", "new_blob")
    rows = touched.join(sides, "path_b64", "left").join(said, "path_b64", "left")
    rows = rows.join(incomplete.select("path_b64").distinct().withColumn("is_incomplete", F.lit(True)), "path_b64", "left")
    taken = None if contexts is None else contexts.select("path_b64").distinct().withColumn("is_context", F.lit(True))
    rows = rows.withColumn("is_context", F.lit(False)) if taken is None else rows.join(taken, "path_b64", "left")
    status = F.when(F.col("is_incomplete"), "unresolved").when(F.col("diagnostics").isNotNull(), "parsed").otherwise("metadata_only")
    codes = F.coalesce("diagnostics", F.array().cast("array<string>"))
    # a file of statements that a table has taken is known for what it is
    codes = F.when(F.coalesce("is_context", F.lit(False)) & (status == "parsed"), F.array_remove(codes, "UNRESOLVED_PREFIX_OR_ARTIFACT")).otherwise(codes)
    return rows.select("path_b64", F.coalesce("operation", F.lit("unchanged")).alias("net_operation"), "old_mode", "new_mode", "old_blob", "new_blob", status.alias("parse_status"), codes.alias("diagnostic_codes"))
