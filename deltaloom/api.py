"""Entry points: inventory, plan, analyse and search over snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators import diff, scan
from deltaloom.plans import history
from deltaloom.plans.analysis import Analysis, analyse, definitions, document
from deltaloom.sources import git
from deltaloom.state import publish
from deltaloom.state.cache import checkpointed
from deltaloom.state.store import Store


def inventory(spark: SparkSession, repo: str, revision: str, scope: list[str] | None = None, default_schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files and definitions of one revision."""
    git.register(spark)
    files = git.snapshot(spark, repo, revision, scope)
    return scan.file_inventory(files), definitions(files, default_schema)


def plan(spark: SparkSession, repo: str, base: str, target: str, scope: list[str] | None = None, maximum: int = 250) -> tuple[str, DataFrame, DataFrame]:
    """Outcome (ANALYZE, NO_CHANGE, OUT_OF_SCOPE_ONLY, DIVERGED, BACKLOG_LIMIT), commits, and net file changes in scope."""
    git.register(spark)
    commits = git.commits(spark, repo, target, None)
    parents = commits.selectExpr("sha", "posexplode_outer(parents) AS (position, parent)")
    one = lambda sha: spark.createDataFrame([(sha,)], "sha string")
    found, outcome = history.commit_range(parents, one(base), one(target), maximum)
    net = diff.file_diff(git.tree(spark, repo, base), git.tree(spark, repo, target), ["path_display"], ["mode", "oid"])
    scoped = history.in_scope(net, scope or [], "path_display")
    if outcome == "ANALYZE" and not scoped.limit(1).count():
        outcome = "OUT_OF_SCOPE_ONLY" if net.limit(1).count() else "NO_CHANGE"
    return outcome, commits.join(found, "sha", "left_semi"), scoped


@dataclass
class RangeHistory:
    """What happened between two revisions: outcome, commits with their files, events in scope, and each path with its net change."""

    outcome: str
    commits: DataFrame
    events: DataFrame
    artifacts: DataFrame


def range_history(spark: SparkSession, repo: str, base: str, target: str, scope: list[str] | None = None, maximum: int = 250) -> RangeHistory:
    """The commits of a range with the files of each, as events, and joined to the inventories of both revisions."""
    outcome, commits, net = plan(spark, repo, base, target, scope, maximum)
    commits = checkpointed(commits)
    changed = checkpointed(git.changes(commits, repo))
    scoped = history.in_scope(changed, scope or [], "path_display")
    pointers = commits.select("sha", F.get("parents", F.lit(0)).alias("parent"))
    chain = history.first_parents(pointers, spark.createDataFrame([(target,)], "head string")).join(commits.select("sha"), "sha", "left_semi")
    net = net.select(F.base64(F.encode("path_display", "utf-8")).alias("path_b64"), "status", *[F.coalesce(c, F.lit("0")).alias(c) for c in ("old_mode", "new_mode", "old_oid", "new_oid")])
    touched = scoped.select("path_b64").distinct()
    sides = [scan.file_inventory(git.snapshot(spark, repo, r, scope, touched), ("path_b64",)) for r in (base, target)]
    inventories = checkpointed(sides[0].unionByName(sides[1]).select("path_b64", "parse_status", "diagnostics"))
    incomplete = inventories.where("parse_status <> 'parsed'")
    return RangeHistory(outcome, history.commit_files(commits, changed, chain), history.events(scoped), history.artifacts(scoped, net, inventories, incomplete))


def run(spark: SparkSession, repo: str, base: str, target: str, scope: list[str] | None = None, default_schema: str | None = None) -> Analysis:
    """Analyse two revisions.

    All files in scope are read: a table in a file that didn't change may be altered in one that did.
    """
    git.register(spark)
    old, new = (git.snapshot(spark, repo, r, scope) for r in (base, target))
    return analyse(old, new, default_schema)


def checkpointed_run(spark: SparkSession, store: Store, scope_hash: str, run_id: str, repo: str, target: str, root: str, **options) -> Analysis | None:
    """Analyse from the stored checkpoint to a target, publish the result below ``root``, and advance the checkpoint.

    Nothing where the target is the checkpoint.  Report, objects and facts are published as one version before the
    checkpoint moves; after a crash in between, the next run moves it first.
    """
    publish.recovered(spark, store, scope_hash, root)
    base = store.base(scope_hash)
    if base is None:
        store.initialise(scope_hash, target)
        return None
    if base == target:
        return None
    store.begin(run_id, scope_hash, target)
    try:
        result = run(spark, repo, base, target, **options)
        publish.published({"report": result.report, "objects": result.objects, "facts": result.facts}, root, run_id, run=run_id, target=target)
    except Exception:
        store.close(run_id, "blocked")
        raise
    publish.finalised(spark, store, scope_hash, root, run_id)
    return result


__all__ = ["inventory", "plan", "range_history", "run", "checkpointed_run", "analyse", "document"]
