import base64
import os
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltaloom import api
from deltaloom.functions import identity
from deltaloom.operators import ranking
from deltaloom.sources import git


def run(path, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, env=env).stdout.decode().strip()


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Root, change, side branch with a merge, a change that is undone, an empty commit, and odd paths."""
    path = str(tmp_path_factory.mktemp("spark-repo"))
    shas = {}

    def commit(name, **files):
        for file, text in files.items():
            at = os.path.join(path, {"odd": "db/odd é\t.sql"}.get(file, f"db/{file}.sql"))
            if text is None:
                os.remove(at)
                continue
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w") as out:
                out.write(text)
        run(path, "add", "-A")
        run(path, "commit", "-q", "--allow-empty", "-m", name)
        shas[name] = run(path, "rev-parse", "HEAD")

    run(path, "init", "-q", "-b", "main")
    commit("root", a="CREATE TABLE a (x NUMBER);\n", b="CREATE TABLE b (x NUMBER);\n")
    commit("edit", a="CREATE TABLE a (x DATE);\n", odd="CREATE TABLE c (x NUMBER);\n")
    run(path, "checkout", "-q", "-b", "side")
    commit("side", b="CREATE TABLE b (x NUMBER, y DATE);\n")
    run(path, "checkout", "-q", "main")
    commit("undo", a="CREATE TABLE a (x NUMBER);\n")
    run(path, "merge", "-q", "--no-ff", "-m", "merge", "side")
    shas["merge"] = run(path, "rev-parse", "HEAD")
    commit("empty")
    commit("last", odd=None, n="stray\nCREATE SEQUENCE n;\n")
    return path, shas


def test_changes_are_those_of_git(spark, repo):
    path, shas = repo
    git.register(spark)
    got = {}
    for r in git.changes(git.commits(spark, path, shas["last"], None), path, 2).orderBy("sha", "position").collect():
        got.setdefault(r.sha, []).append((r.position, r.status, base64.b64decode(r.path_b64).decode(), r.old_oid, r.new_oid))
    for name, sha in shas.items():
        parent = run(path, "rev-list", "--parents", "-n1", sha).split()[1:2]
        raw = subprocess.run(["git", "-C", path, "diff-tree", "--raw", "-r", "-z", "--full-index", "--no-renames", "--root", "--no-commit-id", *parent, sha], check=True, capture_output=True).stdout
        want = [(k, r[4], r[5].decode(), r[2], r[3]) for k, r in enumerate(git.raw_delta(raw))]
        assert got.get(sha, []) == want, name
    assert [x[2] for x in got[shas["merge"]]] == ["db/b.sql"] and shas["empty"] not in got
    with pytest.raises(Exception, match="not compared|diff-tree"):
        git.changes(spark.createDataFrame([("0" * 39 + "1", [])], "sha string, parents array<string>"), path).collect()


def test_range_history(spark, repo):
    path, shas = repo
    got = api.range_history(spark, path, shas["root"], shas["last"], ["db"])
    commits = {r.sha: r for r in got.commits.collect()}
    assert got.outcome == "ANALYZE" and set(commits) == {shas[n] for n in ("edit", "side", "undo", "merge", "empty", "last")}
    files = lambda n: [(f.path_display, f.operation) for f in commits[shas[n]].files]
    assert files("edit") == [("db/a.sql", "modified"), ("db/odd é\t.sql", "added")] and files("empty") == [] and files("merge") == [("db/b.sql", "modified")]
    assert commits[shas["edit"]].files[1].old_blob is None and commits[shas["edit"]].files[1].old_mode is None
    assert {n for n in ("edit", "side", "undo", "merge", "empty", "last") if commits[shas[n]].integration_role == "other_reachable"} == {"side"}
    events = got.events.collect()
    assert len(events) == len({e.event_id for e in events}) == 7 and all(e.parent_sha for e in events)
    shown = {base64.b64decode(r.path_b64).decode(): (r.net_operation, r.parse_status, r.diagnostic_codes) for r in got.artifacts.collect()}
    assert shown == {
        "db/a.sql": ("unchanged", "parsed", []), "db/b.sql": ("modified", "parsed", []),
        "db/odd é\t.sql": ("unchanged", "metadata_only", []), "db/n.sql": ("added", "unresolved", ["UNRESOLVED_PREFIX_OR_ARTIFACT"]),
    }


integers = st.integers(-(10**60), 10**60) | st.integers(-(10**17) - 2, 10**17 + 2) | st.integers(-3, 3)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(integers, integers, st.booleans()), min_size=40, max_size=120))
def test_signed_difference(spark, pairs):
    text = lambda n, odd: ("+" if odd and n >= 0 else "") + (str(n) if not odd else str(n).replace("-", "-00") if n < 0 else "00" + str(n))
    rows = [(k, text(b, odd), text(a, odd), f"{a - b:+d}") for k, (b, a, odd) in enumerate(pairs)]
    rows += [(-1, "5", "5", "+0"), (-2, "-0", "0", "+0"), (-3, "9" * 40, "1" + "0" * 40, "+1"), (-4, "1" + "0" * 34, "0", "-1" + "0" * 34), (-5, "x", "1", None), (-6, None, "1", None), (-7, "1.5", "2", None), (-8, "", "2", None)]
    got = spark.createDataFrame(rows, "k int, b string, a string, want string").withColumn("got", identity.signed_difference(F.col("b"), F.col("a"))).collect()
    assert [r for r in got if r.got != r.want] == []


def test_budgets_and_profiles(spark):
    rows = spark.createDataFrame([(i % 3, i, i % 4 == 0, (i * 37) % 50) for i in range(40)], "g int, i int, first boolean, size int")
    got = ranking.detail_budget(rows, F.col("first"), [F.desc("i")], [F.col("i")], 6).orderBy("shown").collect()
    assert [r.i for r in got] == [36, 32, 28, 24, 20, 16] and [r.shown for r in got] == [1, 2, 3, 4, 5, 6]
    few = ranking.detail_budget(rows.where("i < 9"), F.col("first"), [F.col("i")], [F.desc("i")], 6).orderBy("shown").collect()
    assert [r.i for r in few] == [0, 4, 8, 7, 6, 5]
    assert ranking.detail_budget(rows.where("false"), F.col("first"), [F.col("i")], [F.col("i")], 6).count() == 0
    profiles = [("all", {"size": 40}), ("some", {"size": 3}), ("none", {})]
    data = {g: [r.size for r in sorted(rows.collect(), key=lambda r: r.i) if r.g == g] for g in range(3)}
    for fixed, limit in ((10, 10_000), (10, 100), (10, 20), (30, 20)):
        want = {}
        for g, sizes in data.items():
            fits = [(n, fixed + sum(sizes[: t.get("size", 0)])) for n, t in profiles]
            want[g] = next((x for x in fits if x[1] <= limit), (None, None))
        assert {r.g: (r.profile, r.bytes) for r in ranking.size_profile(rows, ["g"], [F.col("i")], profiles, fixed, limit).collect()} == want


def test_signed_difference_at_the_length_of_decimals(spark):
    """The same results on both sides of the 37 digits that are subtracted as decimals, with any white space around."""
    rows = [("\t1", "2", "+1"), ("2", " 1\n", "-1"), ("-0", "000", "+0"), ("x", "1", None), (None, "1", None)]
    for n in (36, 37, 38, 39):
        for b, a in (("9" * n, "-" + "9" * n), ("-" + "9" * n, "+" + "9" * n), ("0" * 40 + "9" * n, "1" * n), ("1", "1" + "0" * (n - 1))):
            rows.append((b, a, f"{int(a) - int(b):+d}"))
    got = spark.createDataFrame(rows, "b string, a string, want string").withColumn("got", identity.signed_difference(F.col("b"), F.col("a"))).collect()
    assert [x.got for x in got] == [x.want for x in got]
