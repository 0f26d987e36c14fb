"""Snapshots in a Git repository, end to end."""

import subprocess

import pytest

from deltaloom import api
from deltaloom.operators import graph, ranking, rollup, units, validate
from deltaloom.plans import history
from deltaloom.sources import files, git
from deltaloom.state import cache, publish
from deltaloom.state.store import Conflict, Store
from deltaloom.streaming import incremental


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")

    def run(*args):
        return subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q")
    shas = []

    def commit(**texts):
        for name, text in texts.items():
            target = path / "db" / f"{name}.sql"
            target.parent.mkdir(exist_ok=True)
            target.unlink() if text is None else target.write_text(text)
        run("add", "-A")
        run("commit", "-q", "-m", "c")
        shas.append(run("rev-parse", "HEAD"))

    commit(t="CREATE TABLE a.t (id NUMBER(5) NULL);\n", s="CREATE SEQUENCE a.s START WITH 1;\n", v="CREATE VIEW a.v AS SELECT id FROM a.t;\n")
    commit(t="CREATE TABLE a.t (id NUMBER(5) NOT NULL, n DATE);\n", s="CREATE SEQUENCE a.s START WITH 7;\n")
    commit(t="CREATE TABLE a.t (id NUMBER(5) NULL);\n", s=None)
    return str(path), shas


def test_analysis(spark, repo):
    path, (a, b, c) = repo
    got = api.run(spark, path, a, b, ["db"])
    facts = {(r.object_key, r.family, r.component, r.action) for r in got.facts.collect()}
    assert ("SCHEMA|A|TABLE|T", "table.column.nullable", "U:ID", "modified") in facts
    assert ("SCHEMA|A|TABLE|T", "table.column.data_type", "U:N", "added") in facts
    assert ("SCHEMA|A|SEQUENCE|S", "sequence.sequence_property.start_with", "", "modified") in facts
    assert not any(f[1] == "table.column.definition" and f[2] == "U:ID" for f in facts)
    report = {r.object_key: r for r in got.report.collect()}
    assert report["SCHEMA|A|TABLE|T"].level == "high" and report["SCHEMA|A|SEQUENCE|S"].pattern == "start_value_only"
    assert {r.status for r in got.files.collect()} == {"M"}
    assert api.document(spark, got, a, b).count() == 2
    assert {r.code for r in got.checks.collect()} == {"COLUMN_CONTRACT", "SEQUENCE_DEFINITION"}


def test_gates(spark):
    package = "CREATE PACKAGE a.p AS\n PROCEDURE run(x IN NUMBER);\nEND;\n"
    one, two = "CREATE TABLE a.t (id NUMBER);\n", "CREATE TABLE a.t (id DATE);\n"
    fine = "CREATE TABLE a.f (id NUMBER);\n"
    old = {"p": package, "z": one, "v": "CREATE VIEW a.v AS SELECT 'x' AS c FROM d;\nCREATE TABLE a.hid (id NUMBER);\n", "f": fine, "w": "CREATE TABLE a.w (id NUMBER);\n", "b": "CREATE TABLE a.b (id NUMBER);\n"}
    new = {"p": package.replace("AS\n", "AS\n-- " + "x" * 130_000 + "\n"), "z": one, "a": two, "v": old["v"].replace("'x'", "'x"), "f": fine.replace("NUMBER", "DATE"), "w": "CREATE TABLE a.w  ( id NUMBER );\n", "b": b"\xff" + old["b"].encode()}
    tables = [spark.createDataFrame([(k, bytearray(t if isinstance(t, bytes) else t.encode())) for k, t in side.items()], "path string, raw binary") for side in (old, new)]
    got = api.analyse(*tables)
    objects = {r.object_key: (r.operation, r.status, r.diagnostics) for r in got.objects.collect()}
    assert objects == {
        "SCHEMA|A|PACKAGE_SPEC|P": ("modified", "unresolved", ["PACKAGE_EXTRACTION_SIZE_LIMIT"]),
        "SCHEMA|A|TABLE|T": ("modified", "CONFLICTING_DEFINITIONS", ["CONFLICTING_DEFINITIONS"]),
        "SCHEMA|A|VIEW|V": ("modified", "unresolved", ["UNTERMINATED_SINGLE"]),
        "SCHEMA|A|TABLE|HID": ("unknown", "INCOMPLETE_SOURCE_INVENTORY", ["INCOMPLETE_SOURCE_INVENTORY"]),
        "SCHEMA|A|TABLE|B": ("unknown", "INCOMPLETE_SOURCE_INVENTORY", ["INCOMPLETE_SOURCE_INVENTORY"]),
        "SCHEMA|A|TABLE|F": ("modified", "ready", []),
        "SCHEMA|A|TABLE|W": ("modified", "ready", []),
    }
    facts = {(r.object_key[-1], r.family) for r in got.facts.collect()}
    assert ("F", "table.column.data_type") in facts and {f for k, f in facts if k == "W"} == {"common.source.format"} and {k for k, _ in facts} == {"F", "W"}
    assert {r.object_key[-1]: r.level for r in got.risk.collect()}["P"] == "unknown"


def test_history(spark, repo):
    path, (a, b, c) = repo
    outcome, commits, net = api.plan(spark, path, a, c, ["db"])
    assert outcome == "ANALYZE" and commits.count() == 2
    assert [(r.path_display, r.status) for r in net.collect()] == [("db/s.sql", "D")]  # t was changed and changed back
    assert api.plan(spark, path, a, c, ["other"])[0] == "OUT_OF_SCOPE_ONLY"
    assert api.plan(spark, path, a, a)[0] == "NO_CHANGE"
    assert api.plan(spark, path, c, a)[0] == "DIVERGED"
    assert api.plan(spark, path, a, c, None, 1)[0] == "BACKLOG_LIMIT"
    inventory, found = api.inventory(spark, path, b, ["db"])
    assert inventory.count() == 3 and {r.object_type for r in found.collect()} == {"TABLE", "SEQUENCE", "VIEW"}


def test_long_ranges(spark):
    """Histories of 400 commits with side branches, against a walk over the parents."""
    edges = {i: [i - 1] for i in range(1, 400)} | {0: []}
    edges |= {1000 + i: [1000 + i - 1] for i in range(1, 130)} | {1000: [5]}  # a side branch that is merged late
    edges[380] = [379, 1129]
    edges[2000] = [300]  # never merged
    parents = spark.createDataFrame([(f"c{k}", f"c{p}" if p is not None else None, i) for k, ps in edges.items() for i, p in enumerate(ps or [None])], "sha string, parent string, position int")
    one = lambda k: spark.createDataFrame([(f"c{k}",)], "sha string")

    def walked(k):
        seen, front = set(), [k]
        while front:
            if (x := front.pop()) not in seen:
                seen.add(x)
                front += edges[x]
        return seen

    for base, target, outcome in ((200, 350, "ANALYZE"), (20, 320, "BACKLOG_LIMIT"), (370, 385, "ANALYZE")):
        found, said = history.commit_range(parents if target < 385 else parents.drop("position"), one(base), one(target))
        assert said == outcome and {r.sha for r in found.collect()} == {f"c{k}" for k in walked(target) - walked(base)}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "sha string, parent string")
    assert {r.sha for r in history.ancestors(loop, loop.where("sha = 'b'").select("sha")).collect()} == {"a", "b", "c"}


def test_first_parents(spark):
    commits = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)] + [("x", "y"), ("y", "z"), ("z", "y"), ("b", "c40")]
    heads = spark.createDataFrame([("c69",), ("x",), ("b",)], "head string")
    got = sorted((r.sha, r.depth) for r in history.first_parents(spark.createDataFrame(commits, "sha string, parent string"), heads).collect())
    parent = dict(commits)
    want = []
    for at in ("c69", "x", "b"):
        seen = []
        while at and at not in seen:
            want.append((at, len(seen)))
            seen.append(at)
            at = parent[at]
    assert got == sorted(want)


def test_checkpoint(spark, repo, scratch):
    path, (a, b, c) = repo
    store = Store(f"{scratch}/state.db")
    root = f"file://{scratch}/published"
    assert api.checkpointed_run(spark, store, "s", "r0", path, a, root) is None
    made = api.checkpointed_run(spark, store, "s", "r1", path, b, root, scope=["db"])
    assert {r.object_key for r in publish.consumed(spark, root)["report"].collect()} == {r.object_key for r in made.report.collect()} != set()
    assert store.base("s") == b and api.checkpointed_run(spark, store, "s", "r2", path, b, root) is None
    store.begin("r3", "s", c)
    with pytest.raises(Conflict):
        store.begin("r4", "s", c)
    store.rebaseline("s", b, a)
    with pytest.raises(Conflict):
        store.advance("r3")
    store.close("r3", "abandoned")
    store.unit("r1", "u", "d", "in_flight")
    assert store.recover() == 1 and store.status("s")["open_units"] == 1


def test_raw_delta():
    raw = b":100644 100644 a b M\0x\ty\0:100644 100644 c d R090\0p\0q\0"
    assert [(r[4], r[5], r[6]) for r in git.raw_delta(raw)] == [("M", b"x\ty", None), ("R", b"p", b"q")]


def test_zip_and_sinks(spark, scratch):
    import zipfile

    with zipfile.ZipFile(f"{scratch}/a.zip", "w") as z:
        z.writestr("ok.sql", "CREATE TABLE t (a NUMBER);")
        z.writestr("../bad.sql", "x")
    got = {r.member: r for r in files.zip_members(spark, scratch).collect()}
    assert got["ok.sql"].problem is None and got["../bad.sql"].problem == "UNSAFE_PATH"
    df = spark.createDataFrame([(1,)], "a int")
    files.replaced(df, f"file://{scratch}/out")
    files.replaced(df.union(df), f"file://{scratch}/out")
    assert spark.read.json(f"file://{scratch}/out").count() == 2
    report = spark.createDataFrame([("2020", "01-02", "r", "b", "x_y", "d1", "{}")], "year string, day string, repo string, branch string, range_id string, digest string, content string")
    root = f"file://{scratch}/reports"
    files.archived_report(report, root)
    files.archived_report(report, root)
    assert spark.read.parquet(root).count() == 1
    with pytest.raises(ValueError):
        files.archived_report(report.withColumn("digest", __import__("pyspark").sql.functions.lit("d2")), root)
    assert files.found_report(spark, root, "01-02", "r", "b", "d1").count() == 1


def test_graph(spark):
    source = "CREATE PROCEDURE p AS BEGIN WITH c AS (SELECT 1 FROM dual) SELECT 1 INTO x FROM c JOIN s.t ON 1=1; INSERT INTO u VALUES ('FROM z'); q.run(1, b => f(2)); END;"
    rows = spark.createDataFrame([("k", "PROCEDURE", "OWN", "P", source)], "object_key string, object_type string, schema_name string, name string, source string")
    got = {(r.relation, r.ref_schema, r.ref_name) for r in graph.references(rows).collect()}
    assert got == {("READ", "S", "T"), ("WRITE", "OWN", "U"), ("READ", "OWN", "DUAL")}
    called = {(r.ref_schema, r.ref_name, r.routine): (r.positional, r.named, r.ordered) for r in graph.calls(rows).where("NOT local").collect()}
    assert called == {("OWN", "Q", "RUN"): (1, ["B"], True)}
    args = spark.createDataFrame([("1, b => f(2, ')')",), ("",), ("a => 1, 2",), ("f(",)], "t string").select(graph.split_arguments(__import__("pyspark").sql.functions.col("t")).alias("a"))
    assert [r.a and (r.a.positional, r.a.named, r.a.ordered) for r in args.collect()] == [(1, ["B"], True), (0, [], True), (1, ["A"], False), None]


def objects_of(spark, *rows):
    made = [(f"SCHEMA|APP|{kind}|{name}", kind, "APP", name, text) for kind, name, text in rows]
    return spark.createDataFrame(made, "object_key string, object_type string, schema_name string, name string, source string")


def test_relations(spark):
    rows = objects_of(
        spark,
        ("TABLE", "T", "CREATE TABLE t (id NUMBER, CONSTRAINT f FOREIGN KEY (id) REFERENCES other.u (id))"),
        ("TRIGGER", "G", "CREATE TRIGGER g BEFORE INSERT ON t BEGIN :new.id := s.nextval; END;"),
        ("SYNONYM", "Y", "CREATE SYNONYM y FOR x.t"),
        ("PROCEDURE", "P", "CREATE PROCEDURE p (a t.id%TYPE) IS BEGIN DELETE FROM t; MERGE INTO t USING v ON (1=1) WHEN MATCHED THEN UPDATE SET a = 1; END;"),
        ("VIEW", "V", "CREATE VIEW v AS WITH fake AS (SELECT 'from SECRET' x FROM t) SELECT * FROM fake JOIN \"Mixed\" m ON 1 = 1"),
        ("VIEW", "BROKEN", "CREATE VIEW broken AS SELECT 'x FROM t"),
    )
    got = {(r.from_object.split("|")[3], r.relation, r.to_label, r.resolution) for r in graph.edges(rows).where("relation <> 'CALL'").collect()}
    t = "SCHEMA|APP|TABLE|T"
    assert got == {
        ("T", "FK_REF", "OTHER.U", "unresolved"),
        ("G", "TRIGGER_ON", t, "resolved_static"),
        ("G", "READ", "APP.S", "unresolved"),
        ("Y", "SYNONYM_TO", t, "candidate"),
        ("P", "TYPE_REF", "T.ID", "unresolved"),
        ("P", "READ", t, "resolved_static"),
        ("P", "WRITE", t, "resolved_static"),
        ("P", "WRITE", "APP.SET", "unresolved"),
        ("V", "READ", t, "resolved_static"),
        ("V", "READ", "APP.Mixed", "unresolved"),
    }


def test_calls(spark):
    spec = ("PACKAGE_SPEC", "P", "CREATE PACKAGE P AS PROCEDURE RUN(P_ID NUMBER, P_LABEL VARCHAR2 DEFAULT 'x'); PROCEDURE TWICE(A NUMBER); PROCEDURE TWICE(B DATE); PROCEDURE bare; END P;")
    body = ("PACKAGE_BODY", "P", "CREATE PACKAGE BODY P AS PROCEDURE bare IS BEGIN helper; other.go; END; END P;")
    alone = ("PROCEDURE", "JOB", "CREATE PROCEDURE job IS BEGIN NULL; END;")
    caller = ("PROCEDURE", "CALLER", "CREATE PROCEDURE CALLER IS BEGIN APP.P.RUN(P_ID => 1); P.RUN(1, 2, 3); p.twice(1); p.bare; app.job; job; DBMS_OUTPUT.PUT_LINE('ignored'); p.run(f(1, 2), 'x'); END;")
    got = {(r.from_object.split("|")[3], r.to_label, r.resolution, r.reason.replace("call candidate; binding=", "")) for r in graph.edges(objects_of(spark, spec, body, alone, caller)).where("relation = 'CALL'").collect()}
    both = "SCHEMA|APP|PACKAGE_BODY|P,SCHEMA|APP|PACKAGE_SPEC|P"
    one = "SCHEMA|APP|PROCEDURE|JOB"
    fits = "arity_name_compatible_type_unresolved"
    assert {
        ("CALLER", both, "candidate", f"qualified package/routine {fits}"),
        ("CALLER", both, "candidate", "qualified package/routine incompatible_arity_or_names"),
        ("CALLER", both, "candidate", "qualified package/routine overload_candidate"),
        ("CALLER", both, "candidate", "qualified package/routine arguments_unparsed"),
        ("CALLER", one, "resolved_static", f"standalone routine {fits}"),
        ("CALLER", one, "resolved_static", f"local routine {fits}"),
        ("CALLER", "APP.DBMS_OUTPUT", "unresolved", "qualified package/routine definition_unresolved"),
        ("P", both, "candidate", "local routine definition_unresolved"),
        ("P", "APP.OTHER", "unresolved", "qualified package/routine definition_unresolved"),
    } <= got
    pairs = graph.edges(objects_of(spark, spec, body)).where("relation = 'SPEC_BODY'").collect()
    assert len(pairs) == 2 and {r.resolution for r in pairs} == {"resolved_static"}


def test_planes(spark):
    t = ("TABLE", "T", "CREATE TABLE t (id NUMBER)")
    old = graph.edges(objects_of(spark, t, ("VIEW", "GONE", "CREATE VIEW gone AS SELECT * FROM t"), ("VIEW", "STAYS", "CREATE VIEW stays AS SELECT * FROM t")))
    new = graph.edges(objects_of(spark, t, ("VIEW", "STAYS", "CREATE VIEW stays AS SELECT * FROM t"), ("VIEW", "W", "CREATE VIEW w AS SELECT * FROM stays")))
    changed = spark.createDataFrame([("SCHEMA|APP|TABLE|T",)], "object_key string")
    planes = graph.context_planes(old, new, changed)
    assert {(r.side, r.from_object.split("|")[3]) for r in planes.collect()} == {("old_reverse", "GONE"), ("old_reverse", "STAYS"), ("new_reverse", "STAYS")}
    assert {r.from_object.split("|")[3] for r in graph.neighbours(new, changed, 2, True).collect()} == {"STAYS", "W"}
    chosen = graph.selected_context(planes, 1)
    assert {(r.side, r.omitted) for r in chosen.collect()} == {("old_reverse", 1), ("new_reverse", 0)}
    evidence = spark.createDataFrame([("SCHEMA|APP|VIEW|STAYS", "e1"), ("SCHEMA|APP|VIEW|GONE", "e2")], "related string, evidence_id string")
    assert {r.evidence_id for r in graph.context_evidence(planes, evidence, evidence).collect()} == {"e1", "e2"}


def test_cache_and_journal(spark, scratch):
    inputs = spark.createDataFrame([("a",), ("b",), ("a",)], "oid string")
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.withColumn("n", __import__("pyspark").sql.functions.length("oid"))

    for _ in range(2):
        assert cache.through_cache(spark, f"file://{scratch}/cache", inputs, compute, "oid", "v1").count() == 2
    assert seen == [2, 0]
    journal = cache.chained(spark.createDataFrame([("s", i, f"c{i}") for i in range(4)], "scope string, sequence int, content string"), "scope", "sequence", "content")
    assert cache.journal_breaks(journal, "scope", "sequence", "content").count() == 0
    assert cache.journal_breaks(journal.where("sequence <> 2"), "scope", "sequence", "content").count() > 0


def test_reviews_and_rules(spark):
    facts = spark.createDataFrame([("f1", "k", "fam", "c", "modified", "1", "password=abcdef", ["e1"], "verified")], "fact_id string, object_key string, family string, component string, action string, before string, after string, evidence_ids array<string>, verification string")
    evidence = spark.createDataFrame([("k", "e1"), ("k", "e2")], "object_key string, evidence_id string")
    unit = units.unit_inputs(facts, evidence).first()
    assert unit.facts[0].after == "(redacted)" and unit.evidence == ["e1"] and len(unit.digest) == 64
    comments = spark.createDataFrame([("f1", "fam c modified from 1 to password=abcdef"), ("f1", "else")], "fact_id string, comment string")
    assert units.provable(comments, facts).count() == 1
    responses = spark.createDataFrame([("u", "d", ["x"]), ("w", "d", [])], "unit_id string, digest string, evidence_ids array<string>")
    known = spark.createDataFrame([("u", "d", ["e"])], "unit_id string, digest string, evidence_ids array<string>")
    assert {(r.rule, r.subject) for r in validate.response_violations(known, responses).collect()} == {("V7_UNIT", "w"), ("V7_EVIDENCE", "u")}
    levels = spark.createDataFrame([("low", "TABLE")], "level string, object_type string")
    assert rollup.overall_risk(levels, __import__("pyspark").sql.functions.lit(3)).first().level == "medium"
    rows = spark.createDataFrame([(i, i % 2 == 0) for i in range(6)], "i int, limited boolean")
    assert [r.i for r in ranking.slots(rows, rows.limited, "i", 4).collect()] == [0, 1, 2, 4]


def test_stream(spark, scratch):
    source = f"{scratch}/in"
    rows = lambda i: spark.createDataFrame([(f"f{i}", bytearray(b"CREATE TABLE t (a NUMBER);"))], "path string, raw binary")
    rows(1).write.parquet(source)
    for i in (1, 2):
        incremental.scanned_stream(spark, source, f"{scratch}/out", f"{scratch}/check")
        assert spark.read.parquet(f"{scratch}/out").count() == i
        rows(i + 1).write.mode("append").parquet(source)
