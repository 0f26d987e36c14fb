import pytest

from deltaloom.extract import replay, statements
from deltaloom.extract.tokens import code_tokens
from deltaloom.operators import scan
from deltaloom.plans.analysis import analyse


def replayed(spark, **ddl):
    d = spark.createDataFrame(list(ddl.items()), "definition string, fragment string")
    return replay.replayed(d, code_tokens(d))


def columns_of(r, *names):
    out = {}
    for x in r.columns.collect():
        out.setdefault(x.definition, {})[x.component] = tuple(x[n] for n in names)
    return out


def codes_of(r):
    out = {}
    for x in r.diagnostics.collect():
        out.setdefault(x.definition, set()).add((x.code, x.component))
    return out


def test_replay(spark):
    r = replayed(
        spark,
        plain="CREATE TABLE t (a NUMBER, b DATE);",
        add="CREATE TABLE s.t (a NUMBER, b DATE); ALTER TABLE s.t ADD (c VARCHAR2(5 CHAR) DEFAULT 'x, y' NOT NULL, CONSTRAINT k CHECK (c > f(1, 2))); ALTER TABLE s.t ADD d DATE; ALTER TABLE t ADD e DATE; ALTER TABLE s.other ADD z DATE;",
        modify="CREATE TABLE t (a NUMBER(5) NOT NULL, b NUMBER, c DATE DEFAULT SYSDATE); ALTER TABLE t MODIFY a NULL; ALTER TABLE t MODIFY (b VARCHAR2(9), c NOT NULL); ALTER TABLE t MODIFY c DEFAULT ON NULL f(1,  2); ALTER TABLE t MODIFY a NUMBER(7);",
        drop='CREATE TABLE t (a NUMBER, "b" DATE, c DATE, d DATE, e DATE, CONSTRAINT k UNIQUE (d)); ALTER TABLE t DROP COLUMN a; ALTER TABLE t DROP ("b", c); ALTER TABLE t DROP (d, e); COMMENT ON COLUMN t.e IS \'said\'; ALTER TABLE t DROP COLUMN E;',
        refused="CREATE TABLE t (a NUMBER, b DATE, CONSTRAINT k UNIQUE (b)); ALTER TABLE t DROP (a, b); ALTER TABLE t DROP (a, a); ALTER TABLE t DROP (a, zz); ALTER TABLE t DROP COLUMN zz; ALTER TABLE t DROP CONSTRAINT nope; ALTER TABLE t DROP UNUSED COLUMNS;",
        freed="CREATE TABLE t (a NUMBER, b DATE, CONSTRAINT k UNIQUE (b)); ALTER TABLE t DROP CONSTRAINT k; ALTER TABLE t DROP (a, b); ALTER TABLE t ADD a DATE;",
        partial="CREATE TABLE t (a NUMBER, b NUMBER); ALTER TABLE t MODIFY (a DEFAULT 1 NOT NULL, b NOT NULL); ALTER TABLE t ADD c; ALTER TABLE t MODIFY zz NULL; ALTER TABLE t ADD a DATE;",
        comments="CREATE TABLE t (a NUMBER); COMMENT ON TABLE t IS 'x;''y'; COMMENT ON COLUMN t.a IS 'one'; COMMENT ON COLUMN t.a IS 'two'; COMMENT ON COLUMN t.gone IS 'g'; COMMENT ON COLUMN t.gone IS ''; COMMENT ON TABLE u IS 'no'; COMMENT ON COLUMN t.a;",
        properties="CREATE TABLE t (a NUMBER) LOGGING TABLESPACE u; ALTER TABLE t NOLOGGING; ALTER TABLE t PARALLEL 8; ALTER TABLE t PARALLEL (DEGREE 2); ALTER TABLE t ENABLE ROW MOVEMENT; GRANT SELECT ON t TO x; ALTER TABLE t ADD PRIMARY KEY (a); ALTER TABLE t MODIFY CONSTRAINT k DISABLE; ALTER TABLE t ADD (a2 DATE,,b2 DATE);",
    )
    got = columns_of(r, "position", "data_type", "nullable", "default")
    assert got["plain"] == {"U:A": ("1", "NUMBER", None, None), "U:B": ("2", "DATE", None, None)}
    assert got["add"] == {"U:A": ("1", "NUMBER", None, None), "U:B": ("2", "DATE", None, None), "U:C": ("3", "VARCHAR2(5 CHAR)", "NOT NULL", "'x, y'"), "U:D": ("4", "DATE", None, None), "U:E": ("5", "DATE", None, None)}
    assert got["modify"] == {"U:A": ("1", "NUMBER(7)", "NULL", None), "U:B": ("2", "VARCHAR2(9)", None, None), "U:C": ("3", "DATE", "NOT NULL", "f(1,  2)")}
    assert got["drop"] == {"U:D": ("4", "DATE", None, None)}
    assert set(got["refused"]) == {"U:A", "U:B"} and got["freed"] == {"U:A": ("1", "DATE", None, None)}
    assert got["partial"] == {"U:A": ("1", "NUMBER", None, None), "U:B": ("2", "NUMBER", "NOT NULL", None)}
    assert set(got["properties"]) == {"U:A", "U:A2", "U:B2"}
    assert {x.default_on_null for x in r.columns.where("definition = 'modify' AND component = 'U:C'").collect()} == {"DEFAULT ON NULL"}
    constraints = {(x.definition, x.component): (x.kind, x.condition) for x in r.constraints.collect()}
    assert constraints == {("add", "U:K"): ("CHECK", "c > f(1, 2)"), ("drop", "U:K"): ("UNIQUE", None), ("refused", "U:K"): ("UNIQUE", None)}
    assert {(x.definition, x.component, x.value) for x in r.comments.collect()} == {("comments", "TABLE", "'x;''y'"), ("comments", "U:A", "'two'")}
    assert {(x.property, x.value) for x in r.properties.where("definition = 'properties'").collect()} == {("logging", "NOLOGGING"), ("parallel", "PARALLEL 8"), ("tablespace", "u")}
    assert codes_of(r) == {
        "drop": {("ALTER_TABLE_DROP_UNSUPPORTED", None)},
        "refused": {("ALTER_TABLE_DROP_UNSUPPORTED", None)},
        "partial": {("ALTER_COLUMN_PARTIAL_UNRESOLVED", "U:A"), ("ALTER_COLUMN_PARTIAL_UNRESOLVED", "U:C"), ("ALTER_COLUMN_NOT_IN_CREATE", None), ("DUPLICATE_COLUMN", None)},
        "comments": {("COMMENT_UNRESOLVED", None)},
        "properties": {("ALTER_TABLE_UNSUPPORTED", None), ("TABLE_CONTEXT_UNSUPPORTED", None), ("UNNAMED_CONSTRAINT_UNRESOLVED", None), ("ALTER_CONSTRAINT_MODIFY_UNSUPPORTED", None), ("ALTER_TABLE_ITEMS_UNRESOLVED", None)},
    }


def test_create_diagnostics(spark):
    r = replayed(
        spark, twice="CREATE TABLE t (x NUMBER, x VARCHAR2(3), CONSTRAINT k UNIQUE (x), CONSTRAINT k CHECK (x > 1));", bare="CREATE TABLE t (x NUMBER, y);", gap="CREATE TABLE t (x NUMBER,, y DATE);", end="CREATE TABLE t (x NUMBER,);",
        empty="CREATE TABLE t ();", open="CREATE TABLE t (x NUMBER;", none="CREATE TABLE t;", unnamed="CREATE TABLE t (x NUMBER, PRIMARY KEY (x));", fine="CREATE TABLE t (x NUMBER(5,2), CONSTRAINT k UNIQUE (x));",
    )
    assert {d: {c for c, _ in codes} for d, codes in codes_of(r).items()} == {
        "twice": {"DUPLICATE_COLUMN", "DUPLICATE_CONSTRAINT"}, "bare": {"COLUMN_UNRESOLVED"}, "gap": {"EMPTY_TABLE_ITEM"}, "end": {"EMPTY_TABLE_ITEM"}, "empty": {"EMPTY_TABLE_ITEM"},
        "open": {"TABLE_BODY_UNBALANCED"}, "none": {"TABLE_DEFINITION_UNRESOLVED"}, "unnamed": {"UNNAMED_CONSTRAINT_UNRESOLVED"},
    }
    none = spark.createDataFrame([], "definition string, fragment string")
    assert replay.replayed(none, code_tokens(none)).columns.count() == 0


def test_files_of_statements(spark):
    files = {
        "one": "ALTER TABLE a.t ADD x DATE; COMMENT ON COLUMN a.t.x IS 'y';", "default": "-- note\nALTER TABLE t NOLOGGING;\n/\n", "other": "ALTER TABLE a.t ADD x DATE; GRANT x TO y;",
        "deep": "ALTER TABLE a.b.c ADD x DATE;", "none": "ALTER TABLE a.t;", "empty": " ", "quoted": 'ALTER TABLE "A"."t" ADD x DATE;',
    }
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {(r.path, r.n): (r.table_parts, r.text) for r in replay.context_statements(df, "a").collect()}
    assert got == {
        ("one", 0): (["U:A", "U:T"], "ALTER TABLE a.t ADD x DATE"), ("one", 1): (["U:A", "U:T"], "COMMENT ON COLUMN a.t.x IS 'y'"),
        ("default", 0): (["U:A", "U:T"], "ALTER TABLE t NOLOGGING"), ("quoted", 0): (["Q:A", "Q:t"], 'ALTER TABLE "A"."t" ADD x DATE'),
    }
    assert {r.path for r in replay.context_statements(df).collect()} == {"one", "quoted"}


def greedy(files, tables_, most):
    taken, out = {}, {}
    known = {}
    for d, p in tables_:
        known.setdefault(p, []).append(d)
    for path in sorted(files):
        names = files[path]
        found = [known.get(p, []) for p in names]
        if any(not f for f in found) or any(len(f) > 1 for f in found):
            out[path] = "UNKNOWN_TABLE" if any(not f for f in found) else "AMBIGUOUS_TABLE"
            continue
        need = {}
        for f in found:
            need[f[0]] = need.get(f[0], 0) + 1
        if any(taken.get(d, 0) + c > most for d, c in need.items()):
            out[path] = "TOO_MANY_STATEMENTS"
            continue
        for d, c in need.items():
            taken[d] = taken.get(d, 0) + c
        out[path] = None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_files_are_taken_whole_and_in_order(spark, seed):
    import random

    r = random.Random(seed)
    tables_ = [(f"d{i}", f"U:T{i}") for i in range(6)] + [("d6", "U:T6"), ("d6b", "U:T6")]
    files = {f"f{i:03}": [f"U:T{r.choice([0, 0, 0, 1, 1, 2, 3, 4, 5, 5, 6, 9] if r.random() < 0.3 else [0, 0, 1, 2, 3])}" for _ in range(r.choice([1, 1, 2, 3, 5, 9]))] for i in range(60)}
    said = spark.createDataFrame([(p, n, ["U:A", t]) for p, ts in files.items() for n, t in enumerate(ts)], "path string, n int, table_parts array<string>")
    found = spark.createDataFrame([(d, ["U:A", p]) for d, p in tables_], "definition string, table_parts array<string>")
    got = replay.attached(said, found, 12).collect()
    want = greedy(files, tables_, 12)
    assert {r.path: r.reason for r in got if r.reason not in ("UNKNOWN_TABLE", "AMBIGUOUS_TABLE")} == {p: x for p, x in want.items() if x in (None, "TOO_MANY_STATEMENTS")}
    assert {r.path for r in got if r.reason in ("UNKNOWN_TABLE", "AMBIGUOUS_TABLE")} == {p for p, x in want.items() if x in ("UNKNOWN_TABLE", "AMBIGUOUS_TABLE")}
    assert len(got) == sum(map(len, files.values())) and "TOO_MANY_STATEMENTS" in want.values()


def sides(spark, old, new):
    return [spark.createDataFrame([(p, bytearray(t.encode())) for p, t in side.items()], "path string, raw binary") for side in (old, new)]


def facts_of(got, key):
    return {(r.family, r.component, r.action, r.before, r.after) for r in got.facts.where(f"object_key = '{key}'").collect() if not r.family.endswith("column.definition")}


def test_analysis_of_statements_and_diagnostics(spark):
    """What a report said wrongly before: statements in other files and behind CREATE, doubts, and definitions that change places."""
    t = lambda n, body="x NUMBER": f"CREATE TABLE a.{n} ({body});\n"
    routine = "CREATE PACKAGE BODY a.pk AS PROCEDURE o IS PROCEDURE i IS BEGIN NULL; END; BEGIN NULL; END; END;\n"
    old = {
        "other.sql": t("other"), "same.sql": t("same"), "twice.sql": t("twice"), "order.sql": t("one") + t("two"), "nested.sql": routine, "partial.sql": t("partial", "x NUMBER, y NUMBER"), "big.sql": t("big"),
        "old_context.sql": "ALTER TABLE a.gone ADD z DATE;", "gone.sql": t("gone"), "drop.sql": t("refused", "x NUMBER, y DATE, CONSTRAINT k UNIQUE (y)"),
    }
    new = old | {
        "other_add.sql": "ALTER TABLE a.other ADD (c NUMBER NOT NULL);\nCOMMENT ON COLUMN a.other.c IS 'said';\n",
        "same.sql": t("same") + "ALTER TABLE a.same ADD c DATE;\nCOMMENT ON TABLE a.same IS 'y';\n",
        "twice.sql": t("twice", "x NUMBER, x VARCHAR2(3)"), "order.sql": t("two") + t("one"), "nested.sql": routine.replace("i IS BEGIN NULL;", "i IS BEGIN DELETE FROM q;"),
        "partial.sql": t("partial", "x NUMBER, y DATE") + "ALTER TABLE a.partial MODIFY (x DEFAULT 1 NOT NULL);\n", "big.sql": t("big", "x NUMBER -- " + "y" * 3000 + "\n"),
        "many.sql": "ALTER TABLE a.big NOLOGGING;" * 13, "lost.sql": "ALTER TABLE a.nowhere ADD c DATE;", "drop.sql": old["drop.sql"] + "ALTER TABLE a.refused DROP (x, y);\n",
    }
    del new["old_context.sql"]
    got = analyse(*sides(spark, old, new), most_bytes=2000)
    objects = {r.object_key.rpartition("|")[2]: (r.operation, r.status, tuple(r.diagnostics)) for r in got.objects.collect()}
    assert objects == {
        "OTHER": ("modified", "ready", ()), "SAME": ("modified", "ready", ()), "GONE": ("modified", "ready", ()), "ONE": ("modified", "ready", ()), "TWO": ("modified", "ready", ()),
        "TWICE": ("modified", "unresolved", ("DUPLICATE_COLUMN",)), "PK": ("modified", "unresolved", ("NESTED_ROUTINE_LIMITED",)), "PARTIAL": ("modified", "unresolved", ("ALTER_COLUMN_PARTIAL_UNRESOLVED",)),
        "BIG": ("modified", "MANDATORY_CONTEXT_EXCEEDS_BUDGET", ("MANDATORY_CONTEXT_EXCEEDS_BUDGET",)), "REFUSED": ("modified", "unresolved", ("ALTER_TABLE_DROP_UNSUPPORTED",)),
    }
    other = facts_of(got, "SCHEMA|A|TABLE|OTHER")
    assert {("table.column.data_type", "U:C", "added", None, "NUMBER"), ("table.column.nullable", "U:C", "added", None, "NOT NULL"), ("table.comment.text", "U:C", "added", None, "'said'")} <= other
    assert {("table.column.data_type", "U:C", "added", None, "DATE"), ("table.comment.text", "TABLE", "added", None, "'y'")} <= facts_of(got, "SCHEMA|A|TABLE|SAME")
    assert ("table.column.data_type", "U:Z", "removed", "DATE", None) in facts_of(got, "SCHEMA|A|TABLE|GONE")
    assert facts_of(got, "SCHEMA|A|TABLE|ONE") == {("common.source.occurrence_order", "", "modified", "1", "2")}
    assert facts_of(got, "SCHEMA|A|TABLE|TWO") == {("common.source.occurrence_order", "", "modified", "2", "1")}
    partial = facts_of(got, "SCHEMA|A|TABLE|PARTIAL")
    assert ("table.column.data_type", "U:Y", "modified", "NUMBER", "DATE") in partial and not any(f[1] == "U:X" for f in partial)
    assert not any(facts_of(got, k) for k in ("SCHEMA|A|TABLE|TWICE", "SCHEMA|A|PACKAGE_BODY|PK", "SCHEMA|A|TABLE|BIG", "SCHEMA|A|TABLE|REFUSED"))
    assert {(r.side, r.path, r.reason) for r in got.contexts.collect()} == {
        ("before", "old_context.sql", None), ("after", "other_add.sql", None), ("after", "many.sql", "TOO_MANY_STATEMENTS"), ("after", "lost.sql", "UNKNOWN_TABLE")
    }
    assert got.report.count() == len(objects)


def test_statements_of_files_are_cut_without_a_shuffle(spark):
    text = "-- é\nALTER TABLE a.t ADD (x NUMBER CHECK (x > (1; 2)), y DATE);;\n/\nCOMMENT ON TABLE a.t IS ';'"
    said = replay.context_statements(spark.createDataFrame([("f", text), ("g", ";;"), ("h", "ALTER TABLE a.t ADD (x DATE; ALTER TABLE a.t ADD y DATE;")], "path string, text string"))
    assert "Exchange" not in said._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.path, r.n, r.text, text[r.start : r.end] == r.text) for r in said.collect())
    assert got == [
        ("f", 0, "ALTER TABLE a.t ADD (x NUMBER CHECK (x > (1; 2)), y DATE)", True), ("f", 2, "COMMENT ON TABLE a.t IS ';'", True),
        ("h", 0, "ALTER TABLE a.t ADD (x DATE; ALTER TABLE a.t ADD y DATE;", False),
    ]


def test_a_table_takes_the_statements_of_all_files(spark):
    """Without a limit no file is left out, however many statements a table has."""
    files = {"t.sql": "CREATE TABLE a.t (c NUMBER);\n", "u.sql": "CREATE TABLE a.u (c NUMBER);\n"}
    files |= {f"z{k:03}.sql": f"ALTER TABLE a.t ADD (x{k} NUMBER); COMMENT ON TABLE a.{'u' if k % 2 else 't'} IS '{k}';" for k in range(40)} | {"zz.sql": "ALTER TABLE a.t NOLOGGING; ALTER TABLE a.v NOLOGGING;"}
    files = spark.createDataFrame(list(files.items()), "path string, text string")
    found, said = replay.with_contexts(scan.occurrences(files), files)
    assert {(r.path == "zz.sql", r.reason) for r in said.collect()} == {(False, None), (True, "UNKNOWN_TABLE")}
    found = found.select(found.name.alias("definition"), replay.with_statements(found.fragment, found.context).alias("fragment"))
    r = replay.replayed(found, code_tokens(found))
    assert {x.component: x.position for x in r.columns.where("definition = 'T'").collect()} == {"U:C": "1"} | {f"U:X{k}": str(k + 2) for k in range(40)}
    assert {(x.definition, x.value) for x in r.comments.collect()} == {("T", "'38'"), ("U", "'39'")}
    assert r.diagnostics.isEmpty()


def test_files_of_statements_of_any_size_are_read(spark):
    """Beyond 128,000 bytes too, and in a time that grows with the file; comments between the words of a statement hide no file."""
    big = "".join(f"ALTER TABLE a.t{k} ADD (x NUMBER(5, 2), y{k:04} DATE);\n" for k in range(6000))
    files = {"big.sql": big, "note.sql": "ALTER /* t */ TABLE a.t7 NOLOGGING; COMMENT -- on\nON TABLE a.t7 IS 'z';", "t7.sql": "CREATE TABLE a.t7 (c NUMBER);\n"}
    assert len(big) > 2 * 128_000
    files = spark.createDataFrame(list(files.items()), "path string, text string")
    got = replay.context_statements(files.where("path = 'big.sql'")).collect()
    assert [(r.n, r.table_parts, r.text, big[r.start : r.end] == r.text) for r in got] == [(k, ["U:A", f"U:T{k}"], f"ALTER TABLE a.t{k} ADD (x NUMBER(5, 2), y{k:04} DATE)", True) for k in range(6000)]
    created = "".join(f"CREATE TABLE a.t{k} (c NUMBER);\n" for k in range(6000) if k != 7)
    files = files.union(spark.createDataFrame([("made.sql", created)], files.schema))
    found, said = replay.with_contexts(scan.occurrences(files), files)
    assert said.where("reason IS NULL").count() == said.count() == 6002
    assert [[x.path for x in r.context] for r in found.where("name = 'T7'").collect()] == [["big.sql", "note.sql", "note.sql"]]


def test_statements_take_their_text_from_parts(spark):
    """Statements that begin, end or go on in several parts of a long text have theirs whole, by characters."""
    said = [f"COMMENT ON COLUMN a.t.c IS '{'é𝄞' * (k % 7 * 40)}{k}'" if k % 3 else f"ALTER TABLE a.t MODIFY c DEFAULT f('𝄞{k}',  2)" for k in range(400)] + [f"COMMENT ON TABLE a.t IS '{'𝄞' * 3 * replay.PART_CHARS}'", "ALTER TABLE a.t ADD (z NUMBER(5))"]
    text = "CREATE TABLE a.t (c NUMBER); -- 𝄞\n" + " ;\n".join(said) + ";"
    d = spark.createDataFrame([("t", text), ("u", "CREATE TABLE a.u (c NUMBER);")], "definition string, fragment string")
    r = replay.replayed(d, code_tokens(d))
    assert {(x.component, x.value) for x in r.comments.collect()} == {("U:C", said[398].partition(" IS ")[2]), ("TABLE", said[400].partition(" IS ")[2])}
    assert {(x.definition, x.component, x.data_type, x.default) for x in r.columns.collect()} == {("t", "U:C", "NUMBER", "f('𝄞399',  2)"), ("t", "U:Z", "NUMBER(5)", None), ("u", "U:C", "NUMBER", None)}
    later = code_tokens(d).where("definition = 't' AND start > 30")
    assert [x.text for x in replay.statements(later, d).orderBy("n").collect()] == said


def test_no_step_has_a_row_for_each_token_of_the_statements(spark, monkeypatch):
    """Statements are cut and read inside their text: what is written between the steps grows with them, not with their tokens."""
    rows, written = [], replay.checkpointed

    def counted(df):
        rows.append((out := written(df)).count())
        return out

    said = "".join(f"ALTER TABLE a.t ADD (x{k} NUMBER(5, 2) DEFAULT f(1, 2) NOT NULL); ALTER TABLE t MODIFY (x{k} NULL, c DEFAULT {k});" for k in range(300))
    d = spark.createDataFrame([("t", "CREATE TABLE a.t (c NUMBER); " + said), ("u", "CREATE TABLE a.u (c NUMBER)")], "definition string, fragment string")
    monkeypatch.setattr(replay, "checkpointed", counted)
    heads = statements.heads(d)
    r = replay.replayed(d, code_tokens(heads), heads=heads)
    got = {(x.definition, x.component): (x.position, x.nullable, x.default) for x in r.columns.collect()}
    assert got == {("t", "U:C"): ("1", None, "299"), ("u", "U:C"): ("1", None, None)} | {("t", f"U:X{k}"): (str(k + 2), "NULL", "f(1, 2)") for k in range(300)}
    assert r.diagnostics.isEmpty()
    tokens = code_tokens(d).count()
    # the tokens of 300 new columns, of which each is read as a table of its own, and no others
    assert tokens > 11_000 and max(rows) < tokens / 2


def test_tokens_in_python_are_those_of_the_pattern(spark):
    """Texts are cut alike on both sides, by characters; names with letters whose cases engines may know differently have SQL's keys."""
    texts = ["", " ", "a -- b\n/* c */ d /* open", "N'it''s' q'[a;]b]' nQ'!x!' q'{", "'open ; (", '"q""x".\'y\' "open', "a:=1..2 => b||c<=d**e 1.5.x.", "(a(b)c))(;)", "é𝄞$ \x0b\x1c\xa0x ß", "q n nq'(a)'b Q'xyx'z /", "a" * 9 + "\t\r\n" * 9]
    d = spark.createDataFrame(list(enumerate(texts)), "definition int, fragment string")
    want = {}
    for x in code_tokens(d).orderBy("definition", "i").collect():
        want.setdefault(x.definition, []).append((x.tok, x.up, x.depth, x.start, x.end))
    assert {k: list(statements.visible(t)) for k, t in enumerate(texts) if t.strip(" ")} == want
    files = spark.createDataFrame([("f", "ALTER TABLE a.\u0264 NOLOGGING; COMMENT ON COLUMN a.\u0264.x IS 'y'")], "path string, text string")
    upper = spark.range(1).selectExpr("'U:' || upper('\u0264')").first()[0]
    assert {tuple(x.table_parts) for x in replay.context_statements(files).collect()} == {("U:A", upper)}
