"""Scanning and extraction of definitions."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltaloom.extract import objects, replay, tables, tokens
from deltaloom.functions import identity, sqltext
from deltaloom.operators import scan


def files(spark, **texts):
    return scan.decoded(spark.createDataFrame([(k, bytearray(v.encode() if isinstance(v, str) else v)) for k, v in texts.items()], "path string, raw binary"))


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


def test_literals_and_comments_hide_headers(spark):
    text = "CREATE PACKAGE BODY a.b AS x VARCHAR2(99) := q'[; CREATE TABLE X.Y (A NUMBER)]'; y := 'it''s';\r\n-- CREATE VIEW v\r\nEND;"
    rows = scan.occurrences(files(spark, f=text)).collect()
    assert [r.object_key for r in rows] == ["SCHEMA|A|PACKAGE_BODY|B"]
    assert rows[0].fragment_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_spec_body_trigger_and_state(spark):
    text = "CREATE PACKAGE p AS END;\nCREATE PACKAGE BODY p AS END;\nCREATE TRIGGER s.t BEFORE INSERT ON x BEGIN NULL; END;\nALTER TRIGGER S.T ENABLE; ALTER TRIGGER s.t DISABLE;"
    rows = scan.occurrences(files(spark, f=text), "own").orderBy("ordinal").collect()
    assert [(r.object_type, r.trigger_state) for r in rows] == [("PACKAGE_SPEC", None), ("PACKAGE_BODY", None), ("TRIGGER", "DISABLE")]


def test_unknown_ddl_and_bad_bytes(spark):
    raw = spark.createDataFrame([("a", bytearray(b" CREATE WIDGET A.B x ")), ("b", bytearray(b"\xff\xfe"))], "path string, raw binary")
    got = {r.path: r for r in scan.file_inventory(raw).collect()}
    assert (got["a"].objects, got["a"].unresolved_bytes, got["a"].diagnostics) == (0, 19, ["UNRESOLVED_PREFIX_OR_ARTIFACT"])
    assert (got["b"].unresolved_bytes, got["b"].diagnostics) == (2, ["ENCODING_UNRESOLVED"])


def test_many_sequences(spark):
    text = "".join(f"CREATE SEQUENCE s{i} START WITH {i};\n" for i in range(40))
    rows = objects.sequence_options(scan.occurrences(files(spark, f=text))).orderBy("ordinal").collect()
    assert [r.start_with for r in rows] == [str(i) for i in range(40)]


def definition(spark, text):
    return spark.createDataFrame([("d", text)], "definition string, fragment string")


def test_sequence_options_once_or_unknown(spark):
    got = objects.sequence_options(definition(spark, "CREATE SEQUENCE s START WITH -123456789012345678901234 CACHE 2 NOCACHE INCREMENT BY 1.2 ORDER")).first()
    assert (got.start_with, got.cache, got.increment_by, got.order) == ("-123456789012345678901234", None, None, "ORDER")


def test_table_columns(spark):
    ddl = 'CREATE TABLE "Mixed".T (ID NUMBER(9,-1) NOT NULL, "A,B" VARCHAR2(8 CHAR) DEFAULT q\'[x,y]\', N DATE DEFAULT NULL, V AS (A*2) VIRTUAL, I NUMBER GENERATED ALWAYS AS IDENTITY, ID DATE)'
    got = {r.component: r for r in tables.columns(definition(spark, ddl)).collect()}
    assert (got["U:ID"].data_type, got["U:ID"].precision, got["U:ID"].scale, got["U:ID"].nullable) == ("NUMBER(9,-1)", "9", "-1", "NOT NULL")
    assert (got["Q:A,B"].length, got["Q:A,B"].length_semantics, got["Q:A,B"].default) == ("8", "CHAR", "q'[x,y]'")
    assert (got["U:N"].default, got["U:N"].nullable) == ("NULL", None)
    assert (got["U:V"].data_type, got["U:V"].virtual_expression, got["U:I"].identity) == (None, "A*2", "GENERATED ALWAYS AS IDENTITY")
    assert len(got) == 5


def test_constraint(spark):
    ddl = "CREATE TABLE t (a NUMBER, CONSTRAINT fk FOREIGN KEY (a) REFERENCES p.q(x) ON DELETE SET NULL DISABLE NOVALIDATE NOT DEFERRABLE INITIALLY IMMEDIATE NORELY, CONSTRAINT c CHECK (a IN (1,2)))"
    got = {r.component: r for r in tables.constraints(definition(spark, ddl)).collect()}
    fk = got["U:FK"]
    assert (fk.kind, fk.columns, fk.reference, fk.delete_rule) == ("FOREIGN KEY", "a", "p.q(x)", "ON DELETE SET NULL")
    assert (fk.enabled, fk.validation, fk.deferrable, fk.initially, fk.rely) == ("DISABLE", "NOVALIDATE", "NOT DEFERRABLE", "INITIALLY IMMEDIATE", "NORELY")
    assert got["U:C"].condition == "a IN (1,2)"


def test_table_properties_and_partitions(spark):
    ddl = "CREATE GLOBAL TEMPORARY TABLE t (a NUMBER) ON COMMIT PRESERVE ROWS TABLESPACE x ROW STORE COMPRESS ADVANCED PARTITION BY RANGE (a) (PARTITION p1 VALUES LESS THAN (1) TABLESPACE y, PARTITION p2 VALUES LESS THAN (2)); ALTER TABLE t NOLOGGING;"
    got = {r.property: r.value for r in tables.properties(definition(spark, ddl)).collect()}
    assert (got["temporary"], got["on_commit"], got["tablespace"], got["compression"]) == ("GLOBAL TEMPORARY", "ON COMMIT PRESERVE ROWS", "x", "ROW STORE COMPRESS ADVANCED")
    assert "logging" not in got
    assert {r.component for r in tables.partitions(definition(spark, ddl)).collect()} == {"U:P1", "U:P2"}


def test_alter_and_comment_replay(spark):
    ddl = "CREATE TABLE t (a NUMBER, b NUMBER); ALTER TABLE t ADD c DATE; ALTER TABLE t DROP COLUMN b; COMMENT ON TABLE t IS 'x'; COMMENT ON COLUMN t.a IS 'y'; COMMENT ON COLUMN t.a IS '';"
    d = definition(spark, ddl)
    got = replay.replayed(d, tokens.code_tokens(d))
    assert {r.component for r in got.columns.collect()} == {"U:A", "U:C"}
    assert [(r.component, r.value) for r in got.comments.collect()] == [("TABLE", "'x'")]
    more = definition(spark, "CREATE TABLE t (a NUMBER NOT NULL, b NUMBER, c DATE, d DATE); ALTER TABLE t MODIFY a NULL; ALTER TABLE t MODIFY (b DEFAULT f(1, 2), c NOT NULL); ALTER TABLE t DROP (c, d); ALTER TABLE t ADD (e VARCHAR2(5) DEFAULT 'x', CONSTRAINT k CHECK (e > 1));")
    got = {r.component: (r.nullable, r.default) for r in replay.replayed(more, tokens.code_tokens(more)).columns.collect()}
    assert got == {"U:A": ("NULL", None), "U:B": (None, "f(1, 2)"), "U:E": (None, "'x'")}
    alone = definition(spark, "ALTER TABLE t ADD c DATE; COMMENT ON TABLE t IS 'x';")
    assert tables.context_only(alone).count() == 1
    assert tables.context_only(definition(spark, "ALTER TABLE t ADD c DATE; GRANT x TO y;")).count() == 0


def test_index(spark):
    got = objects.indexes(definition(spark, "CREATE BITMAP INDEX i ON s.t (NVL(a, 'x,y'), b DESC) GLOBAL COMPRESS 2 INVISIBLE;")).first()
    assert (got.target, got.kind, got["keys"], got.directions, got.visibility) == ("s.t", "BITMAP", "[\"NVL(a, 'x,y')\",\"b\"]", '["","DESC"]', "INVISIBLE")
    assert got.properties == {"partitioning": "GLOBAL", "compression": "COMPRESS 2"}


def test_view(spark):
    ddl = "CREATE OR REPLACE FORCE VIEW v (x, y) AS WITH c AS (SELECT 1 z FROM dual) SELECT DISTINCT a, COUNT(*) OVER (PARTITION BY b) FROM t JOIN u ON t.i = u.i WHERE n = 'OVER (X)' GROUP BY a HAVING 1 = 1 UNION ALL SELECT * FROM w ORDER BY 1 WITH READ ONLY"
    got = {r.property: r.value for r in objects.views(definition(spark, ddl)).collect()}
    assert (got["output_order"], got["distinct"], got["where"], got["group_by"]) == ('["x","y"]', "DISTINCT", "WHERE n = 'OVER (X)'", "GROUP BY a")
    assert (got["source_references"], got["set_operators"], got["ordering"], got["read_only"]) == ("FROM t JOIN u ON t.i = u.i | FROM w", "UNION ALL SELECT *", "ORDER BY 1", "WITH READ ONLY")
    assert (got["analytic"], got["force"], got["projection"]) == ("OVER (PARTITION BY b)", "FORCE", '["a","COUNT(*) OVER (PARTITION BY b)"]')
    assert (got["join"], got["having"], got["with_clause"]) == ("JOIN u ON t.i = u.i", "HAVING 1 = 1", "WITH c AS (SELECT 1 z FROM dual)") and "editioning" not in got
    joined = objects.views(definition(spark, "CREATE EDITIONING VIEW v AS SELECT a FROM t NATURAL LEFT OUTER JOIN u JOIN w ON (w.x = 1) WHERE b = 1 FETCH FIRST 3 ROWS ONLY WITH CHECK OPTION"))
    got = {(r.property, r.component): r.value for r in joined.collect()}
    assert got["join", ""] == "NATURAL LEFT OUTER JOIN u | JOIN w ON (w.x = 1)" and got["editioning", ""] == "EDITIONING"
    assert (got["row_limit", ""], got["check_option", ""]) == ("FETCH FIRST 3 ROWS ONLY", "WITH CHECK OPTION")


def test_routines(spark):
    ddl = "CREATE PACKAGE p AS PROCEDURE a(x IN OUT NOCOPY NUMBER, y DATE DEFAULT f(1, 2)); FUNCTION a RETURN t.c%TYPE; c CONSTANT NUMBER := 1; END;"
    d = definition(spark, ddl)
    got = objects.routines(d).orderBy("n").collect()
    assert [(r.kind, r.name) for r in got] == [("PROCEDURE", "A"), ("FUNCTION", "A")]
    x, y = got[0].parameters
    assert (x.mode, x.data_type, x.nocopy, y.default) == ("IN OUT", "NUMBER", True, "DEFAULT f(1, 2)")
    assert objects.routine_diagnostics(d, objects.routines(d)).first().diagnostics == []
    more = definition(spark, "CREATE PACKAGE BODY p AS PROCEDURE a IS x NUMBER := CASE WHEN 1 = 1 THEN 1 END; PROCEDURE inner IS BEGIN COMMIT; END; BEGIN IF x > 1 THEN inner; END IF; b.c(1); END a; PROCEDURE a(y DATE) IS BEGIN NULL; END; BEGIN go; END;")
    got = objects.routines(more).orderBy("n").collect()
    assert [(r.name, r.nested) for r in got] == [("A", 1), ("A", 0)] and got[0].source.endswith("END a;") and got[1].source == "PROCEDURE a(y DATE) IS BEGIN NULL; END;"
    assert objects.routine_diagnostics(more, objects.routines(more)).first().diagnostics == ["OVERLOAD_PAIRING_REQUIRES_REVIEW", "NESTED_ROUTINE_LIMITED"]
    facts = [(r.family, r.statement) for r in objects.body_facts(more).orderBy("n", "family").collect()]
    assert ("condition", "x > 1") in facts and ("call_reference", "b.c(1)") in facts and ("call_reference", "inner") in facts and not any("COMMIT" in s for _, s in facts)


def test_package_fields(spark):
    rows = [
        ("s", "PACKAGE_SPEC", "CREATE OR REPLACE EDITIONABLE PACKAGE p AUTHID CURRENT_USER AS TYPE t IS RECORD (a NUMBER); c CONSTANT NUMBER := 1; v DATE; CURSOR q IS SELECT 1 FROM dual; e EXCEPTION; PRAGMA EXCEPTION_INIT(e, -1); PROCEDURE r(a IN NUMBER DEFAULT 2); FUNCTION r RETURN DATE; PROCEDURE o; PROCEDURE o(x DATE); END p;", None),
        ("b", "PACKAGE_BODY", "CREATE PACKAGE BODY p AS n NUMBER; PROCEDURE r(a IN NUMBER DEFAULT 2) IS BEGIN UPDATE t SET x = a; COMMIT; EXECUTE IMMEDIATE 'DELETE FROM z' USING a; EXCEPTION WHEN OTHERS THEN RAISE; END; BEGIN n := 1; END;", None),
        ("f", "FUNCTION", "CREATE FUNCTION f RETURN NUMBER IS BEGIN ROLLBACK; RETURN 1; END;", None),
    ]
    found = objects.fields(spark.createDataFrame(rows, "definition string, object_type string, fragment string, trigger_state string")).collect()
    got = {(r.definition, r.family, r.component): r.value for r in found}
    assert got["s", "package_spec.package_property.authid", ""] == "AUTHID CURRENT_USER" and got["s", "common.object.editionable", ""] == "EDITIONABLE"
    declared = {f.split(".")[1]: v for (d, f, c), v in got.items() if d == "s" and f.endswith(".definition") and c == "1"}
    assert declared == {"type_declaration": "TYPE t IS RECORD (a NUMBER);", "constant": "c CONSTANT NUMBER := 1;", "variable": "v DATE;", "cursor": "CURSOR q IS SELECT 1 FROM dual;", "exception_declaration": "e EXCEPTION;", "pragma": "PRAGMA EXCEPTION_INIT(e, -1);"}
    assert got["s", "package_spec.routine.signature", "PROCEDURE/O"] == '["PROCEDURE o","PROCEDURE o(x DATE)"]' and got["s", "package_spec.routine.return_type", "FUNCTION/R"] == "DATE"
    assert (got["s", "package_spec.parameter.default", "PROCEDURE/R/1"], got["s", "package_spec.parameter.mode", "PROCEDURE/R/1"]) == ("DEFAULT 2", "IN")
    body = lambda p: got.get(("b", f"package_body.body_property.{p}", "PROCEDURE/R"))
    assert (body("sql_statement"), body("transaction_statement"), body("exception_handler")) == ('["UPDATE t SET x = a"]', '["COMMIT"]', '["WHEN OTHERS THEN"]')
    assert body("dynamic_sql_profile") == '["mode=literal,target=static,bind=yes,concat=no,validation=not_applicable,loop=no"]' and body("routine_body").endswith("END;")
    assert got["b", "package_body.variable.definition", "1"] == "n NUMBER;" and got["b", "package_body.body_property.initialization", ""] == "n := 1;"
    own = {f: v for (d, f, _), v in got.items() if d == "f"}
    assert own == {"function.function_property.signature": '["FUNCTION f RETURN NUMBER"]', "function.function_property.transaction_statement": '["ROLLBACK"]', "function.function_property.has_exception": "false", "function.function_property.has_commit": "false", "function.function_property.has_rollback": "true"}


def test_dynamic_profiles(spark):
    said = {
        "EXECUTE IMMEDIATE 'DELETE FROM t'": "mode=literal,target=static,bind=no,concat=no,validation=not_applicable,loop=no",
        "EXECUTE IMMEDIATE 'BEGIN x; END;' USING y;": "mode=literal,target=unknown,bind=yes,concat=no,validation=not_applicable,loop=no",
        "EXECUTE IMMEDIATE 'DROP TABLE ' || DBMS_ASSERT.simple_sql_name(n)": "mode=expression,target=runtime,bind=no,concat=yes,validation=visible,loop=no",
        "EXECUTE IMMEDIATE v USING IN a, OUT b": "mode=expression,target=unknown,bind=yes,concat=no,validation=not_observed,loop=no",
        "DELETE FROM t": "mode=unknown,target=unknown,bind=no,concat=no,validation=unknown,loop=no",
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", objects.dynamic_profile(F.col("t")).alias("p")).collect()
    got = {r.t: r.p for r in rows}
    assert {k: v for k, v in got.items() if "unknown,bind=no,concat=no,validation=" not in v or k != "DELETE FROM t"} == {k: v for k, v in said.items() if k != "DELETE FROM t"}
    assert got["DELETE FROM t"].startswith("mode=unknown,target=unknown,bind=no,concat=no")


def test_very_long_names_and_literals(spark):
    """A megabyte in quotes, and a file of many definitions."""
    name = "n" * 1_000_000
    text = f"""CREATE TABLE s."{name}" (a VARCHAR2(9) DEFAULT '{"x''" * 300_000}');\n""" + "".join(f"CREATE SEQUENCE q{i} START WITH {i};\n" for i in range(2000))
    rows = scan.occurrences(files(spark, f=text)).select("ordinal", "raw_name", "start_char", "end_char", "start_byte", "start_line").orderBy("ordinal").collect()
    assert len(rows) == 2001 and rows[0].raw_name == name and rows[0].end_char == text.index("\n") + 1
    assert [text[r.start_char : r.end_char] for r in rows[1:3]] == ["CREATE SEQUENCE q0 START WITH 0;\n", "CREATE SEQUENCE q1 START WITH 1;\n"] and rows[-1].start_line == 2001
    wrapped = definition(spark, "CREATE PACKAGE BODY p WRAPPED abc")
    assert objects.routine_diagnostics(wrapped, objects.routines(wrapped)).first().diagnostics == ["WRAPPED_SOURCE_OPAQUE"]


@pytest.mark.parametrize(
    "statement, expected",
    [
        ("EXECUTE IMMEDIATE 'DELETE FROM t WHERE a = :1' USING x;", "mode=literal,target=static,bind=yes,concat=no,validation=not_applicable,loop=no"),
        ("EXECUTE IMMEDIATE 'DROP TABLE ' || DBMS_ASSERT.SIMPLE_SQL_NAME(n)", "mode=expression,target=runtime,bind=no,concat=yes,validation=visible,loop=no"),
        ("EXECUTE IMMEDIATE v", "mode=expression,target=unknown,bind=no,concat=no,validation=not_observed,loop=no"),
        ("COMMIT", "mode=unknown,target=unknown,bind=no,concat=no,validation=unknown,loop=no"),
    ],
)
def test_dynamic_sql(spark, statement, expected):
    assert one(spark, objects.dynamic_profile(F.col("t")), statement) == expected


@pytest.mark.parametrize(
    "before, after, expected",
    [("a  b", "a b", "format_only"), ("x 'a  b'", "x 'a b'", "structural_or_logic"), ("a --+ h\nb", "a --+ k\nb", "structural_or_logic"), ("a b", "A b", "structural_or_logic"), ("a", "a", "unchanged")],
)
def test_text_change(spark, before, after, expected):
    assert one(spark, sqltext.text_change(F.col("t"), F.lit(after)), before) == expected


def test_start_value_only(spark):
    change = lambda a, b: one(spark, sqltext.start_value_change(F.col("t"), F.lit(b)), a)
    assert tuple(change("CREATE SEQUENCE s START WITH 1 CACHE 2", "CREATE SEQUENCE s START WITH 9 CACHE 2")) == ("1", "9")
    assert change("CREATE SEQUENCE s START WITH 1 CACHE 2", "CREATE SEQUENCE s START WITH 9 CACHE 3") is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["--", "/*", "*/", "'", '"', "q'[", "]'", "\n", " ", "CREATE", "é", "a", ";"]), max_size=12))
def test_masks_keep_length(spark, parts):
    text = "".join(parts)
    row = spark.createDataFrame([(text,)], "t string").select(sqltext.masked(F.col("t")).alias("m"), F.array_join(sqltext.tokens(F.col("t")), "").alias("j")).first()
    assert len(row.m) == len(text) and row.j == text


def test_identity(spark):
    assert one(spark, identity.component_key(F.col("t")), '"a""b"') == 'Q:a"b'
    assert one(spark, identity.grouped_digits(F.col("t")), "-1234567") == "-1.234.567"
    assert one(spark, identity.big_integer_sign(F.col("t"), F.lit("9" * 45)), "-" + "9" * 60) == 1
    assert one(spark, identity.big_integer_sign(F.col("t"), F.lit("007")), "7") == 0
    key = one(spark, identity.fact_id(F.col("t"), F.lit("f"), F.array(F.lit("a"))), "k")
    assert key == "fact-" + hashlib.sha256(b'["k","f",["a"]]').hexdigest()[:32]


def test_files_are_dealt_before_they_are_cut(spark):
    one_partition = spark.range(40).coalesce(1).selectExpr("concat('f', id) AS path", "concat('CREATE SEQUENCE s', id, ' CACHE 2;') AS text")
    found = scan.occurrences(one_partition).where("object_type = 'SEQUENCE'")
    cut = found.withColumn("p", F.spark_partition_id())
    assert cut.count() == 40 and cut.select("p").distinct().count() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("regexp_extract_all") < plan.index("Exchange")  # the plan's last step stands first
    assert {r.path for r in scan.occurrences(files(spark, a="create view v as select 1 from t;", b="ALTER TABLE t ADD x DATE;")).collect()} == {"a"}


def test_many_views_and_their_joins(spark, monkeypatch):
    # texts, not tokens, are shuffled in parts of bounded bytes, and a clause ends a join in any part
    monkeypatch.setattr(tokens, "PART_BYTES", 1000)
    views = spark.range(300).selectExpr("id AS definition", "concat('CREATE VIEW v AS SELECT a FROM t JOIN u ON t.x = ', id, ' WHERE b = 1;') AS fragment")
    assert tokens.dealt(views).rdd.getNumPartitions() == -(-sum(len(r.fragment) for r in views.collect()) // 1000)
    got = {(r.definition, r.property): r.value for r in objects.views(views).collect()}
    assert all(got[i, "join"] == f"JOIN u ON t.x = {i}" and got[i, "where"] == "WHERE b = 1" for i in range(300)) and len(got) == 4 * 300
