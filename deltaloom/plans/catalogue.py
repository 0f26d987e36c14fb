"""Queries over the driver's tables, one or more for each operator, with the same query as SQL.

Two snapshots of a table are derived by arithmetic on its key: the base lacks keys divisible by 11,
the target lacks keys divisible by 7 and has one attribute rewritten where the key is divisible by 5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.extract import objects as extract
from deltaloom.extract import replay, statements
from deltaloom.extract import tables as extract_tables
from deltaloom.extract.tokens import code_tokens, dealt
from deltaloom.functions import canonical, identity, sqltext
from deltaloom.operators import diff, graph, pages, ranking, rollup, scan, units, validate
from deltaloom.plans import history

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def base(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % 11 != 0)


def target(df: DataFrame, key: str, **changes: Column) -> DataFrame:
    out = df.where(F.col(key) % 7 != 0)
    return out.withColumns({c: F.when(F.col(key) % 5 == 0, v).otherwise(F.col(c)) for c, v in changes.items()})


PART_FAMILIES = {"p_name": "part.name", "p_brand": "part.brand", "p_type": "part.type", "p_size": "part.size"}
_PART_OLD = "SELECT * FROM part WHERE p_partkey % 11 <> 0"
_PART_NEW = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_brand || '*' ELSE p_brand END AS p_brand, p_type, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice FROM part WHERE p_partkey % 7 <> 0"


def _fields_sql(inner: str) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey, '{f}' AS family, {c}::VARCHAR AS value FROM ({inner}) WHERE {c} IS NOT NULL" for c, f in PART_FAMILIES.items())


def part_sides(t) -> tuple[DataFrame, DataFrame]:
    part = t("part")
    return base(part, "p_partkey"), target(part, "p_partkey", p_brand=F.concat("p_brand", F.lit("*")), p_size=F.col("p_size") + 1)


@query(
    """WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0),
n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'A' WHEN n.doc_id IS NULL THEN 'D' ELSE 'M' END AS status, o.h AS old_h, n.h AS new_h
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h"""
)
def q01_file_diff(t):
    docs = t("documents").select("doc_id", "text")
    sides = [d.select("doc_id", F.sha2("text", 256).alias("h")) for d in (base(docs, "doc_id"), target(docs, "doc_id", text=F.concat("text", F.lit("!"))))]
    return diff.file_diff(*sides, ["doc_id"], ["h"])


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey || ',' || l_linenumber AS s, l_partkey FROM lineitem),
o AS (SELECT l_orderkey, string_agg(s, '|' ORDER BY s) AS g, count(*) AS c FROM p WHERE l_orderkey % 11 <> 0 GROUP BY 1),
n AS (SELECT l_orderkey, string_agg(s, '|' ORDER BY s) AS g, count(*) AS c FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN (l_partkey + 1) || ',' || l_linenumber ELSE s END AS s FROM p WHERE l_orderkey % 7 <> 0) GROUP BY 1)
SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, CASE WHEN o.l_orderkey IS NULL THEN 'added' WHEN n.l_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS operation, o.c AS old_parts, n.c AS new_parts
FROM o FULL JOIN n ON o.l_orderkey = n.l_orderkey WHERE o.g IS DISTINCT FROM n.g"""
)
def q02_object_diff(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = [F.col("l_partkey"), F.col("l_linenumber")]
    return diff.object_diff(base(lines, "l_orderkey"), target(lines, "l_orderkey", l_partkey=F.col("l_partkey") + 1), "l_orderkey", parts)


@query(
    f"""WITH o AS ({_fields_sql(_PART_OLD)}), n AS ({_fields_sql(_PART_NEW)})
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(o.family, n.family) AS family, o.value AS before, n.value AS after,
CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'modified' END AS action
FROM o FULL JOIN n ON o.p_partkey = n.p_partkey AND o.family = n.family WHERE o.value IS DISTINCT FROM n.value"""
)
def q03_field_facts(t):
    old, new = part_sides(t)
    return diff.field_changes(diff.unpivot(old, "p_partkey", PART_FAMILIES), diff.unpivot(new, "p_partkey", PART_FAMILIES), ["p_partkey", "family"])


def _facts(t, table: str, key: str, families: dict[str, str], changes: dict[str, Column], may_modify: dict[str, bool], definitions: list[str] | None = None) -> DataFrame:
    df = t(table)
    old, new = base(df, key), target(df, key, **changes)
    spark = df.sparkSession
    known = spark.createDataFrame([(f, "structural", may_modify.get(f, True)) for f in families.values()], "family string, category string, may_modify boolean")
    objects = [d.select(F.col(key).alias("object_key"), F.array().cast("array<string>").alias("diagnostics")) for d in (old, new)]
    fields = [diff.unpivot(d, key, families).withColumnRenamed(key, "object_key").withColumn("component", F.lit("")) for d in (old, new)]
    return diff.facts(*objects, *fields, known, add_or_remove=definitions)


def _facts_sql(table: str, key: str, families: dict[str, str], changes: dict[str, str], splits: list[str], hidden: list[str]) -> str:
    def side(where: str, changed: bool) -> str:
        expr = lambda c: f"CASE WHEN {key} % 5 = 0 THEN {changes[c]} ELSE {c} END" if changed and c in changes else c
        return " UNION ALL ".join(f"SELECT {key} AS k, '{f}' AS family, ({expr(c)})::VARCHAR AS value FROM {table} WHERE {where} AND {c} IS NOT NULL" for c, f in families.items())

    quoted = lambda x: "(" + ", ".join(f"'{i}'" for i in x or ["-"]) + ")"
    return f"""WITH ko AS (SELECT {key} AS k FROM {table} WHERE {key} % 11 <> 0), kn AS (SELECT {key} AS k FROM {table} WHERE {key} % 7 <> 0),
obj AS (SELECT coalesce(ko.k, kn.k) AS k, ko.k IS NOT NULL AS io, kn.k IS NOT NULL AS inn FROM ko FULL JOIN kn ON ko.k = kn.k),
o AS ({side(key + ' % 11 <> 0', False)}), n AS ({side(key + ' % 7 <> 0', True)}),
d AS (SELECT coalesce(o.k, n.k) AS k, coalesce(o.family, n.family) AS family, o.value AS b, n.value AS a FROM o FULL JOIN n ON o.k = n.k AND o.family = n.family WHERE o.value IS DISTINCT FROM n.value),
e AS (SELECT d.*, io, inn, NOT (io AND inn) AS ctx FROM d JOIN obj USING (k)),
f AS (SELECT * FROM e WHERE ctx OR NOT (b IS NOT NULL AND a IS NOT NULL AND family IN {quoted(hidden)})),
r AS (SELECT k, family, io, inn, ctx, CASE WHEN ctx AND io THEN 'removed' WHEN ctx THEN 'added' WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'modified' END AS action, b, a FROM f WHERE ctx OR b IS NULL OR a IS NULL OR family NOT IN {quoted(splits)}
 UNION ALL SELECT k, family, io, inn, ctx, 'removed', b, NULL FROM f WHERE NOT ctx AND b IS NOT NULL AND a IS NOT NULL AND family IN {quoted(splits)}
 UNION ALL SELECT k, family, io, inn, ctx, 'added', NULL, a FROM f WHERE NOT ctx AND b IS NOT NULL AND a IS NOT NULL AND family IN {quoted(splits)})
SELECT k AS object_key, 'common.object.presence' AS family, '' AS component, CASE WHEN io THEN 'removed' ELSE 'added' END AS action, 'presence' AS category,
CASE WHEN io THEN 'present' ELSE 'absent_in_snapshot' END AS before_state, NULL::VARCHAR AS before, CASE WHEN inn THEN 'present' ELSE 'absent_in_snapshot' END AS after_state, NULL::VARCHAR AS after, false AS context_only FROM obj WHERE NOT (io AND inn)
UNION ALL SELECT k, family, '', action, 'structural', CASE WHEN NOT io THEN 'not_applicable' WHEN b IS NULL THEN 'not_in_source' ELSE 'present' END, b, CASE WHEN NOT inn THEN 'not_applicable' WHEN a IS NULL THEN 'not_in_source' ELSE 'present' END, a, ctx FROM r"""


_CUSTOMER = {"c_name": "customer.name", "c_nationkey": "customer.nation", "c_mktsegment": "customer.segment"}


@query(_facts_sql("customer", "c_custkey", _CUSTOMER, {"c_mktsegment": "'X'"}, [], []))
def q04_presence_facts(t):
    return _facts(t, "customer", "c_custkey", _CUSTOMER, {"c_mktsegment": F.lit("X")}, {})


_SUPPLIER = {"s_name": "supplier.name", "s_nationkey": "supplier.nation"}


@query(_facts_sql("supplier", "s_suppkey", _SUPPLIER, {"s_name": "s_name || '#'", "s_nationkey": "s_nationkey + 1"}, ["supplier.name"], []))
def q05_split_facts(t):
    return _facts(t, "supplier", "s_suppkey", _SUPPLIER, {"s_name": F.concat("s_name", F.lit("#")), "s_nationkey": F.col("s_nationkey") + 1}, {"supplier.name": False})


_PART = {"p_name": "part.definition", "p_brand": "part.brand"}


@query(_facts_sql("part", "p_partkey", _PART, {"p_name": "p_name || '~'", "p_brand": "p_brand || '~'"}, [], ["part.definition"]))
def q06_definition_suppression(t):
    return _facts(t, "part", "p_partkey", _PART, {"p_name": F.concat("p_name", F.lit("~")), "p_brand": F.concat("p_brand", F.lit("~"))}, {}, ["part.definition"])


@query(
    f"""WITH o AS ({_fields_sql(_PART_OLD)}), n AS ({_fields_sql(_PART_NEW)}),
d AS (SELECT DISTINCT o.family FROM o JOIN n ON o.p_partkey = n.p_partkey AND o.family = n.family WHERE o.value IS DISTINCT FROM n.value),
c AS (SELECT * FROM (VALUES ('part.name'), ('part.brand'), ('part.type'), ('part.size'), ('part.weight')) v(family))
SELECT family FROM c WHERE family NOT IN (SELECT family FROM d)"""
)
def q07_uncovered_families(t):
    old, new = part_sides(t)
    changes = diff.field_changes(diff.unpivot(old, "p_partkey", PART_FAMILIES), diff.unpivot(new, "p_partkey", PART_FAMILIES), ["p_partkey", "family"]).where("action = 'modified'")
    known = old.sparkSession.createDataFrame([(f,) for f in [*PART_FAMILIES.values(), "part.weight"]], "family string")
    return diff.uncovered(known, changes, ["family"])


_ORDER_NEW = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 15 = 0 THEN 'none' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 7 <> 0"""


def _order_fields(t) -> DataFrame:
    """(object_key, family) of changed fields of orders that are in both snapshots."""
    orders = t("orders")
    new = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 15 == 0, "none").otherwise(F.col("o_orderpriority")).alias("p"))
    old = base(orders, "o_orderkey").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    names = {"s": "sequence.sequence_property.start_with", "p": "table.column.data_type"}
    return diff.field_changes(diff.unpivot(old, "o_orderkey", names), diff.unpivot(new, "o_orderkey", names), ["o_orderkey", "family"]).where("action = 'modified'").withColumnRenamed("o_orderkey", "object_key")


_ORDER_CHANGES = f"""o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 11 <> 0), n AS ({_ORDER_NEW}),
ch AS (SELECT o.o_orderkey AS object_key, o.s IS DISTINCT FROM n.s AS cs, o.p IS DISTINCT FROM n.p AS cp FROM o JOIN n USING (o_orderkey))"""


@query(f"WITH {_ORDER_CHANGES} SELECT object_key, CASE WHEN cs AND NOT cp THEN 'start_value_only' ELSE 'structured' END AS pattern FROM ch WHERE cs OR cp")
def q08_pattern_label(t):
    return _order_fields(t).groupBy("object_key").agg(F.collect_set("family").alias("f")).select("object_key", rollup.pattern_label(F.col("f")).alias("pattern"))


def _order_risk(t) -> DataFrame:
    orders = t("orders")
    old, new = base(orders, "o_orderkey").select("o_orderkey", F.lit(1).alias("x")), orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.lit(1).alias("x"))
    sides = diff._sides(old, new, ["o_orderkey"], ["x"]).select(F.col("o_orderkey").alias("object_key"), F.when(F.col("in_old") & F.col("in_new"), "unchanged").otherwise(diff.operation()).alias("op"))
    changes = _order_fields(t)
    objects = sides.join(changes.select("object_key").distinct().withColumn("c", F.lit(True)), "object_key", "left").where("op <> 'unchanged' OR c")
    objects = objects.select("object_key", F.lit("TABLE").alias("object_type"), F.when(F.col("op") == "unchanged", "modified").otherwise(F.col("op")).alias("operation"), F.lit("ready").alias("status"))
    return rollup.object_risk(changes, objects)


_ORDER_RISK = f"""{_ORDER_CHANGES},
ops AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS object_key, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' END AS op FROM o a FULL JOIN n b ON a.o_orderkey = b.o_orderkey),
risk AS (SELECT ops.object_key, 'TABLE' AS object_type, CASE WHEN op = 'removed' THEN 'unknown' WHEN cp THEN 'high' ELSE 'medium' END AS level FROM ops LEFT JOIN ch USING (object_key) WHERE op IS NOT NULL OR cs OR cp)"""


@query(f"WITH {_ORDER_RISK} SELECT *, CASE level WHEN 'unknown' THEN 'removed_or_unresolved_object' ELSE level || '_source_rule' END AS reason FROM risk")
def q09_object_risk(t):
    return _order_risk(t)


@query(
    f"""WITH {_ORDER_RISK}, e AS (SELECT count(*) AS edges FROM lineitem WHERE l_orderkey % 5 = 0),
m AS (SELECT max(CASE level WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END) AS r FROM risk)
SELECT CASE WHEN r = 4 OR (r = 3 AND edges >= 4) THEN 'high' WHEN r = 3 OR (r = 2 AND edges >= 2) THEN 'medium' WHEN r = 2 THEN 'low' ELSE 'unknown' END AS level, edges FROM m, e"""
)
def q10_overall_risk(t):
    edges = t("lineitem").where("l_orderkey % 5 = 0").count()
    return rollup.overall_risk(_order_risk(t), F.lit(edges).cast("long"))


@query(
    """WITH d AS (SELECT * FROM (VALUES ('F', 0), ('O', 1), ('P', 2), ('X', 3)) v(o_orderstatus, rank)), c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(d.o_orderstatus, c.o_orderstatus) AS o_orderstatus, coalesce(n, 0)::BIGINT AS n, coalesce(rank, 4)::INTEGER AS rank FROM d FULL JOIN c ON d.o_orderstatus = c.o_orderstatus"""
)
def q11_zero_filled_counts(t):
    return rollup.counts_over(t("orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query(
    """WITH c AS (SELECT p_size AS b, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 WHEN p_partkey % 3 = 0 THEN p_size - 2 ELSE p_size END AS a FROM part)
SELECT CASE WHEN a > b THEN 'forward' WHEN a < b THEN 'backward' ELSE 'other' END AS direction, count(*) AS n FROM c GROUP BY 1"""
)
def q12_direction_rollup(t):
    after = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).when(F.col("p_partkey") % 3 == 0, F.col("p_size") - 2).otherwise(F.col("p_size"))
    zeros = lambda c: F.concat(F.when(c < 0, "-").otherwise(""), F.lpad(F.abs(c).cast("string"), 45, "0"))  # noqa: E731  as long as no number type
    return t("part").groupBy(rollup.direction(zeros(F.col("p_size")), zeros(after)).alias("direction")).agg(F.count("*").alias("n"))


@query("SELECT lang, source, CASE grouping(lang, source) WHEN 1 THEN 'lang' WHEN 2 THEN 'source' ELSE 'all' END AS counter, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def q13_counters(t):
    got = rollup.multi_counts(t("documents"), ["lang", "source"], [F.count("*").alias("n"), F.sum("n_chars").alias("chars")])
    return got.select("lang", "source", F.when(F.col("grouping") == 1, "lang").when(F.col("grouping") == 2, "source").otherwise("all").alias("counter"), "n", "chars")


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'blocked' WHEN bool_or(o_orderstatus = 'O') THEN 'limited' ELSE 'complete' END AS quality FROM orders GROUP BY 1")
def q14_quality(t):
    return t("orders").groupBy("o_custkey").agg(rollup.quality(F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "O").alias("quality"))


@query("SELECT left(text, 12) AS k, count(*) AS definitions, count(DISTINCT regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) AS texts FROM documents GROUP BY 1 HAVING texts > 1")
def q15_conflicts(t):
    return diff.conflicts(t("documents").withColumn("k", F.substring("text", 1, 12)), "k", F.col("text"))


@query("SELECT conv_id, turn, lead(turn, 1, 1000000) OVER (PARTITION BY conv_id ORDER BY turn) AS \"end\" FROM conversations")
def q16_fragment_ends(t):
    return ranking.with_end(t("conversations").select("conv_id", "turn"), ["conv_id"], "turn", F.lit(1000000).cast("long"))


@query(
    """WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 3 = 0 THEN -turn ELSE turn END) AS b FROM conversations),
g AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT turn) = count(*))
SELECT conv_id, turn, a AS old_ordinal, b AS new_ordinal FROM o JOIN n USING (conv_id, turn) WHERE a <> b AND conv_id IN (SELECT conv_id FROM g)"""
)
def q17_reordered(t):
    turns = t("conversations").select("conv_id", "turn", F.col("turn").alias("place"))
    new = turns.withColumn("place", F.when(F.col("conv_id") % 3 == 0, -F.col("turn")).otherwise(F.col("turn")))
    return diff.reordered(turns, new, "conv_id", "turn", "place")


@query("SELECT * FROM (SELECT l_returnflag AS side, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 8")
def q18_side_quota(t):
    return ranking.quota(t("lineitem").select(F.col("l_returnflag").alias("side"), "l_orderkey", "l_linenumber"), ["side"], [F.col("l_orderkey"), F.col("l_linenumber")], 8)


@query("SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) WHERE gap <> 1")
def q19_chain_breaks(t):
    return ranking.chain_breaks(t("events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 10")
def q20_top(t):
    return ranking.top(t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")], 10).select("o_orderkey", "o_totalprice")


_LINES = "(SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"SELECT doc_id, line_no::INTEGER AS line_no, line FROM {_LINES} ORDER BY doc_id, line_no LIMIT 50 OFFSET 50")
def q21_page(t):
    return ranking.page(scan.lines(t("documents"), ("doc_id",)), [F.col("doc_id"), F.col("line_no")], 50, 50)


@query("SELECT p_partkey, CASE WHEN p_size > 25 AND p_partkey <= (SELECT max(p_partkey) FROM (SELECT p_partkey FROM part WHERE p_size > 25 ORDER BY 1 LIMIT 40)) THEN 'run' WHEN p_size > 25 THEN 'pending' ELSE 'done' END AS state FROM part")
def q22_unit_budget(t):
    return ranking.unit_budget(t("part").select("p_partkey", "p_size"), F.col("p_size") > 25, "p_partkey", 40).select("p_partkey", "state")


@query("SELECT * FROM (SELECT source, doc_id, (sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS used FROM documents) WHERE used <= 24000")
def q23_byte_budget(t):
    docs = t("documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return ranking.byte_budget(docs, ["source"], [F.col("doc_id")], F.col("size"), 24000).select("source", "doc_id", "used")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def q24_ordered_distinct(t):
    return ranking.ordered_distinct(t("events"), ["user_id", "event_type"], "event_id", ["value"])


def _newlines(column: str) -> str:
    count = lambda mark, n: f"((length({column}) - length(replace({column}, {mark}, ''))) / {n})"
    crlf, lf, cr = count("chr(13) || chr(10)", 2), count("chr(10)", 1), count("chr(13)", 1)
    return f"CASE WHEN ({crlf} > 0)::INT + ({lf} - {crlf} > 0)::INT + ({cr} - {crlf} > 0)::INT > 1 THEN 'MIXED' WHEN {crlf} > 0 THEN 'CRLF' WHEN {lf} > 0 THEN 'LF' WHEN {cr} > 0 THEN 'CR' ELSE 'NONE' END"


@query(f"SELECT 'documents' AS origin, doc_id AS id, {_newlines('text')} AS style FROM documents UNION ALL SELECT 'pages', page_id, {_newlines('html')} FROM pages")
def q25_newline_style(t):
    docs = t("documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), sqltext.newline_style(F.col("text")).alias("style"))
    return docs.unionByName(t("pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), sqltext.newline_style(F.col("html")).alias("style")))


@query(
    f"""SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no BETWEEN 2 AND 4) AS content,
(sum(strlen(line) + 1) FILTER (line_no < 2))::BIGINT AS start_byte, (sum(strlen(line) + 1) FILTER (line_no <= 4) - 1)::BIGINT AS end_byte_exclusive, sha256(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no BETWEEN 2 AND 4)) AS content_sha256
FROM {_LINES} GROUP BY 1 HAVING max(line_no) >= 2"""
)
def q26_line_range(t):
    got = scan.line_range(t("documents"), 2, 4, ("doc_id",))
    return got.withColumns({c: F.col(c).cast("long") for c in ("start_byte", "end_byte_exclusive")})


@query(f"SELECT doc_id, line_no::INTEGER AS line_no, instr(lower(line), 'erst')::INTEGER AS place, substr(line, 1, 2000) AS line FROM {_LINES} WHERE instr(lower(line), 'erst') > 0")
def q27_literal_search(t):
    return scan.search(t("documents"), "erst", keys=("doc_id",))


@query(f"SELECT doc_id, line_no::INTEGER AS line_no FROM {_LINES} WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9_$#])the([^A-Za-z0-9_$#]|$)')")
def q28_references(t):
    return scan.references(t("documents"), "x.the", ("doc_id",)).select("doc_id", "line_no")


_SECRET_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(text, '{p}') THEN {i}"
    for i, p in enumerate(
        [
            r"(?i)authorization\s*:\s*bearer\s+[A-Za-z0-9._~+/=-]{8,}",
            r"(?i)(^|[^A-Za-z0-9_])(api[_-]?key|password|passwd|secret|token)\s*[=:]\s*[''\"]?[^\s,''\"]{6,}",
            r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
        ]
    )
) + " END"


@query(f"SELECT doc_id, ({_SECRET_SQL})::INTEGER AS pattern FROM documents")
def q29_secret_scan(t):
    return t("documents").select("doc_id", sqltext.secret_index(F.col("text")).alias("pattern"))


@query(
    f"""SELECT doc_id, CASE WHEN text IS NULL THEN 'not_in_source' WHEN ({_SECRET_SQL}) IS NOT NULL OR regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') OR regexp_matches(text, '(^|[^0-9])[0-9]{{11}}([^0-9]|$)') THEN 'redacted'
WHEN regexp_full_match(text, '[\\x20-\\x7E\\s]*') AND length(text) <= 1200 THEN 'present' ELSE 'unparsed' END AS state FROM documents"""
)
def q30_redaction(t):
    return t("documents").select("doc_id", sqltext.redacted(F.col("text")).state.alias("state"))


@query("SELECT conv_id, turn, CASE WHEN text IS NULL OR turn % 3 = 0 THEN 'unchanged' WHEN turn % 3 = 1 THEN 'format_only' ELSE 'structural_or_logic' END AS change FROM conversations")
def q31_format_change(t):
    after = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("  \n"), "text")).otherwise(F.concat("text", F.lit(" x")))
    return t("conversations").select("conv_id", "turn", sqltext.text_change(F.col("text"), after).alias("change"))


@query("SELECT sha256(text) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1")
def q32_equal_contents(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query(
    """WITH s AS (SELECT (c_nationkey)::VARCHAR AS schema_name, c_mktsegment || (c_custkey % 40) AS name, c_custkey::VARCHAR AS k FROM customer),
r AS (SELECT s_suppkey, s_nationkey::VARCHAR AS ref_schema, CASE WHEN s_suppkey % 9 = 0 THEN 'NONE' ELSE 'BUILDING' || (s_suppkey % 40) END AS ref_name FROM supplier),
x AS (SELECT schema_name, name, string_agg(k, ',' ORDER BY k) AS l, count(*) AS c FROM s GROUP BY 1, 2), y AS (SELECT name, string_agg(k, ',' ORDER BY k) AS l FROM s GROUP BY 1)
SELECT s_suppkey, coalesce(x.l, y.l, '') AS candidates, CASE WHEN x.c = 1 THEN 'resolved_static' WHEN x.c > 1 OR y.l IS NOT NULL THEN 'candidate' ELSE 'unresolved' END AS resolution,
CASE WHEN x.c = 1 THEN 'exact' WHEN x.c > 1 THEN 'several_exact' WHEN y.l IS NOT NULL THEN 'name_only' ELSE 'not_found' END AS reason
FROM r LEFT JOIN x ON ref_schema = x.schema_name AND ref_name = x.name LEFT JOIN y ON ref_name = y.name"""
)
def q33_resolution(t):
    symbols = t("customer").select(F.col("c_nationkey").cast("string").alias("schema_name"), F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("name"), F.col("c_custkey").cast("string").alias("object_key"))
    refs = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("ref_schema"), F.when(F.col("s_suppkey") % 9 == 0, "NONE").otherwise(F.concat(F.lit("BUILDING"), (F.col("s_suppkey") % 40).cast("string"))).alias("ref_name"))
    return graph.resolved(refs, symbols).select("s_suppkey", F.array_join("candidates", ",").alias("candidates"), "resolution", F.col("how").alias("reason"))


@query(
    """WITH a AS (SELECT o_custkey, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 1)
SELECT a.k AS from_object, b.k AS to_object, 'SPEC_BODY' AS relation FROM a JOIN b USING (o_custkey) UNION ALL SELECT b.k, a.k, 'SPEC_BODY' FROM a JOIN b USING (o_custkey)"""
)
def q34_pairs(t):
    orders = t("orders").select("o_custkey", "o_orderkey")
    return graph.pairs(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query(
    """WITH e AS (SELECT DISTINCT l_partkey AS from_object, l_suppkey AS to_object FROM lineitem), c AS (SELECT p_partkey AS object_key FROM part WHERE p_partkey % 50 = 0)
SELECT DISTINCT object_key, from_object, to_object FROM e JOIN c ON object_key IN (from_object, to_object)"""
)
def q35_attached_edges(t):
    edges = t("lineitem").select(F.col("l_partkey").alias("from_object"), F.col("l_suppkey").alias("to_object")).distinct()
    return graph.attached(edges, t("part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("object_key")))


_EDGES = """e AS (SELECT 'R' || n_regionkey AS f, 'N' || n_nationkey AS t FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer)"""


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'R' || r_regionkey AS node, 0 AS level FROM region WHERE r_regionkey < 2 UNION ALL SELECT e.t, level + 1 FROM w JOIN e ON w.node = e.f WHERE level < 2)
SELECT node, min(level)::INTEGER AS level FROM w GROUP BY 1"""
)
def q36_bounded_search(t):
    edge = lambda df, a, p, b, q: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("from_object"), F.concat(F.lit(q), F.col(b).cast("string")).alias("to_object"))
    edges = edge(t("nation"), "n_regionkey", "R", "n_nationkey", "N").unionByName(edge(t("supplier"), "s_nationkey", "N", "s_suppkey", "S")).unionByName(edge(t("customer"), "c_nationkey", "N", "c_custkey", "C"))
    seeds = t("region").where("r_regionkey < 2").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.reached(edges, seeds)


_LINKS = "l AS (SELECT c_custkey AS name, CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 3 ELSE c_custkey + 1 END AS target FROM customer WHERE c_custkey % 10 <> 6 OR c_custkey % 4 = 0)"


@query(
    f"""WITH RECURSIVE {_LINKS}, w AS (SELECT c_custkey AS start, c_custkey AS last, [c_custkey] AS path, 0 AS hops, NULL::VARCHAR AS code FROM customer
UNION ALL SELECT start, CASE WHEN l.target IS NULL OR list_contains(path, l.target) OR hops = 5 THEN last ELSE l.target END, CASE WHEN l.target IS NULL OR list_contains(path, l.target) OR hops = 5 THEN path ELSE list_append(path, l.target) END,
 CASE WHEN l.target IS NULL OR list_contains(path, l.target) OR hops = 5 THEN hops ELSE hops + 1 END, CASE WHEN l.target IS NULL THEN 'RESOLVED' WHEN list_contains(path, l.target) THEN 'SYNONYM_CYCLE' WHEN hops = 5 THEN 'SYNONYM_HOP_LIMIT' END
 FROM w LEFT JOIN l ON w.last = l.name WHERE code IS NULL)
SELECT start, last, hops, code FROM w WHERE code IS NOT NULL"""
)
def q37_chase(t):
    customers = t("customer").select(F.col("c_custkey").alias("name"))
    links = customers.where("name % 10 <> 6 OR name % 4 = 0").withColumn("target", F.when(F.col("name") % 10 == 0, F.col("name") - 3).otherwise(F.col("name") + 1))
    return graph.chased(links, customers)


@query(
    """WITH RECURSIVE p AS (SELECT event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM events),
w AS (SELECT event_id, parent, 0 AS depth FROM p WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id) UNION ALL SELECT p.event_id, p.parent, depth + 1 FROM w JOIN p ON w.parent = p.event_id)
SELECT event_id, depth::INTEGER AS depth FROM w"""
)
def q38_first_parents(t):
    from deltaloom.plans.history import first_parents
    from pyspark.sql import Window

    events = t("events").select("user_id", "event_id")
    commits = events.withColumn("parent", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    heads = events.groupBy("user_id").agg(F.max("event_id").alias("head")).select("head")
    return first_parents(commits.select(F.col("event_id").alias("sha"), "parent"), heads).select(F.col("sha").alias("event_id"), "depth")


@query(
    """WITH h AS (SELECT o_custkey, count(*) AS hits FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
p AS (SELECT c_custkey, c_nationkey * 1000 + c_custkey % 200 AS grp FROM customer), j AS (SELECT p.*, coalesce(hits, 0) AS hits FROM p LEFT JOIN h ON c_custkey = o_custkey),
g AS (SELECT grp FROM j GROUP BY 1 HAVING min(hits) = 1 AND max(hits) = 1)
SELECT c_custkey, grp::INTEGER AS grp, o_orderkey FROM p JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0) ON c_custkey = o_custkey WHERE grp IN (SELECT grp FROM g)"""
)
def q39_for_all(t):
    parts = t("customer").select("c_custkey", (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 200).cast("int").alias("grp"))
    targets = t("orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return graph.for_all(parts, targets, "grp", ["c_custkey"])


@query(
    """WITH c AS (SELECT l_orderkey, l_partkey % 50 AS r, count(*) AS args FROM lineitem GROUP BY 1, 2), s AS (SELECT DISTINCT p_size AS r, p_partkey % 4 AS n FROM part WHERE p_partkey % 3 = 0),
j AS (SELECT l_orderkey, c.r, args, sum(CASE WHEN args <= n AND args >= floor(n / 2) THEN 1 ELSE 0 END) AS fitting, count(n) AS shapes FROM c LEFT JOIN s ON c.r = s.r GROUP BY 1, 2, 3)
SELECT l_orderkey, r, CASE WHEN shapes = 0 THEN 'definition_unresolved' WHEN fitting = 0 THEN 'incompatible_arity_or_names' WHEN fitting = 1 THEN 'arity_name_compatible_type_unresolved' ELSE 'overload_candidate' END AS binding FROM j"""
)
def q40_arity(t):
    calls = t("lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 50).alias("r")).agg(F.count("*").cast("int").alias("positional")).withColumns({"named": F.array().cast("array<string>"), "ordered": F.lit(True)})
    n = (F.col("p_partkey") % 4).cast("int")
    shapes = t("part").where("p_partkey % 3 = 0").select(F.col("p_size").cast("long").alias("r"), n.alias("n")).distinct().select("r", F.slice(F.array(*[F.lit(f"P{i}") for i in range(4)]), F.lit(1), F.col("n")).alias("names"), F.floor(F.col("n") / 2).cast("int").alias("required"))
    return graph.bound_calls(calls, shapes, ["r"]).select("l_orderkey", "r", "binding")


@query(
    """WITH o AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 7 <> 0),
j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.quality AS q1, n.quality AS q2, o.toxic AS t1, n.toxic AS t2 FROM o FULL JOIN n ON o.doc_id = n.doc_id)
SELECT doc_id, 'quality' AS field, q1::VARCHAR AS before, q2::VARCHAR AS after FROM j WHERE q1 IS DISTINCT FROM q2 UNION ALL SELECT doc_id, 'toxic', t1::VARCHAR, t2::VARCHAR FROM j WHERE t1 IS DISTINCT FROM t2"""
)
def q41_compared(t):
    labels = t("labels")
    return diff.compared(base(labels, "doc_id"), target(labels, "doc_id", quality=1 - F.col("quality")), "doc_id", ["quality", "toxic"])


@query(
    """WITH s AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
m AS (SELECT user_id, count(*) FILTER (before IS DISTINCT FROM event_type) AS transitions, arg_min(event_type, event_id) AS f, arg_max(event_type, event_id) AS l FROM s GROUP BY 1)
SELECT user_id, transitions, f IS DISTINCT FROM l AS net FROM m"""
)
def q42_history_or_net(t):
    from deltaloom.plans.history import transitions

    return transitions(t("events").select(F.col("user_id").alias("path"), F.col("event_id").alias("position"), F.col("event_type").alias("oid"))).withColumnRenamed("path", "user_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0) v WHERE v.doc_id = d.doc_id AND v.h = sha256(d.text))")
def q43_resume(t):
    from deltaloom.state.cache import remaining

    units = t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    done = t("documents").where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return remaining(units, done, ["doc_id", "digest"]).select("doc_id")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) - INTERVAL 10 DAY FROM events) AND event_id % 13 <> 0")
def q44_retention(t):
    from deltaloom.state.cache import expired

    events = t("events").select("event_id", "ts")
    protected = events.where("event_id % 13 = 0").select("event_id")
    return expired(events, "ts", protected, "event_id", days=10).select("event_id")


@query(
    """SELECT 'V1' AS rule, (l_orderkey * 10 + l_linenumber % 6)::VARCHAR AS subject FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber % 6 HAVING count(*) > 1
UNION ALL SELECT 'V3', o_orderkey::VARCHAR FROM orders WHERE o_custkey % 97 = 0 UNION ALL SELECT 'V8', p_partkey::VARCHAR FROM part WHERE NOT (p_size <= 45)"""
)
def q45_integrity(t):
    evidence = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber") % 6).alias("evidence_id"))
    registry = t("customer").where("c_custkey % 97 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return validate.violations(
        validate.duplicates(evidence, "evidence_id", "V1"), validate.dangling(t("orders"), registry, ["o_custkey"], "V3", F.col("o_orderkey")), validate.broken(t("part"), F.col("p_size") <= 45, "V8", F.col("p_partkey"))
    )


def _part_ddl(t) -> DataFrame:
    """One file a part: a comment, a sequence and a table, with names and numbers from the part's columns."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("-- CREATE TABLE not.this (\n"), F.lit("CREATE SEQUENCE app.s_"), k, F.lit(" START WITH "), F.col("p_size").cast("string"), F.lit(" CACHE 20;\n"),
        F.lit("CREATE TABLE app.\"T "), k, F.lit("\" (id NUMBER("), (F.col("p_size") % 38 + 1).cast("string"), F.lit(",2) NOT NULL, name VARCHAR2("), F.col("p_size").cast("string"), F.lit(" CHAR) DEFAULT q'[a,b;'c]');\n"),
    )
    return t("part").select(F.col("p_partkey").alias("path"), "p_size", text.alias("text"))


@query(
    """WITH d AS (SELECT p_partkey, p_size, '-- CREATE TABLE not.this (' || chr(10) AS a, 'CREATE SEQUENCE app.s_' || p_partkey || ' START WITH ' || p_size || ' CACHE 20;' || chr(10) AS b,
'CREATE TABLE app."T ' || p_partkey || '" (id NUMBER(' || (p_size % 38 + 1) || ',2) NOT NULL, name VARCHAR2(' || p_size || ' CHAR) DEFAULT q''[a,b;''c]'');' || chr(10) AS c FROM part)
SELECT p_partkey AS path, 1 AS ordinal, 'SCHEMA|APP|SEQUENCE|S_' || p_partkey AS object_key, length(a)::INTEGER AS start_char, length(a || b)::INTEGER AS end_char, 2 AS start_line, 2 AS end_line, sha256(b) AS fragment_sha256 FROM d
UNION ALL SELECT p_partkey, 2, 'SCHEMA|APP|TABLE|T ' || p_partkey, length(a || b)::INTEGER, length(a || b || c)::INTEGER, 3, 3, sha256(c) FROM d"""
)
def q46_scan(t):
    return scan.occurrences(_part_ddl(t)).select("path", "ordinal", "object_key", "start_char", "end_char", "start_line", "end_line", "fragment_sha256")


@query("SELECT p_partkey AS path, p_size::VARCHAR AS start_with, 'CACHE 20' AS cache, NULL::VARCHAR AS increment_by FROM part")
def q47_sequence_options(t):
    found = scan.occurrences(_part_ddl(t)).where("object_type = 'SEQUENCE'")
    return extract.sequence_options(found).select("path", "start_with", "cache", "increment_by")


@query(
    """SELECT p_partkey AS definition, 'U:ID' AS component, '1' AS position, 'NUMBER(' || (p_size % 38 + 1) || ',2)' AS data_type, NULL::VARCHAR AS length, (p_size % 38 + 1)::VARCHAR AS precision, '2' AS scale, 'NOT NULL' AS nullable, NULL::VARCHAR AS "default" FROM part
UNION ALL SELECT p_partkey, 'U:NAME', '2', 'VARCHAR2(' || p_size || ' CHAR)', p_size::VARCHAR, NULL, NULL, NULL, 'q''[a,b;''c]''' FROM part"""
)
def q48_table_columns(t):
    found = scan.occurrences(_part_ddl(t)).where("object_type = 'TABLE'").select(F.col("path").alias("definition"), "fragment")
    return extract_tables.columns(found).select("definition", "component", "position", "data_type", "length", "precision", "scale", "nullable", "default")


def _value_facts(t) -> DataFrame:
    """Facts made from parts: families and values by arithmetic on the key."""
    k = F.col("p_partkey")
    family = F.element_at(F.array(*[F.lit(f) for f in _FAMILIES]), (k % len(_FAMILIES) + 1).cast("int"))
    return t("part").select(
        k.cast("string").alias("object_key"), family.alias("family"), F.lit("c").alias("component"), F.when(k % 2 == 0, "NOT NULL").otherwise("NULL").alias("after"), F.lit("x").alias("before"), (k % 3 == 0).alias("context_only")
    )


_FAMILIES = ["table.column.nullable", "table.column.length", "table.constraint.kind", "index.index_property.keys", "view.query_property.where", "sequence.sequence_property.cache", "common.source.format"]
_FAMILY_SQL = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FAMILIES)) + " END"


@query(
    f"""WITH f AS (SELECT p_partkey::VARCHAR AS object_key, {_FAMILY_SQL} AS family, p_partkey FROM part)
SELECT * FROM (SELECT object_key, family, 'c' AS component, CASE WHEN family = 'table.column.nullable' AND p_partkey % 2 = 0 THEN 'NULL_DATA_CHECK' WHEN family = 'table.column.length' THEN 'COLUMN_COMPATIBILITY_CHECK'
 WHEN family LIKE 'table.constraint.%' THEN 'CONSTRAINT_DATA_CHECK' WHEN family LIKE 'index.%' THEN 'INDEX_PLAN_CHECK' WHEN family LIKE 'view.%' THEN 'CONSUMER_REGRESSION_CHECK' END AS code FROM f)
WHERE code IS NOT NULL ORDER BY object_key, family, component LIMIT 200"""
)
def q49_deployment_checks(t):
    return rollup.deployment_checks(_value_facts(t))


_KINDS = ["TABLE", "INDEX", "VIEW", "PACKAGE_BODY", "SEQUENCE", "ROLE"]


@query(
    """WITH o AS (SELECT c_custkey::VARCHAR AS object_key, CASE c_custkey % 6 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'INDEX' WHEN 2 THEN 'VIEW' WHEN 3 THEN 'PACKAGE_BODY' WHEN 4 THEN 'SEQUENCE' ELSE 'ROLE' END AS kind, c_custkey % 4 = 0 AS added, c_custkey % 5 = 0 AS con FROM customer),
r AS (SELECT object_key, 1 AS n, 'SOURCE_REFERENCES' AS code FROM o WHERE added UNION ALL SELECT object_key, 2, 'COLUMN_CONTRACT' FROM o WHERE kind = 'TABLE' AND (NOT added) UNION ALL SELECT object_key, 3, 'CONSTRAINT_REFERENCES' FROM o WHERE kind = 'TABLE' AND con
 UNION ALL SELECT object_key, 4, CASE kind WHEN 'INDEX' THEN 'INDEX_DEFINITION' WHEN 'VIEW' THEN 'QUERY_DEFINITION' WHEN 'PACKAGE_BODY' THEN 'CALL_SIGNATURE' WHEN 'SEQUENCE' THEN 'SEQUENCE_DEFINITION' ELSE 'MANUAL_SOURCE_REVIEW' END FROM o WHERE kind <> 'TABLE')
SELECT object_key, (row_number() OVER (PARTITION BY object_key ORDER BY n) - 1)::INTEGER AS rank, code FROM r"""
)
def q50_recommended_checks(t):
    k = F.col("c_custkey")
    objects = t("customer").select(k.cast("string").alias("object_key"), F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 6 + 1).cast("int")).alias("object_type"), F.when(k % 4 == 0, "added").otherwise("modified").alias("operation"))
    families = t("customer").where("c_custkey % 5 = 0").select(k.cast("string").alias("object_key"), F.array(F.lit("table.constraint.kind")).alias("families"))
    return rollup.recommended_checks(objects, families)


_PACKAGE_NAME = "CASE WHEN {0} % 3 = 0 THEN 'A' || {0} % 50 ELSE 'U' || {0} END"


@query(
    f"""WITH pk AS (SELECT {_PACKAGE_NAME.format('p_partkey')} AS name, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1),
al AS (SELECT DISTINCT {_PACKAGE_NAME.format('p_partkey')} AS name FROM part WHERE p_partkey % 10 = 0)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = 1 THEN 'resolved_static' WHEN n > 1 THEN 'candidate' WHEN al.name IS NOT NULL AND l_suppkey % 7 < 3 THEN 'resolved_static' ELSE 'unresolved' END AS resolution
FROM lineitem LEFT JOIN pk ON pk.name = {_PACKAGE_NAME.format('l_partkey')} LEFT JOIN al ON al.name = {_PACKAGE_NAME.format('l_partkey')}"""
)
def q51_call_resolution(t):
    name = lambda c: F.expr(_PACKAGE_NAME.format(c))
    calls = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("S").alias("ref_schema"), name("l_partkey").alias("ref_name"), name("l_partkey").alias("alone_schema"), (F.col("l_suppkey") % 7).cast("string").alias("routine"))
    packages = t("part").where("p_partkey % 5 <> 0").select(F.lit("S").alias("schema_name"), name("p_partkey").alias("name"), F.col("p_partkey").cast("string").alias("object_key"))
    alone = t("part").where("p_partkey % 10 = 0").select(name("p_partkey").alias("schema_name")).distinct().select("schema_name", F.explode(F.array(*[F.lit(str(i)) for i in range(3)])).alias("name"))
    alone = alone.withColumn("object_key", F.concat_ws(".", "schema_name", "name"))
    return graph.resolved_calls(calls, packages, alone).select("l_orderkey", "l_linenumber", "l_partkey", "resolution")


@query(
    """WITH e AS (SELECT DISTINCT (l_orderkey % 40)::VARCHAR AS object_key, l_returnflag AS side, CASE l_linenumber % 6 WHEN 0 THEN 'WRITE' WHEN 1 THEN 'READ' WHEN 2 THEN 'CALL' WHEN 3 THEN 'TYPE_REF' WHEN 4 THEN 'FK_REF' ELSE 'SYNONYM_TO' END AS relation, l_partkey::VARCHAR AS from_object, l_suppkey::VARCHAR AS to_object FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY object_key, side ORDER BY CASE relation WHEN 'TYPE_REF' THEN 0 WHEN 'FK_REF' THEN 1 WHEN 'WRITE' THEN 2 WHEN 'READ' THEN 3 WHEN 'CALL' THEN 4 ELSE 5 END, to_object, from_object, relation) AS rank, greatest(count(*) OVER (PARTITION BY object_key, side) - 8, 0) AS omitted FROM e)
SELECT object_key, side, relation, from_object, to_object, rank::INTEGER AS rank, omitted::BIGINT AS omitted FROM n WHERE rank <= 8"""
)
def q52_context_selection(t):
    relation = F.element_at(F.array(*[F.lit(x) for x in ("WRITE", "READ", "CALL", "TYPE_REF", "FK_REF", "SYNONYM_TO")]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    edges = t("lineitem").select((F.col("l_orderkey") % 40).cast("string").alias("object_key"), F.col("l_returnflag").alias("side"), relation.alias("relation"), F.col("l_partkey").cast("string").alias("from_object"), F.col("l_suppkey").cast("string").alias("to_object")).distinct()
    return graph.selected_context(edges)


@query("WITH c AS (SELECT p_partkey, p_size <= 5 AS lim FROM part), s AS (SELECT * FROM c ORDER BY (NOT lim)::INT, p_partkey LIMIT 120) SELECT p_partkey FROM s")
def q53_slots(t):
    parts = t("part").select("p_partkey", (F.col("p_size") <= 5).alias("limited"))
    return ranking.slots(parts, F.col("limited"), "p_partkey", 120).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def q54_cursor_page(t):
    return ranking.page_after(t("events").select("event_id"), "event_id", 500, 100)


@query("WITH m AS (SELECT max(level) AS l FROM (SELECT CASE WHEN p_size > 45 THEN 3 ELSE 2 END AS level FROM part)) SELECT level, types FROM (SELECT CASE WHEN p_size > 45 THEN 'high' ELSE 'low' END AS level, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS types FROM part GROUP BY 1)")
def q55_risk_basis(t):
    levels = t("part").select(F.when(F.col("p_size") > 45, "high").otherwise("low").alias("level"), F.col("p_brand").alias("object_type"))
    return rollup.risk_basis(levels)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'INCOMPLETE_SOURCE_INVENTORY' WHEN o_orderkey % 3 = 0 THEN 'CONFLICTING_DEFINITIONS' WHEN o_orderkey % 5 = 0 THEN 'SECRET_IN_MANDATORY_SOURCE' WHEN o_totalprice > 200000 THEN 'MANDATORY_CONTEXT_EXCEEDS_BUDGET' ELSE 'ready' END AS status,
CASE WHEN o_orderstatus = 'P' THEN 'unresolved' WHEN o_orderkey % 4 = 0 THEN 'limited' ELSE 'verified' END AS coverage FROM orders"""
)
def q56_object_status(t):
    k = F.col("o_orderkey")
    status = rollup.status_of(k % 2 == 0, k % 3 == 0, k % 5 == 0, F.col("o_totalprice") > 200000)
    return t("orders").select("o_orderkey", status.alias("status"), rollup.coverage(F.col("o_orderstatus") != "P", k % 4 == 0).alias("coverage"))


@query("SELECT p_partkey, regexp_replace(reverse(regexp_replace(reverse((p_partkey * 98765)::VARCHAR), '([0-9]{3})', '\\1.', 'g')), '^\\.', '') AS shown FROM part")
def q57_grouped_digits(t):
    return t("part").select("p_partkey", identity.grouped_digits((F.col("p_partkey") * 98765).cast("string")).alias("shown"))


@query("SELECT c_custkey, 'SCHEMA|N' || c_nationkey || '|TABLE|' || upper(c_mktsegment) || '|U:' || upper(c_mktsegment) AS k, 'id_' || sha256('{\"name\":\"' || c_mktsegment || '\",\"nation\":' || c_nationkey || ',\"none\":null}') AS id FROM customer")
def q58_identities(t):
    name = identity.canonical_name(F.col("c_mktsegment"), F.lit(False))
    schema = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    key = identity.object_key(F.lit("SCHEMA"), schema, F.lit("table"), name, identity.component_key(F.col("c_mktsegment")))
    return t("customer").select("c_custkey", key.alias("k"), identity.stable_id("id", nation=F.col("c_nationkey"), name=F.col("c_mktsegment"), none=F.lit(None).cast("string")).alias("id"))


def _index_ddl(t) -> DataFrame:
    """One index and one view a part."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    index = F.concat(F.lit("CREATE UNIQUE INDEX app.i"), k, F.lit(" ON app.t"), size, F.lit(" (NVL(a, 'x,"), size, F.lit("'), b DESC) TABLESPACE ts"), size, F.lit(" INVISIBLE;"))
    distinct = F.when(F.col("p_size") % 3 == 0, "DISTINCT ").otherwise("")
    joined = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" LEFT JOIN u ON t.x = "), size)).otherwise("")
    view = F.concat(F.lit("CREATE VIEW app.v"), k, F.lit(" AS SELECT "), distinct, F.lit("a, b"), size, F.lit(" FROM t"), size, joined, F.lit(" WHERE a = 'FROM z' GROUP BY b"), size)
    return t("part").select(F.col("p_partkey").alias("definition"), index.alias("index"), view.alias("view"))


@query("SELECT p_partkey AS definition, 'app.t' || p_size AS target, 'UNIQUE' AS \"unique\", 'NORMAL' AS kind, '[\"NVL(a, ''x,' || p_size || ''')\",\"b\"]' AS keys, '[\"\",\"DESC\"]' AS directions, 'INVISIBLE' AS visibility, 'TABLESPACE ts' || p_size AS tablespace FROM part")
def q59_indexes(t):
    found = extract.indexes(_index_ddl(t).select("definition", F.col("index").alias("fragment")))
    return found.select("definition", "target", "unique", "kind", "keys", "directions", "visibility", F.col("properties")["tablespace"].alias("tablespace"))


@query(
    """SELECT p_partkey AS definition, x.property AS property, x.value AS value FROM (SELECT p_partkey, unnest([{'property': 'projection', 'value': '["a","b' || p_size || '"]'}, {'property': 'source_references', 'value': 'FROM t' || p_size || CASE WHEN p_size % 2 = 0 THEN ' LEFT JOIN u ON t.x = ' || p_size ELSE '' END},
{'property': 'where', 'value': 'WHERE a = ''FROM z'''}, {'property': 'group_by', 'value': 'GROUP BY b' || p_size}, {'property': 'join', 'value': CASE WHEN p_size % 2 = 0 THEN 'LEFT JOIN u ON t.x = ' || p_size END}, {'property': 'distinct', 'value': CASE WHEN p_size % 3 = 0 THEN 'DISTINCT' END}]) AS x FROM part) WHERE x.value IS NOT NULL"""
)
def q60_views(t):
    return extract.views(_index_ddl(t).select("definition", F.col("view").alias("fragment"))).select("definition", "property", "value")


def _package_ddl(t) -> DataFrame:
    k, size = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(
        F.lit("CREATE PACKAGE BODY p"), k, F.lit(" AS PROCEDURE run"), size, F.lit("(a IN NUMBER, b OUT VARCHAR2) IS BEGIN UPDATE t"), size, F.lit(" SET x = a; EXECUTE IMMEDIATE 'DELETE FROM t"), size, F.lit("'; COMMIT; END; END;")
    )
    return t("supplier").select(F.col("s_suppkey").alias("definition"), "s_nationkey", text.alias("fragment"))


@query("SELECT s_suppkey AS definition, 'PROCEDURE' AS kind, 'RUN' || s_nationkey AS name, 'PROCEDURE run' || s_nationkey || '(a IN NUMBER, b OUT VARCHAR2)' AS signature, 2 AS parameters, 'OUT' AS second_mode FROM supplier")
def q61_routines(t):
    found = extract.routines(_package_ddl(t))
    return found.select("definition", "kind", "name", "signature", F.size("parameters").alias("parameters"), F.col("parameters")[1]["mode"].alias("second_mode"))


@query(
    """SELECT s_suppkey AS definition, x.family AS family, x.statement AS statement, CASE WHEN x.family = 'dynamic_sql' THEN 'mode=literal,target=static,bind=no,concat=no,validation=not_applicable,loop=no' END AS profile FROM (SELECT s_suppkey,
unnest([{'family': 'sql_statement', 'statement': 'UPDATE t' || s_nationkey || ' SET x = a'}, {'family': 'dynamic_sql', 'statement': 'EXECUTE IMMEDIATE ''DELETE FROM t' || s_nationkey || ''''}, {'family': 'transaction_statement', 'statement': 'COMMIT'}]) AS x FROM supplier)"""
)
def q62_body_facts(t):
    found = extract.body_facts(_package_ddl(t))
    profile = F.when(F.col("family") == "dynamic_sql", extract.dynamic_profile(F.col("statement")))
    return found.select("definition", "family", "statement", profile.alias("profile"))


@query("SELECT DISTINCT s_suppkey::VARCHAR AS from_object, 'WRITE' AS relation, 'APP' AS ref_schema, 'T' || s_nationkey AS ref_name FROM supplier")
def q63_references(t):
    rows = _package_ddl(t).select(F.col("definition").cast("string").alias("object_key"), F.lit("APP").alias("schema_name"), F.col("fragment").alias("source"))
    return graph.references(rows).select("from_object", "relation", "ref_schema", "ref_name")


@query(
    """WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CREATE SEQUENCE s' || p_partkey || ' CACHE 2;' || chr(13) || chr(10) WHEN 1 THEN 'SET x' || chr(10) || 'CREATE TABLE t (a NUMBER);' || chr(10) || 'CREATE VIEW v AS SELECT 1 FROM t;' WHEN 2 THEN 'GRANT a TO b;' ELSE 'CREATE TABLE t (a VARCHAR2(9) DEFAULT ''é' END AS text FROM part)
SELECT p_partkey, strlen(text)::BIGINT AS bytes, 'utf-8' AS encoding, CASE p_partkey % 4 WHEN 0 THEN 'CRLF' WHEN 1 THEN 'LF' ELSE 'NONE' END AS newline_style, CASE p_partkey % 4 WHEN 0 THEN 'parsed' WHEN 2 THEN 'unresolved' ELSE 'limited' END AS parse_status,
CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS objects, CASE p_partkey % 4 WHEN 1 THEN 5 WHEN 2 THEN 13 ELSE 0 END AS unresolved_bytes,
CASE p_partkey % 4 WHEN 0 THEN '' WHEN 3 THEN 'UNTERMINATED_SINGLE' ELSE 'UNRESOLVED_PREFIX_OR_ARTIFACT' END AS diagnostics FROM d"""
)
def q64_file_inventory(t):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("CREATE SEQUENCE s"), k.cast("string"), F.lit(" CACHE 2;\r\n"))).when(k % 4 == 1, "SET x\nCREATE TABLE t (a NUMBER);\nCREATE VIEW v AS SELECT 1 FROM t;")
    text = text.when(k % 4 == 2, "GRANT a TO b;").otherwise("CREATE TABLE t (a VARCHAR2(9) DEFAULT 'é")
    found = scan.file_inventory(t("part").select("p_partkey", text.cast("binary").alias("raw")), ("p_partkey",))
    return found.select("p_partkey", F.col("bytes").cast("long").alias("bytes"), "encoding", "newline_style", "parse_status", "objects", "unresolved_bytes", F.array_join("diagnostics", ",").alias("diagnostics"))


#: The same chains by the name they had while q38 was bounded.
QUERIES["q65_whole_first_parents"], SQL["q65_whole_first_parents"] = QUERIES["q38_first_parents"], SQL["q38_first_parents"]


def _altered_files(t) -> DataFrame:
    """(path, text): one file with a table a customer, and one file with a statement about a customer's table an order."""
    k, c = F.col("o_orderkey").cast("string"), F.concat(F.lit("a.t"), F.col("o_custkey").cast("string"))
    kind = F.col("o_orderkey") % 5
    null = F.when(F.col("o_orderkey") % 2 == 0, "NULL").otherwise("NOT NULL")
    text = (
        F.when(kind == 0, F.concat(F.lit("ALTER TABLE "), c, F.lit(" ADD (x"), k, F.lit(" NUMBER("), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(") NOT NULL);")))
        .when(kind == 1, F.concat(F.lit("ALTER TABLE "), c, F.lit(" MODIFY c "), null, F.lit(";")))
        .when(kind == 2, F.concat(F.lit("COMMENT ON COLUMN "), c, F.lit(".c IS '"), "o_orderpriority", F.lit("';")))
        .when(kind == 3, F.concat(F.lit("ALTER TABLE "), c, F.lit(" MODIFY c DEFAULT "), k, F.lit(";")))
        .otherwise(F.concat(F.lit("ALTER TABLE "), c, F.lit(" DROP (c, d);")))
    )
    created = F.concat(F.lit("CREATE TABLE a.t"), F.col("c_custkey").cast("string"), F.lit(" (c NUMBER, d DATE, CONSTRAINT k UNIQUE (d));\n"))
    made = base(t("customer"), "c_custkey").select(F.concat(F.lit("t/"), F.col("c_custkey").cast("string"), F.lit(".sql")).alias("path"), created.alias("text"))
    return made.union(t("orders").select(F.concat(F.lit("z/"), F.lpad(k, 20, "0"), F.lit(".sql")), text))


@query(
    """WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS said FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 11 <> 0), m AS (SELECT c_custkey, (SELECT arg_max(CASE WHEN k % 2 = 0 THEN 'NULL' ELSE 'NOT NULL' END, k) FROM s WHERE c = c_custkey AND k % 5 = 1) AS nullable,
(SELECT arg_max(k::VARCHAR, k) FROM s WHERE c = c_custkey AND k % 5 = 3) AS def, (SELECT arg_max(chr(39) || said || chr(39), k) FROM s WHERE c = c_custkey AND k % 5 = 2) AS said,
(SELECT count(*) FROM s WHERE c = c_custkey AND k % 5 = 4) AS refused FROM customer WHERE c_custkey % 11 <> 0)
SELECT c_custkey AS customer, 'U:C' AS component, 1 AS position, 'NUMBER' AS data_type, nullable, def AS default_value, said AS comment_text, refused > 0 AS refused FROM m
UNION ALL SELECT c_custkey, 'U:D', 2, 'DATE', NULL, NULL, NULL, refused > 0 FROM m
UNION ALL SELECT c, 'U:X' || k, 2 + row_number() OVER (PARTITION BY c ORDER BY k), 'NUMBER(' || k % 9 + 1 || ')', 'NOT NULL', NULL, NULL, (SELECT refused > 0 FROM m WHERE c_custkey = c) FROM s WHERE k % 5 = 0"""
)
def q66_altered_tables(t):
    """Tables as the statements of other files leave them: all of them, joined by name and replayed in order."""
    files = _altered_files(t)
    found, _ = replay.with_contexts(scan.occurrences(files), files)
    found = found.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("definition"), replay.with_statements(F.col("fragment"), F.col("context")).alias("fragment"))
    found = dealt(found)
    heads = dealt(statements.heads(found))
    got = replay.replayed(found, code_tokens(heads), heads=heads)
    refused = got.diagnostics.where("code = 'ALTER_TABLE_DROP_UNSUPPORTED'").select("definition", F.lit(True).alias("refused")).distinct()
    rows = got.columns.join(got.comments.withColumnRenamed("value", "comment_text"), ["definition", "component"], "left").join(refused, "definition", "left")
    return rows.select(F.col("definition").alias("customer"), "component", F.col("position").cast("int").alias("position"), "data_type", "nullable", F.col("default").alias("default_value"), "comment_text", F.coalesce("refused", F.lit(False)).alias("refused"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS said, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 11 <> 0),
s AS (SELECT * FROM o WHERE r <= 12), a AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT a.o_orderkey AS file, CASE WHEN c_custkey IS NULL OR a.o_custkey % 11 = 0 THEN 'UNKNOWN_TABLE' WHEN s.k IS NULL THEN 'TOO_MANY_STATEMENTS' ELSE 'taken' END AS reason FROM a LEFT JOIN customer ON c_custkey = a.o_custkey LEFT JOIN s ON s.k = a.o_orderkey"""
)
def q67_files_of_statements(t):
    """Which files of statements are taken where a table takes twelve, and why the others are not: a row for each file."""
    files = _altered_files(t)
    _, said = replay.with_contexts(scan.occurrences(files), files, most=replay.MOST)
    return said.select(F.regexp_extract("path", "0*([0-9]+)", 1).cast("long").alias("file"), F.coalesce("reason", F.lit("taken")).alias("reason"))


@query(
    """SELECT p_partkey AS part, unnest(CASE p_partkey % 8 WHEN 0 THEN ['DUPLICATE_COLUMN'] WHEN 1 THEN ['COLUMN_UNRESOLVED'] WHEN 2 THEN ['EMPTY_TABLE_ITEM'] WHEN 3 THEN ['TABLE_BODY_UNBALANCED'] WHEN 4 THEN ['TABLE_DEFINITION_UNRESOLVED']
WHEN 5 THEN ['UNNAMED_CONSTRAINT_UNRESOLVED'] WHEN 6 THEN CASE WHEN p_size % 2 = 0 THEN ['ALTER_COLUMN_PARTIAL_UNRESOLVED', 'TABLE_CONTEXT_UNSUPPORTED'] ELSE ['TABLE_CONTEXT_UNSUPPORTED'] END ELSE [] END) AS code FROM part"""
)
def q68_table_diagnostics(t):
    """What extraction doubts of a table a part, by code."""
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    body = F.when(k == 0, F.concat(F.lit(" (a NUMBER("), size, F.lit("), a DATE);"))).when(k == 1, F.concat(F.lit(" (a NUMBER, b"), size, F.lit(");"))).when(k == 2, " (a NUMBER,, b DATE);").when(k == 3, " (a NUMBER;").when(k == 4, ";")
    body = body.when(k == 5, " (a NUMBER, PRIMARY KEY (a));").when(k == 6, F.concat(F.lit(" (a NUMBER); GRANT SELECT ON t TO x;"), F.when(F.col("p_size") % 2 == 0, " ALTER TABLE t MODIFY a DEFAULT 1 NOT NULL;").otherwise(""))).otherwise(" (a NUMBER, b DATE);")
    rows = t("part").select(F.col("p_partkey").alias("definition"), F.concat(F.lit("CREATE TABLE t"), body).alias("fragment"))
    return replay.replayed(rows, code_tokens(rows)).diagnostics.select(F.col("definition").alias("part"), "code").distinct()


def _changes(t) -> DataFrame:
    """Lines as the files that commits (orders) changed."""
    line, zero = F.col("l_linenumber"), F.lit("0" * 40)
    status = F.element_at(F.array(*[F.lit(x) for x in "ADMT"]), (F.col("l_partkey") % 4 + 1).cast("int"))
    blob = lambda c: F.sha1(F.col(c).cast("string").cast("binary"))
    return t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("sha"), (F.col("l_orderkey") - 1).cast("string").alias("parent"), (line - 1).cast("int").alias("position"), F.lit("100644").alias("old_mode"), F.lit("100644").alias("new_mode"),
        F.when(status == "A", zero).otherwise(blob("l_suppkey")).alias("old_oid"), F.when(status == "D", zero).otherwise(blob("l_partkey")).alias("new_oid"), status.alias("status"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path_b64"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path_display"),
    )


_OPERATION = "CASE l_partkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'unknown' END"


@query(
    f"""SELECT o_orderkey AS sha, CASE WHEN o_orderkey % 5 = 0 THEN 'root' ELSE 'first_parent' END AS delta_kind, CASE WHEN o_orderkey % 3 = 0 THEN 'target_first_parent_chain' ELSE 'other_reachable' END AS integration_role,
coalesce(string_agg('p' || l_partkey || ':' || {_OPERATION} || ':' || CASE WHEN l_partkey % 4 = 0 THEN '' ELSE left(sha1(l_suppkey::VARCHAR), 6) END, ',' ORDER BY l_linenumber, 'p' || l_partkey, sha1(l_suppkey::VARCHAR)), '') AS files FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def q69_commit_files(t):
    """Orders as commits, lines as the files of each, nested in order."""
    k = F.col("o_orderkey")
    commits = t("orders").select(k.cast("string").alias("sha"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((k - 1).cast("string"))).alias("parents"))
    found = history.commit_files(commits, _changes(t), commits.where("sha % 3 = 0"))
    shown = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["path_b64"], f["operation"], F.coalesce(F.substring(f["old_blob"], 1, 6), F.lit("")))), ",")
    return found.select(F.col("sha").cast("long").alias("sha"), "delta_kind", "integration_role", shown.alias("files"))


@query(
    f"""WITH c AS (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN repeat('0', 40) ELSE sha1(l_suppkey::VARCHAR) END AS old, CASE WHEN l_partkey % 4 = 1 THEN repeat('0', 40) ELSE sha1(l_partkey::VARCHAR) END AS new FROM lineitem)
SELECT 'event_' || sha256('{{"commit":"' || l_orderkey || '","new_blob":"' || new || '","old_blob":"' || old || '","path":"p' || l_partkey || '","position":' || l_linenumber - 1 || '}}') AS event_id, l_orderkey AS commit_sha, l_orderkey - 1 AS parent_sha, 'p' || l_partkey AS path, {_OPERATION} AS operation FROM c"""
)
def q70_history_events(t):
    found = history.events(_changes(t))
    return found.select("event_id", F.col("commit_sha").cast("long").alias("commit_sha"), F.col("parent_sha").cast("long").alias("parent_sha"), F.col("path_b64").alias("path"), "operation")


@query(
    """WITH v AS (SELECT 'p' || l_partkey AS path, max(l_partkey % 3) AS m, list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber <= 4))) AS codes, max((l_partkey % 7 = 0)::INT) AS bad, l_partkey FROM lineitem GROUP BY l_partkey)
SELECT path, CASE WHEN l_partkey % 5 = 0 THEN 'unchanged' ELSE 'modified' END AS net_operation, CASE WHEN bad = 1 THEN 'unresolved' WHEN codes IS NULL THEN 'metadata_only' ELSE 'parsed' END AS parse_status, coalesce(array_to_string(codes, ','), '') AS codes FROM v"""
)
def q71_artifacts(t):
    """Parts as the paths that a range touched, with net changes and the codes of their inventories."""
    path = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    net = t("lineitem").where("l_partkey % 5 <> 0").select(path.alias("path_b64"), F.lit("M").alias("status"), *[F.lit("1").alias(c) for c in ("old_mode", "new_mode", "old_oid", "new_oid")]).distinct()
    inventories = t("lineitem").where("l_linenumber <= 4").select(path.alias("path_b64"), F.array("l_returnflag").alias("diagnostics"))
    incomplete = t("lineitem").where("l_partkey % 7 = 0").select(path.alias("path_b64"))
    found = history.artifacts(_changes(t), net, inventories, incomplete)
    return found.select(F.col("path_b64").alias("path"), "net_operation", "parse_status", F.array_join("diagnostic_codes", ",").alias("codes"))


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, (CASE WHEN l_suppkey % 3 = 0 THEN '-' ELSE '' END) || l_partkey || lpad(l_suppkey::VARCHAR, 28, '0') AS b, (CASE WHEN l_partkey % 4 = 0 THEN '-' WHEN l_partkey % 4 = 1 THEN '+' ELSE '' END) || l_suppkey || lpad(l_orderkey::VARCHAR, 28, '0') AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE (CASE WHEN a::HUGEINT - b::HUGEINT < 0 THEN '' ELSE '+' END) || (a::HUGEINT - b::HUGEINT)::VARCHAR END AS delta FROM v"""
)
def q72_sequence_deltas(t):
    """Signed differences of integers of over thirty digits; what is no integer has none."""
    text = lambda c: F.col(c).cast("string")
    before = F.concat(F.when(F.col("l_suppkey") % 3 == 0, "-").otherwise(""), text("l_partkey"), F.lpad(text("l_suppkey"), 28, "0"))
    after = F.concat(F.when(F.col("l_partkey") % 4 == 0, "-").when(F.col("l_partkey") % 4 == 1, "+").otherwise(""), text("l_suppkey"), F.lpad(text("l_orderkey"), 28, "0"))
    return t("lineitem").select("l_orderkey", "l_linenumber", identity.signed_difference(before, F.when(F.col("l_linenumber") == 7, "x").otherwise(after)).alias("delta"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F')::INT, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END, o_totalprice DESC, o_orderkey) AS shown FROM orders)
SELECT o_custkey, o_orderkey, shown::INTEGER AS shown FROM r WHERE shown <= 5"""
)
def q73_detail_budgets(t):
    """Of each customer five orders: finished ones by key, then others by price."""
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    found = ranking.detail_budget(rows, F.col("o_orderstatus") == "F", [F.col("o_orderkey")], [F.desc("o_totalprice"), F.col("o_orderkey")], 5, ["o_custkey"])
    return found.select("o_custkey", "o_orderkey", "shown")


_PROFILES = [("full", {"index_bytes": 60, "detail_bytes": 24}), ("compact", {"index_bytes": 24, "detail_bytes": 8}), ("summary", {"index_bytes": 16, "detail_bytes": 2}), ("minimal", {})]


@query(
    """WITH r AS (SELECT l_suppkey, 40 + l_linenumber AS i, 300 + l_partkey % 900 AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem),
s AS (SELECT l_suppkey, 500 + sum(CASE WHEN n <= 60 THEN i ELSE 0 END + CASE WHEN n <= 24 THEN d ELSE 0 END) AS f, 500 + sum(CASE WHEN n <= 24 THEN i ELSE 0 END + CASE WHEN n <= 8 THEN d ELSE 0 END) AS c, 500 + sum(CASE WHEN n <= 16 THEN i ELSE 0 END + CASE WHEN n <= 2 THEN d ELSE 0 END) AS s FROM r GROUP BY 1)
SELECT l_suppkey, CASE WHEN f <= 8000 THEN 'full' WHEN c <= 8000 THEN 'compact' WHEN s <= 8000 THEN 'summary' ELSE 'minimal' END AS profile, (CASE WHEN f <= 8000 THEN f WHEN c <= 8000 THEN c WHEN s <= 8000 THEN s ELSE 500 END)::BIGINT AS bytes FROM s"""
)
def q74_size_profiles(t):
    """The first profile of each supplier's lines that stays within 8,000 bytes."""
    rows = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (40 + F.col("l_linenumber")).alias("index_bytes"), (300 + F.col("l_partkey") % 900).alias("detail_bytes"))
    return ranking.size_profile(rows, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], _PROFILES, 500, 8000)


@query("SELECT (1 + (row_number() OVER o - 1) // 40)::INTEGER AS page, o_orderkey, o_totalprice FROM orders WINDOW o AS (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) QUALIFY row_number() OVER o <= 120")
def q75_bound_pages(t):
    """Three pages of orders, each behind the cursor of the one before."""
    order = [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", False)]
    out, cursor = None, None
    for number in (1, 2, 3):
        page = pages.bound_page(t("orders"), order, 40, "r", "s", {"table": "orders"}, cursor)
        rows = page.rows.select(F.lit(number).alias("page"), "o_orderkey", "o_totalprice")
        out, cursor = rows if out is None else out.unionByName(rows), page.next
    return out


@query(
    """SELECT DISTINCT unit, id AS evidence_id FROM (SELECT l_orderkey AS unit, 'r' || l_partkey % 40 AS id FROM lineitem UNION ALL SELECT l_orderkey, 'b' || l_suppkey % 10 FROM lineitem WHERE l_linenumber % 2 = 0
UNION ALL SELECT l_orderkey, 'a' || l_partkey % 7 FROM lineitem UNION ALL SELECT l_orderkey, 'r' || l_suppkey % 5 FROM lineitem UNION ALL SELECT l_orderkey, 'i' || l_linenumber FROM lineitem WHERE l_suppkey % 3 <> 0)"""
)
def q76_evidence_ids(t):
    """Orders as review inputs: all ids that their nested rows name."""
    name = lambda letter, c, n: F.concat(F.lit(letter), (F.col(c) % n).cast("string"))
    side = lambda ids: F.struct(ids.alias("evidence_ids"))
    before = F.when(F.col("l_linenumber") % 2 == 0, side(F.array(name("b", "l_suppkey", 10))))
    item = F.struct(F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("i"), F.col("l_linenumber").cast("string"))).alias("evidence_id"))
    units_ = t("lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(
        F.collect_list(F.struct(name("r", "l_partkey", 40).alias("evidence_id"))).alias("evidence_registry"),
        F.collect_list(F.struct(before.alias("before"), side(F.array(name("a", "l_partkey", 7))).alias("after"))).alias("facts"),
        F.collect_list(F.struct(F.array(name("r", "l_suppkey", 5)).alias("evidence_ids"), F.array(item).alias("items"))).alias("research_receipts"),
    )
    return units.evidence_ids(units_, "unit")


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), own AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <> 3), reg AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'target' ELSE 'both' END AS side FROM part WHERE p_partkey % 10 <> 0),
u AS (SELECT *, unnest([{'e': 'base', 'id': l_partkey}, {'e': 'target', 'id': l_partkey + 1}]) AS x FROM f)
SELECT DISTINCT 'V5_OWNER' AS rule, u.l_orderkey || '-' || l_linenumber AS subject FROM u LEFT JOIN own ON own.l_orderkey = u.l_orderkey AND own.l_partkey = x.id WHERE own.l_partkey IS NULL
UNION ALL SELECT DISTINCT 'V5_SIDE', l_orderkey || '-' || l_linenumber FROM u LEFT JOIN reg ON p_partkey = x.id WHERE coalesce(side <> 'both' AND side <> x.e, true)"""
)
def q77_side_rules(t):
    """Lines as facts with evidence on two sides, held against their orders' evidence and the registry's sides."""
    part, text = F.col("l_partkey"), lambda c: c.cast("string")
    facts = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_orderkey").alias("object_key"), F.array(text(part)).alias("before_ids"), F.array(text(part + 1)).alias("after_ids"))
    objects = t("lineitem").where("l_linenumber <> 3").groupBy(F.col("l_orderkey").alias("object_key")).agg(F.collect_set(text(part)).alias("evidence_ids"))
    key = F.col("p_partkey")
    registry = t("part").where("p_partkey % 10 <> 0").select(text(key).alias("evidence_id"), F.when(key % 3 == 0, "base").when(key % 3 == 1, "target").otherwise("both").alias("side"))
    return validate.side_violations(facts, objects, registry)


@query(
    """SELECT c_custkey, '{"a":' || c_nationkey || ',"list":[' || CASE WHEN c_nationkey % 2 = 0 THEN '{"k":' || c_custkey || ',"v":null}' ELSE '' END || '],"z":{"b":"' || c_mktsegment || '","c":null}}' AS text,
sha256('{"a":' || c_nationkey || ',"list":[' || CASE WHEN c_nationkey % 2 = 0 THEN '{"k":' || c_custkey || '}' ELSE '' END || '],"z":{"b":"' || c_mktsegment || '","c":null}}') AS digest FROM customer"""
)
def q78_canonical_documents(t):
    """Customers as nested documents: canonical JSON, and its digest without one key."""
    none = F.lit(None).cast("string")
    item = F.struct(F.col("c_custkey").alias("k"), none.alias("v"))
    document = F.struct(F.struct(none.alias("c"), F.col("c_mktsegment").alias("b")).alias("z"), F.filter(F.array(F.when(F.col("c_nationkey") % 2 == 0, item)), lambda x: x.isNotNull()).alias("list"), F.col("c_nationkey").alias("a"))
    rows = t("customer").select("c_custkey", document.alias("d"))
    kind = rows.schema["d"].dataType
    return rows.select("c_custkey", canonical.text_of(F.col("d"), kind).alias("text"), canonical.digest_of(F.col("d"), kind, ("v",)).alias("digest"))
