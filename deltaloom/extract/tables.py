"""Properties of CREATE TABLE definitions, with the ALTER TABLE and COMMENT ON statements that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.extract.tokens import clauses, code_tokens, dealt, first_at, span, text_of
from deltaloom.functions import identity

#: Words that end a column's type, and words that start a constraint item.
AFTER_TYPE = ["DEFAULT", "GENERATED", "CONSTRAINT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "COLLATE", "VISIBLE", "INVISIBLE", "NOT", "NULL"]
CONSTRAINT_WORDS = ["CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "CHECK"]
CHARACTER_TYPES = ["CHAR", "NCHAR", "VARCHAR", "VARCHAR2", "NVARCHAR2", "RAW"]
NUMERIC_TYPES = ["NUMBER", "NUMERIC", "DECIMAL", "DEC"]
#: Words that start a table property after the column list.
PROPERTY_WORDS = ["ORGANIZATION", "ON", "TABLESPACE", "STORAGE", "LOB", "LOGGING", "NOLOGGING", "PARALLEL", "NOPARALLEL", "COMPRESS", "NOCOMPRESS", "ROW", "COLUMN", "PARTITION"]


def placed(definitions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Tokens with the table's parenthesised body marked: opening, closing, and the first ``;`` after it."""
    whole = Window.partitionBy("definition")
    tokens = code_tokens(definitions) if tokens is None else tokens
    tokens = tokens.withColumn("table_at", first_at(F.col("up") == "TABLE", whole))
    tokens = tokens.withColumn("opening", first_at((F.col("tok") == "(") & (F.col("i") > F.col("table_at")), whole))
    tokens = tokens.withColumn("closing", first_at((F.col("tok") == ")") & (F.col("i") > F.col("opening")) & (F.col("depth") == 0), whole))
    return tokens.withColumn("stop", F.coalesce(first_at((F.col("tok") == ";") & (F.col("i") > F.col("closing")), whole), F.lit(2**31 - 1)))


def items(definitions: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Tokens of the items of the body, numbered from 1; a comma belongs to none."""
    body = (placed(definitions) if marked is None else marked).where("i > opening AND i < closing")
    comma = (F.col("tok") == ",") & (F.col("depth") == 1)
    before = Window.partitionBy("definition").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = body.withColumn("position", F.sum(comma.cast("int")).over(before) + 1).where(~comma)
    item = Window.partitionBy("definition", "position").orderBy("i")
    return numbered.withColumn("k", F.row_number().over(item)).withColumn("first_word", F.first("up").over(item))


def columns(definitions: DataFrame, marked: DataFrame | None = None, first_only: bool = True) -> DataFrame:
    """One row a column: definition, component (Q: or U: name), position and its fourteen properties.

    ``definitions`` has definition (an id) and fragment (text).  Of several columns of one name the first counts, unless all are asked for.
    """
    whole = Window.partitionBy("definition", "position")
    top = F.col("depth") == 1
    up, i = F.col("up"), F.col("i")
    definitions = dealt(definitions) if marked is None else definitions
    rows = items(definitions, marked).where(~F.col("first_word").isin(CONSTRAINT_WORDS))
    ends_type = top & (F.col("k") > 1) & (up.isin(AFTER_TYPE) | ((up == "AS") & (F.col("nxt") == "(")))
    rows = rows.withColumn("after_type", F.coalesce(first_at(ends_type, whole), F.lit(2**31 - 1)))
    tail = top & (i >= F.col("after_type"))
    rows = rows.withColumn("default_at", first_at(tail & (up == "DEFAULT"), whole))
    on_null = F.max(tail & (up == "ON") & (F.col("prv") == "DEFAULT") & (F.col("nxt") == "NULL")).over(whole)
    rows = rows.withColumn("on_null", F.coalesce(on_null, F.lit(False)))
    rows = rows.withColumn("default_from", F.col("default_at") + F.when(F.col("on_null"), 3).otherwise(1))
    ends_default = top & (i >= F.col("default_from")) & up.isin([w for w in AFTER_TYPE if w != "NULL"])
    rows = rows.withColumn("default_to", F.coalesce(first_at(ends_default, whole), F.lit(2**31 - 1)))
    rows = rows.withColumn("generated_at", first_at(tail & (up == "GENERATED"), whole))
    rows = rows.withColumn("virtual_at", first_at(tail & (up == "AS") & (F.col("nxt") == "("), whole))
    rows = rows.withColumn("virtual_end", first_at(top & (F.col("tok") == ")") & (i > F.col("virtual_at")), whole))
    null_word = tail & (up == "NULL") & ~F.coalesce(F.col("prv").isin("ON", "NOT", "DEFAULT"), F.lit(False))
    grouped = rows.groupBy("definition", "position").agg(
        F.max(F.when(F.col("k") == 1, F.col("tok"))).alias("raw_name"),
        F.max("k").alias("n_tokens"),
        *span(F.lit(True), "definition_text"),
        *span((F.col("k") > 1) & (i < F.col("after_type")), "data_type"),
        F.max(tail & (up == "NOT") & (F.col("nxt") == "NULL")).alias("not_null"),
        F.max(null_word).alias("is_null"),
        *span((i >= F.col("default_from")) & (i < F.col("default_to")), "default"),
        F.max("on_null").alias("on_null"),
        *span(i >= F.col("generated_at"), "generated"),
        F.max(tail & (up == "IDENTITY") & (F.col("prv") == "AS")).alias("has_identity"),
        *span((i > F.col("virtual_at") + 1) & (i < F.col("virtual_end")), "virtual"),
        F.max(F.when(tail & up.isin("VISIBLE", "INVISIBLE"), up)).alias("visibility"),
        F.max(F.when(top & (F.col("prv") == "COLLATE"), F.col("tok"))).alias("collation"),
    )
    joined = grouped.join(definitions.select("definition", "fragment"), "definition")
    data_type = text_of("data_type")
    kind = F.upper(F.regexp_extract(data_type, r"^(\w+)", 1))
    character, numeric = kind.isin(CHARACTER_TYPES), kind.isin(NUMERIC_TYPES)
    number = lambda pattern: F.nullif(F.replace(F.regexp_extract(data_type, pattern, 1), F.lit(" "), F.lit("")), F.lit(""))
    wide = joined.where((F.col("n_tokens") > 1) & (data_type.isNotNull() | F.col("virtual_from").isNotNull())).select(
        "definition",
        identity.component_key(F.col("raw_name")).alias("component"),
        F.col("position").cast("string").alias("position"),
        text_of("definition_text").alias("definition_text"),
        data_type.alias("data_type"),
        F.when(character, number(r"\(\s*\+?([0-9]+)")).alias("length"),
        F.when(character, F.nullif(F.upper(F.regexp_extract(data_type, r"(?i)\(\s*\+?[0-9]+\s+(BYTE|CHAR)", 1)), F.lit(""))).alias("length_semantics"),
        F.when(numeric, number(r"\(\s*([+-]?\s*[0-9]+)\s*[,)]")).alias("precision"),
        F.when(numeric, number(r"\([^,()]*,\s*([+-]?\s*[0-9]+)\s*\)")).alias("scale"),
        F.when(F.col("not_null"), "NOT NULL").when(F.col("is_null"), "NULL").alias("nullable"),
        text_of("default").alias("default"),
        F.when(F.col("on_null"), "DEFAULT ON NULL").alias("default_on_null"),
        F.when(F.col("has_identity"), text_of("generated")).alias("identity"),
        text_of("virtual").alias("virtual_expression"),
        "visibility",
        "collation",
    )
    if not first_only:
        return wide
    first = Window.partitionBy("definition", "component").orderBy(F.col("position").cast("int"))
    return wide.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def constraints(definitions: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """One row a named table constraint: definition, component and its twelve properties (top level only)."""
    whole = Window.partitionBy("definition", "position")
    up, i, top = F.col("up"), F.col("i"), F.col("depth") == 1
    rows = items(definitions, marked).where(F.col("first_word") == "CONSTRAINT")
    group_at = first_at(top & (F.col("tok") == "("), whole)
    rows = rows.withColumn("group_at", group_at).withColumn("group_end", first_at(top & (F.col("tok") == ")") & (i > F.col("group_at")), whole))
    rows = rows.withColumn("reference_at", first_at(top & (up == "REFERENCES"), whole))
    stop = ["ON", "ENABLE", "DISABLE", "VALIDATE", "NOVALIDATE", "DEFERRABLE", "NOT", "INITIALLY", "RELY", "NORELY", "USING"]
    rows = rows.withColumn("reference_end", F.coalesce(first_at(top & (i > F.col("reference_at")) & up.isin(stop), whole), F.lit(2**31 - 1)))
    rows = rows.withColumn("delete_at", first_at(top & (up == "ON") & (F.col("nxt") == "DELETE"), whole))
    rows = rows.withColumn("set_null", F.max((i == F.col("delete_at") + 2) & (up == "SET")).over(whole))
    rows = rows.withColumn("using_at", first_at(top & (up == "USING") & (F.col("nxt") == "INDEX"), whole))
    last = lambda words: F.max_by(F.when(top & up.isin(words), up), F.when(top & up.isin(words), i))
    grouped = rows.groupBy("definition", "position").agg(
        F.max(F.when(F.col("k") == 2, F.col("tok"))).alias("raw_name"),
        F.max(F.when(F.col("k") == 3, F.concat_ws(" ", up, F.when(up.isin("PRIMARY", "FOREIGN"), F.col("nxt"))))).alias("kind"),
        *span(F.lit(True), "definition_text"),
        *span((i > F.col("group_at")) & (i < F.col("group_end")), "group"),
        *span((i > F.col("reference_at")) & (i < F.col("reference_end")), "reference"),
        *span((i >= F.col("delete_at")) & (i <= F.col("delete_at") + F.when(F.col("set_null"), 3).otherwise(2)), "rule"),
        last(["ENABLE", "DISABLE"]).alias("enabled"),
        last(["VALIDATE", "NOVALIDATE"]).alias("validation"),
        F.max_by(F.when(top & (up == "DEFERRABLE"), F.when(F.col("prv") == "NOT", "NOT DEFERRABLE").otherwise("DEFERRABLE")), F.when(top & (up == "DEFERRABLE"), i)).alias("deferrable"),
        F.max_by(F.when(top & (up == "INITIALLY") & F.col("nxt").isin("IMMEDIATE", "DEFERRED"), F.concat(F.lit("INITIALLY "), "nxt")), F.when(top & (up == "INITIALLY"), i)).alias("initially"),
        last(["RELY", "NORELY"]).alias("rely"),
        *span(i >= F.col("using_at"), "using"),
    )
    joined = grouped.join(definitions.select("definition", "fragment"), "definition")
    columns_text = F.regexp_replace(text_of("group"), r"\s*,\s*", ", ")
    wide = joined.where("raw_name IS NOT NULL").select(
        "definition",
        identity.component_key(F.col("raw_name")).alias("component"),
        F.col("position").cast("int").alias("position"),
        text_of("definition_text").alias("definition_text"),
        "kind",
        F.when(F.col("kind") != "CHECK", columns_text).alias("columns"),
        text_of("reference").alias("reference"),
        F.when(F.col("kind") == "CHECK", text_of("group")).alias("condition"),
        text_of("rule").alias("delete_rule"),
        "enabled",
        "validation",
        "deferrable",
        "initially",
        "rely",
        text_of("using").alias("index_association"),
    )
    first = Window.partitionBy("definition", "component").orderBy("position")
    return wide.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "position")


def properties(definitions: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Rows (definition, property, value) of the clauses between the column list and the end of the statement."""
    marked = placed(definitions) if marked is None else marked
    tokens = marked.where("i > closing AND i < stop")
    starts = (F.col("depth") == 0) & F.col("up").isin(PROPERTY_WORDS) & ~F.coalesce((F.col("up") == "COMPRESS") & (F.col("prv") == "STORE"), F.lit(False))
    found = clauses(tokens, starts, definitions)
    named = (
        F.when(F.col("word") == "ORGANIZATION", "organization")
        .when((F.col("word") == "ON") & (F.col("next_word") == "COMMIT"), "on_commit")
        .when(F.col("word") == "TABLESPACE", "tablespace")
        .when(F.col("word") == "STORAGE", "storage")
        .when(F.col("word") == "LOB", "lob_storage")
        .when(F.col("word").isin("LOGGING", "NOLOGGING"), "logging")
        .when(F.col("word").isin("PARALLEL", "NOPARALLEL"), "parallel")
        .when(F.col("word").isin("COMPRESS", "NOCOMPRESS") | (F.col("word").isin("ROW", "COLUMN") & (F.col("next_word") == "STORE")), "compression")
        .when((F.col("word") == "PARTITION") & (F.col("next_word") == "BY"), "partitioning")
    )
    value = F.when(named == "organization", F.upper("next_word")).when(named == "tablespace", F.regexp_extract("body", r"^(\S+)", 1)).when(named == "logging", F.col("word")).otherwise(F.col("whole"))
    rows = found.select("definition", named.alias("property"), value.alias("value"), "clause_no").where("property IS NOT NULL")
    rows = rows.groupBy("definition", "property").agg(F.max_by("value", "clause_no").alias("value"))
    external = rows.where("property = 'organization' AND value = 'EXTERNAL'").select("definition", F.lit("external").alias("property"), F.lit("ORGANIZATION EXTERNAL").alias("value"))
    head = marked.where("i < table_at").groupBy("definition").agg(F.collect_set("up").alias("words"))
    kind = F.when(F.array_contains("words", "PRIVATE"), "PRIVATE TEMPORARY").when(F.array_contains("words", "GLOBAL"), "GLOBAL TEMPORARY").otherwise("TEMPORARY")
    temporary = head.where(F.array_contains("words", "TEMPORARY")).select("definition", F.lit("temporary").alias("property"), kind.alias("value"))
    return rows.unionByName(external).unionByName(temporary)


def partitions(definitions: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Rows (definition, component, definition_text) of the named partitions."""
    tokens = (placed(definitions) if marked is None else marked).where("i > closing AND i < stop AND depth <= 1")
    found = clauses(tokens, (F.col("depth") == 1) & (F.col("up") == "PARTITION") & F.coalesce(F.col("prv").isin(",", "("), F.lit(False)), definitions)
    name = F.regexp_extract("body", r'^("(?:[^"]++|"")*+"|\S+)', 1)
    return found.select("definition", identity.component_key(name).alias("component"), F.regexp_replace("whole", r"[\s,]+$", "").alias("definition_text"), "clause_no").groupBy("definition", "component").agg(
        F.min_by("definition_text", "clause_no").alias("definition_text")
    )


def statements(definitions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Rows (definition, n, words, target, rest) of ALTER TABLE and COMMENT ON statements of texts, in order.

    target is the list of component keys of the named table (and column).
    """
    tokens = (code_tokens(definitions) if tokens is None else tokens).where("tok <> '/'")
    after = Window.partitionBy("definition").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tokens.withColumn("n", F.coalesce(F.sum((F.col("tok") == ";").cast("int")).over(after), F.lit(0))).where("tok <> ';'")
    listed = numbered.groupBy("definition", "n").agg(F.sort_array(F.collect_list(F.struct("i", "tok", "up"))).alias("t"))
    up = F.transform("t", lambda x: x["up"])
    actions = ["ADD", "MODIFY", "DROP", "PARALLEL", "NOPARALLEL", "LOGGING", "NOLOGGING"]
    alter = (up[0] == "ALTER") & (up[1] == "TABLE")
    comment = (up[0] == "COMMENT") & (up[1] == "ON") & up[2].isin("TABLE", "COLUMN")
    at = F.when(alter, F.array_position(F.transform(up, lambda w: F.when(w.isin(actions), "!").otherwise("")), "!")).when(comment, F.array_position(up, "IS"))
    names = F.when(at > 0, F.slice("t", F.when(alter, 3).otherwise(4), F.greatest(at - F.when(alter, 3).otherwise(4), F.lit(0))))
    parts = F.transform(F.filter(names, lambda x: x["tok"] != "."), lambda x: identity.component_key(x["tok"]))
    rest = F.when(at > 0, F.array_join(F.transform(F.slice("t", at + 1, F.size("t")), lambda x: x["tok"]), " "))
    kind = F.when(alter, F.concat(F.lit("ALTER TABLE "), F.element_at(up, F.greatest(at, F.lit(1)).cast("int")))).when(comment, F.concat(F.lit("COMMENT ON "), up[2]))
    return listed.select("definition", "n", kind.alias("kind"), parts.alias("target"), rest.alias("rest"))


def context_only(definitions: DataFrame) -> DataFrame:
    """Definitions (files) that consist of ALTER TABLE and COMMENT ON statements only, with their number."""
    return statements(definitions).groupBy("definition").agg(F.min(F.col("kind").isNotNull() & (F.size("target") > 0)).alias("all_known"), F.count("*").alias("statements")).where("all_known").drop("all_known")
