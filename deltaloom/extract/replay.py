"""Tables as they are after the ALTER TABLE and COMMENT ON statements that follow them, or stand in files of their own.

Two steps.  ``attached`` joins files that consist of such statements to the tables they name: a file
counts only if each of its statements names exactly one table.  A table takes all statements of such
files, in the order of their paths; a caller may set a limit (an analysis has ``MOST``), and files beyond it
say so.  ``replayed`` is an ordered fold: every statement becomes typed operations (rows), and each table's
operations are applied to its typed columns, constraints, comments and properties in turn.  An operation
that doesn't fit changes nothing and leaves a diagnostic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.extract import statements as cut
from deltaloom.extract import tables
from deltaloom.extract.tokens import code_tokens, dealt
from deltaloom.functions import identity
from deltaloom.state.cache import checkpointed

#: Statements that a table of an analysis takes from other files at most, and characters of the parts of a long text that tests cut statements across.
MOST, PART_CHARS = 12, 4096
#: Fields of columns and constraints.
COLUMN_FIELDS = ("position", "definition_text", "data_type", "length", "length_semantics", "precision", "scale", "nullable", "default", "default_on_null", "identity", "virtual_expression", "visibility", "collation")
CONSTRAINT_FIELDS = ("definition_text", "kind", "columns", "reference", "condition", "delete_rule", "enabled", "validation", "deferrable", "initially", "rely", "index_association")
#: The diagnostic that blocks single columns, not their table.
PARTIAL = "ALTER_COLUMN_PARTIAL_UNRESOLVED"

_COLUMN = "struct<key:string," + ",".join(f"{f}:string" for f in COLUMN_FIELDS) + ">"
_CONSTRAINT = "struct<key:string,words:array<string>," + ",".join(f"{f}:string" for f in CONSTRAINT_FIELDS) + ">"
_PAIR = "struct<key:string,value:string>"


@dataclass
class Replayed:
    """Rows by definition: columns, constraints (as extracted), comments (component, value), properties (property, value), diagnostics (code, component: null for the whole table)."""

    columns: DataFrame
    constraints: DataFrame
    comments: DataFrame
    properties: DataFrame
    diagnostics: DataFrame


def part_key(raw: Column, quoted: Column) -> Column:
    return F.when(quoted, F.concat(F.lit("Q:"), raw)).otherwise(F.concat(F.lit("U:"), F.upper(raw)))


def statements(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (definition, n, kind, parts, start, end, text) of the statements of texts (definition, fragment), cut at the outer ``;``.

    They begin at the first of the definition's code tokens given, which say no more than that place.  parts are the
    component keys of what is named before the action or IS.  kind is null for other statements, NONE or NO VALUE without an action.
    """
    opened = F.col("depth") + F.when(F.col("tok") == ")", 1).otherwise(0)
    first = tokens.groupBy("definition").agg(F.min("start").cast("int").alias("from"), F.min_by(opened, "i").cast("int").alias("depth"))
    rows = cut.mapped(texts.join(first, "definition").select("definition", "fragment", "from", "depth"), cut.STATEMENT, cut.statements_of)
    return rows.select("definition", "n", "kind", F.transform("names", identity.component_key).alias("parts"), "start", "end", "text")


def context_statements(files: DataFrame, default_schema: str | None = None) -> DataFrame:
    """Rows (path, n, table_parts, text, start, end) of files (path, text) that consist of ALTER TABLE and COMMENT ON statements.

    Files of any size are read whole, in a time that grows with their size.  A file with any other statement,
    or a name of more than two parts, or without a schema where there is no default, has none.
    """
    rows = cut.mapped(files.select("path", "text"), cut.CONTEXT, partial(cut.context_of, least=2 if default_schema is None else 1))
    parts, schema = F.transform("names", identity.component_key), F.concat(F.lit("U:"), F.upper(F.lit(default_schema).cast("string")))
    return rows.select("path", "n", F.when(F.size("names") == 2, parts).otherwise(F.concat(F.array(schema), parts)).alias("table_parts"), "text", "start", "end")


def attached(said: DataFrame, found: DataFrame, most: int | None = None) -> DataFrame:
    """Statements (path, n, table_parts, ...) with ``definition``, the table that takes them, and ``reason`` why not.

    ``found`` has the tables (definition, table_parts), one row a definition.  All statements of a file are taken, or none:
    UNKNOWN_TABLE or AMBIGUOUS_TABLE if one of them names no table or several, and where ``most`` is given
    TOO_MANY_STATEMENTS if with it a table would have more.  Files are taken in the order of their paths.  Each round
    decides all files whose tables are not waited for by an earlier undecided file, the first file in any case.
    """
    targets = found.groupBy("table_parts").agg(F.count("*").alias("tables"), F.min("definition").alias("definition"))
    of_file = Window.partitionBy("path")
    unfit = F.when(F.col("tables").isNull(), "UNKNOWN_TABLE").when(F.col("tables") > 1, "AMBIGUOUS_TABLE")
    if most is None:
        return said.join(targets, "table_parts", "left").withColumn("reason", F.max(unfit).over(of_file)).drop("tables")
    # names and numbers alone decide; texts are met by the decisions in the end
    met = said.groupBy("path", "table_parts").agg(F.count("*").alias("c")).join(targets, "table_parts", "left")
    met = checkpointed(met.withColumn("reason", F.max(unfit).over(of_file)))
    counts = met.where("reason IS NULL").groupBy("path", "definition").agg(F.sum("c").alias("c"))
    state = checkpointed(counts.withColumn("taken", F.lit(None).cast("boolean")))
    earlier = Window.partitionBy("definition").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    while not state.where("taken IS NULL").isEmpty():
        sure = F.coalesce(F.sum(F.when(F.col("taken"), F.col("c"))).over(earlier), F.lit(0))
        open_ = F.coalesce(F.sum(F.when(F.col("taken").isNull(), F.col("c"))).over(earlier), F.lit(0))
        marked = state.withColumns({"fits": sure + open_ + F.col("c") <= most, "fails": sure + F.col("c") > most})
        per = marked.where("taken IS NULL").groupBy("path").agg(F.min("fits").alias("fits"), F.max("fails").alias("fails"))
        decided = per.select("path", F.when(F.col("fails"), False).when(F.col("fits"), True).alias("now")).where("now IS NOT NULL")
        state = checkpointed(state.join(decided, "path", "left").select("path", "definition", "c", F.coalesce("taken", "now").alias("taken")))
    refused = state.where("NOT taken").select("path").distinct().withColumn("over", F.lit(True))
    decided = met.join(refused, "path", "left")
    decided = decided.select("path", "table_parts", "definition", F.coalesce("reason", F.when(F.col("over"), "TOO_MANY_STATEMENTS")).alias("reason"))
    return said.join(decided, ["path", "table_parts"])


def with_contexts(found: DataFrame, files: DataFrame, default_schema: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Definitions (path, object_key, definition, ...) with ``context``, and the statements of other files as of ``attached``.

    ``found`` is as of ``scan.occurrences``; ``files`` (path, text) are all files.  context is the list of (path,
    sha256, text) that a table takes from other files, in order; empty for all else.
    """
    place = F.concat_ws("\x1f", "object_key", "path", F.col("ordinal").cast("string"))
    none = F.array().cast("array<struct<path:string,sha256:string,text:string>>")
    # a comment may stand between the words of a statement, so only its first one is looked for
    others = files.where(F.col("text").isNotNull() & F.lower("path").endswith(".sql") & F.upper("text").rlike("ALTER|COMMENT"))
    if others.isEmpty():  # no plan for what isn't there
        said = files.sparkSession.createDataFrame([], "table_parts array<string>, path string, n long, text string, start long, end long, definition string, reason string")
        return found.withColumn("context", none), said
    found = checkpointed(found)
    others = others.join(found.select("path").distinct(), "path", "left_anti")
    said = checkpointed(context_statements(others.repartition("path"), default_schema))
    kinds = found.where("object_type = 'TABLE'").select(place.alias("definition"), F.array(part_key(F.col("raw_schema"), F.col("schema_quoted")), part_key(F.col("raw_name"), F.col("name_quoted"))).alias("table_parts"))
    said = attached(said, kinds, most)
    taken = said.where("reason IS NULL").groupBy("definition").agg(F.sort_array(F.collect_list(F.struct("path", "n", F.sha2("text", 256).alias("sha256"), "text"))).alias("context"))
    taken = taken.select(F.col("definition").alias("place_"), F.transform("context", lambda x: F.struct(x["path"].alias("path"), x["sha256"].alias("sha256"), x["text"].alias("text"))).alias("context"))
    return found.join(taken, place == F.col("place_"), "left").withColumn("context", F.coalesce("context", none)).drop("place_"), said


def with_statements(fragment: Column, context: Column) -> Column:
    """A definition's text and the statements it takes, as one text."""
    added = F.concat(F.regexp_replace(fragment, r"\s+$", ""), F.lit("\n"), F.array_join(F.transform(context, lambda x: x["text"]), ";\n"), F.lit(";"))
    return F.when(F.size(context) > 0, added).otherwise(fragment)


def create_diagnostics(marked: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows (definition, code) of what the body of CREATE TABLE has that typed rows can't say.

    ``marked`` is as of ``tables.placed``, ``columns`` as of ``tables.columns`` with all columns of equal name.
    """
    heads = marked.groupBy("definition").agg(F.max("opening").alias("opening"), F.max("closing").alias("closing"))
    codes = heads.select("definition", F.when(F.col("opening").isNull(), "TABLE_DEFINITION_UNRESOLVED").when(F.col("closing").isNull(), "TABLE_BODY_UNBALANCED").alias("code"))
    body = tables.items(None, marked)
    commas = marked.where("i > opening AND i < closing AND tok = ',' AND depth = 1").groupBy("definition").agg(F.count("*").alias("commas"))
    per = body.groupBy("definition", "position").agg(F.max("first_word").alias("first_word"), F.max("k").alias("size"))
    filled = heads.where("closing IS NOT NULL").join(commas, "definition", "left").join(per.groupBy("definition").agg(F.count("*").alias("filled")), "definition", "left")
    codes = codes.unionByName(filled.where(F.coalesce("filled", F.lit(0)) <= F.coalesce("commas", F.lit(0))).select("definition", F.lit("EMPTY_TABLE_ITEM").alias("code")))
    parsed = columns.select("definition", F.col("position").cast("int").alias("position"), F.lit(True).alias("parsed"))
    each = per.join(parsed, ["definition", "position"], "left")
    is_constraint = F.col("first_word").isin(tables.CONSTRAINT_WORDS)
    named = (F.col("first_word") == "CONSTRAINT") & (F.col("size") > 2)
    code = F.when(is_constraint & ~named, "UNNAMED_CONSTRAINT_UNRESOLVED").when(~is_constraint & F.col("parsed").isNull(), "COLUMN_UNRESOLVED")
    codes = codes.unionByName(each.select("definition", code.alias("code")))
    twice = columns.groupBy("definition", "component").agg(F.count("*").alias("c")).where("c > 1").select("definition", F.lit("DUPLICATE_COLUMN").alias("code"))
    names = body.where("first_word = 'CONSTRAINT' AND k = 2").groupBy("definition", identity.component_key(F.col("tok")).alias("key")).agg(F.count("*").alias("c"))
    codes = codes.unionByName(twice).unionByName(names.where("c > 1").select("definition", F.lit("DUPLICATE_CONSTRAINT").alias("code")))
    return codes.where("code IS NOT NULL").distinct()


def operations(rows: DataFrame) -> DataFrame:
    """Rows (definition, n, item, op, key, keys, value, code, column, constraint): what each statement does to its table.

    ``rows`` are as of ``cut.operations_of``, which reads in one pass over a text what its statements say.  Statements
    about other tables do nothing; an unqualified name is that of the table it stands with.  Only items that are
    whole columns or constraints (body) meet the extractors here.
    """
    typed = {"column": _COLUMN, "constraint": _CONSTRAINT}
    keys = F.when(F.col("op") == "default", F.col("names")).otherwise(F.transform("names", identity.component_key))
    rows = rows.select("definition", "n", "item", "op", F.coalesce("word", identity.component_key(F.col("name"))).alias("key"), keys.alias("keys"), "value", "code", "body")
    plain = rows.where("body IS NULL").select(*rows.columns[:-1], *[F.lit(None).cast(kind).alias(name) for name, kind in typed.items()])
    items = rows.where("body IS NOT NULL").withColumn("id", F.concat_ws("\x1f", "definition", F.col("n").cast("string"), F.col("item").cast("string")))
    if items.isEmpty():  # no plan for what isn't there
        return plain
    # tables of one column or constraint each, for the extractors of CREATE TABLE
    synthetic = dealt(items.select(F.col("id").alias("definition"), F.concat(F.lit("TABLE ("), "body", F.lit(")")).alias("fragment")))
    marked = checkpointed(tables.placed(synthetic, code_tokens(synthetic)))
    column = tables.columns(synthetic, marked).select(F.col("definition").alias("id"), F.struct(F.col("component").alias("key"), *COLUMN_FIELDS).cast(_COLUMN).alias("column"))
    items = items.join(column, "id", "left")
    if marked.where("up = 'CONSTRAINT'").isEmpty():
        items = items.withColumn("constraint", F.lit(None).cast(_CONSTRAINT))
    else:
        items = items.join(constraint_rows(synthetic, marked).select(F.col("definition").alias("id"), "constraint"), "id", "left")
    missing = (F.col("op") == "add_constraint") & F.col("constraint").isNull()
    op = F.when(missing, "none").when((F.col("op") != "add_constraint") & F.col("column").isNull(), "partial").otherwise(F.col("op"))
    code = F.when(missing, "UNNAMED_CONSTRAINT_UNRESOLVED").otherwise(F.col("code"))
    return plain.unionByName(items.withColumns({"op": op, "code": code}).select(*plain.columns))


def constraint_rows(definitions: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows (definition, constraint) of named constraints: their fields, and every word of them as a component key."""
    words = tables.items(None, marked).where("first_word = 'CONSTRAINT'").groupBy("definition", "position").agg(
        F.max(F.when(F.col("k") == 2, identity.component_key(F.col("tok")))).alias("component"), F.collect_set(identity.component_key(F.col("tok"))).alias("words")
    )
    first = words.groupBy("definition", "component").agg(F.min_by("words", "position").alias("words"))
    rows = tables.constraints(definitions, marked).join(first, ["definition", "component"])
    return rows.select("definition", F.struct(F.col("component").alias("key"), "words", *CONSTRAINT_FIELDS).cast(_CONSTRAINT).alias("constraint"))


def _folded(state: Column, x: Column) -> Column:
    """The state after one operation."""
    has = lambda rows, k: F.exists(rows, lambda r: r["key"] == k)
    without = lambda rows, k: F.filter(rows, lambda r: r["key"] != k)
    cols, cons, op, key = state["columns"], state["constraints"], x["op"], x["key"]
    there = has(cols, key)
    droppable = F.forall(x["keys"], lambda k: has(cols, k)) & ~F.exists(cons, lambda c: F.arrays_overlap(c["words"], x["keys"]))
    position = (F.size(cols) + 1).cast("string")
    added = F.struct(x["column"]["key"].alias("key"), position.alias("position"), *[x["column"][f].alias(f) for f in COLUMN_FIELDS if f != "position"])

    def changed(c: Column) -> Column:
        fields = []
        for f in COLUMN_FIELDS:
            new = F.coalesce(x["column"][f], c[f]) if f != "position" else c[f]
            value = F.when(op == "modify", new)
            if f == "nullable":
                value = value.when(op == "nullable", x["value"])
            if f == "default":
                value = value.when(op == "default", x["value"])
            if f == "default_on_null":
                value = value.when(op == "default", F.get(x["keys"], F.lit(0)))
            fields.append(value.otherwise(c[f]).alias(f))
        return F.when(c["key"] == key, F.struct(c["key"].alias("key"), *fields)).otherwise(c)

    columns = (
        F.when((op == "add") & ~there, F.concat(cols, F.array(added)))
        .when(op.isin("modify", "nullable", "default") & there, F.transform(cols, changed))
        .when((op == "drop") & droppable, F.filter(cols, lambda c: ~F.array_contains(x["keys"], c["key"])))
        .otherwise(cols)
    )
    constraints = F.when((op == "add_constraint") & ~has(cons, x["constraint"]["key"]), F.concat(cons, F.array(x["constraint"]))).when(op == "drop_constraint", without(cons, key)).otherwise(cons)
    pair = F.struct(key.alias("key"), x["value"].alias("value"))
    comments = (
        F.when(op == "comment", F.concat(without(state["comments"], key), F.array(pair))).when(op == "uncomment", without(state["comments"], key))
        .when((op == "drop") & droppable, F.filter(state["comments"], lambda c: ~F.array_contains(x["keys"], c["key"]))).otherwise(state["comments"])
    )
    properties = F.when(op == "property", F.concat(without(state["properties"], key), F.array(pair))).otherwise(state["properties"])
    code = F.coalesce(
        x["code"],
        F.when((op == "add") & there, "DUPLICATE_COLUMN").when(op.isin("modify", "nullable", "default") & ~there, "ALTER_COLUMN_NOT_IN_CREATE").when(op == "partial", PARTIAL)
        .when((op == "drop") & ~droppable, "ALTER_TABLE_DROP_UNSUPPORTED").when((op == "drop_constraint") & ~has(cons, key), "ALTER_TABLE_DROP_UNSUPPORTED")
        .when((op == "add_constraint") & has(cons, x["constraint"]["key"]), "DUPLICATE_CONSTRAINT"),
    )
    codes = F.when(code.isNotNull(), F.concat(state["codes"], F.array(F.struct(F.when(op == "partial", key).alias("key"), code.alias("value"))))).otherwise(state["codes"])
    return F.struct(columns.alias("columns"), constraints.alias("constraints"), comments.alias("comments"), properties.alias("properties"), codes.alias("codes"))


def replayed(definitions: DataFrame, tokens: DataFrame, marked: DataFrame | None = None, heads: DataFrame | None = None) -> Replayed:
    """The tables of CREATE TABLE definitions (definition, fragment) after the statements that follow in the same text.

    ``tokens`` are those of the definitions, or of their ``heads``, if given: the texts up to the end of CREATE TABLE.

    Defined results: a statement about another table does nothing; one that can't be applied changes
    nothing and gives its diagnostic; of several columns of one name the first counts and the table has a
    diagnostic; an empty table of definitions gives empty tables.
    """
    texts, definitions = definitions, definitions if heads is None else heads
    marked = checkpointed(tables.placed(definitions, tokens)) if marked is None else marked
    every = checkpointed(tables.columns(definitions, marked, first_only=False))
    first = Window.partitionBy("definition", "component").orderBy(F.col("position").cast("int"))
    columns = every.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")
    codes = create_diagnostics(marked, every).withColumn("component", F.lit(None).cast("string"))
    constraints = tables.constraints(definitions, marked)
    properties = tables.properties(definitions, marked)
    comments = properties.select("definition", F.lit("").alias("component"), "value").where("false")
    head = marked.where("i > table_at AND i < opening AND tok <> '.'").groupBy("definition").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "tok"))), lambda x: x["tok"]).alias("own"))
    later = marked.where("i = stop").select("definition", F.col("end").cast("int").alias("from"), F.col("depth").cast("int").alias("depth")).join(head, "definition")
    said = checkpointed(cut.mapped(texts.join(later, "definition").select("definition", "fragment", "from", "depth", "own"), cut.OPERATION, cut.operations_of))
    if said.isEmpty():
        return Replayed(columns, constraints, comments, properties, codes)
    ops = operations(said)
    ops = ops.groupBy("definition").agg(F.sort_array(F.collect_list(F.struct("n", "item", "op", "key", "keys", "value", "code", "column", "constraint"))).alias("ops"))
    listed = lambda df, entry, name: df.groupBy("definition").agg(F.sort_array(F.collect_list(entry)).alias(name))
    column = F.struct(F.col("position").cast("int").alias("p"), F.struct(F.col("component").alias("key"), *COLUMN_FIELDS).cast(_COLUMN).alias("c"))
    base = ops.join(listed(columns, column, "columns"), "definition", "left").join(listed(constraint_rows(definitions, marked), F.col("constraint"), "constraints"), "definition", "left")
    base = base.join(listed(properties, F.struct(F.col("property").alias("key"), "value"), "properties"), "definition", "left")
    or_none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    start = F.struct(
        or_none(F.transform("columns", lambda x: x["c"]), _COLUMN).alias("columns"), or_none(F.col("constraints"), _CONSTRAINT).alias("constraints"),
        F.array().cast(f"array<{_PAIR}>").alias("comments"), or_none(F.col("properties"), _PAIR).alias("properties"), F.array().cast(f"array<{_PAIR}>").alias("codes"),
    )
    ended = checkpointed(base.select("definition", F.aggregate("ops", start, _folded).alias("s")))
    done = ended.select("definition")
    untouched = lambda df: df.join(done, "definition", "left_anti")
    of = lambda name: ended.select("definition", F.explode(f"s.{name}").alias("x"))
    columns = untouched(columns).unionByName(of("columns").select("definition", F.col("x.key").alias("component"), *[f"x.{f}" for f in COLUMN_FIELDS]))
    constraints = untouched(constraints).unionByName(of("constraints").select("definition", F.col("x.key").alias("component"), *[f"x.{f}" for f in CONSTRAINT_FIELDS]))
    properties = untouched(properties).unionByName(of("properties").select("definition", F.col("x.key").alias("property"), "x.value"))
    comments = of("comments").select("definition", F.col("x.key").alias("component"), "x.value")
    codes = codes.unionByName(of("codes").select("definition", F.col("x.value").alias("code"), F.col("x.key").alias("component")).distinct())
    return Replayed(columns, constraints, comments, properties, codes)
