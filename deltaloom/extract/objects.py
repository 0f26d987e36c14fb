"""Properties of sequences, indexes, views, triggers and routines, and all properties as field rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.extract import replay, tables
from deltaloom.extract.tokens import clauses, code_tokens, dealt, first_at, span, text_of, unpivoted
from deltaloom.functions import identity, sqltext

#: Sequence options, by the words before their number; by a word with a number and one without; by one of two words.
NUMBER_OPTIONS = {"start_with": ("START", "WITH"), "increment_by": ("INCREMENT", "BY")}
WORD_OR_NUMBER_OPTIONS = {"min_value": ("MINVALUE", "NOMINVALUE"), "max_value": ("MAXVALUE", "NOMAXVALUE"), "cache": ("CACHE", "NOCACHE")}
WORD_OPTIONS = {
    "cycle": ("CYCLE", "NOCYCLE"),
    "order": ("ORDER", "NOORDER"),
    "scale": ("SCALE", "NOSCALE"),
    "extend": ("EXTEND", "NOEXTEND"),
    "shard": ("SHARD", "NOSHARD"),
    "session": ("SESSION", "GLOBAL"),
    "keep": ("KEEP", "NOKEEP"),
}
SEQUENCE_OPTIONS = (*NUMBER_OPTIONS, *WORD_OR_NUMBER_OPTIONS, *WORD_OPTIONS)
PACKAGE_BYTES = 128_000
FAR = 2**31 - 1


def sequence_options(definitions: DataFrame, text: str = "fragment") -> DataFrame:
    """The definitions with a column for each option: its text if it is written exactly once, else null.

    Each option is looked for among the code tokens; an integer is digits that no word, sign or
    decimal point goes on from, with its sign right before it.  Texts with something unterminated have
    no options.
    """
    rows = definitions.withColumn("pieces__", sqltext.tokens(F.col(text)))
    rows = rows.withColumn("seen__", F.when(F.size(sqltext.piece_diagnostics(F.col("pieces__"))) == 0, sqltext.seen_tokens(F.col("pieces__"))))
    seen = F.col("seen__")

    def number(k: Column) -> Column:
        """Struct (first, last) of the pieces of the integer that is the k-th token, else null."""
        at, sign = F.get(seen, k), F.get(seen, k)["up"].isin("+", "-")
        digits = F.when(sign, F.get(seen, k + 1)).otherwise(at)
        after = F.get("pieces__", digits["piece"] + 1)
        good = digits["tok"].rlike("^[0-9]+$") & (digits["piece"] == at["piece"] + sign.cast("int")) & ~F.coalesce(after.rlike(r"^[\w.$#]"), F.lit(False))
        return F.when(good, F.struct(at["piece"].alias("first"), digits["piece"].alias("last")))

    def found(name: str) -> Column:
        word = lambda k: F.get(seen, k)["up"]
        own = lambda k: F.get(seen, k)["piece"]
        alone = lambda k: F.struct(own(k).alias("first"), own(k).alias("last"))
        if name in NUMBER_OPTIONS:
            one, two = NUMBER_OPTIONS[name]
            return F.transform(seen, lambda x, k: F.when((x["up"] == one) & (word(k + 1) == two), number(k + 2)))
        if name in WORD_OR_NUMBER_OPTIONS:
            yes, no = WORD_OR_NUMBER_OPTIONS[name]
            with_number = lambda k: F.when(number(k + 1).isNotNull(), F.struct(own(k).alias("first"), number(k + 1)["last"].alias("last")))
            return F.transform(seen, lambda x, k: F.when(x["up"] == yes, with_number(k)).when(x["up"] == no, alone(k)))
        return F.transform(seen, lambda x, k: F.when(x["up"].isin(*WORD_OPTIONS[name]), alone(k)))

    for name in SEQUENCE_OPTIONS:
        hits = F.filter(found(name), lambda x: x.isNotNull())
        rows = rows.withColumn("hits__", hits)
        hit = F.col("hits__")[0]
        value = F.upper(F.array_join(F.slice("pieces__", hit["first"] + 1, hit["last"] - hit["first"] + 1), ""))
        rows = rows.withColumn(name, F.when(F.size("hits__") == 1, value)).drop("hits__")
    return rows.drop("pieces__", "seen__")


def indexes(definitions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """One row an index: target, unique, kind, keys, directions, and its clauses by name."""
    whole = Window.partitionBy("definition")
    definitions = dealt(definitions) if tokens is None else definitions
    tokens = code_tokens(definitions) if tokens is None else tokens
    up, i = F.col("up"), F.col("i")
    tokens = tokens.withColumn("index_at", first_at(up == "INDEX", whole))
    tokens = tokens.withColumn("on_at", first_at((up == "ON") & (i > F.col("index_at")), whole))
    tokens = tokens.withColumn("opening", first_at((F.col("tok") == "(") & (i > F.col("on_at")), whole))
    tokens = tokens.withColumn("closing", first_at((F.col("tok") == ")") & (i > F.col("opening")) & (F.col("depth") == 0), whole))
    tokens = tokens.withColumn("stop", F.coalesce(first_at((F.col("tok") == ";") & (i > F.col("closing")), whole), F.lit(2**31 - 1)))
    inside = tokens.where("i > opening AND i < closing")
    comma = (F.col("tok") == ",") & (F.col("depth") == 1)
    before = Window.partitionBy("definition").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("n", F.sum(comma.cast("int")).over(before)).where(~comma)
    direction = (F.col("depth") == 1) & up.isin("ASC", "DESC")
    keys = inside.groupBy("definition", "n").agg(*span(~direction, "key"), F.max(F.when(direction, up)).alias("direction"))
    keys = keys.join(definitions.select("definition", "fragment"), "definition").select("definition", "n", text_of("key").alias("key"), "direction")
    keys = keys.groupBy("definition").agg(F.sort_array(F.collect_list(F.struct("n", "key", "direction"))).alias("k"))
    keys = keys.select("definition", F.to_json(F.transform("k", lambda x: x["key"])).alias("keys"), F.to_json(F.transform("k", lambda x: F.coalesce(x["direction"], F.lit("")))).alias("directions"))
    heads = tokens.groupBy("definition").agg(
        *span((i > F.col("on_at")) & (i < F.col("opening")), "target"),
        F.max(F.when((i < F.col("index_at")) & (up == "UNIQUE"), "UNIQUE")).alias("unique"),
        F.max(F.when((i < F.col("index_at")) & (up == "BITMAP"), "BITMAP")).alias("bitmap"),
        F.max(F.when((i > F.col("closing")) & (up == "INDEXTYPE"), "DOMAIN")).alias("domain"),
        F.max_by(F.when((i > F.col("closing")) & up.isin("VISIBLE", "INVISIBLE"), up), F.when(up.isin("VISIBLE", "INVISIBLE"), i)).alias("visibility"),
    )
    heads = heads.join(definitions.select("definition", "fragment"), "definition").select(
        "definition", text_of("target").alias("target"), "unique", F.coalesce("bitmap", "domain", F.lit("NORMAL")).alias("kind"), "visibility"
    )
    words = {"LOCAL": "partitioning", "GLOBAL": "partitioning", "TABLESPACE": "tablespace", "STORAGE": "storage", "COMPRESS": "compression", "NOCOMPRESS": "compression", "LOGGING": "logging", "NOLOGGING": "logging", "PARALLEL": "parallel", "NOPARALLEL": "parallel", "PARAMETERS": "domain_parameters", "VISIBLE": None, "INVISIBLE": None, "INDEXTYPE": None}
    found = clauses(tokens.where("i > closing AND i < stop"), (F.col("depth") == 0) & up.isin(list(words)), definitions)
    name = F.create_map(*[x for k, v in words.items() if v for x in (F.lit(k), F.lit(v))])[F.col("word")]
    extra = found.select("definition", name.alias("property"), "whole", "clause_no").where("property IS NOT NULL").groupBy("definition", "property").agg(F.max_by("whole", "clause_no").alias("value"))
    extra = extra.groupBy("definition").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("properties"))
    return heads.join(keys, "definition", "left").join(extra, "definition", "left")


#: Words that start a clause of a query, some with the word after them; and words before JOIN.
QUERY_CLAUSES = {"FROM": "source_references", "WHERE": "where", "HAVING": "having", "UNION": "set_operators", "INTERSECT": "set_operators", "MINUS": "set_operators", "FETCH": "row_limit", "OFFSET": "row_limit"}
QUERY_PAIRS = {("GROUP", "BY"): "group_by", ("ORDER", "BY"): "ordering", ("WITH", "CHECK"): "check_option", ("WITH", "READ"): "read_only"}
JOIN_WORDS = ("NATURAL", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS")


def views(definitions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Rows (definition, property, component, value) of a view's query: its clauses as written, repeats joined by ' | '.

    A clause reaches to the next one, a join to the next join or clause; the projection and the
    declared columns are JSON lists, and each declared column is a component by its place.
    """
    whole = Window.partitionBy("definition")
    order = whole.orderBy("i")
    up, i, tok = F.col("up"), F.col("i"), F.col("tok")
    definitions = dealt(definitions) if tokens is None else definitions
    tokens = code_tokens(definitions) if tokens is None else tokens
    tokens = tokens.withColumn("view_at", first_at(up == "VIEW", whole))
    tokens = tokens.withColumn("as_at", first_at((up == "AS") & (i > F.col("view_at")), whole))
    tokens = tokens.withColumn("semicolon", F.coalesce(first_at((tok == ";") & (i > F.col("as_at")), whole), F.lit(FAR)))
    tokens = tokens.withColumn("before_end", F.lag("end").over(order))
    query = tokens.where("i > as_at AND i < semicolon")
    query = query.withColumn("query_at", F.min("i").over(whole)).withColumn("query_start", F.min("start").over(whole)).withColumn("query_end", F.max("end").over(whole))
    top = query.where((F.col("depth") == 0) & ~tok.isin("(", ")")).withColumn("then", F.lead("up").over(order))
    top = top.withColumn("select_at", first_at(up == "SELECT", whole))
    place = F.struct("i", "start", "before_end")
    before = [F.lag(F.struct("up", place.alias("place"))).over(order)] + [F.lag(F.struct("up", place.alias("place")), k).over(order) for k in (2, 3)]
    top = top.withColumns({f"b{k + 1}": b for k, b in enumerate(before)})
    name = F.create_map(*[F.lit(x) for pair in QUERY_CLAUSES.items() for x in pair])[up]
    for (one, two), value in QUERY_PAIRS.items():
        fits = (up == one) & (F.col("then") == two)
        name = F.when(fits & (i > F.col("select_at")) if one == "WITH" else fits, value).otherwise(name)
    starts = top.select("definition", name.alias("property"), place.alias("at"), "query_end").where("property IS NOT NULL")
    worded = lambda k: F.coalesce(F.col(f"b{k}.up").isin(*JOIN_WORDS), F.lit(False))
    join_at = F.when(worded(1) & worded(2) & worded(3), F.col("b3.place")).when(worded(1) & worded(2), F.col("b2.place")).when(worded(1), F.col("b1.place")).otherwise(place)
    is_join = up == "JOIN"
    ends = top.select("definition", F.when(is_join, "join").otherwise(name).alias("property"), F.when(is_join, join_at).otherwise(place).alias("at"), "query_end").where("property IS NOT NULL")

    def segments(rows: DataFrame) -> DataFrame:
        end = F.coalesce(F.lead("at.before_end").over(Window.partitionBy("definition").orderBy("at.i")), F.col("query_end"))
        return rows.select("definition", "property", F.col("at.i").alias("n"), F.col("at.start").alias("from"), end.alias("to"))

    over = query.where((tok == ")") | ((up == "OVER") & (F.col("prv") == ")") & (F.col("nxt") == "(")))
    over = over.withColumn("next", F.lead(F.struct("tok", "end")).over(Window.partitionBy("definition", "depth").orderBy("i"))).where((up == "OVER") & (F.col("next.tok") == ")"))
    parts = segments(starts).unionByName(segments(ends).where("property = 'join'"))
    parts = parts.unionByName(over.select("definition", F.lit("analytic").alias("property"), i.alias("n"), F.col("start").alias("from"), F.col("next.end").alias("to")))
    with_ = top.where((i == F.col("select_at")) & (i > F.col("query_at"))).select("definition", F.lit("with_clause").alias("property"), i.alias("n"), F.col("query_start").alias("from"), F.col("before_end").alias("to"))
    # dealt anew behind the union: its parts come from one shuffle, but their numbers of partitions may differ by then
    texts = parts.unionByName(with_).repartition("definition").join(definitions.select("definition", "fragment"), "definition")
    texts = texts.select("definition", "property", "n", F.trim(F.substring("fragment", F.col("from") + 1, F.col("to") - F.col("from"))).alias("value"))
    listed = texts.groupBy("definition", "property").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), " | ").alias("value"))

    first_clause = starts.join(top.where(i == F.col("select_at")).select("definition", "select_at"), "definition").where("at.i > select_at").groupBy("definition").agg(F.min("at.i").alias("stop"))
    chosen = query.join(top.where(i == F.col("select_at")).select("definition", "select_at", F.col("then").isin("DISTINCT", "UNIQUE").alias("is_distinct"), F.col("then").alias("distinct")), "definition").join(first_clause, "definition", "left")
    chosen = chosen.where((i > F.col("select_at") + F.when(F.col("is_distinct"), 1).otherwise(0)) & (i < F.coalesce("stop", F.lit(FAR))))
    projection = _listed(chosen, definitions, 0).select("definition", F.lit("projection").alias("property"), F.to_json("items").alias("value"))
    distinct = top.where((i == F.col("select_at")) & F.col("then").isin("DISTINCT", "UNIQUE")).select("definition", F.lit("distinct").alias("property"), F.col("then").alias("value"))
    columns = _listed(tokens.where("i > view_at AND i < as_at AND depth >= 1"), definitions, 1)
    ordered = columns.select("definition", F.lit("output_order").alias("property"), F.to_json("items").alias("value"))
    flags = tokens.where("i < view_at").groupBy("definition").agg(F.collect_set("up").alias("w"))
    has = lambda word: F.array_contains("w", word)
    flags = flags.select("definition", F.explode(F.array(F.struct(F.lit("force").alias("property"), F.when(has("FORCE"), "FORCE").when(has("NOFORCE"), "NO FORCE").alias("value")), F.struct(F.lit("editioning").alias("property"), F.when(has("EDITIONING"), "EDITIONING").alias("value")))).alias("x"))
    rows = listed.unionByName(projection).unionByName(distinct).unionByName(ordered).unionByName(flags.select("definition", "x.property", "x.value").where("value IS NOT NULL"))
    rows = rows.withColumn("component", F.lit(""))
    each = columns.select("definition", F.posexplode("items").alias("k", "value")).select("definition", F.lit("output_column").alias("property"), "value", (F.col("k") + 1).cast("string").alias("component"))
    return rows.unionByName(each)


def _listed(tokens: DataFrame, definitions: DataFrame, depth: int) -> DataFrame:
    """(definition, items): the texts between the commas of one depth."""
    comma = (F.col("tok") == ",") & (F.col("depth") == depth)
    before = Window.partitionBy("definition").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = tokens.withColumn("n", F.sum(comma.cast("int")).over(before)).where(~comma)
    grouped = numbered.groupBy("definition", "n").agg(*span(F.lit(True), "item")).join(definitions.select("definition", "fragment"), "definition")
    return grouped.groupBy("definition").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", text_of("item").alias("t")))), lambda x: x["t"]).alias("items"))


def trigger_target(text: Column) -> Column:
    """The name after the first ON that a name follows, as written up to a blank."""
    seen = sqltext.seen_tokens(sqltext.tokens(text))
    n = F.greatest(F.size(seen), F.lit(1))
    four = F.arrays_zip(seen.alias("a"), *[F.slice(seen, k, n).alias(c) for k, c in ((2, "b"), (3, "c"), (4, "d"))])
    hit = F.get(F.filter(four, lambda x: (x["a"]["up"] == "ON") & sqltext.is_name(x["b"]["tok"])), F.lit(0))
    plain = ~hit["b"]["tok"].startswith('"') & (hit["c"]["tok"] == ".")
    return F.when(plain, F.concat_ws(".", hit["b"]["tok"], hit["d"]["tok"])).otherwise(hit["b"]["tok"])


def _blocks(tokens: DataFrame) -> DataFrame:
    """Tokens with the routine (n, 0 before the first) they follow, the place of its IS, AS or ``;``, and how routines nest.

    ``open`` is how many routine bodies are open before the token: each IS or AS of a routine opens
    one, each END at which no BEGIN, CASE, IF or LOOP is left open closes the last.
    """
    up, i = F.col("up"), F.col("i")
    order = Window.partitionBy("definition").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("definition").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    after_end = F.coalesce(F.col("prv") == "END", F.lit(False))
    head = up.isin("PROCEDURE", "FUNCTION") & (F.col("depth") == 0) & ~F.coalesce(F.col("prv").isin("END", "DROP"), F.lit(False))
    tokens = tokens.withColumn("n", F.sum(head.cast("int")).over(order))
    step = F.when(up.isin("BEGIN", "CASE", "IF", "LOOP") & ~after_end, 1).when(up == "END", -1).otherwise(0)
    tokens = tokens.withColumn("nest", F.sum(step).over(order))
    one = Window.partitionBy("definition", "n")
    tokens = tokens.withColumn("first", F.min("i").over(one))
    tokens = tokens.withColumn("stop", F.when(F.col("n") > 0, F.coalesce(first_at((F.col("depth") == 0) & (up.isin("IS", "AS") | (F.col("tok") == ";")), one), F.lit(FAR))))
    opens = (F.col("n") > 0) & (i == F.col("stop")) & up.isin("IS", "AS")
    # the END of a routine belongs to a BEGIN, not to a CASE in a declaration
    outermost = F.last(F.when((F.col("nest") == 1) & up.isin("BEGIN", "CASE", "IF", "LOOP") & ~after_end, up), ignorenulls=True).over(order)
    tokens = tokens.withColumn("closes", (up == "END") & (F.col("nest") == 0) & (F.col("n") > 0) & (outermost == "BEGIN"))
    return tokens.withColumn("open", F.coalesce(F.sum(opens.cast("int") - F.col("closes").cast("int")).over(before), F.lit(0)))


def routines(definitions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Rows (definition, n, kind, name, signature, source, parameters, return_type, nested) of the procedures and functions of texts.

    A signature reaches from PROCEDURE or FUNCTION to the first IS, AS or ; outside parentheses, a
    source to the end of the routine.  parameters is a list of structs (position, name, mode,
    data_type, default, nocopy, definition).  Routines inside routines are left out and counted
    (nested).  Texts over PACKAGE_BYTES bytes and wrapped ones are left out (see ``routine_diagnostics``).
    """
    fit = definitions.where((F.octet_length("fragment") <= PACKAGE_BYTES) & ~F.col("fragment").rlike(WRAPPED))
    up, i = F.col("up"), F.col("i")
    tokens = code_tokens(fit) if tokens is None else tokens.join(fit.select("definition"), "definition", "left_semi")
    tokens = _blocks(tokens).where("n > 0")
    one = Window.partitionBy("definition", "n")
    tokens = tokens.withColumn("inner", F.max(F.when(i == F.col("first"), F.col("open"))).over(one) > 0)
    # a routine and those inside it, up to the END that closes it
    whole = Window.partitionBy("definition").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = tokens.withColumn("outer", F.max(F.when((i == F.col("first")) & ~F.col("inner"), F.col("n"))).over(whole))
    group = Window.partitionBy("definition", "outer")
    tokens = tokens.withColumn("shut", first_at(F.col("closes") & (F.col("open") <= 1), group))
    tokens = tokens.withColumn("last", first_at((F.col("tok") == ";") & (i >= F.coalesce("shut", "stop")), group))
    source = tokens.where(i <= F.coalesce("last", F.lit(FAR))).groupBy("definition", F.col("outer").alias("n")).agg(*span(F.lit(True), "source"), F.count_distinct(F.when(F.col("inner"), F.col("n"))).cast("int").alias("nested"))
    signature = tokens.where("NOT inner AND i < stop")
    signature = signature.withColumn("opening", first_at(F.col("tok") == "(", one)).withColumn("closing", first_at((F.col("tok") == ")") & (F.col("depth") == 0), one))
    heads = signature.groupBy("definition", "n").agg(
        F.min_by("up", "i").alias("kind"), F.min_by("nxt", "i").alias("name"), *span(F.lit(True), "signature"), *span((i > F.coalesce("closing", "first")) & (F.col("prv") == "RETURN"), "return_from"), F.max("end").alias("return_to")
    )
    comma = (F.col("tok") == ",") & (F.col("depth") == 1)
    inside = signature.where("i > opening AND i < closing").withColumn("position", F.sum(comma.cast("int")).over(Window.partitionBy("definition", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1).where(~comma)
    param = Window.partitionBy("definition", "n", "position")
    inside = inside.withColumn("k", F.row_number().over(param.orderBy("i"))).withColumn("default_at", F.coalesce(first_at(up.isin("DEFAULT", ":="), param), F.lit(FAR)))
    mode = (F.col("k") > 1) & (F.col("k") <= 4) & up.isin("IN", "OUT", "NOCOPY")
    params = inside.groupBy("definition", "n", "position").agg(
        F.min_by("tok", "i").alias("name"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(mode & (up != "NOCOPY"), F.struct("i", "up")))), lambda x: x["up"]), " ").alias("mode"),
        *span((F.col("k") > 1) & ~mode & (i < F.col("default_at")), "data_type"),
        *span(i >= F.col("default_at"), "default"),
        *span(F.lit(True), "definition_text"),
        F.max(up == "NOCOPY").alias("nocopy"),
    )
    params = params.join(fit.select("definition", "fragment"), "definition").select(
        "definition",
        "n",
        F.struct("position", "name", F.nullif(F.col("mode"), F.lit("")).alias("mode"), text_of("data_type").alias("data_type"), text_of("default").alias("default"), "nocopy", text_of("definition_text").alias("definition")).alias("p"),
    )
    params = params.groupBy("definition", "n").agg(F.sort_array(F.collect_list("p")).alias("parameters"))
    named = heads.join(source, ["definition", "n"]).join(fit.select("definition", "fragment"), "definition")
    returned = F.when(F.col("return_from_from").isNotNull(), F.trim(F.substring("fragment", F.col("return_from_from") + 1, F.col("return_to") - F.col("return_from_from"))))
    named = named.select("definition", "n", "kind", "name", text_of("signature").alias("signature"), text_of("source").alias("source"), returned.alias("return_type"), "nested")
    return named.join(params, ["definition", "n"], "left")


#: First words of package declarations, and their families.
DECLARED = {"TYPE": "type_declaration", "SUBTYPE": "type_declaration", "CURSOR": "cursor", "PRAGMA": "pragma"}


def package_properties(definitions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Rows (definition, property, component, value): what packages declare outside routines, AUTHID, and the initialisation of bodies.

    Declarations are the statements between the package's AS or IS and its first routine body, BEGIN
    or END; each is a component by its place among those of its family.
    """
    fit = definitions.where((F.octet_length("fragment") <= PACKAGE_BYTES) & ~F.col("fragment").rlike(WRAPPED))
    up, i = F.col("up"), F.col("i")
    tokens = code_tokens(fit) if tokens is None else tokens.join(fit.select("definition"), "definition", "left_semi")
    whole = Window.partitionBy("definition")
    tokens = _blocks(tokens)
    tokens = tokens.withColumn("as_at", first_at((F.col("depth") == 0) & up.isin("AS", "IS"), whole))
    ends = (F.col("open") > 0) | ((i > F.col("as_at")) & (((up == "BEGIN") & (F.col("open") == 0)) | (up == "END")))
    tokens = tokens.withColumn("stop_at", F.coalesce(first_at(ends, whole), F.lit(FAR)))
    order = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    body = tokens.where("i > as_at AND i < stop_at").withColumn("statement", F.coalesce(F.sum((F.col("tok") == ";").cast("int")).over(order), F.lit(0))).where("tok <> ';'")
    grouped = body.groupBy("definition", "statement").agg(F.min_by("up", "i").alias("word"), F.min_by("nxt", "i").alias("then"), F.max(up == "CONSTANT").alias("constant"), *span(F.lit(True), "text")).where("word NOT IN ('PROCEDURE', 'FUNCTION')")
    family = F.create_map(*[F.lit(x) for pair in DECLARED.items() for x in pair])[F.col("word")]
    family = F.coalesce(family, F.when(F.col("then") == "EXCEPTION", "exception_declaration").when(F.col("constant"), "constant").otherwise("variable"))
    rows = grouped.join(fit.select("definition", "fragment"), "definition").select("definition", "statement", family.alias("property"), F.concat(text_of("text"), F.lit(";")).alias("value"))
    rows = rows.withColumn("component", F.row_number().over(Window.partitionBy("definition", "property").orderBy("statement")).cast("string")).drop("statement")
    authid = tokens.where((up == "AUTHID") & (i < F.col("as_at"))).select("definition", F.lit("authid").alias("property"), F.concat_ws(" ", "up", "nxt").alias("value"), F.lit("").alias("component"))
    start = first_at((up == "BEGIN") & (F.col("open") == 0) & (F.col("nest") == 1), whole)
    set_up = tokens.withColumn("begin_at", start).withColumn("end_at", F.max(F.when(up == "END", i)).over(whole)).where("i > begin_at AND i < end_at")
    set_up = set_up.groupBy("definition").agg(*span(F.lit(True), "text")).join(fit.select("definition", "fragment"), "definition")
    set_up = set_up.select("definition", F.lit("initialization").alias("property"), text_of("text").alias("value"), F.lit("").alias("component"))
    return rows.unionByName(authid).unionByName(set_up)


WRAPPED = r"(?is)\b(?:PACKAGE(?:\s+BODY)?|PROCEDURE|FUNCTION)\s+\S+\s+WRAPPED\b"


def routine_diagnostics(definitions: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (definition, diagnostics): size limit, wrapped source, no routine found, overloads, nested routines."""
    per = found.groupBy("definition", "kind", F.upper("name").alias("name")).agg(F.count("*").alias("count"), F.sum("nested").alias("nested")).groupBy("definition").agg(F.max("count").alias("most"), F.sum("nested").alias("nested"))
    rows = definitions.join(per, "definition", "left")
    big, wrapped = F.octet_length("fragment") > PACKAGE_BYTES, F.col("fragment").rlike(WRAPPED)
    codes = [
        (big, "PACKAGE_EXTRACTION_SIZE_LIMIT"),
        (~big & wrapped, "WRAPPED_SOURCE_OPAQUE"),
        (~big & ~wrapped & F.col("most").isNull(), "PACKAGE_PARSE_UNRESOLVED"),
        (F.col("most") > 1, "OVERLOAD_PAIRING_REQUIRES_REVIEW"),
        (F.col("nested") > 0, "NESTED_ROUTINE_LIMITED"),
    ]
    return rows.select("definition", F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in codes])).alias("diagnostics"))


def body_facts(definitions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Rows (definition, n, routine, family, statement) of what the statements of routine bodies do, in order.

    A statement ends at a semicolon, or after THEN, LOOP, BEGIN, IS, AS, ELSE or EXCEPTION; routine is
    the place of the routine (0 before the first).  Statements of routines inside routines are left
    out.  A condition is what stands between IF or WHILE and THEN or LOOP.
    """
    up = F.col("up")
    tokens = _blocks(code_tokens(definitions) if tokens is None else tokens)
    one = Window.partitionBy("definition", "n")
    tokens = tokens.withColumn("inner", F.coalesce(F.max(F.when(F.col("i") == F.col("first"), F.col("open"))).over(one), F.lit(0)) > 0)
    order = Window.partitionBy("definition").orderBy("i")
    # after a routine inside has closed, the statements are the outer routine's again
    nested = F.col("inner") & (F.col("open") > 1)
    tokens = tokens.withColumn("routine", F.coalesce(F.max(F.when(~F.col("inner"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))).withColumn("nested", nested)
    after = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = (F.col("tok") == ";") | ((F.col("depth") == 0) & up.isin("THEN", "LOOP", "BEGIN", "IS", "AS", "ELSE", "EXCEPTION"))
    numbered = tokens.withColumn("k", F.coalesce(F.sum(ends.cast("int")).over(after), F.lit(0))).where("tok <> ';' AND NOT nested")
    grouped = numbered.groupBy("definition", F.col("k").alias("n")).agg(
        F.min("routine").alias("routine"),
        F.min_by("up", "i").alias("w"),
        F.min_by("nxt", "i").alias("w2"),
        *span(F.lit(True), "statement"),
        F.max((F.col("tok") == ":=")).alias("assigns"),
        F.max((F.col("nxt") == "(") & up.rlike(r"^[A-Z\"]")).alias("calls"),
        F.count("*").alias("words"),
        F.sum(F.when((F.col("tok") == ".") | (F.col("prv") == "."), 1).otherwise(0)).alias("dots"),
    )
    rows = grouped.join(definitions.select("definition", "fragment"), "definition").withColumn("text", text_of("statement"))
    w = F.col("w")
    name_alone = w.rlike(r"^[A-Z\"]") & (F.col("words") == F.col("dots") + 1)  # a call without arguments
    family = (
        F.when(w.isin("COMMIT", "ROLLBACK", "SAVEPOINT"), "transaction_statement")
        .when((w == "EXECUTE") & (F.col("w2") == "IMMEDIATE"), "dynamic_sql")
        .when(w.isin("INSERT", "UPDATE", "DELETE", "MERGE", "SELECT"), "sql_statement")
        .when(w == "RAISE", "raise")
        .when(w == "WHEN", "exception_handler")
        .when(w.isin("IF", "ELSIF", "CASE", "FOR", "WHILE", "LOOP", "EXIT", "CONTINUE", "RETURN", "GOTO"), "control_flow")
        .when(F.col("assigns"), "assignment")
        .when(F.col("calls") & ~w.isin("CREATE", "PROCEDURE", "FUNCTION", "PACKAGE"), "call_reference")
        .when(name_alone & (F.col("routine") > 0) & ~w.isin("BEGIN", "END", "NULL", "ELSE", "EXCEPTION", "DECLARE", "IS", "AS", "THEN"), "call_reference")
    )
    rows = rows.select("definition", "n", "routine", family.alias("family"), F.col("text").alias("statement")).where("family IS NOT NULL")
    condition = F.regexp_extract("statement", r"(?is)^(?:IF|WHILE)\b\s*(.*?)\s*\b(?:THEN|LOOP)$", 1)
    conditions = rows.where(F.col("family") == "control_flow").select("definition", "n", "routine", F.lit("condition").alias("family"), condition.alias("statement")).where("statement <> ''")
    return rows.unionByName(conditions)


#: Words before the name of an object in a statement.
TARGET_WORDS = ("FROM", "JOIN", "INTO", "UPDATE", "TABLE", "VIEW", "INDEX", "SEQUENCE")


def dynamic_profile(statement: Column, loop: Column | bool = False) -> Column:
    """mode, target, bind, concat, validation and loop of an EXECUTE IMMEDIATE statement, as one text.

    The expression is what stands between IMMEDIATE and the first USING outside literals.
    """
    pieces = sqltext.tokens(statement)
    visible = F.filter(F.transform(pieces, lambda t, k: F.struct(k.alias("piece"), t.alias("tok"), F.upper(t).alias("up"))), lambda x: ~x["tok"].rlike(r"^(?:\s|--|/\*)"))
    visible = F.when(F.try_element_at(visible, F.lit(-1))["tok"] == ";", F.slice(visible, 1, F.greatest(F.size(visible) - 1, F.lit(0)))).otherwise(visible)
    known = F.coalesce((F.get(visible, F.lit(0))["up"] == "EXECUTE") & (F.get(visible, F.lit(1))["up"] == "IMMEDIATE") & (F.size(visible) > 2), F.lit(False))
    using = F.array_position(F.transform(visible, lambda x: x["up"]), "USING")
    count = F.when(using > 0, using - 1).otherwise(F.size(visible)).cast("int")
    expression = F.slice(visible, 3, F.greatest(count - 2, F.lit(0)))
    text = F.array_join(F.transform(expression, lambda x: x["tok"]), " ")
    bind = F.array_join(F.slice(F.transform(visible, lambda x: x["up"]), 3, F.greatest(F.size(visible), F.lit(1))), " ").rlike(r"\bUSING\b")
    concat = text.contains("||")
    literal = (F.size(expression) == 1) & text.rlike(r"(?s)^'(?:[^']++|'')*+'$")
    inner = sqltext.seen_tokens(sqltext.tokens(F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("''"), F.lit("'"))))
    two = F.arrays_zip(inner.alias("a"), F.slice(inner, 2, F.greatest(F.size(inner), F.lit(1))).alias("b"))
    static = F.exists(two, lambda x: F.coalesce(x["a"]["up"].isin(*TARGET_WORDS) & sqltext.is_name(x["b"]["tok"]), F.lit(False)))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    mode = F.when(~known, "unknown").when(literal, "literal").otherwise("expression")
    target = F.when(~known, "unknown").when(literal & static, "static").when(literal, "unknown").when(concat, "runtime").otherwise("unknown")
    validation = F.when(~known, "unknown").when(literal, "not_applicable").when(concat & text.rlike(r"(?i)\bDBMS_ASSERT\s*\."), "visible").otherwise("not_observed")
    looped = F.lit(loop) if isinstance(loop, bool) else loop
    return F.concat(
        F.lit("mode="), mode, F.lit(",target="), target, F.lit(",bind="), yes(known & bind), F.lit(",concat="), yes(known & concat), F.lit(",validation="), validation, F.lit(",loop="), yes(looped)
    )


def _by_routine(found: DataFrame, prefix: str) -> DataFrame:
    """Rows (definition, family, component, value) of routines: one path a kind and name, overloads as one group of sources and signatures."""
    path = F.concat_ws("/", "kind", F.upper("name"))
    grouped = found.withColumn("path", path).groupBy("definition", "path").agg(F.count("*").alias("many"), F.array_sort(F.collect_list("source")).alias("sources"), F.array_sort(F.collect_list("signature")).alias("signatures"), F.first("return_type").alias("return_type"), F.first("parameters").alias("parameters"))
    alone = F.col("many") == 1
    value = lambda c: F.when(alone, F.col(c)[0]).otherwise(F.to_json(c))
    entries = [("definition", value("sources")), ("signature", value("signatures")), ("return_type", F.when(alone, F.col("return_type")))]
    rows = grouped.select("definition", F.col("path").alias("component"), F.explode(F.array(*[F.struct(F.lit(f"{prefix}.routine.{p}").alias("family"), v.alias("value")) for p, v in entries])).alias("x"))
    single = grouped.where(alone).select("definition", "path", F.explode("parameters").alias("p"))
    keys = ["definition", "name", "position", "mode", "data_type", "default", "nocopy"]
    parts = [F.struct(F.lit(f"{prefix}.parameter.{k}").alias("family"), F.col(f"p.{k}").cast("string").alias("value")) for k in keys]
    params = single.select("definition", F.concat_ws("/", "path", F.col("p.position").cast("string")).alias("component"), F.explode(F.array(*parts)).alias("x"))
    return rows.unionByName(params).select("definition", "x.family", "component", "x.value")


def fields(definitions: DataFrame) -> DataFrame:
    """All typed properties as rows (definition, object_type, family, component, value)."""
    return fields_and_diagnostics(definitions)[0]


def fields_and_diagnostics(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All typed properties as rows (definition, object_type, family, component, value), and what extraction doubts.

    Diagnostics are rows (definition, code, component): component is null where the whole definition is in
    doubt, else the column that is.  Definitions (definition, object_type, fragment, trigger_state) are cut to tokens once, which are
    written and shared by all extractors; each type has a branch of its own, and types that do not
    occur (at most eighteen do) have none.
    """
    from deltaloom.state.cache import checkpointed

    kinds = {r[0] for r in definitions.select("object_type").distinct().collect()}
    read = {"TABLE", "INDEX", "VIEW", "PACKAGE_SPEC", "PACKAGE_BODY", "PROCEDURE", "FUNCTION"} & kinds
    tokens = checkpointed(code_tokens(definitions.where(F.col("object_type").isin(*read)), keep=("object_type",))) if read else None
    of = lambda kind: definitions.where(F.col("object_type") == kind)
    tokens_of = lambda kind: tokens.where(F.col("object_type") == kind).drop("object_type")
    key = ["definition", "component"]
    column_families = {c: c for c in ("data_type", "length", "length_semantics", "precision", "scale", "nullable", "default", "default_on_null", "identity", "virtual_expression", "visibility", "position", "collation")} | {"definition_text": "definition"}
    constraint_families = {c: c for c in ("kind", "columns", "reference", "condition", "delete_rule", "enabled", "validation", "deferrable", "initially", "rely", "index_association")} | {"definition_text": "definition"}
    none = F.lit("").alias("component")
    parts, doubts = [], []
    nested = lambda found: found.where("nested > 0").select("definition", F.lit("NESTED_ROUTINE_LIMITED").alias("code"), F.lit(None).cast("string").alias("component")).distinct()

    def add(df: DataFrame, kind: str, prefix: str) -> None:
        parts.append(df.select("definition", F.lit(kind).alias("object_type"), F.concat(F.lit(prefix), "property").alias("family"), "component", "value"))

    if "TABLE" in kinds:
        d, t = of("TABLE"), tokens_of("TABLE")
        placed = checkpointed(tables.placed(d, t))
        replayed = replay.replayed(d, t, placed)
        doubts.append(replayed.diagnostics.select("definition", "code", "component"))
        add(unpivoted(replayed.columns, key, column_families), "TABLE", "table.column.")
        add(unpivoted(replayed.constraints, key, constraint_families), "TABLE", "table.constraint.")
        add(replayed.properties.withColumn("component", F.lit("")), "TABLE", "table.table_property.")
        add(tables.partitions(d, placed).select("definition", "component", F.lit("definition").alias("property"), F.col("definition_text").alias("value")), "TABLE", "table.partition.")
        add(replayed.comments.select("definition", "component", F.lit("text").alias("property"), "value"), "TABLE", "table.comment.")
    if "SEQUENCE" in kinds:
        add(unpivoted(sequence_options(of("SEQUENCE")).withColumn("component", F.lit("")), key, {c: c for c in SEQUENCE_OPTIONS}), "SEQUENCE", "sequence.sequence_property.")
    if "INDEX" in kinds:
        found = checkpointed(indexes(of("INDEX"), tokens_of("INDEX")).withColumn("component", F.lit("")))
        add(unpivoted(found, key, {"target": "target", "unique": "unique", "kind": "kind", "keys": "keys", "directions": "direction", "visibility": "visibility"}), "INDEX", "index.index_property.")
        add(found.select("definition", "component", F.explode("properties").alias("property", "value")), "INDEX", "index.index_property.")
    if "VIEW" in kinds:
        found = views(of("VIEW"), tokens_of("VIEW"))
        found = found.withColumn("property", F.when(F.col("property") == "output_column", "output_column.definition").otherwise(F.concat(F.lit("query_property."), "property")))
        add(found, "VIEW", "view.")
    if "TRIGGER" in kinds:
        add(of("TRIGGER").select("definition", none, F.lit("target").alias("property"), trigger_target(F.col("fragment")).alias("value")), "TRIGGER", "trigger.trigger_property.")
        add(of("TRIGGER").select("definition", none, F.lit("enabled_state").alias("property"), F.col("trigger_state").alias("value")), "TRIGGER", "trigger.trigger_property.")
    for kind in sorted({"PACKAGE_SPEC", "PACKAGE_BODY"} & kinds):
        prefix, d, t = kind.lower(), of(kind), tokens_of(kind)
        found = checkpointed(routines(d, t))
        doubts.append(nested(found))
        parts.append(_by_routine(found, prefix).select("definition", F.lit(kind).alias("object_type"), "family", "component", "value"))
        declared = package_properties(d, t)
        family = F.when(F.col("property") == "authid", f"{prefix}.package_property.authid").when(F.col("property") == "initialization", f"{prefix}.body_property.initialization").otherwise(F.concat(F.lit(f"{prefix}."), "property", F.lit(".definition")))
        parts.append(declared.where("property <> 'initialization'" if kind == "PACKAGE_SPEC" else "property <> 'authid'").select("definition", F.lit(kind).alias("object_type"), family.alias("family"), "component", "value"))
        if kind == "PACKAGE_BODY":
            alone = found.withColumn("path", F.concat_ws("/", "kind", F.upper("name"))).withColumn("many", F.count("*").over(Window.partitionBy("definition", "path"))).where("many = 1")
            bodies = alone.select("definition", F.col("path").alias("component"), F.lit("routine_body").alias("property"), F.col("source").alias("value"))
            facts = body_facts(d, t).join(alone.select("definition", F.col("n").alias("routine"), "path"), ["definition", "routine"])
            profiles = facts.where("family = 'dynamic_sql'").withColumn("statement", dynamic_profile(F.col("statement"))).withColumn("family", F.lit("dynamic_sql_profile"))
            listed = facts.unionByName(profiles).groupBy("definition", "path", "family").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n", "statement"))), lambda x: x["statement"])).alias("value"))
            add(bodies.unionByName(listed.select("definition", F.col("path").alias("component"), F.col("family").alias("property"), "value")), kind, "package_body.body_property.")
    for kind in sorted({"PROCEDURE", "FUNCTION"} & kinds):
        d, t = of(kind), tokens_of(kind)
        prefix = f"{kind.lower()}.{kind.lower()}_property."
        found = checkpointed(routines(d, t))
        doubts.append(nested(found))
        add(found.groupBy("definition").agg(F.to_json(F.array(F.min_by("signature", "n"))).alias("value")).select("definition", none, F.lit("signature").alias("property"), "value"), kind, prefix)
        facts = body_facts(d, t).where("family IN ('transaction_statement', 'exception_handler')")
        starts = lambda word: F.max((F.col("family") == "transaction_statement") & F.upper("statement").startswith(word))
        per = facts.groupBy("definition").agg(
            *[F.transform(F.sort_array(F.collect_list(F.when(F.col("family") == f, F.struct("n", "statement")))), lambda x: x["statement"]).alias(f) for f in ("transaction_statement", "exception_handler")],
            starts("COMMIT").alias("has_commit"), starts("ROLLBACK").alias("has_rollback"),
        )
        said = lambda c: F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")
        wide = d.select("definition").join(per, "definition", "left").select(
            "definition", none,
            *[F.when(F.size(f) > 0, F.to_json(f)).alias(f) for f in ("transaction_statement", "exception_handler")],
            said(F.size("exception_handler") > 0).alias("has_exception"), said(F.col("has_commit")).alias("has_commit"), said(F.col("has_rollback")).alias("has_rollback"),
        )
        add(unpivoted(wide, key, {c: c for c in ("transaction_statement", "exception_handler", "has_exception", "has_commit", "has_rollback")}), kind, prefix)
    for kind in sorted({"TYPE", "TYPE_BODY"} & kinds):
        add(of(kind).select("definition", none, F.lit("raw_definition").alias("property"), F.trim("fragment").alias("value")), kind, f"{kind.lower()}.type_property.")
    for kind, word in (("VIEW", "VIEW"), ("PACKAGE_SPEC", "PACKAGE"), ("PACKAGE_BODY", "PACKAGE")):
        if kind in kinds:
            before = tokens_of(kind).withColumn("at", first_at(F.col("up") == word, Window.partitionBy("definition"))).where("i < at").groupBy("definition").agg(F.collect_set("up").alias("w"))
            editionable = F.when(F.array_contains("w", "NONEDITIONABLE"), "NONEDITIONABLE").when(F.array_contains("w", "EDITIONABLE"), "EDITIONABLE")
            add(before.select("definition", none, F.lit("editionable").alias("property"), editionable.alias("value")), kind, "common.object.")
    text = F.lit("")
    out = definitions.select("definition", "object_type", text.alias("family"), none, text.alias("value")).where("false") if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    said = definitions.select("definition", text.alias("code"), none).where("false") if not doubts else doubts[0]
    for p in doubts[1:]:
        said = said.unionByName(p)
    return out.where("value IS NOT NULL"), said
