"""The static dependency graph: edges from texts, resolution of names, bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import identity, sqltext

#: Relations of an edge, and how near each is to a change (equal numbers are alike).
PRIORITY = {"TYPE_REF": 0, "SPEC_BODY": 0, "TRIGGER_ON": 1, "FK_REF": 1, "WRITE": 2, "READ": 3, "CALL": 4, "SYNONYM_TO": 5}
#: Words before ( or ; that are no calls, and words that a called name does not follow.
NO_CALLS = (
    "BEGIN", "CASE", "COMMIT", "CREATE", "DECLARE", "DELETE", "END", "EXCEPTION", "EXECUTE", "FOR", "FUNCTION", "IF", "INSERT", "LOOP", "MERGE",
    "NULL", "PROCEDURE", "RAISE", "RETURN", "ROLLBACK", "SELECT", "THEN", "UPDATE", "WHEN", "WHILE",
)
NOT_CALLED = ("PROCEDURE", "FUNCTION", "END")
#: Fixed value: so many characters before a name are looked at for such a word.
CALL_CONTEXT = 32
#: Kinds of objects whose texts call routines by their name alone.
CALLERS = ("PACKAGE_BODY", "PROCEDURE", "FUNCTION")
#: Diagnostics of a text whose routines are not known.
OPAQUE = ("PACKAGE_EXTRACTION_SIZE_LIMIT", "WRAPPED_SOURCE_OPAQUE", "PACKAGE_PARSE_UNRESOLVED")
DEPTH = 2
AHEAD, BACK = 6, 5


def source_tokens(objects: DataFrame) -> DataFrame:
    """Code tokens of objects (object_key, schema_name, source, ...) with those around them: a1, a2 ... after and b1, b2 ... before.

    Literals are no tokens here.  Objects with something unterminated have none.
    """
    rest = [c for c in objects.columns if c != "source"]
    rows = objects.select(*rest, sqltext.tokens(F.col("source")).alias("pieces"))
    whole = F.size(sqltext.piece_diagnostics(F.col("pieces"))) == 0
    rows = rows.select(*rest, whole.alias("whole"), F.posexplode_outer("pieces").alias("piece", "tok")).where("whole AND tok IS NOT NULL").drop("whole")
    order = Window.partitionBy("object_key").orderBy("piece")
    rows = rows.withColumn("start", F.sum(F.length("tok")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("tok"))
    rows = rows.where(~F.col("tok").rlike(sqltext.UNSEEN)).withColumn("i", F.row_number().over(order))
    around = {f"a{k}": F.lead("tok", k).over(order) for k in range(1, AHEAD + 1)} | {f"b{k}": F.lag("tok", k).over(order) for k in range(1, BACK + 1)}
    return rows.withColumns(around).withColumn("up", F.upper("tok"))


def _upper(column: str) -> Column:
    return F.coalesce(F.upper(column), F.lit(""))


def _ahead(k: int) -> Column:
    """The name, qualified or not, that starts k tokens ahead."""
    one, dot, two = (F.col(f"a{k + d}") if k + d <= AHEAD else F.lit(None).cast("string") for d in range(3))
    return F.when(sqltext.is_name(one), F.when((dot == ".") & sqltext.is_name(two), F.array(one, two)).otherwise(F.array(one)))


def _behind(k: int, dot: bool = False) -> Column:
    """The name, qualified or not, that ends k tokens before."""
    one, two = F.col(f"b{k}"), F.col(f"b{k + 2}")
    name = F.when((F.col(f"b{k + 1}") == ".") & sqltext.is_name(two), F.array(two, one)).otherwise(F.array(one))
    return F.when(sqltext.is_name(one), name)


def _canonical(raw: Column) -> Column:
    return F.when(identity.is_quoted(raw), identity.unquoted(raw)).otherwise(F.upper(raw))


def references(objects: DataFrame) -> DataFrame:
    """Distinct (from_object, relation, ref_schema, ref_name, ref_label) of objects (object_key, schema_name, source).

    Each rule looks at a token and its neighbours.  Names of common table expressions are left out,
    and objects with something unterminated.
    """
    tokens = source_tokens(objects.select("object_key", "schema_name", "source"))
    up, next_ = F.col("up"), _upper("a1")
    order = Window.partitionBy("object_key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = tokens.withColumn("trigger_no", F.sum((up == "TRIGGER").cast("int")).over(order))
    on = (up == "ON") & (F.col("trigger_no") > 0) & sqltext.is_name(F.col("a1"))
    tokens = tokens.withColumn("on_no", F.sum(on.cast("int")).over(Window.partitionBy("object_key", "trigger_no").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    into = up.isin("INSERT", "MERGE") & (next_ == "INTO")
    synonym_for = F.when(_upper("a2") == "FOR", _ahead(3)).when((F.col("a2") == ".") & (_upper("a4") == "FOR"), _ahead(5))
    rules = [
        ("WRITE", F.when(into | ((up == "DELETE") & (next_ == "FROM")), _ahead(2)).when(up == "UPDATE", _ahead(1))),
        ("READ", F.when(up.isin("FROM", "JOIN"), _ahead(1)).when(up.isin("NEXTVAL", "CURRVAL") & (F.col("b1") == "."), _behind(2))),
        ("FK_REF", F.when(up == "REFERENCES", _ahead(1))),
        ("TRIGGER_ON", F.when(on & (F.col("on_no") == 1), _ahead(1))),
        ("TYPE_REF", F.when((F.col("tok") == "%") & next_.isin("TYPE", "ROWTYPE"), _behind(1))),
        ("SYNONYM_TO", F.when((up == "SYNONYM") & sqltext.is_name(F.col("a1")), synonym_for)),
    ]
    found = tokens.select("object_key", "schema_name", F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), parts.alias("parts")) for r, parts in rules])).alias("x"))
    found = found.select("object_key", "schema_name", "x.relation", "x.parts", _canonical(F.try_element_at("x.parts", F.lit(-1))).alias("ref_name")).where("parts IS NOT NULL")
    with_names = tokens.where((up == "WITH") | (F.col("tok") == ",")).where((_upper("a2") == "AS") & (F.col("a3") == "(") & sqltext.is_name(F.col("a1")))
    with_names = with_names.select("object_key", F.upper("a1").alias("cte")).distinct()
    found = found.join(with_names, (found.object_key == with_names.object_key) & (F.upper(found.ref_name) == with_names.cte), "left_anti")
    qualified = F.size("parts") == 2
    return found.select(
        F.col("object_key").alias("from_object"),
        "relation",
        F.when(qualified, _canonical(F.col("parts")[0])).otherwise(F.upper("schema_name")).alias("ref_schema"),
        "ref_name",
        F.array_join("parts", ".").alias("ref_label"),
    ).distinct()


def calls(objects: DataFrame) -> DataFrame:
    """Calls in objects (object_key, object_type, schema_name, name, source): one row a place.

    Columns: object_key, i (place), local, ref_schema and ref_name (the package), alone_schema (of a
    routine outside packages), routine, and the arguments (positional, named, ordered; all null where
    they can't be told apart).  A qualified name before ( or ; is a call; a name alone is a local one
    in the texts of ``CALLERS``, unless it is one of ``NO_CALLS`` or follows one of ``NOT_CALLED``.
    """
    tokens = source_tokens(objects.select("object_key", "object_type", "schema_name", "name", "source"))
    order = Window.partitionBy("object_key").orderBy("i")
    word = F.when(F.col("tok").rlike("^[A-Za-z]"), F.struct("up", "start"))
    before = F.last(word, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    tokens = tokens.withColumn("word", before)
    called = sqltext.is_name(F.col("tok")) & F.col("a1").isin("(", ";")
    qualified = called & (F.col("b1") == ".") & sqltext.is_name(F.col("b2"))
    follows = F.coalesce((F.col("word.start") >= F.col("start") - CALL_CONTEXT) & F.col("word.up").isin(*NOT_CALLED), F.lit(False))
    local = called & F.col("object_type").isin(*CALLERS) & ~_canonical(F.col("tok")).isin(*NO_CALLS) & ~F.coalesce(F.col("b1") == ".", F.lit(False)) & ~follows
    package = F.when(qualified, _behind(2)).when(local & (F.col("object_type") == "PACKAGE_BODY"), F.array("name")).when(local, F.array(F.coalesce("schema_name", "name")))
    found = tokens.select("*", F.coalesce(local, F.lit(False)).alias("local"), package.alias("package"), (F.col("i") + 1).alias("opening")).where("package IS NOT NULL")
    # an object's own name stands for a package by its upper-case form
    canon = lambda raw: F.when(F.col("local"), F.upper(raw)).otherwise(_canonical(raw))
    two = F.size("package") == 2
    found = found.select(
        "object_key",
        "i",
        "local",
        "opening",
        F.when(two, canon(F.col("package")[0])).otherwise(F.upper("schema_name")).alias("ref_schema"),
        canon(F.try_element_at("package", F.lit(-1))).alias("ref_name"),
        canon(F.col("package")[0]).alias("alone_schema"),
        _canonical(F.col("tok")).alias("routine"),
        (F.col("a1") == ";").alias("bare"),
    )
    joined = found.join(_arguments(tokens), ["object_key", "opening"], "left")
    none = F.col("bare")
    return joined.select(
        "object_key", "i", "local", "ref_schema", "ref_name", "alone_schema", "routine",
        F.when(none, 0).otherwise(F.col("positional")).alias("positional"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.col("named")).alias("named"),
        F.when(none, True).otherwise(F.col("ordered")).alias("ordered"),
    )


def _arguments(tokens: DataFrame) -> DataFrame:
    """(object_key, opening, positional, named, ordered) of what is between parentheses, by the place of the opening one.

    A token belongs to the last parenthesis opened at the level below its own; a parenthesis is at the
    level that it stands in.
    """
    order = Window.partitionBy("object_key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, closes = F.col("tok") == "(", F.col("tok") == ")"
    level = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order) - opens.cast("int")
    rows = tokens.select("object_key", "i", "tok", "up", level.alias("level"))
    # each parenthesis also starts a group on the level that it opens
    rows = rows.withColumn("at", F.explode(F.when(F.col("tok") == "(", F.array(F.struct(F.lit(False).alias("starts"), "level"), F.struct(F.lit(True).alias("starts"), (F.col("level") + 1).alias("level")))).otherwise(F.array(F.struct(F.lit(False).alias("starts"), "level")))))
    inside = Window.partitionBy("object_key", "at.level").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("opening", F.last(F.when(F.col("at.starts"), F.col("i")), ignorenulls=True).over(inside)).where("opening IS NOT NULL AND at.level > 0")
    # the group is whole if its level was left again: some ) at the level below comes before the next (
    pairs_ = tokens.where(opens | closes).select("object_key", "i", "tok", level.alias("level"))
    shut = pairs_.withColumn("then", F.lead("tok").over(Window.partitionBy("object_key", "level").orderBy("i"))).where((F.col("tok") == "(") & (F.col("then") == ")")).select("object_key", F.col("i").alias("opening"))
    own = F.collect_list(F.when(~F.col("at.starts"), F.struct("i", "tok", "up")))
    listed = rows.groupBy("object_key", "opening").agg(F.sort_array(own).alias("t")).join(shut, ["object_key", "opening"], "left_semi")
    commas = F.filter(F.transform("t", lambda x, k: F.when(x["tok"] == ",", k)), lambda k: k.isNotNull())
    ends = F.concat(commas, F.array(F.size("t")))
    parts = F.transform(ends, lambda e, k: F.slice("t", F.when(k == 0, 1).otherwise(F.get(ends, k - 1) + 2), F.greatest(e - F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1), F.lit(0))))
    listed = listed.withColumn("parts", F.when(F.size("t") == 0, F.array().cast("array<array<struct<i:int,tok:string,up:string>>>")).otherwise(parts))
    name_of = lambda p: F.when((F.get(p, F.lit(1))["tok"] == "=>") & F.get(p, F.lit(0))["tok"].rlike(identity.PLAIN_NAME) & (F.size(p) > 2), F.get(p, F.lit(0))["up"])
    listed = listed.withColumn("names", F.transform("parts", name_of))
    named = F.filter("names", lambda n: n.isNotNull())
    first_named = F.array_position(F.transform("names", lambda n: n.isNotNull()), True)
    ordered = (first_named == 0) | F.forall(F.slice("names", F.greatest(first_named, F.lit(1)).cast("int"), F.greatest(F.size("names"), F.lit(1))), lambda n: n.isNotNull())
    good = F.forall("parts", lambda p: F.size(p) > 0)
    return listed.where(good).select("object_key", "opening", (F.size("names") - F.size(named)).alias("positional"), named.alias("named"), ordered.alias("ordered"))


def routine_shapes(objects: DataFrame) -> DataFrame:
    """Distinct (shape_schema, shape_name, routine, names, required) of the routines of packages and of standalone ones."""
    from deltaloom.extract import objects as extract

    kinds = objects.where(F.col("object_type").isin("PACKAGE_SPEC", "PACKAGE_BODY", "PROCEDURE", "FUNCTION"))
    texts = kinds.select(F.col("object_key").alias("definition"), F.col("source").alias("fragment"))
    found = extract.routines(texts)
    opaque = extract.routine_diagnostics(texts, found).where(F.arrays_overlap("diagnostics", F.array(*[F.lit(x) for x in OPAQUE]))).select("definition")
    rows = found.join(opaque, "definition", "left_anti").join(kinds.select(F.col("object_key").alias("definition"), "object_type", F.col("schema_name").alias("shape_schema"), F.col("name").alias("shape_name")), "definition")
    alone = F.col("object_type").isin("PROCEDURE", "FUNCTION")
    names = F.coalesce(F.transform("parameters", lambda p: F.upper(F.replace(F.coalesce(p["name"], F.lit("")), F.lit('"'), F.lit("")))), F.array().cast("array<string>"))
    required = F.coalesce(F.size(F.filter("parameters", lambda p: p["default"].isNull())), F.lit(0))
    return rows.select("shape_schema", "shape_name", F.when(alone, F.upper("shape_name")).otherwise(F.upper("name")).alias("routine"), names.alias("names"), required.alias("required")).distinct()


#: What an edge of each relation says it is.
REASONS = {
    "WRITE": "DML target",
    "FK_REF": "foreign key target",
    "TRIGGER_ON": "trigger target",
    "SYNONYM_TO": "synonym target",
    "TYPE_REF": "percent type reference",
    "READ": "query source",
    "SPEC_BODY": "package specification/body pair",
}


def edges(objects: DataFrame) -> DataFrame:
    """Distinct (from_object, to_candidates, to_label, relation, resolution, reason) of a snapshot's objects.

    ``objects`` has object_key, object_type, schema_name, name and source.  Local calls that resolve to
    nothing are no edges; package specifications and bodies are tied both ways.
    """
    symbols = objects.select("schema_name", "name", "object_key")
    refs = resolved(references(objects).drop("ref_label").distinct(), symbols)
    label = lambda: F.when(F.col("resolution") != "unresolved", F.array_join("candidates", ",")).otherwise(F.concat_ws(".", "ref_schema", "ref_name"))
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[F.col("relation")]
    out = refs.select("from_object", F.col("candidates").alias("to_candidates"), label().alias("to_label"), "relation", "resolution", reason.alias("reason"))
    packages = objects.where(F.col("object_type").isin("PACKAGE_SPEC", "PACKAGE_BODY")).select("schema_name", "name", "object_key")
    alone = objects.where(F.col("object_type").isin("PROCEDURE", "FUNCTION")).select("schema_name", "name", "object_key")
    found = resolved_calls(calls(objects), packages, alone).where("NOT local OR resolution <> 'unresolved'")
    found = found.withColumns({"shape_schema": F.when(F.col("alone"), F.col("alone_schema")).otherwise(F.col("ref_schema")), "shape_name": F.when(F.col("alone"), F.col("routine")).otherwise(F.col("ref_name"))})
    bound = bound_calls(found, routine_shapes(objects), ["shape_schema", "shape_name", "routine"])
    kind = F.when(F.col("local"), "local routine").when(F.col("alone"), "standalone routine").otherwise("qualified package/routine")
    out = out.unionByName(
        bound.select(F.col("object_key").alias("from_object"), F.col("candidates").alias("to_candidates"), label().alias("to_label"), F.lit("CALL").alias("relation"), "resolution", F.concat(kind, F.lit(" call candidate; binding="), "binding").alias("reason"))
    )
    of = lambda kind: objects.where(F.col("object_type") == kind)
    both = pairs(of("PACKAGE_SPEC"), of("PACKAGE_BODY"), ["schema_name", "name"], "object_key", "SPEC_BODY")
    both = both.select("from_object", F.array("to_object").alias("to_candidates"), F.col("to_object").alias("to_label"), "relation", F.lit("resolved_static").alias("resolution"), F.lit(REASONS["SPEC_BODY"]).alias("reason"))
    return out.unionByName(both).distinct()


def neighbours(edges_: DataFrame, changed: DataFrame, depth: int = DEPTH, reverse: bool = False) -> DataFrame:
    """Rows (object_key, edge columns): for each changed object (object_key) the edges at most ``depth`` steps away.

    Forwards, edges leave a node; in reverse, they name it as their target or one of their candidates.
    Only resolved edges are followed further, and no node is visited twice.  Edges are distinct, as ``edges`` gives
    them: the first step then needs no shuffle of what it finds.
    """
    if not 0 <= depth <= 2:
        raise ValueError("depth must be between 0 and 2")
    at = edges_.select(F.explode(F.array_distinct("to_candidates")).alias("node"), "*") if reverse else edges_.select(F.col("from_object").alias("node"), "*")
    front = seen = changed.select("object_key", F.col("object_key").alias("node")).distinct()
    chosen = None
    for level in range(depth):
        step = front.join(at, "node").drop("node")
        step = step.distinct() if level else step  # later, several nodes lead to one edge
        chosen = step if chosen is None else chosen.unionByName(step).distinct()
        if level + 1 < depth:
            onward = F.col("from_object") if reverse else F.element_at("to_candidates", 1)
            front = step.where("resolution = 'resolved_static'").select("object_key", onward.alias("node")).distinct().join(seen, ["object_key", "node"], "left_anti")
            seen = seen.unionByName(front)
    return chosen if chosen is not None else front.join(at, "node").drop("node").where("false")


def context_planes(old_edges: DataFrame, new_edges: DataFrame, changed: DataFrame, depth: int = 1) -> DataFrame:
    """Edges of each changed object with their ``side``: who used it before, whom it uses now, and who uses it now."""
    planes = [("old_reverse", neighbours(old_edges, changed, depth, True)), ("new_outgoing", neighbours(new_edges, changed, depth)), ("new_reverse", neighbours(new_edges, changed, depth, True))]
    out = None
    for side, rows in planes:
        rows = rows.withColumn("side", F.lit(side))
        out = rows if out is None else out.unionByName(rows)
    return out


def resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with candidates (list), resolution and how: exact schema and name first, else the name alone.

    ``refs`` has ref_schema and ref_name; ``symbols`` (schema_name, name, object_key); no schema is a
    schema of its own.  Two hash joins on grouped symbols, instead of a look through all symbols for
    each reference.
    """
    exact = symbols.groupBy("schema_name", "name").agg(F.array_sort(F.collect_set("object_key")).alias("hits__"))
    by_name = symbols.groupBy("name").agg(F.array_sort(F.collect_set("object_key")).alias("by_name__"))
    joined = refs.join(exact, refs.ref_schema.eqNullSafe(exact.schema_name) & (refs.ref_name == exact.name), "left").drop("schema_name", "name")
    joined = joined.join(by_name, joined.ref_name == by_name.name, "left").drop("name")
    hits = F.coalesce(F.size("hits__"), F.lit(0))
    candidates = F.coalesce("hits__", "by_name__", F.array().cast("array<string>"))
    resolution = F.when(hits == 1, "resolved_static").when(hits > 1, "candidate").when(F.col("by_name__").isNotNull(), "candidate").otherwise("unresolved")
    how = F.when(hits == 1, "exact").when(hits > 1, "several_exact").when(F.col("by_name__").isNotNull(), "name_only").otherwise("not_found")
    return joined.select(*refs.columns, candidates.alias("candidates"), resolution.alias("resolution"), how.alias("how"))


def resolved_calls(calls_: DataFrame, packages: DataFrame, standalone: DataFrame) -> DataFrame:
    """Calls (ref_schema, ref_name: package, alone_schema, routine) resolved to packages, else to routines of alone_schema; alone says which."""
    first = resolved(calls_, packages)
    alone = standalone.groupBy("schema_name", "name").agg(F.array_sort(F.collect_set("object_key")).alias("alone"))
    joined = first.join(alone, (first.alone_schema == alone.schema_name) & (first.routine == alone.name), "left").drop("schema_name", "name")
    use = (F.col("resolution") == "unresolved") & F.col("alone").isNotNull()
    return joined.select(
        *calls_.columns,
        F.when(use, F.col("alone")).otherwise(F.col("candidates")).alias("candidates"),
        F.when(use, F.when(F.size("alone") == 1, "resolved_static").otherwise("candidate")).otherwise(F.col("resolution")).alias("resolution"),
        use.alias("alone"),
    )


def bound_calls(calls_: DataFrame, shapes: DataFrame, on: list[str]) -> DataFrame:
    """Calls with a binding: how many of the routine's shapes their arguments fit.

    calls: positional (count), named (list, upper case), ordered (no positional after named), all null
    where the arguments are unknown; shapes: names (list), required (count).  A call fits if it gives no
    more positional arguments than there are parameters, names parameters only and none twice, and
    gives the required number of parameters, by place or by name.
    """
    shaped = shapes.groupBy(*on).agg(F.collect_set(F.struct("names", "required")).alias("shapes"))  # the overloads of one routine
    condition = None
    for c in on:
        one = calls_[c].eqNullSafe(shaped[c])
        condition = one if condition is None else condition & one
    joined = calls_.join(shaped, condition, "left").select(*[calls_[c] for c in calls_.columns], "shapes")
    given = F.size("named")

    def fits(shape: Column) -> Column:
        supplied = F.array_union("named", F.slice(shape["names"], F.lit(1), F.greatest(F.col("positional"), F.lit(0))))
        return (F.col("positional") <= F.size(shape["names"])) & F.forall("named", lambda n: F.array_contains(shape["names"], n)) & (F.size(supplied) >= shape["required"])

    fitting = F.when(F.col("ordered") & (F.size(F.array_distinct("named")) == given), F.size(F.filter("shapes", fits))).otherwise(0)
    binding = (
        F.when(F.col("positional").isNull(), "arguments_unparsed")
        .when(F.col("shapes").isNull(), "definition_unresolved")
        .when(fitting == 0, "incompatible_arity_or_names")
        .when(fitting == 1, "arity_name_compatible_type_unresolved")
        .otherwise("overload_candidate")
    )
    return joined.withColumn("binding", binding).drop("shapes")


def split_arguments(text: Column) -> Column:
    """Struct (positional, named, ordered) of a call's argument list; null where it isn't balanced."""
    pieces = sqltext.tokens(text)
    state = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("current"), F.array().cast("array<string>").alias("done")),
        lambda s, t: F.struct(
            (s["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"),
            F.when((t == ",") & (s["depth"] == 0), "").otherwise(F.concat(s["current"], t)).alias("current"),
            F.when((t == ",") & (s["depth"] == 0), F.concat(s["done"], F.array(F.trim(s["current"])))).otherwise(s["done"]).alias("done"),
        ),
    )
    arguments = F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.concat(state["done"], F.array(F.trim(state["current"]))))
    name = rf"(?s)^({sqltext.NAME})\s*=>"
    named = F.filter(arguments, lambda a: a.rlike(name))
    ordered = F.size(F.filter(arguments, lambda a, i: ~a.rlike(name) & (i >= F.size(arguments) - F.size(named)))) == 0
    result = F.struct((F.size(arguments) - F.size(named)).alias("positional"), F.transform(named, lambda a: F.upper(F.regexp_extract(a, name, 1))).alias("named"), ordered.alias("ordered"))
    return F.when((state["depth"] == 0) & F.forall(arguments, lambda a: a != ""), result)


def pairs(left: DataFrame, right: DataFrame, on: list[str], key: str, relation: str = "SPEC_BODY") -> DataFrame:
    """Both directions of the pairs of rows with equal ``on`` columns."""
    a, b = left.select(*on, F.col(key).alias("from_object")), right.select(*on, F.col(key).alias("to_object"))
    one = a.join(b, on).select("from_object", "to_object", F.lit(relation).alias("relation"))
    return one.unionByName(one.select(F.col("to_object").alias("from_object"), F.col("from_object").alias("to_object"), "relation"))


def attached(edges: DataFrame, changed: DataFrame, key: str = "object_key") -> DataFrame:
    """Each edge with every changed object it touches: two equi-joins and a union, not a join on OR."""
    ends = [edges.join(changed, edges[end] == changed[key]).select(changed[key], *edges.columns) for end in ("from_object", "to_object")]
    return ends[0].union(ends[1]).distinct()


def reached(edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, source: str = "from_object", target: str = "to_object") -> DataFrame:
    """(node, level): nodes at most ``depth`` edges from the seeds (node), each at its least level.

    One join a level; the depth is bounded, so the plan is.  Only new nodes are followed further.
    """
    seen = front = seeds.select("node").distinct().withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        hops = edges.select(F.col(source).alias("node"), F.col(target).alias("next"))
        step = front.join(hops, "node").select(F.col("next").alias("node")).distinct().withColumn("level", F.lit(level))
        front = step.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(front)
    return seen


def touched_edges(edges: DataFrame, nodes: DataFrame, depth: int = DEPTH, source: str = "from_object") -> DataFrame:
    """Edges that leave nodes reached in fewer than ``depth`` steps, once each."""
    inner = nodes.where(F.col("level") < depth).select(F.col("node").alias(source))
    return edges.join(inner, source, "left_semi").distinct()


def chased(links: DataFrame, starts: DataFrame, hops: int = 5) -> DataFrame:
    """(start, last, hops, code) of following links (name, target) from each start (name).

    code: RESOLVED where the last name is no link, SYNONYM_CYCLE or SYNONYM_HOP_LIMIT.
    """
    now = starts.select(F.col("name").alias("start"), F.col("name").alias("last"), F.array("name").alias("path"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("code"))
    unique = links.groupBy("name").agg(F.min("target").alias("target"))
    for i in range(hops + 1):
        joined = now.join(unique, now.last == unique.name, "left")
        open_ = F.col("code").isNull()
        ended, cycle = open_ & F.col("target").isNull(), open_ & F.array_contains("path", F.col("target"))
        over = open_ & F.lit(i == hops)
        code = F.when(~open_, F.col("code")).when(ended, "RESOLVED").when(cycle, "SYNONYM_CYCLE").when(over, "SYNONYM_HOP_LIMIT")
        go = open_ & ~F.coalesce(ended, F.lit(True)) & ~F.coalesce(cycle, F.lit(False)) & ~over
        now = joined.select(
            "start", F.when(go, F.col("target")).otherwise(F.col("last")).alias("last"), F.when(go, F.concat("path", F.array("target"))).otherwise(F.col("path")).alias("path"), (F.col("hops") + go.cast("int")).alias("hops"), code.alias("code")
        )
    return now.select("start", "last", "hops", "code")


def for_all(parts: DataFrame, targets: DataFrame, group: str, on: list[str], most: int | None = None) -> DataFrame:
    """Groups of which every part hits exactly one target, with their parts and targets (a division).

    ``most`` bounds the parts of one target.
    """
    hits = targets.groupBy(*on).agg(F.count("*").alias("hits"))
    joined = parts.join(hits, on, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    good = joined.groupBy(group).agg(F.min("hits").alias("least"), F.max("hits").alias("most")).where("least = 1 AND most = 1").select(group)
    rows = parts.join(good, group, "left_semi").join(targets, on)
    if most is not None:
        rows = rows.withColumn("n__", F.count("*").over(Window.partitionBy(*on))).where(F.col("n__") <= most).drop("n__")
    return rows


def selected_context(edges_: DataFrame, quota: int = 8) -> DataFrame:
    """Edges of the three planes (column ``side``), the first ``quota`` of each side and object by relation priority, with omissions counted.

    Each task keeps ``quota`` rows of an object and side, and counts the others, before anything is shuffled: an
    object of a million edges sends as much as one of a few.
    """
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])[F.col("relation")]
    target = "to_label" if "to_label" in edges_.columns else "to_object"
    w = Window.partitionBy("object_key", "side").orderBy(rank, target, "from_object", "relation")
    first = edges_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)
    counts = edges_.groupBy(F.col("object_key").alias("key_"), F.col("side").alias("side_")).agg(F.greatest(F.count("*") - quota, F.lit(0)).alias("omitted"))
    return first.join(counts, F.col("object_key").eqNullSafe(F.col("key_")) & F.col("side").eqNullSafe(F.col("side_"))).drop("key_", "side_")


def context_evidence(selected: DataFrame, old_evidence: DataFrame, new_evidence: DataFrame) -> DataFrame:
    """Distinct evidence rows (object_key of the change, evidence columns) of the objects at the far ends of selected edges.

    Evidence tables have related (an object) and their own columns; the old side reads the old one.
    """
    far = F.when(F.col("side") == "new_outgoing", F.col("to_label")).otherwise(F.col("from_object"))
    rows = selected.select("object_key", "side", far.alias("related"))
    old = rows.where("side = 'old_reverse'").join(old_evidence, "related")
    return old.unionByName(rows.where("side <> 'old_reverse'").join(new_evidence, "related")).drop("side", "related").distinct()
