"""From files to object definitions: occurrences, inventories, lines and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import identity, sqltext


def decoded(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Files with ``text`` (null unless the bytes are UTF-8) and ``encoding``."""
    text = F.when(F.is_valid_utf8(F.col(raw).cast("string")), F.col(raw).cast("string"))
    return files.withColumn("text", text).withColumn("encoding", F.when(F.col("text").isNotNull(), "utf-8").otherwise("unresolved"))


def occurrences(files: DataFrame, default_schema: Column | str | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row for each object definition of each file (columns ``keys`` and ``text``).

    A definition reaches from its header to the next header or the end of the file.  A text is cut to
    pieces once; definitions are joined from their pieces before they become rows, so that no row
    carries the text of others, and places are running sums of the definitions' own lengths.  Files are
    dealt before they are cut: many of them can come from one small partition, and cutting is the work.
    """
    schema = F.lit(default_schema).cast("string") if not isinstance(default_schema, Column) else default_schema
    own = [F.col(k) for k in keys]
    # a header has the word, so other texts needn't be cut
    rows = files.where("text IS NOT NULL").where(F.contains(F.upper("text"), F.lit("CREATE"))).select(*own, schema.alias("default_schema"), "text")
    rows = rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = rows.select(*own, "default_schema", sqltext.tokens(F.col("text")).alias("pieces"))
    rows = rows.withColumn("seen", sqltext.seen_tokens(F.col("pieces")))
    rows = rows.select(*own, "default_schema", "pieces", sqltext.headers(F.col("seen")).alias("heads"), sqltext.trigger_states(F.col("seen")).alias("states"))

    def names(x: Column) -> tuple[Column, Column]:
        """Canonical schema and name of a struct (first, second)."""
        qualified = x["second"].isNotNull()
        return F.when(qualified, canonical(x["first"])).otherwise(F.upper("default_schema")), canonical(F.when(qualified, x["second"]).otherwise(x["first"]))

    def state_of(head: Column) -> Column:
        schema_name, name = names(head)
        fit = F.filter("states", lambda s: names(s)[0].eqNullSafe(schema_name) & (names(s)[1] == name))
        return F.when(head["object_type"] == "TRIGGER", F.try_element_at(fit, F.lit(-1))["state"])

    def definition(head: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("heads", k + 1)["piece"], F.size("pieces"))
        text = F.array_join(F.slice("pieces", head["piece"] + 1, stop - head["piece"]), "")
        return F.struct(head["object_type"].alias("object_type"), head["public"].alias("public"), head["first"].alias("first"), head["second"].alias("second"), state_of(head).alias("trigger_state"), text.alias("fragment"))

    lead = F.array_join(F.slice("pieces", 1, F.coalesce(F.get("heads", F.lit(0))["piece"], F.lit(0))), "")
    rows = rows.select(*own, "default_schema", F.transform("heads", definition).alias("found"), lead.alias("lead"))
    rows = rows.select(*own, "default_schema", F.length("lead").alias("c0"), F.octet_length("lead").alias("b0"), F.regexp_count("lead", F.lit("\n")).alias("l0"), F.posexplode_outer("found").alias("k", "x"))
    # filtered only here: a condition on the arrays would be pushed down and cut the text once more for each use
    rows = rows.where("x IS NOT NULL").select(*own, "default_schema", "c0", "b0", "l0", (F.col("k") + 1).alias("ordinal"), "x.*")
    rows = rows.withColumns({"chars": F.length("fragment"), "bytes": F.octet_length("fragment"), "lines": F.regexp_count("fragment", F.lit("\n"))})
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda start, c: (F.col(start) + F.coalesce(F.sum(c).over(before), F.lit(0))).cast("int")
    rows = rows.withColumns({"start_char": at("c0", "chars"), "start_byte": at("b0", "bytes"), "start_line": at("l0", "lines") + 1})
    has_schema = F.col("second").isNotNull()
    last = F.col("start_line") + F.col("lines") - F.when(F.col("fragment").endswith("\n"), 1).otherwise(0)
    found = rows.select(
        *own,
        "ordinal",
        "object_type",
        F.when(has_schema, identity.unquoted(F.col("first"))).otherwise(F.col("default_schema")).alias("raw_schema"),
        identity.unquoted(F.coalesce("second", "first")).alias("raw_name"),
        (has_schema & identity.is_quoted(F.col("first"))).alias("schema_quoted"),
        identity.is_quoted(F.coalesce("second", "first")).alias("name_quoted"),
        "start_char",
        (F.col("start_char") + F.col("chars")).alias("end_char"),
        "start_byte",
        (F.col("start_byte") + F.col("bytes")).alias("end_byte_exclusive"),
        "start_line",
        F.greatest("start_line", last).cast("int").alias("end_line"),
        F.sha2("fragment", 256).alias("fragment_sha256"),
        "fragment",
        F.when((F.col("object_type") == "SYNONYM") & F.col("public"), "PUBLIC").otherwise("SCHEMA").alias("namespace"),
        "trigger_state",
    )
    found = found.withColumn("schema_name", identity.canonical_name(F.col("raw_schema"), F.col("schema_quoted"))).withColumn("name", identity.canonical_name(F.col("raw_name"), F.col("name_quoted")))
    return found.withColumn("object_key", identity.object_key(F.col("namespace"), F.col("schema_name"), F.col("object_type"), F.col("name")))


def canonical(raw: Column) -> Column:
    return F.when(identity.is_quoted(raw), identity.unquoted(raw)).otherwise(F.upper(raw))


def file_inventory(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Per file (columns ``keys``, ``raw``): bytes, encoding, newline style, objects, bytes before the first, diagnostics."""
    rows = decoded(files).withColumn("pieces", sqltext.tokens(F.col("text")))
    rows = rows.withColumn("heads", sqltext.headers(sqltext.seen_tokens(F.col("pieces"))))
    rows = rows.withColumn("objects", F.coalesce(F.size("heads"), F.lit(0))).withColumn("objects", F.when(F.col("text").isNull(), 0).otherwise(F.col("objects")))
    lead = F.array_join(F.slice("pieces", 1, F.coalesce(F.get("heads", F.lit(0))["piece"], F.size("pieces"))), "")
    stray = F.octet_length(F.regexp_replace(F.when(F.col("text").isNotNull(), lead), r"^\s+|\s+$", ""))
    unresolved = F.when(F.col("text").isNull(), F.octet_length("raw")).otherwise(stray)
    diagnostics = F.when(F.col("text").isNull(), F.array(F.lit("ENCODING_UNRESOLVED"))).otherwise(
        F.concat(sqltext.piece_diagnostics(F.col("pieces")), F.when(stray > 0, F.array(F.lit("UNRESOLVED_PREFIX_OR_ARTIFACT"))).otherwise(F.array().cast("array<string>")))
    )
    status = F.when(F.col("text").isNull() | (F.col("objects") == 0), "unresolved").when(F.size(diagnostics) > 0, "limited").otherwise("parsed")
    return rows.select(
        *keys, F.octet_length("raw").alias("bytes"), "encoding", sqltext.newline_style(F.col("text")).alias("newline_style"), status.alias("parse_status"), "objects", unresolved.alias("unresolved_bytes"), diagnostics.alias("diagnostics")
    )


def lines(files: DataFrame, keys: tuple[str, ...] = ("path",), text: str = "text") -> DataFrame:
    """One row a line: ``keys``, line_no (from 1) and line."""
    return files.select(*keys, F.posexplode(F.split(text, "\n")).alias("i", "line")).select(*keys, (F.col("i") + 1).alias("line_no"), "line")


def line_range(files: DataFrame, first: int, last: int, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """The lines first..last of each file as one text, with byte offsets and hash."""
    parts = F.split("text", "\n")
    taken = F.slice(parts, F.lit(first), F.greatest(F.least(F.size(parts), F.lit(last)) - first + 1, F.lit(0)))
    before = F.array_join(F.slice(parts, F.lit(1), F.lit(first - 1)), "\n") if first > 1 else F.lit("")
    start = F.octet_length(before) + (1 if first > 1 else 0)
    rows = files.where(F.size(parts) >= first).select(*keys, F.array_join(taken, "\n").alias("content"), start.alias("start_byte"))
    return rows.select("*", (F.col("start_byte") + F.octet_length("content")).alias("end_byte_exclusive"), F.sha2("content", 256).alias("content_sha256"))


def search(files: DataFrame, query: str, regex: bool = False, keys: tuple[str, ...] = ("path",), cut: int = 2000) -> DataFrame:
    """Lines that contain a text (or match a pattern), case ignored: first place in the line, and the line cut."""
    found = lines(files, keys)
    if regex:
        place = F.regexp_instr("line", F.lit("(?i)" + query))
    else:
        place = F.instr(F.lower("line"), query.lower())
    return found.where(place > 0).select(*keys, "line_no", place.alias("place"), F.substring("line", 1, cut).alias("line"))


def whole_word(word: str) -> str:
    """A pattern for a name between signs that names don't have (ASCII)."""
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
    return rf"(?i)(?:^|[^A-Za-z0-9_$#]){quoted}(?:[^A-Za-z0-9_$#]|$)"


def references(files: DataFrame, name: str, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Lines that name the last part of a (qualified) name."""
    return lines(files, keys).where(F.col("line").rlike(whole_word(name.rpartition(".")[2].strip('"'))))


def symbols(files: DataFrame, name: str, kind: str | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Lines that create or alter a symbol, with its kind."""
    kinds = "|".join(t.replace(" ", r"\s+") for t in sorted(sqltext.OBJECT_TYPES, key=len, reverse=True))
    pattern = rf"(?i)(?:^|[^A-Za-z0-9_$#])(?:CREATE|ALTER)\s[^;]*?(?:^|[^A-Za-z0-9_$#])({kinds})[^A-Za-z0-9_$#]"
    found = references(files, name, keys).select("*", F.regexp_replace(F.upper(F.regexp_extract("line", pattern, 1)), r"\s+", " ").alias("kind")).where("kind <> ''")
    return found if kind is None else found.where(F.col("kind") == kind.upper())
