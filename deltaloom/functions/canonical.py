"""Canonical JSON in column expressions: keys sorted at every depth, chosen keys left out, digests of what is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Left out of digests: how long something took says nothing of what it is.
TIMING = ("elapsed_ms",)


def ordered(value: Column, kind: T.DataType, without: tuple[str, ...] = ()) -> Column:
    """The value with the fields of its structs in the order of their names, at every depth, less those in ``without``; nulls stay."""
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind.fields if f.name not in without), key=lambda f: f.name.encode())
        return F.when(value.isNotNull(), F.struct(*[ordered(value[f.name], f.dataType, without).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType, without))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], ordered(e["value"], kind.valueType, without))))
    return value


def text_of(value: Column, kind: T.DataType, without: tuple[str, ...] = ()) -> Column:
    """Canonical JSON: sorted keys, no blanks, nulls kept."""
    return F.to_json(ordered(value, kind, without), {"ignoreNullFields": "false"})


def digest_of(value: Column, kind: T.DataType, without: tuple[str, ...] = TIMING) -> Column:
    return F.sha2(text_of(value, kind, without), 256)


def strict(text: Column, schema: str, most: int = 1_000_000) -> Column:
    """JSON text as a struct of the schema, null unless it is an object of at most ``most`` bytes with the schema's keys, all of them and no other, of its types.

    Spark reads JSON leniently; what it read is held against the text parsed as a variant, key by key at the top.
    """
    kind = T._parse_datatype_string(schema)
    parsed = F.from_json(text, kind, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(text)
    same_keys = F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(f.name for f in kind.fields)])
    # a value that Spark could not read as its type is null though the text has one
    given = [F.get_json_object(text, f"$.{f.name}").isNull() == parsed[f.name].isNull() for f in kind.fields]
    fits = F.lit(True)
    for g in given:
        fits = fits & g
    # inside brackets, so that nothing may follow the object
    alone = F.concat(F.lit("["), text, F.lit("]"))
    valid = F.try_parse_json(alone).isNotNull() & (F.json_array_length(alone) == 1) & (F.octet_length(text) <= most)
    return F.when(F.coalesce(valid & same_keys & fits, F.lit(False)), parsed)


def fingerprint(name: Column, version: Column, sha256: Column) -> Column:
    """One line of a policy's fingerprint."""
    return F.concat_ws(":", name, version, sha256)


def duration(milliseconds: Column) -> Column:
    """Whole seconds, rounded half up, as hours, minutes and seconds in words; zero parts left out."""
    seconds = F.floor((milliseconds + 500) / 1000)
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    said = F.concat_ws(" ", part(F.floor(seconds / 3600), "h"), part(F.floor(seconds % 3600 / 60), "min"), part(seconds % 60, "s"))
    return F.when(milliseconds.isNotNull(), F.when(seconds == 0, "0 s").otherwise(said))
