"""Identifiers, keys and digests of database objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what an identifier without quotes looks like.
PLAIN_NAME = r"^[A-Za-z][A-Za-z0-9_$#]*$"


def unquoted(raw: Column) -> Column:
    """The name inside double quotes, doubled quotes made single; other text as it is."""
    return F.when(is_quoted(raw), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)


def is_quoted(raw: Column) -> Column:
    return F.coalesce((F.length(raw) >= 2) & raw.startswith('"') & raw.endswith('"'), F.lit(False))


def canonical_name(name: Column, quoted: Column) -> Column:
    """Quoted names verbatim, plain names in upper case, any other verbatim."""
    return F.when(quoted, name).when(name.rlike(PLAIN_NAME), F.upper(name)).otherwise(name)


def name_confidence(name: Column, quoted: Column) -> Column:
    return F.when(quoted | name.rlike(PLAIN_NAME), "known").otherwise("uncertain")


def object_key(namespace: Column, schema: Column, object_type: Column, name: Column, subkey: Column | None = None) -> Column:
    parts = [namespace, F.coalesce(schema, F.lit("")), F.upper(object_type), name]
    key = F.concat_ws("|", *parts)
    return key if subkey is None else F.when(F.length(subkey) > 0, F.concat_ws("|", key, subkey)).otherwise(key)


def component_key(raw: Column) -> Column:
    """Q: and the exact name if quoted, U: and the upper-case name otherwise."""
    return F.when(is_quoted(raw), F.concat(F.lit("Q:"), unquoted(raw))).otherwise(F.concat(F.lit("U:"), F.upper(raw)))


def stable_id(prefix: str, **fields: Column) -> Column:
    """prefix_ and the SHA-256 of the fields as canonical JSON: keys sorted, nulls kept."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.concat(F.lit(prefix + "_"), F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256))


def fact_id(object_key_: Column, family: Column, path: Column) -> Column:
    """fact- and 32 hex digits of the SHA-256 of the JSON list [key, family, path]."""
    text = F.concat(F.lit("["), json_text(object_key_), F.lit(","), json_text(family), F.lit(","), F.to_json(path), F.lit("]"))
    return F.concat(F.lit("fact-"), F.substring(F.sha2(text, 256), 1, 32))


def json_text(value: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def grouped_digits(value: Column, mark: str = ".") -> Column:
    """An integer literal with its digits grouped by three, never parsed as a number."""
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), F.regexp_replace(value, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", mark)).otherwise(value)


def rendered(value: Column, kind: str) -> Column:
    """A property value as fact text: booleans true or false, containers JSON, empty containers null."""
    if kind == "boolean":
        return F.when(value.isNull(), None).when(value, "true").otherwise("false")
    if kind in ("array", "map"):
        return F.when(F.size(value) > 0, F.to_json(value))
    return value.cast("string")


def big_integer_sign(before: Column, after: Column) -> Column:
    """-1, 0 or 1 as ``after`` is less than, equal to or more than ``before``; null unless both are integers.

    Integers of any length are compared as text: sign, then number of digits, then digits.
    """

    def digits(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"^[+-]", ""), r"^0+(?=[0-9])", "")

    def negative(x: Column) -> Column:
        return x.startswith("-") & (digits(x) != "0")

    whole = before.rlike(r"^[+-]?[0-9]+$") & after.rlike(r"^[+-]?[0-9]+$")
    b, a = digits(before), digits(after)
    larger = F.when(F.length(a) != F.length(b), F.length(a) > F.length(b)).otherwise(a > b)
    plain = F.when(a == b, 0).when(larger, 1).otherwise(-1)
    order = (
        F.when(negative(before) & ~negative(after), 1)
        .when(~negative(before) & negative(after), -1)
        .when(negative(before), -plain)
        .otherwise(plain)
    )
    return F.when(whole, order)


#: Digits of a limb: sums and differences of two fit a long.
LIMB = 17
#: Digits of a decimal.
DECIMAL = 38


def signed_difference(before: Column, after: Column) -> Column:
    """``after`` less ``before`` with its sign (+0 for none), exact for integers of any length; null unless both are integers.

    Two integers of fewer than ``DECIMAL`` digits are subtracted as decimals.  Longer magnitudes are cut to limbs of ``LIMB`` digits, added or subtracted limb by limb with a carry, and put together again.
    """
    pattern = r"^\s*[+-]?[0-9]+\s*$"

    def digits(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.trim(x), r"^[+-]", ""), r"^0+(?=[0-9])", "")

    def combined(larger: Column, smaller: Column, add: Column) -> Column:
        """|larger| + |smaller|, or |larger| - |smaller|, as digits."""
        n = F.ceil(F.length(larger) / LIMB).cast("int")
        limbs = lambda x: F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.lpad(x, n * LIMB, "0"), (n - k) * LIMB + 1, F.lit(LIMB)).cast("long"))
        steps = F.zip_with(limbs(larger), limbs(smaller), lambda a, b: F.when(add, a + b).otherwise(a - b))
        base = F.lit(10**LIMB)

        def step(state: Column, x: Column) -> Column:
            value = x + state["carry"]
            carry = F.when(value >= base, 1).when(value < 0, -1).otherwise(0).cast("long")
            return F.struct(carry.alias("carry"), F.concat(F.lpad((value - carry * base).cast("string"), LIMB, "0"), state["text"]).alias("text"))

        ended = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text")), step)
        return digits(F.transform(F.array(ended), lambda e: F.concat(e["carry"].cast("string"), e["text"]))[0])

    b, a = digits(before), digits(after)
    minus_b, minus_a = F.trim(before).startswith("-") & (b != "0"), F.trim(after).startswith("-") & (a != "0")
    a_larger = F.when(F.length(a) != F.length(b), F.length(a) > F.length(b)).otherwise(a >= b)
    add = minus_a != minus_b
    size = combined(F.when(a_larger, a).otherwise(b), F.when(a_larger, b).otherwise(a), add)
    negative = F.when(a_larger, minus_a).otherwise(~minus_b) & (size != "0")
    # up to 37 digits the difference fits a decimal of 38
    short = rf"^\s*[+-]?0*[0-9]{{1,{DECIMAL - 1}}}\s*$"
    number = lambda x: F.trim(x).try_cast(f"decimal({DECIMAL},0)")
    less = number(after) - number(before)
    signed = F.concat(F.when(less < 0, "").otherwise("+"), less.cast("string"))
    return F.when(before.rlike(short) & after.rlike(short), signed).when(before.rlike(pattern) & after.rlike(pattern), F.concat(F.when(negative, "-").otherwise("+"), size))
