"""Lexical functions on DDL text, in SQL expressions alone.

``tokens`` cuts a text into a list of pieces that together are the text, so offsets are sums of
piece lengths.  The masks blank out what isn't code, with all offsets kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of SQL text in order of preference; the last alternatives take whatever is left.
TOKEN = "|".join(
    [
        r"--[^\r\n]*",
        r"/\*[\s\S]*?\*/",
        r"/\*[\s\S]*",
        r"[nN]?[qQ]'(?:\[[\s\S]*?\]'|\([\s\S]*?\)'|\{[\s\S]*?\}'|<[\s\S]*?>'|([^\s\[\(\{<])[\s\S]*?\1')",
        r"[nN]?[qQ]'[\s\S]*",
        r"'(?:[^']++|'')*+'",
        r"'[\s\S]*",
        r'"(?:[^"]++|"")*+"',
        r'"[\s\S]*',
        r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_$#\x{80}-\x{10FFFF}]*",
        r"[0-9]+(?:\.[0-9]+)?",
        r"[ \t\r\n\f\x0B]+",
        r":=|=>|\|\||<=|>=|<>|!=|\.\.|\*\*",
        r"[\s\S]",
    ]
)
_HIDDEN = r"(?s)^(?:--|/\*|'|[nN]?[qQ]')"
UNSEEN = r"(?s)^(?:[ \t\r\n\f\x0B]|--|/\*|'|[nN]?[qQ]')"
#: The kinds of objects that definitions declare.
OBJECT_TYPES = (
    "TABLE",
    "SEQUENCE",
    "INDEX",
    "VIEW",
    "MATERIALIZED VIEW",
    "MATERIALIZED VIEW LOG",
    "PACKAGE",
    "PACKAGE BODY",
    "PROCEDURE",
    "FUNCTION",
    "TRIGGER",
    "TYPE",
    "TYPE BODY",
    "SYNONYM",
    "DIRECTORY",
    "DATABASE LINK",
    "USER",
    "ROLE",
)
#: Words between CREATE and the kind of object.
MODIFIERS = ("OR", "REPLACE", "NO", "FORCE", "EDITIONABLE", "NONEDITIONABLE", "PUBLIC", "UNIQUE", "BITMAP")
#: Visible tokens that a header has at most: modifiers, kind, and a qualified name.
HEADER_TOKENS = 16
NAME = r'(?:"(?:[^"]++|"")*+"|[A-Za-z][A-Za-z0-9_$#]*+)'


def seen_tokens(pieces: Column) -> Column:
    """Structs (piece, tok, up) of the pieces that are code: neither white space nor comment nor literal."""
    numbered = F.transform(pieces, lambda t, i: F.struct(i.alias("piece"), t.alias("tok"), F.upper(t).alias("up")))
    return F.filter(numbered, lambda x: ~x["tok"].rlike(UNSEEN))


def is_name(tok: Column) -> Column:
    return F.coalesce(tok.rlike(r'^["A-Za-z]'), F.lit(False))


def _following(seen: Column, word: str, many: int) -> Column:
    """Structs (piece, next) for each token that is the word, with so many tokens after it."""
    placed = F.transform(seen, lambda x, k: F.struct(x["piece"].alias("piece"), x["up"].alias("up"), k.alias("k")))
    return F.transform(F.filter(placed, lambda x: x["up"] == word), lambda x: F.struct(x["piece"].alias("piece"), F.slice(seen, x["k"] + 2, many).alias("next")))


def _named(name: Column, dot: Column, second: Column) -> list[Column]:
    """Fields first and second of a name that may be qualified."""
    return [name["tok"].alias("first"), F.when((dot["tok"] == ".") & is_name(second["tok"]), second["tok"]).alias("second")]


def headers(seen: Column) -> Column:
    """Structs (piece, object_type, public, first, second) of the definitions' headers, in order.

    A header is CREATE, modifiers, the longest kind of object that fits, and a name.
    """
    after = F.transform(
        _following(seen, "CREATE", HEADER_TOKENS),
        lambda x: F.struct(
            x["piece"].alias("piece"),
            F.exists(x["next"], lambda t: t["up"] == "PUBLIC").alias("public"),
            F.slice(x["next"], F.greatest(F.array_position(F.transform(x["next"], lambda t: t["up"].isin(*MODIFIERS)), F.lit(False)), F.lit(1)).cast("int"), 7).alias("rest"),
        ),
    )

    def kind(rest: Column) -> Column:
        words, found = F.transform(rest, lambda t: t["up"]), F.lit(None).cast("struct<name:string,n:int>")
        for name in sorted(OBJECT_TYPES, key=lambda t: t.count(" ")):
            own = name.split(" ")
            fits = (F.slice(words, 1, len(own)) == F.array(*[F.lit(w) for w in own])) & is_name(F.get(rest, F.lit(len(own)))["tok"])
            found = F.when(fits, F.struct(F.lit(name).alias("name"), F.lit(len(own)).alias("n"))).otherwise(found)
        return found

    typed = F.transform(after, lambda x: F.struct(x["piece"].alias("piece"), x["public"].alias("public"), x["rest"].alias("rest"), kind(x["rest"]).alias("kind")))
    typed = F.filter(typed, lambda x: x["kind"].isNotNull())
    return F.transform(
        typed,
        lambda x: F.struct(
            x["piece"].alias("piece"),
            F.when(x["kind"]["name"] == "PACKAGE", "PACKAGE_SPEC").otherwise(F.replace(x["kind"]["name"], F.lit(" "), F.lit("_"))).alias("object_type"),
            x["public"].alias("public"),
            *_named(*[F.get(x["rest"], x["kind"]["n"] + k) for k in range(3)]),
        ),
    )


def trigger_states(seen: Column) -> Column:
    """Structs (first, second, state) of ALTER TRIGGER name ENABLE or DISABLE, in order."""
    found = F.transform(
        F.filter(_following(seen, "ALTER", 6), lambda x: F.get(x["next"], F.lit(0))["up"] == "TRIGGER"),
        lambda x: F.struct(*_named(*[F.get(x["next"], F.lit(k)) for k in (1, 2, 3)]), F.get(x["next"], F.lit(2))["up"].alias("short"), F.get(x["next"], F.lit(4))["up"].alias("long")),
    )
    stated = F.transform(found, lambda x: F.struct(x["first"].alias("first"), x["second"].alias("second"), F.when(x["second"].isNull(), x["short"]).otherwise(x["long"]).alias("state")))
    return F.filter(stated, lambda x: x["state"].isin("ENABLE", "DISABLE"))


def tokens(text: Column) -> Column:
    """All pieces of the text in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def blank(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\r\n]", " ")


def masked(text: Column) -> Column:
    """Comments and literals blanked; quoted names and line ends kept; as long as the text."""
    return F.array_join(F.transform(tokens(text), lambda t: F.when(t.rlike(_HIDDEN), blank(t)).otherwise(t)), "")


def code_only(text: Column) -> Column:
    """Quoted names blanked as well; empty where something isn't terminated."""
    all_blank = F.array_join(F.transform(tokens(text), lambda t: F.when(t.rlike(_HIDDEN) | t.startswith('"'), blank(t)).otherwise(t)), "")
    return F.when(F.size(mask_diagnostics(text)) > 0, "").otherwise(all_blank)


def unterminated(piece: Column) -> Column:
    """The diagnostic of a piece that runs to the end of the text without its end, else null."""
    return (
        F.when(piece.rlike(r"^/\*") & ~piece.rlike(r"(?s)^/\*.*\*/$"), "UNTERMINATED_BLOCK_COMMENT")
        .when(piece.rlike(r"^[nN]?[qQ]'") & ~piece.rlike(r"(?s)^[nN]?[qQ]'(?:\[.*\]|\(.*\)|\{.*\}|<.*>|([^\s\[\(\{<]).*\1)'$"), "UNTERMINATED_QQUOTE")
        .when(piece.startswith("'") & ~piece.rlike(r"^'(?:[^']++|'')*+'$"), "UNTERMINATED_SINGLE")
        .when(piece.startswith('"') & ~piece.rlike(r'^"(?:[^"]++|"")*+"$'), "UNTERMINATED_DOUBLE")
    )


def mask_diagnostics(text: Column) -> Column:
    """What isn't terminated in the text; an open line comment is fine."""
    return piece_diagnostics(tokens(text))


def piece_diagnostics(pieces: Column) -> Column:
    """What isn't terminated runs to the end, so only the last piece can be such."""
    return F.array_compact(F.array(unterminated(F.try_element_at(pieces, F.lit(-1)))))


def newline_style(text: Column) -> Column:
    """CRLF, LF, CR, MIXED or NONE, by counts."""

    def count(mark: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)

    crlf = count("\r\n")
    lf, cr = count("\n") - crlf, count("\r") - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds > 1, "MIXED").when(crlf > 0, "CRLF").when(lf > 0, "LF").when(cr > 0, "CR").otherwise("NONE")


def without_format(text: Column) -> Column:
    """White space between tokens made one blank; inside comments and literals it stays."""
    joined = F.array_join(F.transform(tokens(text), lambda t: F.when(t.rlike(r"^[ \t\r\n\f\x0B]"), " ").otherwise(t)), "")
    return F.regexp_replace(joined, r"^ +| +$", "")


def text_change(before: Column, after: Column) -> Column:
    """unchanged, format_only or structural_or_logic."""
    return F.when(before.eqNullSafe(after), "unchanged").when(without_format(before) == without_format(after), "format_only").otherwise("structural_or_logic")


def only_white_space_differs(before: Column, after: Column) -> Column:
    """Equal visible tokens, and no comment (nor hint) in either text."""

    def seen(text: Column) -> Column:
        return F.filter(tokens(text), lambda t: ~t.rlike(r"^[ \t\r\n\f\x0B]"))

    hidden = F.exists(tokens(before), lambda t: t.rlike(r"^(?:--|/\*)")) | F.exists(tokens(after), lambda t: t.rlike(r"^(?:--|/\*)"))
    return (seen(before) == seen(after)) & ~hidden


START_WITH = r"(?i)\bSTART\s+WITH\s+([+-]?[0-9]+)(?![\w.$#])"


def start_value_change(before: Column, after: Column) -> Column:
    """Struct (before, after) if the texts differ in the number after START WITH and nowhere else, else null."""

    def one(text: Column) -> Column:
        return F.regexp_count(code_only(text), F.lit(START_WITH)) == 1

    def value(text: Column) -> Column:
        return F.regexp_extract(code_only(text), START_WITH, 1)

    def rest(text: Column) -> Column:
        return F.regexp_replace(text, START_WITH, "START WITH ?")

    same = one(before) & one(after) & (rest(before) == rest(after)) & (value(before) != value(after))
    return F.when(same, F.struct(value(before).alias("before"), value(after).alias("after")))


#: What secrets look like, in order; the first that fits counts.
SECRETS = [
    r"(?i)authorization\s*:\s*bearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"(?i)(?:^|[^A-Za-z0-9_])(?:api[_-]?key|password|passwd|secret|token)\s*[=:]\s*['\"]?[^\s,'\"]{6,}",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?is)(?:^|[^A-Za-z0-9_])CREATE\s+(?:USER|DATABASE\s+LINK)[^A-Za-z0-9_].*?[^A-Za-z0-9_]IDENTIFIED\s+BY(?:[^A-Za-z0-9_]|$)",
]
PERSONAL = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?:^|[^0-9])[0-9]{11}(?:[^0-9]|$)"]
UNSAFE = [r"(?i)https?://", r"<[A-Za-z/!][^>]*>", r"\{\{|\{%", r"(?i)(?:^|[^A-Za-z])(?:select|insert|update|delete|drop|alter|grant)\s+[A-Za-z*]"]


def secret_index(text: Column, extra: list[str] | None = None) -> Column:
    """Number of the first secret pattern that the text has, null if none."""
    found = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate([*SECRETS, *(extra or [])]))):
        found = F.when(text.rlike(pattern), i).otherwise(found)
    return found


def redacted(value: Column, limit: int = 1200, shown: Column | None = None) -> Column:
    """Struct (state, value): present values that may be shown, others redacted or unparsed."""
    personal = F.lit(False)
    for pattern in PERSONAL:
        personal = personal | value.rlike(pattern)
    secret = secret_index(value).isNotNull()
    allowed = F.lit(True) if shown is None else shown
    plain = value.rlike(r"^[\x20-\x7E\s]*$") & (F.length(value) <= limit)
    state = F.when(value.isNull(), "not_in_source").when(secret | personal, "redacted").when(allowed & plain, "present").otherwise("unparsed")
    return F.struct(state.alias("state"), F.when(state == "present", value).alias("value"))


def redacted_path(path: Column) -> Column:
    """The path if it has safe signs only and nothing personal or secret, else null."""
    personal = path.rlike("|".join(f"(?:{p})" for p in PERSONAL))
    return F.when(path.rlike(r"^[A-Za-z0-9_./ -]+$") & ~personal & secret_index(path).isNull(), path)


def unsafe_texts(texts: Column) -> Column:
    """Whether any of the texts has links, markup, templates or statements."""
    return F.exists(texts, lambda t: t.rlike("|".join(f"(?:{p})" for p in UNSAFE)))
