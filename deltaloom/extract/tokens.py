"""Definitions as tables of tokens, and spans of them as text.

Extraction is relational: a token's nesting depth, item and clause are running sums and counts over
its definition, so all windows share one shuffle on the definition's id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import sqltext
from deltaloom.state.cache import checkpointed

#: Bytes of text whose tokens are sorted in one task, about.
PART_BYTES = 1 << 20


def dealt(definitions: DataFrame, text: str = "fragment", key: str = "definition") -> DataFrame:
    """The definitions (key, text), written once and dealt by key in parts of bounded bytes.

    Texts are shuffled here, before they are cut: tokens, of which there are many times as many bytes,
    stay where their text is, and a task has the tokens of so many bytes however large the table is.
    """
    rows = checkpointed(definitions.select(key, text))
    size = rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    if size <= PART_BYTES:
        return rows.repartition(key)
    return rows.repartition(max(-(-size // PART_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def code_tokens(definitions: DataFrame, text: str = "fragment", key: str = "definition", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (definition, i, tok, up, start, end, depth, prv, nxt) of the visible tokens, and text's place; and the columns to keep.

    depth counts the parentheses around a token; a parenthesis has the depth of what it stands in.
    """
    pieces = definitions.select(key, *keep, F.posexplode_outer(sqltext.tokens(F.col(text))).alias("piece", "tok")).where("tok IS NOT NULL")
    order = Window.partitionBy(key).orderBy("piece")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("end", F.sum(F.length("tok")).over(upto)).withColumn("start", F.col("end") - F.length("tok"))
    shown = pieces.where(~F.col("tok").rlike(r"^(?:[ \t\r\n\f\x0B]|--|/\*)"))
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    shown = shown.withColumn("i", F.row_number().over(order)).withColumn("up", F.upper("tok"))
    shown = shown.withColumn("depth", F.sum(step).over(upto) - F.when(F.col("tok") == "(", 1).otherwise(0))
    return shown.select(key, *keep, "i", "tok", "up", "start", "end", "depth", F.lag("up").over(order).alias("prv"), F.lead("up").over(order).alias("nxt"))


def first_at(condition: Column, window) -> Column:
    """Number of the first token of the window that meets a condition."""
    return F.min(F.when(condition, F.col("i"))).over(window)


def span(condition: Column, name: str) -> list[Column]:
    """Aggregates: where the tokens that meet a condition begin and end in the text."""
    return [F.min(F.when(condition, F.col("start"))).alias(f"{name}_from"), F.max(F.when(condition, F.col("end"))).alias(f"{name}_to")]


def text_of(name: str, text: str = "fragment") -> Column:
    """The text of a span made by ``span``."""
    return F.when(F.col(f"{name}_from").isNotNull(), F.trim(F.substring(text, F.col(f"{name}_from") + 1, F.col(f"{name}_to") - F.col(f"{name}_from"))))


def clauses(tokens: DataFrame, starts: Column, definitions: DataFrame, key: str = "definition", text: str = "fragment") -> DataFrame:
    """Rows (definition, clause_no, word, next_word, body): from each token that starts a clause to the next one.

    ``starts`` is true for such tokens; body is what follows the first word.
    """
    order = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = tokens.withColumn("clause_no", F.sum(F.when(starts, 1).otherwise(0)).over(order)).where("clause_no > 0")
    first = F.min("i").over(Window.partitionBy(key, "clause_no"))
    grouped = numbered.withColumn("first", first).groupBy(key, "clause_no").agg(
        F.min_by("up", "i").alias("word"), F.min_by("nxt", "i").alias("next_word"), *span(F.col("i") > F.col("first"), "body"), *span(F.lit(True), "whole")
    )
    joined = grouped.join(definitions.select(key, text), key)
    return joined.select(key, "clause_no", "word", "next_word", text_of("body", text).alias("body"), text_of("whole", text).alias("whole"))


def unpivoted(df: DataFrame, keys: list[str], values: dict[str, str], family: Column | None = None) -> DataFrame:
    """Wide properties to rows (keys, property, value), nulls left out; ``values`` maps column to property."""
    pairs = [F.struct(F.lit(p).alias("property"), F.col(c).cast("string").alias("value")) for c, p in values.items()]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("x")).select(*keys, "x.property", "x.value").where("value IS NOT NULL")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
