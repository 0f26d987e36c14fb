"""Quality rules as a ledger of failure bits, in DataFrame functions alone.

Every text is measured once and every rule evaluated once: a ledger row has the measurements and one
bit for each rule that the text fails.  Policies are versioned sets of rules, so a verdict is a
bitwise AND with a policy's mask, and what a policy would keep without one of its rules follows from
the counts of failure patterns: neither reads a text again.  All measurements are made inside a row:
the ledger needs no shuffle.

Windows of words are compared by 64-bit hashes within their text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.storage import removed, written

#: Words, characters that count as symbols, and the width of a window.
WORD, SYMBOL, WINDOW = r"[^\x20\x09-\x0D]+", "[#*$%&|<>]", 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted")

#: Rules by name, in the order of their bits: what fails.  New rules are added at the end; a bit is never given anew.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 20,
    "repeated_words": lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 30,
    "symbols": lambda: F.col("n_symbols") * 100 > F.col("n_words") * 40,
    "repeated_lines": lambda: F.col("n_dup_lines") * 100 > F.col("n_lines") * 50,
    "word_length": lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20),
    "shouting": lambda: F.col("n_shouted") * 100 > F.col("n_words") * 40,
}
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"base": ("few_words", "repeated_words"), "v1": tuple(RULES)}
POLICY = "v1"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used inside."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more; n log n in the words of a text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda at, i: F.least(F.coalesce(F.get(places, i + 1) - at, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: F.get(ordered, i - 1)["h"].eqNullSafe(x["h"]) | F.get(ordered, i + 1)["h"].eqNullSafe(x["h"]))
        return bound(F.sort_array(F.transform(twice, lambda x: x["at"])), covered)

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bound(ordered, repeated))

    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(bound(windows, counted))


def measured(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ``MEASURES`` (long) of every row: one projection, no shuffle."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.rlike(line, F.lit(WORD)))
    rows = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    found = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_lines": F.size("lines"),
        "n_shouted": F.regexp_count("text", F.lit("[A-Z][A-Z]+")),
    }
    return rows.select("doc_id", *[found[m].cast("long").alias(m) for m in MEASURES])


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return reduce(lambda a, b: a | bit(b), rules, 0)


def ledger(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: one bit for each rule that the text fails.

    Defined results: a null or empty text has no words, lines or symbols and fails ``few_words``;
    repeated rows are each measured; a null id stays null; a text of any length is measured whole; an
    empty table gives an empty table; extra columns are ignored.
    """
    rows = measured(documents, id_column, text_column)
    bits = [F.when(fails(), F.lit(bit(name))).otherwise(F.lit(0)) for name, fails in RULES.items()]
    return rows.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def judged(rows: DataFrame, policy: str = POLICY, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Ledger rows with ``base_failed``, ``kept`` by the policy, and ``only_rule``: the one rule that alone rejects, or null."""
    known = policies or POLICIES
    against = F.col("failed").bitwiseAND(F.lit(mask(known[policy])))
    only = F.coalesce(*[F.when(against == bit(name), F.lit(name)) for name in RULES])
    base = F.col("failed").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & (against == 0), "only_rule": only})


def patterns(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows and words have each failure pattern: at most 2**rules rows a group, summed before the shuffle."""
    return rows.groupBy(*by, "failed").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] | None = None, *by: str) -> DataFrame:
    """What each policy keeps, and would keep without each of its rules, from the counts of failure patterns.

    policy, rule (null: the policy itself), kept and kept_words (rows and words that pass), gained (rows
    that only this rule rejects), failing (rows that fail the rule), ever and always (bitwise OR and AND
    of the patterns of all rows), a row for each group of ``by``.
    """
    counted = patterns(rows, *by)
    tried = []
    for name, rules in (policies or POLICIES).items():
        for rule in (None, *rules):
            without = mask(tuple(r for r in rules if r != rule))
            tried.append(F.struct(F.lit(name).alias("policy"), F.lit(rule).cast("string").alias("rule"), F.lit(without).cast("long").alias("mask"), F.lit(mask(rules)).cast("long").alias("whole"), F.lit(bit(rule) if rule else 0).cast("long").alias("bit")))
    each = counted.select(*by, "failed", "n", "n_words", F.inline(F.array(*tried)))
    passes = F.col("failed").bitwiseAND(F.col("mask")) == 0
    alone = (F.col("failed").bitwiseAND(F.col("whole")) == F.col("bit")) & (F.col("bit") != 0)
    zero = F.lit(0).cast("long")
    return each.groupBy(*by, "policy", "rule").agg(
        F.sum(F.when(passes, F.col("n")).otherwise(zero)).alias("kept"),
        F.sum(F.when(passes, F.col("n_words")).otherwise(zero)).alias("kept_words"),
        F.sum(F.when(alone, F.col("n")).otherwise(zero)).alias("gained"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(zero)).alias("failing"),
        F.bit_or("failed").alias("ever"),
        F.bit_and("failed").alias("always"),
    )


def stored(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The ledger, written: later policies and ablations read it and no texts."""
    return written(ledger(documents), "ledger", path)


def forgotten(spark, path: str) -> None:
    """Delete a stored ledger."""
    removed(spark, path)


def oracle_sql(policy: str = POLICY) -> str:
    """The ledger and a policy's verdicts in DuckDB's SQL."""
    ratios = {
        "few_words": "n_words < 20",
        "repeated_words": "n_repeat_words * 100 > n_words * 30",
        "symbols": "n_symbols * 100 > n_words * 40",
        "repeated_lines": "n_dup_lines * 100 > n_lines * 50",
        "word_length": "word_chars < n_words * 2 OR word_chars > n_words * 20",
        "shouting": "n_shouted * 100 > n_words * 40",
    }
    failed = " + ".join(f"CASE WHEN {ratios[r]} THEN {bit(r)} ELSE 0 END" for r in RULES)
    only = " ".join(f"WHEN {bit(r)} THEN '{r}'" for r in RULES)
    chosen, base = mask(POLICIES[policy]), mask(POLICIES["base"])
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
      w AS MATERIALIZED (SELECT row, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
      u AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS i FROM (SELECT row, words FROM w)),
      v AS (SELECT row, i, list(word) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win FROM u),
      g AS (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS times FROM v WHERE len(win) = {WINDOW}),
      r AS (SELECT row, sum(least({WINDOW}, coalesce(next - i, {WINDOW})))::BIGINT AS n FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS next FROM g WHERE times > 1) GROUP BY row),
      m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOL}'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        len(regexp_extract_all(text, '[A-Z][A-Z]+'))::BIGINT AS n_shouted FROM w LEFT JOIN r USING (row)),
      f AS (SELECT *, ({failed})::BIGINT AS failed FROM m)
    SELECT *, failed & {base} <> 0 AS base_failed, failed & {chosen | base} = 0 AS kept, CASE failed & {chosen} {only} END AS only_rule FROM f"""
