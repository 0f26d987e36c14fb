"""Queries over the documents, pages and benchmark tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import collocations, manifest, mixing, rules

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.token_counts import token_counts

    return token_counts(_table(spark, folder, "documents"), byte_bpe(), limit=1024)


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.storage import new_path
    from deltaloom.llm.token_files import token_digests, write_tokens

    path = new_path(spark, "tokens")
    write_tokens(_table(spark, folder, "documents"), path, byte_bpe(), end_id=0)
    return token_digests(spark, path)


#: The rules that op2 judges by.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.urls import url_verdicts

    return url_verdicts(_table(spark, folder, "pages"), URL_RULES)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.storage import new_path
    from deltaloom.llm.warc import archived

    return archived(_table(spark, folder, "pages"), new_path(spark, "warc"), least_bytes=0)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.decontaminate import contaminated

    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.syncmers import document_fingerprints

    return document_fingerprints(_table(spark, folder, "documents"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.quality import quality_scores

    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from deltaloom.llm.mixing import mixed

    rows = mixed(_table(spark, folder, "documents"))
    return rows.select("doc_id", "cell_source", "cell_lang", "cell_topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "kept")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.language import languages_of

    return languages_of(_table(spark, folder, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.jaccard import jaccard_join

    return jaccard_join(_table(spark, folder, "documents"), n_words=3, num=90, den=100)


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.rules import judged, ledger

    return judged(ledger(_table(spark, folder, "documents")))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from deltaloom.llm.manifest import tampered_text, verified

    return verified(_table(spark, folder, "documents"), {"text": tampered_text()})


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_url_filter, op3_decontamination, op4_syncmer_fingerprints, op5_quality_classifier, op6_mixing, op7_language_id, op8_ngram_jaccard_join,
        op9_token_files, op10_warc, op11_quality_rules, op12_collocations, op13_merkle_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.oracle_sql(), "op11_quality_rules": rules.oracle_sql(), "op12_collocations": collocations.oracle_sql(), "op13_merkle_manifest": manifest.oracle_sql()}
