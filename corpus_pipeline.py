"""The corpus pipeline: from raw documents to token ids on disk.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  Stages keep the columns of docs, and the last returns a digest of
the token files it has written.

Defined results, for every stage: an empty table gives an empty table; other columns, whatever their
names, are kept; repeated rows are judged alike, but of those equal in id and text one is left by the
second stage; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm.decontaminate import clean
from deltaloom.llm.jaccard import one_of_each_group
from deltaloom.llm.mixing import sampled
from deltaloom.llm.quality import accepted
from deltaloom.llm.queries import byte_bpe
from deltaloom.llm.storage import new_path, written
from deltaloom.llm.token_files import token_digests, write_tokens

#: Near duplicates share at least so much (in hundredths) of their shingles of so many words.
NEAR_WORDS, NEAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts have the score of a text without n-grams; without labels all stay.
    """
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Null, empty and wordless texts are like no other and stay; so do rows without an id.
    """
    return one_of_each_group(docs, NEAR_WORDS, NEAR, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go.

    Null and wordless texts stay; rows without an id are judged by their text; without a benchmark all stay.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of sources, languages and topics.

    Null sources and languages are a value of their own; texts without words have weight 1; where targets
    can't be met, raking ends as near as it comes and warns.
    """
    return sampled(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written in ascending document id; the result is read from the files.

    Null and empty texts have the end id alone; null ids come first, rows of equal id by their text.
    """
    path = new_path(spark, "tokens")
    write_tokens(docs, path, byte_bpe(), end_id=0)
    return token_digests(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_files),
]

#: SQL cannot express the classifier, the latent search or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
