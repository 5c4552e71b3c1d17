"""From raw documents to training tokens: language, copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the docs
of the next one. All stages but the last give the columns of `documents`, extra ones included, with the values they came with.

Defined cases, in any stage: rows are told apart by their id and text, so ids may repeat or be null. A null text is empty; texts without a
letter go in the first stage. Rows with a null language train nothing and are judged by their text; a null source is a source of its own.
Of equal texts, and of groups of similar ones, one row stays. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing, vocabularies
from pagesieve.llm.queries import RANKS
from pagesieve.llm.tables import fold, table
from pagesieve.session import work_folder


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; those that the identification rejects go."""
    model = language_id.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return language_id.keep_known(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingles, the one with the least id."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture of sources takes them, some not at all."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts, and whether they decode to the text they came from."""
    decoded = byte_bpe.round_trip(docs, vocabularies.path(RANKS, spark))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Language models and merges are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL}
