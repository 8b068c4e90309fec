"""A corpus pipeline over ``documents``: language, near duplicates, repeats, mix, pieces.

Each stage takes the documents that the one before it kept, works on all of them, and its decisions take
effect: a row that it rejects is gone, a text that it cuts is shorter. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkblot.llm import langid, mixing, pieces, setjoin, suffixes
from inkblot.llm.common import fresh, written

ORACLE_SQL = None  # none of the stages but the mix can be said in SQL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence."""
    name = fresh(docs, "_lang")
    told = langid.predict(docs, langid.fit(docs), name)
    return told.where(F.col(name)["accepted"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return setjoin.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur earlier in the corpus; n_chars follows the text."""
    out = suffixes.without_repeats(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces."""
    ids, exact = fresh(docs, "ids"), fresh(docs, "exact")
    return pieces.encode(docs, ids=ids, exact=exact)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
