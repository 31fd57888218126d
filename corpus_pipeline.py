"""The corpus pipeline: language ID, near duplicates, PII, mixing to target weights, packing.

Each stage works on all that its predecessor kept; each result is written as
Parquet and read again.  Tables that are null, empty or repeat rows are handled
as the operators' own texts say.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import jaccard, langid, mixing, packing, pii
from tracewell.llm.shared import fresh, shared_folder
from tracewell.session import ship

#: A document whose most probable language is less probable than this is rejected.
LEAST_SCORE = 0.35

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a clear language; sets lang where it is null."""
    ship(spark)
    (into,) = fresh(docs, "language")
    found = langid.predict(docs, langid.train(docs), into)
    kept = found.filter((F.col(f"{into}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{into}.score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", f"{into}.lang_pred")).drop(into)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, one with the least doc_id, of each group linked by five-word shingles at 0.8 or more.

    Rows are told apart by their shingle sets, not by doc_id: a null or repeated doc_id
    with different texts is as many documents.  Rows without a word are one document if
    doc_id and text are equal.
    """
    ship(spark)
    return jaccard.one_of_each(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    ship(spark)
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass over its source."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids; a document that the mix repeats has its pieces repeated."""
    ship(spark)
    return packing.pack(docs, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Networks, components and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
