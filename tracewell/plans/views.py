"""What the API and the user interface show: event views, bytes as text, confidence, percentiles, fixtures and results."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.sources.sinks import Objects

#: The share of a bar that each level of confidence fills.
PERCENTAGES = {"high": 95, "certain": 95, "medium": 60, "probable": 60, "low": 25, "heuristic": 25}


def shown(data: Column) -> Column:
    """Bytes as text where they are valid UTF-8, else as lowercase hex bytes parted by spaces; null as an empty text."""
    text = F.try_validate_utf8(data.cast("string"))
    pairs = F.regexp_replace(F.lower(F.hex(data)), "(..)(?!$)", "$1 ")
    return F.coalesce(text, pairs, F.lit(""))


def percentage(level: Column) -> Column:
    """How far a bar of confidence is filled; 0 for an unknown level or none."""
    found = F.lit(0)
    for name, value in PERCENTAGES.items():
        found = F.when(F.lower(level) == name, value).otherwise(found)
    return found


def percentiles(df: DataFrame, by: list[str], value: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """by, p50, p95, ...: of n sorted values the one at place floor(n * point / 100), from 0; nulls don't count.

    Equal values are counted before they are sorted, so a group's window has a row
    for each distinct value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    rows = counts.withColumn("__upto", F.sum("__n").over(W.partitionBy(*by).orderBy(value)))
    rows = rows.withColumn("__all", F.sum("__n").over(W.partitionBy(*by)))
    place = lambda p: F.expr(f"__all * {p} div 100")
    here = lambda p: (place(p) < F.col("__upto")) & (place(p) >= F.col("__upto") - F.col("__n"))
    return rows.groupBy(*by).agg(*[F.max(F.when(here(p), F.col(value))).alias(f"p{p}") for p in points])


def event_view(evidence: DataFrame) -> DataFrame:
    """An event as the API gives it: payload in base64, hash in hex, the link before it."""
    digest = F.col("content_hash")
    if dict(evidence.dtypes)["content_hash"] == "binary":
        digest = F.lower(F.hex(digest))
    checked = F.when(digest.isNotNull(), F.struct(digest.alias("hash_hex"), F.col("previous_link")))
    return evidence.select("event_id", "source", F.octet_length("raw_bytes").cast("long").alias("size_bytes"), F.base64("raw_bytes").alias("payload_base64"), checked.alias("integrity"))


def summary_view(evidence: DataFrame) -> DataFrame:
    """A line of the list of events."""
    return evidence.select("event_id", "source", F.col("ingestion_ns").alias("ingestion_timestamp"), F.col("content_hash").isNotNull().alias("has_integrity"))


def frame_view(frames: DataFrame) -> DataFrame:
    """A frame of an interpretation: bytes in base64, the decision, typed and canonical fields as JSON.

    Unmapped fields and abstentions aren't shown.
    """
    return frames.select(
        "event_id", "frame_index", F.base64("frame_bytes").alias("frame_base64"), "parser_id", "parser_version", "parser_outcome", "parser_error",
        "inference", F.to_json("ir").alias("fields"), F.to_json(F.col("canonical").dropFields("unmapped", "abstentions")).alias("canonical"),
    )


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, fixture): every *.json below a folder as text, without a byte order mark; names sort the rows of a tie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    return files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("fixture"))


def put_results(spark: SparkSession, folder: str, key: str, results: Mapping[str, object]) -> None:
    """The results of a benchmark as indented JSON, put in one step; a number that isn't finite is an error."""
    Objects(spark, folder).put(key, json.dumps(results, indent=2, allow_nan=False).encode())
