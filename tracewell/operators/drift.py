"""Drift: a window's profile as one long table of counts, and what differs between two of them.

profile: (dimension, field, key, cnt) with the dimensions total, format,
structural, schema, semantic and vocabulary; field is set for vocabulary only.
All come from one scan: each frame is unpivoted into its observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.mapping import TARGETS

VOLUME, FREQUENCY, VOCABULARY = 0.50, 0.15, 1000


def observations(frames: DataFrame) -> DataFrame:
    """frames' columns with (dimension, field, key) for everything a profile counts."""
    c = F.col("canonical")
    one = lambda dimension, key, name=None: F.struct(F.lit(dimension).alias("dimension"), F.lit(name).cast("string").alias("field"), key.alias("key"))
    items = [F.array(one("total", F.lit("events")), one("format", F.col("parser_id")))]
    tracked = [t for t in TARGETS if t != "timestamp"]
    items.append(F.transform(F.map_keys(c["unmapped"]), lambda k: one("structural", k)))
    for t in tracked:
        source = c[t]["source_field"]
        items.append(F.when(c[t].isNotNull(), F.array(one("schema", F.lit(t)), one("structural", source), one("semantic", F.concat(source, F.lit("->"), F.lit(t))))).otherwise(F.array().cast("array<struct<dimension:string,field:string,key:string>>")))
    for t in ("action", "severity"):
        items.append(F.when(c[t].isNotNull(), F.array(one("vocabulary", c[t]["value"], t))).otherwise(F.array().cast("array<struct<dimension:string,field:string,key:string>>")))
    rows = frames.filter("canonical is not null").select("*", F.explode(F.concat(*items)).alias("o"))
    return rows.select(*frames.columns, "o.*")


def profile(frames: DataFrame, by: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(by..., dimension, field, key, cnt); the first ``VOCABULARY`` values of a field, in order of ``order``, count."""
    by = by or []
    seen = observations(frames)
    first = F.min(F.col(order)) if order else F.min("key")
    counts = seen.groupBy(*by, "dimension", "field", "key").agg(F.count("*").alias("cnt"), first.alias("first"))
    alone = F.when(F.col("dimension") != "vocabulary", F.col("key"))  # only a vocabulary is ranked
    rank = F.row_number().over(W.partitionBy(*by, "dimension", "field", alone).orderBy("first", "key"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= VOCABULARY).drop("rank", "first")


def detect(baseline: DataFrame, current: DataFrame, volume: float = VOLUME, frequency: float = FREQUENCY) -> DataFrame:
    """(dimension, field, item, drift_type, old, new) between two profiles: counts for volume, shares else."""
    names = ["dimension", "field", "key", "cnt"]
    return compare(baseline.select(F.lit("old").alias("side"), *names).unionByName(current.select(F.lit("new").alias("side"), *names)), "side", volume, frequency)


def compare(profiles: DataFrame, side: str, volume: float = VOLUME, frequency: float = FREQUENCY) -> DataFrame:
    """What ``detect`` gives, for profiles in one table whose column ``side`` is old or new: each row is read once."""
    count = lambda name: F.sum(F.when(F.col(side) == name, F.col("cnt"))).alias(name)
    both = profiles.groupBy("dimension", F.coalesce("field", F.lit("")).alias("field"), "key").agg(count("old"), count("new"))
    of_field, of_all = W.partitionBy("dimension", "field"), W.partitionBy(F.lit(0))  # counts of keys, not events
    for name in ("old", "new"):
        whole = F.when(F.col("dimension") == "vocabulary", F.sum(name).over(of_field)).otherwise(F.sum(F.when(F.col("dimension") == "total", F.col(name))).over(of_all))
        both = both.withColumn(f"{name}_all", whole)
    total, words = F.col("dimension") == "total", F.col("dimension") == "vocabulary"
    shift = F.abs(F.col("new") / F.col("new_all") - F.col("old") / F.col("old_all"))
    change = F.abs(F.coalesce("new", F.lit(0)) - F.col("old")) / F.col("old")
    kind = (
        F.when(total, F.when((F.col("old") > 0) & (change >= volume), "VolumeChanged"))
        .when(words & (F.col("old_all").isNull() | F.col("new_all").isNull()), F.lit(None))  # a field that one side lacks
        .when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Removed").when(shift >= frequency, "FrequencyChanged")
    )
    shown = lambda name: F.when(F.col("drift_type") == "VolumeChanged", F.coalesce(F.col(name), F.lit(0)).cast("double")).when(F.col("drift_type") == "FrequencyChanged", F.col(name) / F.col(f"{name}_all")).alias(name)
    found = both.withColumn("drift_type", kind).filter("drift_type is not null")
    return found.select(F.when(total, "volume").otherwise(F.col("dimension")).alias("dimension"), "field", F.col("key").alias("item"), "drift_type", shown("old"), shown("new"))


def has_drift(found: DataFrame) -> bool:
    """Whether ``detect`` found anything."""
    return not found.isEmpty()
