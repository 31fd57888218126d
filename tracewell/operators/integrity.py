"""Content hashes, the lineage chain and its verification.

Evidence: (seq, event_id, source, ingestion_ns, raw_bytes, size_bytes,
content_hash, previous_link).  ``seq`` is the order of storing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a run of the chain that one task links or checks.
RUN = 1 << 20


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def deduplicated(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first event of each id, without those stored already."""
    first = events.groupBy("event_id").agg(F.min_by(F.struct(*events.columns), "seq").alias("e")).select("e.*")
    return first if stored is None else first.join(stored.select("event_id"), "event_id", "left_anti")


def linked(events: DataFrame, tail: str | None = None) -> DataFrame:
    """previous_link: the id of the event before by seq; ``tail`` (the store's last id) for the first.

    Runs of seq are linked apart from each other; a run's first event takes the
    last id of the run before from a table with one row for each run.
    """
    run = events.withColumn("run", F.floor(F.col("seq") / RUN))
    ends = run.groupBy("run").agg(F.max_by("event_id", "seq").alias("last"))
    before = ends.select(F.col("run"), F.lag("last").over(W.orderBy("run")).alias("before"))  # a row for each run
    own = F.lag("event_id").over(W.partitionBy("run").orderBy("seq"))
    out = run.withColumn("own", own).join(before, "run").withColumn("previous_link", F.coalesce("own", "before", F.lit(tail)))
    return out.withColumn("content_hash", content_hash(F.col("raw_bytes"))).select(*events.columns, "content_hash", "previous_link")


def verified(evidence: DataFrame) -> DataFrame:
    """evidence with ``status``: MissingMetadata, HashMismatch, BrokenLink or Success, in that order of precedence."""
    ids = evidence.select(F.col("event_id").alias("linked_id")).distinct()
    met = evidence.join(ids, F.col("previous_link") == F.col("linked_id"), "left")
    status = (
        F.when(F.col("content_hash").isNull(), "MissingMetadata")
        .when(F.col("content_hash") != content_hash(F.col("raw_bytes")), "HashMismatch")
        .when(F.col("previous_link").isNotNull() & F.col("linked_id").isNull(), "BrokenLink")
        .otherwise("Success")
    )
    return met.withColumn("status", status).drop("linked_id")


def chain_verified(evidence: DataFrame) -> DataFrame:
    """(event_id, seq, status, failed_at): the failure nearest before (or at) each event of a chain in order of seq."""
    own = verified(evidence).select("seq", "event_id", "status").withColumn("run", F.floor(F.col("seq") / RUN))
    bad = F.when(F.col("status") != "Success", F.struct("status", "event_id"))
    within = F.last(bad, ignorenulls=True).over(W.partitionBy("run").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    ends = own.groupBy("run").agg(F.max_by(F.struct("status", "event_id"), F.when(F.col("status") != "Success", F.col("seq"))).alias("bad"))
    ends = ends.withColumn("bad", F.when(F.col("bad.status") != "Success", F.col("bad")))
    before = ends.select("run", F.last("bad", ignorenulls=True).over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    found = own.withColumn("bad", within).join(before, "run").withColumn("f", F.coalesce("bad", "before"))
    return found.select("event_id", "seq", F.coalesce("f.status", F.lit("Success")).alias("status"), F.col("f.event_id").alias("failed_at"))


def walked(evidence: DataFrame, head: str, limit: int = 100_000) -> DataFrame:
    """(event_id, depth, cycle): the links followed back from ``head``, for chains that aren't in order of seq."""
    spark = evidence.sparkSession
    view = "links_to_walk"
    evidence.select("event_id", "previous_link").createOrReplaceTempView(view)
    return spark.sql(
        f"""WITH RECURSIVE walk(event_id, previous_link, depth, seen) MAX RECURSION LEVEL {limit} AS (
              SELECT event_id, previous_link, 0, array(event_id) FROM {view} WHERE event_id = :head
              UNION ALL
              SELECT e.event_id, e.previous_link, w.depth + 1, array_append(w.seen, e.event_id)
              FROM walk w JOIN {view} e ON w.previous_link = e.event_id WHERE NOT array_contains(w.seen, e.event_id))
            SELECT event_id, depth, array_contains(seen, previous_link) AS cycle FROM walk""",
        {"head": head},
    )
