"""Evidence: files, buffers and the store of immutable events."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.bytesx import event_id
from tracewell.operators.framing import framed
from tracewell.operators.integrity import deduplicated, linked

EVIDENCE = "seq long, event_id string, source string, ingestion_ns decimal(38,0), raw_bytes binary, size_bytes long, content_hash string, previous_link string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, raw_bytes): whole files, byte for byte; the source is the path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.col("content").alias("raw_bytes"))


def read_buffer(spark: SparkSession, data: bytes, source: str = "stdin") -> DataFrame:
    return spark.createDataFrame([(source, bytearray(data))], "source string, raw_bytes binary")


def decode_requests(requests: DataFrame) -> DataFrame:
    """(source, raw_bytes, error) from (source_name, evidence_base64, evidence_text): base64 wins over text."""
    data = F.coalesce(F.try_to_binary("evidence_base64", F.lit("base64")), F.when(F.col("evidence_base64").isNull(), F.encode("evidence_text", "UTF-8")))
    error = F.when(F.col("evidence_base64").isNull() & F.col("evidence_text").isNull(), "no evidence").when(data.isNull(), "bad base64").when(F.octet_length(data) == 0, "empty evidence")
    return requests.select(F.col("source_name").alias("source"), data.alias("raw_bytes"), error.alias("error"))


def records(buffers: DataFrame, framer: str = "NewlineFramer", base_index: int = 0) -> tuple[DataFrame, DataFrame]:
    """Events of buffers without a framing error, and the errors (source, kind, detail).

    An event's bytes are its whole range, line end included.  The index counts
    records of a buffer from ``base_index``; seq orders buffers by source.
    """
    both = framed(buffers, framer)
    rows = both.filter("framed.kind is null").select("source", "raw_bytes", F.posexplode("framed.frames").alias("i", "f"))
    data = F.substring(F.col("raw_bytes"), (F.col("f.start") + 1).cast("int"), (F.col("f.end") - F.col("f.start")).cast("int"))
    events = rows.select("source", (F.col("i") + base_index).cast("long").alias("index"), data.alias("raw_bytes"))
    events = events.withColumn("event_id", event_id(F.col("source"), F.col("index"), F.col("raw_bytes")))
    return events, both.filter("framed.kind is not null").select("source", F.col("framed.kind").alias("kind"), F.col("framed.detail").alias("detail"))


def sequenced(events: DataFrame, start: int = 0) -> DataFrame:
    """events with seq in order of (source, index): counts of each source come first, then places within it."""
    sizes = events.groupBy("source").agg((F.max("index") + 1).alias("n"))
    from pyspark.sql import Window as W

    before = sizes.select("source", (F.sum("n").over(W.orderBy("source")) - F.col("n") + start).alias("before"))  # a row for each source
    return events.join(before, "source").withColumn("seq", F.col("before") + F.col("index")).drop("before")


class Store:
    """An append-only table of evidence in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVIDENCE).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVIDENCE)

    def append(self, events: DataFrame, now_ns: int | None = None) -> dict[str, int]:
        """Stores events (source, index, event_id, raw_bytes) whose id is new; total and stored counts."""
        stored = self.table()
        last = stored.agg(F.max("seq").alias("seq"), F.max_by("event_id", "seq").alias("tail")).first()
        fresh = deduplicated(sequenced(events, 0 if last["seq"] is None else last["seq"] + 1), stored)
        rows = fresh.withColumns({"ingestion_ns": F.lit(str(now_ns or time.time_ns())).cast("decimal(38,0)"), "size_bytes": F.octet_length("raw_bytes").cast("long")})
        total, before = events.count(), stored.count()
        self._add(linked(rows, last["tail"]).select(*[c.split()[0] for c in EVIDENCE.replace("decimal(38,0)", "decimal").split(", ")]))
        return {"total": total, "stored": self.table().count() - before}

    def _add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def retrieve(self, wanted: str) -> DataFrame:
        """The event, with its payload in base64; no rows if there is none."""
        return self.table().filter(F.col("event_id") == wanted).withColumn("payload", F.base64("raw_bytes"))

    def events(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of metadata in order of storing; 500 events at most."""
        return page(self.table(), limit, offset)


def page(evidence: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return evidence.select("seq", "event_id", "source", "size_bytes", "content_hash", "previous_link").orderBy("seq").offset(offset).limit(min(limit, 500))


def ingest(spark: SparkSession, buffers: DataFrame, store: Store, framer: str = "NewlineFramer", base_index: int = 0) -> dict[str, int]:
    """Frames buffers and stores their records; a framing error anywhere stops it before anything is stored."""
    events, errors = records(buffers, framer, base_index)
    if bad := errors.limit(1).collect():
        raise ValueError(f"framing error in {bad[0]['source']}: {bad[0]['kind']} {bad[0]['detail']}")
    return store.append(events)


class MemoryStore(Store):
    """A store that lives as long as its session: batches of events in order, nothing on disk."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "")
        self.batches = spark.createDataFrame([], EVIDENCE)

    def table(self) -> DataFrame:
        return self.batches

    def _add(self, rows: DataFrame) -> None:
        self.batches = self.batches.unionByName(rows.persist())
