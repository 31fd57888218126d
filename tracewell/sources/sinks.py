"""Where interpretations go: columnar export, relational tables, documents, objects."""

from __future__ import annotations

import uuid

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.mapping import TARGETS

#: Keys of the relational tables.
TABLES = {"configs": ["config_hash"], "events": ["event_id"], "interpretations": ["interpretation_id"], "frames": ["interpretation_id", "frame_index"], "entity_edges": ["interpretation_id", "frame_index", "entity_type", "entity_value", "role"]}


def columnar(frames: DataFrame, integrity_verified: bool = True, created_at_secs: int = 0) -> DataFrame:
    """The seven export columns; parser_id only for successes."""
    return frames.select(
        F.col("event_id").alias("source_event_id"), "interpretation_id", F.col("frame_index").cast("int").alias("frame_index"), "frame_bytes",
        F.when(F.col("parser_outcome") == "Success", F.col("parser_id")).alias("parser_id"), F.lit(integrity_verified).alias("integrity_verified"), F.lit(created_at_secs).cast("long").alias("created_at_secs"),
    )


def write_columnar(frames: DataFrame, path: str, **facts) -> None:
    columnar(frames, **facts).sortWithinPartitions("source_event_id", "frame_index").write.parquet(path)


class Relational:
    """Tables in a folder, appended to without repeating a key; an interpretation that is there is left alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def insert(self, name: str, rows: DataFrame) -> None:
        there = self.table(name)
        fresh = rows.dropDuplicates(TABLES[name])
        if there is not None:
            fresh = fresh.join(there.select(*TABLES[name]), TABLES[name], "left_anti")
        fresh.write.mode("append").parquet(f"{self.path}/{name}")

    def save(self, frames: DataFrame, edges: DataFrame) -> None:
        there = self.table("interpretations")
        if there is not None:
            frames = frames.join(there.select("interpretation_id"), "interpretation_id", "left_anti")
            edges = edges.join(there.select("interpretation_id"), "interpretation_id", "left_anti")
        flat = frames.select("interpretation_id", "event_id", "frame_index", "frame_bytes", "parser_id", "parser_outcome", "parser_error", F.to_json("canonical").alias("canonical"), F.to_json("ir").alias("ir"))
        self.insert("configs", frames.select("config_hash"))
        self.insert("events", frames.select("event_id", "source"))
        self.insert("frames", flat)
        self.insert("entity_edges", edges)
        self.insert("interpretations", frames.select("interpretation_id", "event_id", "config_hash"))  # last: it says that the rest is there

    def by_entity(self, entity_type: str, value: str) -> DataFrame:
        return self.table("entity_edges").filter((F.col("entity_type") == entity_type) & (F.col("entity_value") == value)).select("interpretation_id").distinct().orderBy("interpretation_id")

    def exists(self, interpretation_id: str) -> bool:
        there = self.table("interpretations")
        return there is not None and bool(there.filter(F.col("interpretation_id") == interpretation_id).limit(1).count())


# Documents


def index_name(name: str) -> str:
    """The name, if an index can have it."""
    if not name or name != name.lower() or name[0] in "-_+" or name in (".", "..") or len(name.encode()) > 255 or set(name) & set('\\/*?"<>| ,#:'):
        raise ValueError(f"no index can be named {name!r}")
    return name


def documents(frames: DataFrame, created_at: Column) -> DataFrame:
    """(_id, document): one JSON document for each frame; canonical and other values without their provenance."""
    repeated = frames.groupBy("interpretation_id", "frame_index").count().filter("count > 1").limit(1)
    if repeated.count():
        raise ValueError("a frame index is repeated")
    c = F.col("canonical")
    body = F.struct(
        F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"), "interpretation_id", "event_id", "frame_index", "parser_id",
        F.struct(*[c[t]["value"].alias(t) for t in TARGETS]).alias("canonical"), F.transform_values("ir", lambda k, v: v["value"]).alias("ir"),
    )
    return frames.select(F.concat_ws("_", "interpretation_id", F.col("frame_index").cast("string")).alias("_id"), F.to_json(body).alias("document"))


def bulk_lines(docs: DataFrame, index: str) -> DataFrame:
    """NDJSON: an action line and a document line in one value, as a bulk request takes them."""
    action = F.to_json(F.struct(F.struct(F.lit(index_name(index)).alias("_index"), F.col("_id")).alias("index")))
    return docs.select(F.concat(action, F.lit("\n"), F.col("document")).alias("value"))


def bulk_outcome(status: int, body: str | None) -> None:
    """Raises what a bulk response says went wrong."""
    import json

    if status >= 300:
        raise OSError(f"HTTP {status}")
    if not body:
        raise OSError("an empty response")
    try:
        told = json.loads(body)
    except ValueError as e:
        raise OSError("the response isn't JSON") from e
    if told.get("errors"):
        raise OSError("some documents were refused")


# Objects


def object_key(key: str) -> str:
    path = PurePosixPath(key)
    if not key or path.is_absolute() or ".." in path.parts or "\\" in key or "\0" in key:
        raise ValueError(f"{key!r} isn't a key")
    return str(path)


class Objects:
    """Keys to bytes in a folder of any file system that Spark reaches; a put replaces the object at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, key: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{object_key(key)}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def put(self, key: str, data: bytes) -> None:
        path, fs, jvm = self._at(key)
        part = jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(part, path, options)  # one step; raises if it fails

    def exists(self, key: str) -> bool:
        path, fs, _ = self._at(key)
        return fs.exists(path)

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise KeyError(key)
        return bytes(self.spark.read.format("binaryFile").load(f"{self.path}/{object_key(key)}").first()["content"])
