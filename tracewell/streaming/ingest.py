"""Streams of payloads into the store: at least once, and by id exactly once."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.evidence import Store, records


@dataclass(frozen=True)
class KafkaConfig:
    broker: str = "localhost:9092"
    topic: str = "evidence_ingest"
    partition: int = 0
    retry_ms: int = 5000

    @classmethod
    def from_environment(cls, prefix: str = "KAFKA_") -> KafkaConfig:
        get = os.environ.get
        return cls(get(f"{prefix}BROKER", cls.broker), get(f"{prefix}TOPIC", cls.topic), int(get(f"{prefix}PARTITION", cls.partition)), int(get(f"{prefix}RETRY_MS", cls.retry_ms)))

    def options(self) -> dict[str, str]:
        """For readStream.format("kafka"): only what arrives from now on."""
        return {"kafka.bootstrap.servers": self.broker, "assign": f'{{"{self.topic}":[{self.partition}]}}', "startingOffsets": "latest", "kafka.retry.backoff.ms": str(self.retry_ms)}

    @property
    def source(self) -> str:
        return f"kafka-{self.topic}"


def read_kafka(spark: SparkSession, config: KafkaConfig) -> DataFrame:
    """(source, raw_bytes, offset)."""
    rows = spark.readStream.format("kafka").options(**config.options()).load()
    return rows.select(F.lit(config.source).alias("source"), F.col("value").alias("raw_bytes"), "offset")


def store_batch(store: Store, quarantine: str, framer: str = "NewlineFramer"):
    """For foreachBatch: payloads (source, raw_bytes) with a framing error go to ``quarantine``, the rest to the store.

    Each payload is a source of its own by its place, so ids don't depend on how
    payloads are dealt into batches; a batch that runs again stores nothing new.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        place = F.col("offset") if "offset" in batch.columns else F.sha2("raw_bytes", 256)
        named = batch.select(F.concat_ws("/", "source", place.cast("string")).alias("source"), "raw_bytes")
        events, errors = records(named, framer)
        errors.withColumn("batch", F.lit(number)).write.mode("append").parquet(quarantine)
        store.append(events)

    return run


def start(payloads: DataFrame, store: Store, quarantine: str, checkpoint: str, framer: str = "NewlineFramer", **trigger):
    return payloads.writeStream.foreachBatch(store_batch(store, quarantine, framer)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
