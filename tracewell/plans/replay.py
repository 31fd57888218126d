"""Versioned interpretations: configurations, their identity, replay, and differences."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.bytesx import prefixed
from tracewell.operators import inference, mapping, parsers
from tracewell.operators.framing import frames

ALLOWED = {"framer": ("NewlineFramer", "1.0.0"), "mapper": ("DefaultMapper", "1.0.0"), "parsers": {"json-flat": parsers.JSON, "syslog": parsers.SYSLOG_PARSER, "cef": parsers.CEF}, "detectors": ("json", "syslog", "cef")}


class ConfigError(ValueError):
    """A configuration that isn't allowed."""


@dataclass(frozen=True)
class PipelineConfig:
    """policy "replay": inference only for Unsupported records; "bench": for all failures, and unseen formats are onboarded."""

    parsers: tuple[parsers.Parser, ...]
    detectors: tuple[str, ...] = inference.DEFAULT
    policy: str = "replay"
    framer: tuple[str, str] = ("NewlineFramer", "1.0.0")
    mapper: tuple[str, str] = ("DefaultMapper", "1.0.0")

    def serialized(self) -> bytes:
        text = lambda s: len(s.encode()).to_bytes(4, "big") + s.encode()
        both = lambda c: text(c[0]) + text(c[1])
        out = both(self.framer) + both(self.mapper) + len(self.parsers).to_bytes(4, "big")
        out += b"".join(both((p.id, p.version)) for p in self.parsers) + len(self.detectors).to_bytes(4, "big")
        return out + b"".join(text(d) for d in self.detectors)

    def identity(self) -> str:
        return hashlib.sha256(self.serialized()).hexdigest()


BENCH = PipelineConfig((parsers.CEF, parsers.JSON, parsers.SYSLOG_PARSER), ("json", "cef", "syslog", "kv", "csv"), "bench")
SERVE = PipelineConfig((parsers.JSON, parsers.SYSLOG_PARSER, parsers.CEF))
CLI_EMPTY = PipelineConfig((), ())


def requested(framer: tuple[str, str], mapper: tuple[str, str], parser_ids: list[str], detectors: list[str]) -> PipelineConfig:
    """A configuration from a request; only known components are allowed."""
    if framer != ALLOWED["framer"] or mapper != ALLOWED["mapper"]:
        raise ConfigError("unknown framer or mapper")
    if unknown := [p for p in parser_ids if p not in ALLOWED["parsers"]] + [d for d in detectors if d not in ALLOWED["detectors"]]:
        raise ConfigError(f"unknown components: {unknown}")
    return PipelineConfig(tuple(ALLOWED["parsers"][p] for p in parser_ids), tuple(detectors), framer=framer, mapper=mapper)


def interpretation_id(event_id: Column, config: PipelineConfig) -> Column:
    return F.sha2(F.concat(prefixed(event_id), F.lit(bytearray(config.serialized()))), 256)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: filters and projections stay above the explode."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def interpret(records: DataFrame, config: PipelineConfig) -> DataFrame:
    """records (with event_id, frame_index and frame_bytes) parsed, inferred, typed and mapped."""
    data = F.col("frame_bytes")
    registry = parsers.Registry(list(config.parsers))
    out = registry.dispatch(records, "frame_bytes", "first")
    status = F.col("first.result.status")
    ask = (status == "Unsupported") if config.policy == "replay" else (status != "Success")
    nothing = F.lit(None).cast("struct<decision:string,parser_id:string,format_name:string,confidence:string,reason:string>")
    out = _once(out, "inference", F.when(ask, inference.infer(F.when(ask, data), config.detectors)).otherwise(nothing))
    again = {p.id: p for p in config.parsers}
    if config.policy == "bench":
        again = {p.id: p for p in (parsers.KV, parsers.CSV)}
    second = F.lit(None).cast(f"struct<parser_id:string,version:string,result:{parsers.RESULT}>")
    for p in again.values():
        mine = (F.col("inference.decision") == "Recognized") & (F.col("inference.parser_id") == p.id)
        got = F.struct(F.lit(p.id).alias("parser_id"), F.lit(p.version).alias("version"), p.parse(F.when(mine, data)).alias("result"))
        second = F.when(mine, got).otherwise(second)
    out = _once(out, "parsed", F.coalesce(second, F.col("first")))
    done = F.col("parsed.result.status") == "Success"
    out = _once(out, "ir", F.when(done, mapping.to_ir(F.col("parsed.parser_id"), F.col("parsed.result.fields"))))
    out = _once(out, "canonical", mapping.canonical(F.col("parsed.parser_id"), F.col("ir")))
    return out.select(
        *records.columns,
        F.when(done, F.col("parsed.parser_id")).alias("parser_id"),
        F.when(done, F.col("parsed.version")).alias("parser_version"),
        F.when(done, "Success").otherwise("Failed").alias("parser_outcome"),
        F.when(~done, F.col("parsed.result.status")).alias("parser_error"),
        "inference", "ir", "canonical",
    )


def replay(evidence: DataFrame, config: PipelineConfig, integrity: DataFrame | None = None) -> DataFrame:
    """Frames of every event's interpretation; events whose chain fails have none.

    integrity: (event_id, status), as from ``chain_verified``.
    """
    good = evidence
    if integrity is not None:
        good = evidence.join(integrity.filter("status = 'Success'").select("event_id"), "event_id", "left_semi")
    records = frames(good.select("event_id", "source", "raw_bytes"), config.framer[0])
    out = interpret(records, config)
    return out.select(interpretation_id(F.col("event_id"), config).alias("interpretation_id"), F.lit(config.identity()).alias("config_hash"), "*")


# Differences


def _values(frames_: DataFrame) -> DataFrame:
    """(event_id, frame_index, field, value): canonical values, and unmapped ones as unmapped.<name>."""
    c = F.col("canonical")
    own = F.array(*[F.struct(F.lit(t).alias("field"), c[t]["value"].alias("value"), F.to_json(c[t]).alias("whole")) for t in mapping.TARGETS])
    more = F.transform(F.map_entries(c["unmapped"]), lambda e: F.struct(F.concat(F.lit("unmapped."), e["key"]).alias("field"), e["value"]["value"].alias("value"), F.to_json(e["value"]).alias("whole")))
    rows = frames_.filter("canonical is not null").select("event_id", "frame_index", F.explode(F.filter(F.concat(own, more), lambda x: x["whole"].isNotNull())).alias("x"))
    return rows.select("event_id", "frame_index", "x.*")


def frame_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event_id, frame_index, change): same, removed, added, or both for an index whose bytes differ."""
    keys = ["event_id", "frame_index"]
    a = old.select(*keys, F.sha2("frame_bytes", 256).alias("a"))
    b = new.select(*keys, F.sha2("frame_bytes", 256).alias("b"))
    change = F.when(F.col("a") == F.col("b"), F.array(F.lit("same"))).otherwise(F.filter(F.array(F.when(F.col("a").isNotNull(), "removed"), F.when(F.col("b").isNotNull(), "added")), lambda x: x.isNotNull()))
    return a.join(b, keys, "full_outer").select(*keys, F.explode(change).alias("change"))


def field_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event_id, frame_index, field, old_value, new_value) of frames with equal bytes; provenance counts as a difference."""
    keys = ["event_id", "frame_index"]
    same = frame_diff(old, new).filter("change = 'same'").select(*keys)
    a = _values(old.join(same, keys, "left_semi")).select(*keys, "field", F.col("value").alias("old_value"), F.col("whole").alias("a"))
    b = _values(new.join(same, keys, "left_semi")).select(*keys, "field", F.col("value").alias("new_value"), F.col("whole").alias("b"))
    return a.join(b, [*keys, "field"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, "field", "old_value", "new_value")


def abstention_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event_id, frame_index, removed, added): abstentions of one side only."""
    keys = ["event_id", "frame_index"]
    a = old.select(*keys, F.col("canonical.abstentions").alias("a"))
    b = new.select(*keys, F.col("canonical.abstentions").alias("b"))
    none = F.array().cast(old.schema["canonical"].dataType["abstentions"].dataType)
    x, y = F.coalesce("a", none), F.coalesce("b", none)
    return a.join(b, keys, "full_outer").select(*keys, F.array_except(x, y).alias("removed"), F.array_except(y, x).alias("added")).filter("size(removed) + size(added) > 0")
