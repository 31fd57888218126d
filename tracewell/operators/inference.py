"""Format inference: detectors give candidates with evidence, and the decision abstains rather than guesses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.bytesx import let, trim, trim_ascii, valid, view

LOW, MEDIUM, HIGH = 1, 2, 3
NAMES = {1: "Low", 2: "Medium", 3: "High"}
CANDIDATE = "struct<parser_id:string,format_name:string,confidence:int,evidence:array<struct<rule:string,supports:boolean>>>"
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) "


def _evidence(*items: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("supports")) for r, s in items])


def _candidate(parser_id: str, name: str, confidence: Column, evidence: Column) -> Column:
    return F.struct(F.lit(parser_id).alias("parser_id"), F.lit(name).alias("format_name"), confidence.cast("int").alias("confidence"), evidence.alias("evidence")).cast(CANDIDATE)


def _stripped(data: Column) -> Column:
    """Without a byte order mark and ASCII white space."""
    return trim_ascii(F.regexp_replace(view(data), r"\A\xEF\xBB\xBF", ""))


def detect_json(data: Column) -> Column:
    return let(_stripped(data), lambda text: _json(data, text))


def _json(data: Column, text: Column) -> Column:
    opens, closes = text.startswith("{"), text.endswith("}")
    level = F.when(opens & closes, HIGH).otherwise(MEDIUM)
    base = _evidence(("json-object-delimiters", opens), ("json-object-delimiters", closes))
    colon = F.when(F.contains(text, F.lit(":")) | (opens & closes), F.concat(base, _evidence(("json-key-colon", F.lit(True))))).otherwise(base)
    bad = _candidate("json-flat", "JSON", F.lit(LOW), _evidence(("json-utf8", F.lit(False))))
    return F.when(F.length(text) > 0, F.when(~valid(data), bad).when(opens | closes, _candidate("json-flat", "JSON", level, colon)))


def detect_cef(data: Column) -> Column:
    return let(_stripped(data), lambda text: _cef(data, text))


def _cef(data: Column, text: Column) -> Column:
    version, pipes = text.startswith("CEF:0|"), F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    level = F.when(version & (pipes >= 6), HIGH).when(pipes >= 4, MEDIUM).otherwise(LOW)
    evidence = _evidence(("cef-header-prefix", F.lit(True)), ("cef-version-digit", version), ("cef-pipe-count", pipes >= 6))
    return F.when(valid(data) & text.startswith("CEF:"), _candidate("cef", "CEF", level, evidence))


def detect_syslog(data: Column) -> Column:
    return let(_stripped(data), lambda text: _syslog(data, text))


def _syslog(data: Column, text: Column) -> Column:
    name = "Syslog (RFC 3164)"
    one = lambda c, e: _candidate("syslog-rfc3164", name, c, e)
    bare = F.when(text.rlike(r"\A" + MONTH), one(F.lit(MEDIUM), _evidence(("syslog-timestamp-shape", F.lit(True)))))
    unclosed = one(F.lit(LOW), _evidence(("syslog-priority-bracket", F.lit(True)), ("syslog-priority-bracket", F.lit(False))))
    value, month = text.rlike(r"\A<[0-9]{0,3}>"), text.rlike(r"(?s)\A<[^>]*+>" + MONTH)
    evidence = _evidence(("syslog-priority-bracket", F.lit(True)), ("syslog-priority-value", value))
    evidence = F.when(month, F.concat(evidence, _evidence(("syslog-timestamp-shape", F.lit(True))))).otherwise(evidence)
    supports = 1 + value.cast("int") + month.cast("int")
    closed = one(F.when(supports >= 3, HIGH).when(supports == 2, MEDIUM).otherwise(LOW), evidence)
    return F.when(valid(data) & (F.length(text) > 0), F.when(~text.startswith("<"), bare).when(~F.contains(text, F.lit(">")), unclosed).otherwise(closed))


def detect_kv(data: Column) -> Column:
    return let(trim(view(F.encode(F.make_valid_utf8(data.cast("string")), "UTF-8"))), _kv)


def _kv(text: Column) -> Column:
    tokens = F.filter(F.split(text, " ", -1), lambda t: F.length(t) > 0)
    pairs = F.size(F.filter(tokens, lambda t: F.contains(t, F.lit("=")) & ~t.startswith("=") & ~t.endswith("=")))
    enough = (pairs >= 2) & (F.size(tokens) >= 2) & (pairs >= F.floor(F.size(tokens) / 2))
    return F.when(~text.rlike(r"\A(?:[{<\[]|CEF:)") & enough, _candidate("generic-kv-space-eq", "Key-Value", F.lit(MEDIUM), _evidence(("kv-heuristic", F.lit(True)))))


def detect_csv(data: Column) -> Column:
    return let(trim(view(F.encode(F.make_valid_utf8(data.cast("string")), "UTF-8"))), _csv)


def _csv(text: Column) -> Column:
    three = text.rlike(r"(?s)\A[^,=]+,[^,=]+,[^,=]+\z") & ~text.rlike(r"\A[{<\[]")
    return F.when(three, _candidate("generic-csv-3col", "CSV", F.lit(MEDIUM), _evidence(("csv-heuristic", F.lit(True)))))


DETECTORS: dict[str, Callable[[Column], Column]] = {"json": detect_json, "cef": detect_cef, "syslog": detect_syslog, "kv": detect_kv, "csv": detect_csv}
DEFAULT = ("json", "cef", "syslog")


def net_support(candidate: Column) -> Column:
    return F.aggregate(candidate["evidence"], F.lit(0), lambda a, e: a + F.when(e["supports"], 1).otherwise(-1))


def candidates(data: Column, detectors: tuple[str, ...] = DEFAULT) -> Column:
    """With more support than contradiction, by falling confidence, then parser id."""
    found = F.filter(F.array(*[DETECTORS[d](data) for d in detectors]), lambda c: c.isNotNull() & (net_support(c) > 0))
    order = lambda a, b: F.when(a["confidence"] != b["confidence"], F.signum(b["confidence"] - a["confidence"]).cast("int")).when(a["parser_id"] < b["parser_id"], -1).when(a["parser_id"] > b["parser_id"], 1).otherwise(0)
    return F.array_sort(found, order)


def infer(data: Column, detectors: tuple[str, ...] = DEFAULT, known: Column | None = None) -> Column:
    """struct(decision, parser_id, format_name, confidence, reason).

    ``known``: the id of a registered parser that reads the record, or null; it
    is taken as is, with high confidence.
    """
    ranked = candidates(data, detectors) if detectors else F.array().cast(f"array<{CANDIDATE}>")
    return let(ranked, lambda r: _decided(data, r, known))


def _decided(data: Column, ranked: Column, known: Column | None) -> Column:
    def outcome(decision: str, parser: Column | None, name: Column | None, level: Column | None, reason: str | None) -> Column:
        text = lambda c: F.lit(None).cast("string") if c is None else c
        return F.struct(F.lit(decision).alias("decision"), text(parser).alias("parser_id"), text(name).alias("format_name"), text(level).alias("confidence"), F.lit(reason).cast("string").alias("reason"))

    level = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), c["confidence"])
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    tie = F.coalesce((top["confidence"] == second["confidence"]) & (top["confidence"] >= MEDIUM), F.lit(False))
    out = F.when(F.octet_length(data) == 0, outcome("Abstained", None, None, None, "EmptyInput"))
    if known is not None:
        out = out.when(known.isNotNull(), outcome("Recognized", known, known, F.lit("High"), None))
    return (
        out.when(F.size(ranked) == 0, outcome("Abstained", None, None, None, "NoRecognizableStructure"))
        .when(tie, outcome("Abstained", None, None, level(top), "AmbiguousCandidates"))
        .when(top["confidence"] == LOW, outcome("Abstained", None, None, level(top), "InsufficientEvidence"))
        .otherwise(outcome("Recognized", top["parser_id"], top["format_name"], level(top), None))
    )
