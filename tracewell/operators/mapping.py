"""Typed intermediate representation, and rules that map it to canonical fields with provenance.

A rule takes a value only if exactly one of its source fields is there; otherwise
it abstains and says why, and the fields stay unmapped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.bytesx import let

VALUE = "struct<value_type:string,value:string,start:int,end:int>"
TARGETS = ["timestamp", "source_ip", "source_hostname", "dest_ip", "dest_hostname", "severity", "message", "action"]
CANONICAL = "struct<value:string,source_field:string,start:int,end:int,transformations:array<string>,rule_id:string,confidence:string>"


def to_ir(parser_id: Column, fields: Column) -> Column:
    """map(name -> value): the last of equal names wins; only JSON has other types than String."""
    typed = lambda f: F.when((parser_id == "json-flat") & (f["raw_value"] == "null"), "Null").when((parser_id == "json-flat") & f["raw_value"].isin("true", "false"), "Boolean").otherwise("String")
    names = F.transform(fields, lambda f: f["name"])
    last = let(names, lambda n: F.filter(fields, lambda f, i: ~F.array_contains(F.slice(n, i + 2, F.size(n)), f["name"])))
    entries = F.transform(last, lambda f: F.struct(f["name"].alias("key"), F.struct(typed(f).alias("value_type"), f["raw_value"].alias("value"), f["start"], f["end"]).alias("value")))
    return F.map_from_entries(F.array_sort(entries))


@dataclass(frozen=True)
class Rule:
    parser_id: str
    target: str
    sources: tuple[str, ...]
    rule_id: str
    confidence: str
    kind: str = "string"


# Severity names by number and word, and the rules.
SYSLOG_LEVELS = {"0": "Emergency", "1": "Alert", "2": "Critical", "3": "Error", "4": "Warning", "5": "Notice", "6": "Info", "7": "Debug"}
CEF_LEVELS = {"0": "Info", "1": "Info", "2": "Info", "3": "Info", "4": "Warning", "5": "Warning", "6": "Warning", "7": "Error", "8": "Error", "9": "Critical", "10": "Critical"}
CEF_WORDS = {"low": "Info", "medium": "Warning", "high": "Error", "very-high": "Critical", "fatal": "Critical"}
JSON_WORDS = {
    "trace": "Trace", "debug": "Debug", "info": "Info", "information": "Info", "notice": "Notice", "warn": "Warning", "warning": "Warning",
    "err": "Error", "error": "Error", "crit": "Critical", "critical": "Critical", "fatal": "Critical", "alert": "Alert", "emerg": "Emergency", "emergency": "Emergency",
}
RULES = [
    Rule("syslog-rfc3164", "timestamp", ("syslog.timestamp",), "syslog-ts-1", "Certain"),
    Rule("syslog-rfc3164", "source_hostname", ("syslog.hostname",), "syslog-host-1", "Certain"),
    Rule("syslog-rfc3164", "message", ("syslog.message",), "syslog-msg-1", "Certain"),
    Rule("syslog-rfc3164", "severity", ("syslog.severity",), "syslog-sev-1", "Certain", "syslog"),
    Rule("cef", "timestamp", ("rt",), "cef-rt-1", "Certain"),
    Rule("cef", "source_ip", ("src",), "cef-src-1", "Certain"),
    Rule("cef", "source_hostname", ("shost",), "cef-shost-1", "Certain"),
    Rule("cef", "dest_ip", ("dst",), "cef-dst-1", "Certain"),
    Rule("cef", "dest_hostname", ("dhost",), "cef-dhost-1", "Certain"),
    Rule("cef", "message", ("cef.name",), "cef-msg-1", "Probable"),
    Rule("cef", "severity", ("cef.severity",), "cef-sev-1", "Certain", "cef"),
    Rule("json-flat", "timestamp", ("timestamp", "@timestamp", "time"), "json-heur-ts-1", "Heuristic"),
    Rule("json-flat", "source_ip", ("src_ip", "source_ip", "client_ip", "src", "client"), "json-heur-srcip-1", "Heuristic"),
    Rule("json-flat", "source_hostname", ("host", "hostname", "src_host"), "json-heur-srchost-1", "Heuristic"),
    Rule("json-flat", "dest_ip", ("dst_ip", "dest_ip", "target_ip"), "json-heur-dstip-1", "Heuristic"),
    Rule("json-flat", "dest_hostname", ("dst_host", "dest_host", "target_host"), "json-heur-dsthost-1", "Heuristic"),
    Rule("json-flat", "message", ("message", "msg"), "json-heur-msg-1", "Heuristic"),
    Rule("json-flat", "severity", ("level", "severity", "log_level"), "json-heur-sev-1", "Heuristic", "json"),
]
ORDER = ["timestamp", "source_ip", "source_hostname", "dest_ip", "dest_hostname", "message", "severity"]



def _severity(kind: str, value: Column) -> tuple[Column, list[Column]]:
    """The severity a value names, or null, and the transformations."""
    number = F.when(value.rlike(r"\A\+?0*[0-9]{1,3}\z"), F.regexp_replace(value, r"\A\+?0*(?=[0-9])", ""))
    if kind == "syslog":
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in SYSLOG_LEVELS.items() for x in kv]), number), [F.lit("identity"), F.lit("syslog_priority_to_severity")]
    words = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(value))
    if kind == "cef":
        by_number = F.try_element_at(F.create_map(*[F.lit(x) for kv in CEF_LEVELS.items() for x in kv]), number)
        return F.when(number.isNotNull(), by_number).otherwise(words(CEF_WORDS)), [F.lit("identity"), F.lit("cef_severity_to_canonical"), F.when(number.isNull(), F.lit("lowercase"))]
    return words(JSON_WORDS), [F.lit("identity"), F.lit("lowercase")]


ABSTENTION = "struct<target:string,fields:array<string>,rule_id:string,reason:string>"


def _applied(rule: Rule, ir: Column) -> Column:
    """struct(found, abstained) of a rule."""
    nothing, kept = F.lit(None).cast(CANONICAL), F.lit(None).cast(ABSTENTION)
    both = lambda found, abstained: F.struct(found.alias("found"), abstained.alias("abstained"))

    def abstain(there: Column, reason: str) -> Column:
        return both(nothing, F.struct(F.lit(rule.target).alias("target"), there.alias("fields"), F.lit(rule.rule_id).alias("rule_id"), F.lit(reason).alias("reason")).cast(ABSTENTION))

    def take(there: Column, one: Column) -> Column:
        value, steps = (one["value"], [F.lit("identity")]) if rule.kind == "string" else _severity(rule.kind, one["value"])
        blank = (one["value_type"] == "Null") | ~one["value"].rlike(r"[^\p{IsWhite_Space}]")
        found = lambda v: F.struct(v.alias("value"), there[0].alias("source_field"), one["start"].alias("start"), one["end"].alias("end"), F.filter(F.array(*steps), lambda x: x.isNotNull()).alias("transformations"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.confidence).alias("confidence")).cast(CANONICAL)
        return F.when(blank, abstain(there, "InsufficientEvidence")).otherwise(let(value, lambda v: F.when(v.isNull(), abstain(there, "TypeMismatch")).otherwise(both(found(v), kept))))

    there = F.filter(F.array(*[F.lit(s) for s in rule.sources]), lambda s: F.map_contains_key(ir, s))
    return let(there, lambda t: F.when(F.size(t) == 0, both(nothing, kept)).when(F.size(t) > 1, abstain(t, "Ambiguous")).otherwise(let(F.element_at(ir, t[0]), lambda one: take(t, one))))


def canonical(parser_id: Column, ir: Column) -> Column:
    """struct(<target>..., unmapped map, abstentions); null for parsers without rules, and for what wasn't parsed."""
    results = []
    for target in ORDER:
        own = F.struct(F.lit(None).cast(CANONICAL).alias("found"), F.lit(None).cast(ABSTENTION).alias("abstained"))
        for rule in (r for r in RULES if r.target == target):
            own = F.when(parser_id == rule.parser_id, _applied(rule, ir)).otherwise(own)
        results.append(own.alias(target))

    def whole(r: Column) -> Column:
        used = F.array_compact(F.array(*[r[t]["found"]["source_field"] for t in ORDER]))
        values = [(r[t]["found"] if t in ORDER else F.lit(None).cast(CANONICAL)).alias(t) for t in TARGETS]
        unmapped = let(used, lambda u: F.map_filter(ir, lambda k, v: ~F.array_contains(u, k)))
        return F.struct(*values, unmapped.alias("unmapped"), F.array_compact(F.array(*[r[t]["abstained"] for t in ORDER])).alias("abstentions"))

    return F.when(parser_id.isin(*{r.parser_id for r in RULES}) & ir.isNotNull(), let(F.struct(*results), whole))
