"""Entities: normalised addresses and host names of interpreted frames, as an edge list."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"source_ip": "SourceIp", "dest_ip": "DestIp", "source_hostname": "SourceHostname", "dest_hostname": "DestHostname"}
_EDGE = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def ipv4(text: Column) -> Column:
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(_trim(text).rlike(rf"\A{part}(?:\.{part}){{3}}\z"), _trim(text))


def _ipv6(text: str | None) -> str | None:
    try:
        return None if text is None or "%" in text else str(ipaddress.IPv6Address(text))
    except ValueError:
        return None


def ipv6(text: Column) -> Column:
    """The shortest text form; scopes aren't accepted.  Python runs only for what has a colon."""
    return F.when(F.contains(text, F.lit(":")), F.udf(_ipv6, "string", useArrow=True)(_trim(text)))


def hostname(text: Column) -> Column:
    name = F.lower(_trim(text))
    return F.when(F.length(name) > 0, name)


def normalized(entity_type: str, value: Column) -> Column:
    if entity_type not in ("ip", "hostname"):
        raise ValueError(f"no entity type {entity_type!r}")
    return hostname(value) if entity_type == "hostname" else F.coalesce(ipv4(value), ipv6(value))


def edges(frames: DataFrame) -> DataFrame:
    """(interpretation_id, event_id, frame_index, entity_type, entity_value, role, confidence, rule_id)."""
    c = F.col("canonical")
    keys = [k for k in ("interpretation_id", "event_id", "frame_index") if k in frames.columns]

    def one(target: str, kind: str, value: Column) -> Column:
        own = F.struct(F.lit(kind).alias("entity_type"), value.alias("entity_value"), F.lit(ROLES[target]).alias("role"), c[target]["confidence"].alias("confidence"), c[target]["rule_id"].alias("rule_id"))
        return F.when(value.isNotNull(), own)

    found = []
    for target in ("source_ip", "dest_ip"):
        v4 = ipv4(c[target]["value"])
        found += [one(target, "IPv4", v4), one(target, "IPv6", F.when(v4.isNull(), ipv6(c[target]["value"])))]
    found += [one(t, "Hostname", hostname(c[t]["value"])) for t in ("source_hostname", "dest_hostname")]
    rows = frames.filter("canonical is not null").select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e"))
    return rows.select(*keys, "e.*")


def lookup(edge_list: DataFrame, entity_type: str, value: str) -> DataFrame:
    """Sorted distinct interpretation ids of an address ("ip") or a host name ("hostname")."""
    kinds = ["Hostname"] if entity_type == "hostname" else ["IPv4", "IPv6"]
    want = normalized(entity_type, F.lit(value))
    return edge_list.filter(F.col("entity_type").isin(kinds) & (F.col("entity_value") == want)).select("interpretation_id").distinct().orderBy("interpretation_id")
