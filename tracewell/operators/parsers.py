"""Parsers: a record's bytes to (status, error, fields), and their registry.

status is Success, Unsupported (another parser may try), Malformed or
ResourceLimit (both end the dispatch).  Fields are in order, with byte spans in
the record.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.bytesx import WHITE, lead, let, parts, text_of, trim, unsigned, valid, view

FIELDS = "array<struct<name:string,raw_value:string,start:int,end:int>>"
RESULT = f"struct<status:string,error:string,fields:{FIELDS}>"
MAX_JSON, MAX_CEF, MAX_PAIRS = 1000, 500, 1000  # fixed values


def _result(status: str, error: str | None = None, fields: Column | None = None) -> Column:
    none = F.lit(None).cast(FIELDS)
    return F.struct(F.lit(status).alias("status"), F.lit(error).alias("error"), (none if fields is None else fields.cast(FIELDS)).alias("fields")).cast(RESULT)


def _field(name: str | Column, value: Column, start: Column, end: Column | None = None) -> Column:
    """A field of a part of the view; its span covers the value."""
    end = start + F.length(value) if end is None else end
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), text_of(value).alias("raw_value"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _trimmed(name: str | Column, value: Column, start: Column) -> Column:
    return _field(name, trim(value), start + F.when(F.length(trim(value)) > 0, lead(value)).otherwise(0))


# syslog

#: Fixed value: groups <pri>, pri, gap, timestamp, gap, host, gap, tag, colon and gap, message.
SYSLOG = rf"(?s)\A(<([^>]*+)>)?+({WHITE}*+)((?=.{{15}})(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) *+[0-9]*+ ..:..:..)({WHITE}*+)([^ ]++)({WHITE}*+)([^:]*+)(:{WHITE}*+)?+(.*)\z"


def syslog(data: Column) -> Column:
    return let(view(data), lambda text: let(F.struct(trim(text).alias("body"), lead(text).alias("first")), lambda t: _syslog(data, t["body"], t["first"])))


def _syslog_fields(g: Column, sizes: Column, first: Column, length: Column) -> Column:
    at = lambda i: first + F.aggregate(F.slice(F.array_remove(sizes, -1), 1, i), F.lit(0), lambda a, x: a + x) - F.when(F.lit(i > 1), sizes[1]).otherwise(0)  # noqa: E731  group 2 lies in group 1
    number = unsigned(g[1], 2**32 - 1)
    priority = [
        _field("syslog.priority", g[1], first + 1),
        F.struct(F.lit("syslog.facility").alias("name"), F.shiftright(number, 3).cast("string").alias("raw_value"), (first + 1).cast("int").alias("start"), (first + 1 + sizes[1]).cast("int").alias("end")),
        F.struct(F.lit("syslog.severity").alias("name"), number.bitwiseAND(7).cast("string").alias("raw_value"), (first + 1).cast("int").alias("start"), (first + 1 + sizes[1]).cast("int").alias("end")),
    ]
    end = (first + length).cast("int")
    rest = [
        _field("syslog.timestamp", g[3], at(3)),
        _trimmed("syslog.hostname", g[5], at(5)),
        _trimmed("syslog.tag", g[7], at(7)),
        F.when(F.length(g[9]) > 0, _field("syslog.message", g[9], at(9))).otherwise(F.struct(F.lit("syslog.message").alias("name"), F.lit("").alias("raw_value"), end.alias("start"), end.alias("end"))),
    ]
    return F.when(F.length(g[0]) > 0, F.concat(F.array(*priority), F.array(*rest))).otherwise(F.array(*rest))


def _syslog(data: Column, body: Column, first: Column) -> Column:
    fields = let(parts(body, SYSLOG, 10), lambda g: let(F.transform(g, lambda x: F.length(x)), lambda sizes: _syslog_fields(g, sizes, first, F.length(body))))
    opened = body.startswith("<")
    pri = F.regexp_extract(body, r"\A<([^>]*+)>", 1)
    after = F.regexp_replace(body, rf"\A<[^>]*+>{WHITE}*+", "")
    return (
        F.when(~valid(data), _result("Malformed", "not UTF-8"))
        .when(F.length(body) == 0, _result("Unsupported", "empty"))
        .when(opened & ~F.contains(body, F.lit(">")), _result("Malformed", "unclosed priority"))
        .when(opened & unsigned(pri, 2**32 - 1).isNull(), _result("Malformed", "priority isn't a number"))
        .when(after.startswith("1 "), _result("Unsupported", "RFC 5424"))
        .when(~body.rlike(SYSLOG), _result("Malformed", "no RFC 3164 timestamp and host"))
        .otherwise(_result("Success", None, fields))
    )


# CEF

CEF_HEADER = ["cef.device_vendor", "cef.device_product", "cef.device_version", "cef.signature_id", "cef.name", "cef.severity"]
#: Fixed value: an extension: key, value.
CEF_PAIR = r"(?s)(?<![^ ])([A-Za-z0-9_.\-]+)=(.*?)(?= [A-Za-z0-9_.\-]+=|\z)"
CEF_BEFORE = r"(?s)\A(.*?)(?:(?<![^ ])[A-Za-z0-9_.\-]+=|\z)"


def cef(data: Column) -> Column:
    return let(view(data), lambda text: let(F.struct(trim(text).alias("body"), lead(text).alias("first")), lambda t: _cef(data, t["body"], t["first"])))


def _cef(data: Column, body: Column, first: Column) -> Column:
    def read(s: Column, sizes: Column) -> Column:
        at = lambda i: first + F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x + 1)
        version = F.substring(s[0], F.lit(5), F.length(s[0]))
        header = [_trimmed("cef.version", version, first + 4), *(_trimmed(n, s[i], at(i)) for i, n in enumerate(CEF_HEADER, 1))]
        start = at(7) + F.length(F.regexp_extract(s[7], CEF_BEFORE, 1))

        def step(state: Column, pair: Column) -> Column:
            begin = state["at"] + F.length(pair["k"]) + 1
            return F.struct((begin + F.length(pair["v"]) + 1).cast("int").alias("at"), F.concat(state["out"], F.array(_field(text_of(pair["k"]), pair["v"], begin))).alias("out"))

        keys, values = (F.regexp_extract_all(s[7], F.lit(CEF_PAIR), F.lit(i)) for i in (1, 2))
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        more = lambda p: F.aggregate(p, F.struct(start.cast("int").alias("at"), F.array().cast(FIELDS).alias("out")), step, lambda x: x["out"])
        return (
            F.when(F.size(s) < 8, _result("Malformed", "fewer than 8 segments"))
            .when(trim(version) != "0", _result("Unsupported", "CEF version"))
            .otherwise(let(pairs, lambda p: F.when(F.size(p) > MAX_CEF, _result("ResourceLimit", "too many extensions")).otherwise(_result("Success", None, F.concat(F.array(*header), more(p))))))
        )

    split = let(F.split(body, r"\|", 8), lambda s: let(F.transform(s, lambda x: F.length(x)), lambda sizes: read(s, sizes)))
    return F.when(~valid(data), _result("Malformed", "not UTF-8")).when(~body.startswith("CEF:"), _result("Unsupported", "no CEF prefix")).otherwise(split)


# JSON: a lenient scanner with spans, which no built-in function has

_WHITE = re.compile(r"[\t-\r \x85\xa0  -     　]*")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*+)"', re.S)
_NUMBER = re.compile(r"[0-9\-][0-9+\-.eE]*")
_INSIDE = re.compile(r'["{}\[\]]')


def _json(data: bytes | None) -> dict | None:
    if data is None:
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return {"status": "Malformed", "error": "not UTF-8", "fields": None}
    start = _WHITE.match(text, 1 if text[:1] == "﻿" else 0).end()
    end = len(text)
    while end > start and _WHITE.fullmatch(text[end - 1]):
        end -= 1
    if not (end - start >= 2 and text[start] == "{" and text[end - 1] == "}"):
        return {"status": "Unsupported", "error": "not an object", "fields": None}
    fields, at, last = [], start + 1, end - 1
    place = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].encode()))

    def bad(why: str) -> dict:
        return {"status": "Malformed", "error": why, "fields": None}

    while True:
        at = _WHITE.match(text, at, last).end()
        if at >= last:
            break
        key = _STRING.match(text, at, last)
        if not key:
            return bad("a key must be a string")
        at = _WHITE.match(text, key.end(), last).end()
        if text[at : at + 1] != ":" or at >= last:
            return bad("no colon after a key")
        at = _WHITE.match(text, at + 1, last).end()
        found = _value(text, at, last)
        if isinstance(found, str):
            return bad(found)
        lo, hi, at = found
        fields.append((key.group(1), text[lo:hi], place(lo), place(hi)))
        if len(fields) > MAX_JSON:
            return {"status": "ResourceLimit", "error": "too many fields", "fields": None}
        at = _WHITE.match(text, at, last).end()
        if at < last:
            if text[at] != ",":
                return bad("no comma between fields")
            at += 1
    return {"status": "Success", "error": None, "fields": fields}


def _value(text: str, at: int, last: int) -> tuple[int, int, int] | str:
    """(start, end, where to go on) of a value, or what is wrong with it."""
    sign = text[at] if at < last else ""
    if sign == '"':
        m = _STRING.match(text, at, last)
        return (*m.span(1), m.end()) if m else "a string without its closing quote"
    if sign in ("{", "["):
        closing, depth, place = {"{": "}", "[": "]"}[sign], 0, at
        while m := _INSIDE.search(text, place, last):
            place = m.end()
            if m.group() == '"':
                inner = _STRING.match(text, m.start(), last)
                if not inner:
                    break
                place = inner.end()
            elif m.group() in "{[":
                depth += 1  # any opener counts, only the outermost's closer counts back
            elif m.group() == closing:
                depth -= 1
                if not depth:
                    return at, place, place
        return "a bracket that nothing closes"
    if sign and sign in "tfn":
        end = at
        while end < last and text[end].isalpha():
            end += 1
        return at, end, end
    m = _NUMBER.match(text, at, last)
    return (*m.span(), m.end()) if m else "unexpected value"


def json_flat(data: Column) -> Column:
    return F.udf(_json, RESULT, useArrow=True)(data)


# Generated parsers


def key_value(pair_separator: str, separator: str) -> Callable[[Column], Column]:
    def parse(data: Column) -> Column:
        text = view(data)
        tokens = F.split(text, re.escape(_latin(pair_separator)), -1)
        width = len(_latin(pair_separator))
        placed = _placed(tokens, width)
        real = F.filter(placed, lambda p: F.length(trim(p["token"])) > 0)
        where = lambda p: F.instr(p["token"], F.lit(_latin(separator)))
        key = lambda p: F.substring(p["token"], F.lit(1), where(p) - 1)
        value = lambda p: F.substring(p["token"], where(p) + len(_latin(separator)), F.length(p["token"]))
        fields = F.transform(real, lambda p: _trimmed(text_of(trim(key(p))), value(p), p["at"] + where(p) - 1 + len(_latin(separator))))
        return (
            F.when(F.octet_length(data) == 0, _result("Unsupported", "empty"))
            .when(~valid(data), _result("Malformed", "not UTF-8"))
            .when(~F.contains(text, F.lit(_latin(separator))), _result("Unsupported", "no separator"))
            .when(F.exists(real, lambda p: where(p) == 0), _result("Malformed", "a token has no separator"))
            .when(F.exists(real, lambda p: F.length(trim(key(p))) == 0), _result("Malformed", "an empty key"))
            .when(F.size(real) > MAX_PAIRS, _result("ResourceLimit", "too many pairs"))
            .otherwise(_result("Success", None, fields))
        )

    return parse


def delimited(separator: str, names: list[str]) -> Callable[[Column], Column]:
    def parse(data: Column) -> Column:
        text, own = view(data), _latin(separator)
        placed = _placed(F.split(text, re.escape(own), -1), len(own))
        fields = F.zip_with(F.slice(placed, 1, len(names)), F.slice(F.array(*[F.lit(n) for n in names]), F.lit(1), F.least(F.size(placed), F.lit(len(names)))), lambda p, n: _trimmed(n, p["token"], p["at"]))
        out = F.when(F.octet_length(data) == 0, _result("Unsupported", "empty")).when(~valid(data), _result("Malformed", "not UTF-8"))
        if len(names) > 1:
            out = out.when(~F.contains(text, F.lit(own)), _result("Unsupported", "no separator"))
        return out.otherwise(_result("Success", None, fields))

    return parse


def _latin(text: str) -> str:
    return text.encode().decode("latin-1")


def _placed(tokens: Column, width: int) -> Column:
    none = F.array().cast("array<struct<token:string,at:int>>")
    step = lambda s, t: F.struct((s["at"] + F.length(t) + width).alias("at"), F.concat(s["out"], F.array(F.struct(t.alias("token"), s["at"].alias("at")))).alias("out"))
    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])


# Registry


@dataclass(frozen=True)
class Parser:
    id: str
    version: str
    parse: Callable[[Column], Column]
    stage: str = "Stable"


@dataclass
class Registry:
    """Parsers in order; the first that doesn't answer Unsupported decides."""

    parsers: list[Parser] = field(default_factory=list)

    def register(self, parser: Parser) -> None:
        if self.get(parser.id):
            raise ValueError(f"parser {parser.id!r} is there already")
        self.parsers.append(parser)

    def get(self, parser_id: str) -> Parser | None:
        return next((p for p in self.parsers if p.id == parser_id), None)

    def identity(self) -> list[tuple[str, str]]:
        return [(p.id, p.version) for p in self.parsers]

    def __len__(self) -> int:
        return len(self.parsers)

    def dispatch(self, df: DataFrame, column: str, name: str = "first") -> DataFrame:
        """df with struct(parser_id, version, result); a parser sees only records that all before it left as Unsupported.

        Each answer is exploded from an array of one, so that what is above the
        explode can't make it be computed again.
        """
        out, columns = df, []
        for i, p in enumerate(self.parsers):
            open_ = F.lit(True) if not columns else F.col(columns[-1])["status"].isNull() | (F.col(columns[-1])["status"] == "Unsupported")
            for c in columns[:-1]:
                open_ = open_ & (F.col(c)["status"].isNull() | (F.col(c)["status"] == "Unsupported"))
            answer = p.parse(F.when(open_, F.col(column)))
            out = out.select("*", F.explode(F.array(F.when(open_, answer))).alias(f"__{name}{i}"))
            columns.append(f"__{name}{i}")
        found = F.struct(F.lit(None).cast("string").alias("parser_id"), F.lit(None).cast("string").alias("version"), _result("Unsupported", "no parser").alias("result"))
        for p, c in reversed(list(zip(self.parsers, columns, strict=True))):
            own = F.struct(F.lit(p.id).alias("parser_id"), F.lit(p.version).alias("version"), F.col(c).alias("result"))
            found = F.when(F.col(c)["status"] != "Unsupported", own).otherwise(found)
        return out.select(*df.columns, F.explode(F.array(found)).alias(name))


JSON = Parser("json-flat", "0.1.0", json_flat)
CEF = Parser("cef", "0.1.0", cef)
SYSLOG_PARSER = Parser("syslog-rfc3164", "0.1.0", syslog)
KV = Parser("generic-kv-space-eq", "1.0.0", key_value(" ", "="))
CSV = Parser("generic-csv-3col", "1.0.0", delimited(",", ["col1", "col2", "col3"]))
