"""Framers: one input row to its records, with exact byte ranges, and an error for what is left.

``frames(df, framer)`` gives (input columns, frame_index, frame_bytes,
range_start, range_end); ``frame_errors`` (input columns, kind, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: bytes of a frame, at most.
MAX_FRAME = 64 * 1024 * 1024
RESULT = "struct<frames:array<struct<data:binary,start:long,end:long>>,kind:string,detail:string>"


def _newline(data: bytes | None) -> dict | None:
    if data is None:
        return None
    *lines, rest = data.split(b"\n")
    out, at = [], 0
    for line in lines:
        if len(line) > MAX_FRAME:
            return {"frames": out, "kind": "OversizedFrame", "detail": f"a record has more than {MAX_FRAME} bytes"}
        end = at + len(line) + 1
        out.append((line[:-1] if line[-1:] == b"\r" else line, at, end))
        at = end
    if len(rest) > MAX_FRAME:
        return {"frames": out, "kind": "OversizedFrame", "detail": f"a record has more than {MAX_FRAME} bytes"}
    return {"frames": out, "kind": "Incomplete" if rest else None, "detail": f"{len(rest)} bytes without a line end" if rest else None}


def newline(data: Column) -> Column:
    """Records end with LF; one CR before it is dropped; what follows the last LF is incomplete.

    Running offsets make this sequential; one Arrow pass was far faster than
    nested higher-order functions (35 s against 2 s on a thousand documents).
    """
    return F.udf(_newline, RESULT, useArrow=True)(data)


def _length_prefix(data: bytes | None) -> dict | None:
    if data is None:
        return None
    out, at, kind, detail = [], 0, None, None
    while at < len(data):
        if len(data) - at < 4:
            kind, detail = "Incomplete", f"{len(data) - at} bytes of a length"
            break
        n = int.from_bytes(data[at : at + 4], "big")
        if n > MAX_FRAME:
            kind, detail = "OversizedFrame", f"{n} bytes declared"
            break
        if len(data) - at - 4 < n:
            kind, detail = "Incomplete", f"{len(data) - at - 4} of {n} bytes"
            break
        out.append((data[at + 4 : at + 4 + n], at + 4, at + 4 + n))
        at += 4 + n
    return {"frames": out, "kind": kind, "detail": detail}


def _json_objects(data: bytes | None) -> dict | None:
    """Objects by the depth of their braces outside strings; offsets are bytes."""
    import re

    if data is None:
        return None
    try:
        data.decode()
    except UnicodeDecodeError:
        return {"frames": [], "kind": "Malformed", "detail": "not UTF-8"}
    white = re.compile(rb"(?:[\x09-\x0d\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)*")
    mark = re.compile(rb'[{}"]')
    string = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
    out, at, kind, detail = [], white.match(data).end(), None, None
    while at < len(data):
        if data[at : at + 1] != b"{":
            kind, detail = "Malformed", f"no object at byte {at}"
            break
        depth, place = 0, at
        while m := mark.search(data, place):
            place = m.end()
            if m.group() == b'"':
                closing = string.match(data, place)
                if not closing:
                    place = len(data)
                    break
                place = closing.end()
            else:
                depth += 1 if m.group() == b"{" else -1
                if not depth:
                    break
        if depth or not m:
            kind, detail = "Incomplete", f"the object at byte {at} isn't closed"
            break
        out.append((data[at:place], at, place))
        at = white.match(data, place).end()
    return {"frames": out, "kind": kind, "detail": detail}


def length_prefix(data: Column) -> Column:
    """Four bytes of length, high first, then the record."""
    return F.udf(_length_prefix, RESULT, useArrow=True)(data)


def json_object(data: Column) -> Column:
    """Objects one after another, white space between them."""
    return F.udf(_json_objects, RESULT, useArrow=True)(data)


FRAMERS = {"NewlineFramer": newline, "LengthPrefixFramer": length_prefix, "JsonObjectFramer": json_object}


def framed(df: DataFrame, framer: str = "NewlineFramer", column: str = "raw_bytes") -> DataFrame:
    """df with ``framed``, computed once for frames and errors alike."""
    return df.withColumn("framed", F.explode(F.array(FRAMERS[framer](F.col(column)))))


def frames(df: DataFrame, framer: str = "NewlineFramer", column: str = "raw_bytes") -> DataFrame:
    rest = [c for c in df.columns if c != column]
    out = framed(df, framer, column).select(*rest, F.posexplode("framed.frames").alias("frame_index", "f"))
    return out.select(*rest, "frame_index", F.col("f.data").alias("frame_bytes"), F.col("f.start").alias("range_start"), F.col("f.end").alias("range_end"))


def frame_errors(df: DataFrame, framer: str = "NewlineFramer", column: str = "raw_bytes") -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return framed(df, framer, column).filter("framed.kind is not null").select(*rest, F.col("framed.kind").alias("kind"), F.col("framed.detail").alias("detail"))
