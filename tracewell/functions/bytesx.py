"""Byte-exact text on Spark: a text's ISO-8859-1 view has one character for each byte.

Lengths and positions in the view are byte offsets, and any bytes survive the
way there and back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the UTF-8 bytes of a Unicode white space character, in the view.
WHITE = r"(?:[\x09-\x0D\x20]|\xC2\x85|\xC2\xA0|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80)"
#: Parts of a match are joined by this; it can't occur in a view.
PART = "Ā"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def view(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def bytes_of(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def text_of(text: Column) -> Column:
    """The UTF-8 string that a (part of a) view stands for."""
    return bytes_of(text).cast("string")


def valid(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def lead(text: Column) -> Column:
    """Bytes of white space at the start of a view."""
    return F.length(F.regexp_extract(text, rf"\A{WHITE}*+", 0))


def trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A{WHITE}++", ""), rf"(?<!{WHITE}){WHITE}++\z", "")


def trim_ascii(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\A[ \t\n\f\r]++", ""), r"(?<![ \t\n\f\r])[ \t\n\f\r]++\z", "")


def parts(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that matches the whole view, from one match."""
    return F.split(F.regexp_replace(text, pattern, PART.join(f"${i}" for i in range(1, groups + 1))), PART, -1)


def unsigned(text: Column, most: int) -> Column:
    """An unsigned decimal with an optional plus sign, or null where it isn't one or is too large."""
    number = F.when(text.rlike(r"\A\+?[0-9]+\z"), F.regexp_replace(text, r"\A\+?0*(?=[0-9])", ""))
    return F.when(F.length(number) <= 10, F.when(number.cast("long") <= most, number.cast("long")))


def prefixed(data: Column) -> Column:
    """A string's bytes after their number as four bytes, high first."""
    return F.concat(word(F.octet_length(data), 8), data.cast("binary"))


def word(number: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), digits, "0"))


def event_id(source: Column, index: Column, data: Column) -> Column:
    """SHA-256 of the prefixed source, the index as eight bytes, and the record."""
    return F.sha2(F.concat(prefixed(source), word(index, 16), data), 256)
