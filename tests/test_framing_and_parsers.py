"""Behaviour tables: bytes in, records, fields and decisions out."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import framing, inference, parsers


def rows(spark, values, column):
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i long, b binary")
    return [r["x"] for r in df.select("i", F.explode(F.array(column(F.col("b")))).alias("x")).orderBy("i").collect()]


NEWLINE = [
    (b"", [], None),
    (b"a\nb\n", [b"a", b"b"], None),
    (b"a\r\n\r\r\n\n", [b"a", b"\r", b""], None),
    (b"a\nrest", [b"a"], "Incomplete"),
    (b"\x00\xff\n", [b"\x00\xff"], None),
]


def test_newline(spark):
    for (data, want, kind), got in zip(NEWLINE, rows(spark, [x[0] for x in NEWLINE], framing.newline), strict=True):
        assert [bytes(f["data"]) for f in got["frames"]] == want and got["kind"] == kind
        assert b"".join(data[f["start"] : f["end"]] for f in got["frames"]) == data[: got["frames"][-1]["end"] if want else 0]


def test_length_prefix(spark):
    cases = [b"\0\0\0\2hi\0\0\0\0", b"\0\0", b"\0\0\0\5hi", b"\xff\xff\xff\xffx", b""]
    got = rows(spark, cases, framing.length_prefix)
    assert [[bytes(f["data"]) for f in g["frames"]] for g in got] == [[b"hi", b""], [], [], [], []]
    assert [g["kind"] for g in got] == [None, "Incomplete", "Incomplete", "OversizedFrame", None]


def test_json_objects(spark):
    cases = [b' {"a":"}"} {"b":{}}\n', b'{"a":1', b'{"a":1}x', b"\xff", b""]
    got = rows(spark, cases, framing.json_object)
    assert [[bytes(f["data"]) for f in g["frames"]] for g in got] == [[b'{"a":"}"}', b'{"b":{}}'], [], [b'{"a":1}'], [], []]
    assert [g["kind"] for g in got] == [None, "Incomplete", "Malformed", "Malformed", None]


def fields(result):
    return {f["name"]: f["raw_value"] for f in result["fields"] or []}


def check_spans(cases, got, derived=()):
    for data, r in zip(cases, got, strict=True):
        for f in r["fields"] or []:
            if f["name"] not in derived:
                assert data[f["start"] : f["end"]].decode() == f["raw_value"], f


def test_syslog(spark):
    cases = ["<34>Oct 11 22:14:15 mymachine su: 'su root' failed é".encode(), "  <13>Jan  5 01:02:03 hé tag".encode(), b"", b"<34", b"<x>Oct 11 22:14:15 h t: m", b"<34>1 2003", b"plain text", b"\xff", b"Jan  ab:cd:ef h t: m"]
    got = rows(spark, cases, parsers.syslog)
    assert [g["status"] for g in got] == ["Success", "Success", "Unsupported", "Malformed", "Malformed", "Unsupported", "Malformed", "Malformed", "Malformed"]
    assert fields(got[0]) == {"syslog.priority": "34", "syslog.facility": "4", "syslog.severity": "2", "syslog.timestamp": "Oct 11 22:14:15", "syslog.hostname": "mymachine", "syslog.tag": "su", "syslog.message": "'su root' failed é"}
    assert fields(got[1])["syslog.tag"] == "tag" and fields(got[1])["syslog.message"] == ""
    check_spans(cases, got, ("syslog.facility", "syslog.severity"))


def test_cef(spark):
    cases = ["CEF:0|V|P|1.0|200|Tést|3|src=1.2.3.4 msg=a b  c dst=5.6.7.8".encode(), b'CEF:0|V|P|1|2|n|3|src=1.2.3.4 [5; "six"] x=|y', b"CEF:1|V|P|1|2|n|3|", b"CEF:0|V", b"{}", b"CEF:0|V|P|1|2|n|3|left=right middle"]
    got = rows(spark, cases, parsers.cef)
    assert [g["status"] for g in got] == ["Success", "Success", "Unsupported", "Malformed", "Unsupported", "Success"]
    assert fields(got[0]) == {"cef.version": "0", "cef.device_vendor": "V", "cef.device_product": "P", "cef.device_version": "1.0", "cef.signature_id": "200", "cef.name": "Tést", "cef.severity": "3", "src": "1.2.3.4", "msg": "a b  c", "dst": "5.6.7.8"}
    assert fields(got[1])["src"] == '1.2.3.4 [5; "six"]' and fields(got[1])["x"] == "|y"
    check_spans(cases, got)


def test_json(spark):
    cases = ['{"src_ip":"10.0.0.1","é":"a\\"b", "n": -1.5e3, "t":true, "o":{"a":[1]x},}'.encode(), b'{"x":{"a":[1]}}', b'{"a":{"b":1}}', b"[1]", b'{"a" 1}', b"\xff", b'{"a":ALLOW}', ("{" + ",".join(f'"k{i}":1' for i in range(1002)) + "}").encode()]
    got = rows(spark, cases, parsers.json_flat)
    assert [g["status"] for g in got] == ["Malformed", "Malformed", "Success", "Unsupported", "Malformed", "Malformed", "Malformed", "ResourceLimit"]
    good = ['{"src_ip":"10.0.0.1","é":"a\\"b", "n": -1.5e3, "t":true,}'.encode()]
    got = rows(spark, good, parsers.json_flat)
    assert fields(got[0]) == {"src_ip": "10.0.0.1", "é": 'a\\"b', "n": "-1.5e3", "t": "true"}
    check_spans(good, got)


def test_generated(spark):
    cases = [b"room=12 colour= pale blue  door=shut", b"plain", b"a=1 b", b" =1 a=2", b""]
    got = rows(spark, cases, parsers.key_value(" ", "="))
    assert [g["status"] for g in got] == ["Malformed", "Unsupported", "Malformed", "Malformed", "Unsupported"]
    got = rows(spark, [b"room=12 colour=blue door=shut"], parsers.key_value(" ", "="))
    assert fields(got[0]) == {"room": "12", "colour": "blue", "door": "shut"}
    got = rows(spark, [b"north, 7,wet,late", b"a,b", b"abc"], parsers.delimited(",", ["col1", "col2", "col3"]))
    assert [fields(g) for g in got] == [{"col1": "north", "col2": "7", "col3": "wet"}, {"col1": "a", "col2": "b"}, {}]
    assert got[2]["status"] == "Unsupported"


DECISIONS = [
    (b"", "Abstained", None, "EmptyInput"),
    (b'{"a":1}', "Recognized", "json-flat", None),
    (b'{"host":"quay","level":', "Recognized", "json-flat", None),
    (b"CEF:0|a|b|c|d|e|f|", "Recognized", "cef", None),
    (b"CEF:1|a|b|c|d|e|f|", "Recognized", "cef", None),
    (b"<34", "Abstained", None, "NoRecognizableStructure"),
    (b"Jan  5 12:34:56 h t: {x}", "Abstained", None, "AmbiguousCandidates"),
    (b"a=1 b=2 c", "Recognized", "generic-kv-space-eq", None),
    (b"a,b,c", "Recognized", "generic-csv-3col", None),
    (b"just words", "Abstained", None, "NoRecognizableStructure"),
]


def test_inference(spark):
    got = rows(spark, [d[0] for d in DECISIONS], lambda b: inference.infer(b, ("json", "cef", "syslog", "kv", "csv")))
    assert [(g["decision"], g["parser_id"], g["reason"]) for g in got] == [d[1:] for d in DECISIONS]


def test_registry():
    registry = parsers.Registry([parsers.JSON])
    registry.register(parsers.CEF)
    assert registry.identity() == [("json-flat", "0.1.0"), ("cef", "0.1.0")] and len(registry) == 2
    with pytest.raises(ValueError):
        registry.register(parsers.JSON)
