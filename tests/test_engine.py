"""Store, replay, lookups, onboarding, sinks and streaming end to end on small inputs."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import entities, integrity, onboarding, parsers
from tracewell.plans import replay as R
from tracewell.sources import sinks
from tracewell.sources.evidence import Store, decode_requests, ingest, read_buffer
from tracewell.streaming.ingest import KafkaConfig, start

LINES = b'{"src":"10.1.1.5"}\n{"source_ip":"10.1.1.5","level":"error"}\n{"client":"10.1.1.5"}\n{"note":"10.1.1.5"}\n'


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = Store(spark, str(tmp_path_factory.mktemp("store") / "evidence"))
    assert ingest(spark, read_buffer(spark, LINES, "app"), out) == {"total": 4, "stored": 4}
    return out


def test_duplicates_and_errors(spark, store):
    assert ingest(spark, read_buffer(spark, LINES, "app"), store)["stored"] == 0
    with pytest.raises(ValueError):
        ingest(spark, read_buffer(spark, b"no line end", "app"), store)
    assert store.events(limit=2, offset=1).count() == 2
    first = store.events(limit=1).first()["event_id"]
    assert store.retrieve(first).count() == 1 and store.retrieve("none").count() == 0


def test_chain(spark, store):
    evidence = store.table()
    assert {r["status"] for r in integrity.chain_verified(evidence).collect()} == {"Success"}
    bad = evidence.withColumn("raw_bytes", F.when(F.col("seq") == 1, F.lit(bytearray(b"x"))).otherwise(F.col("raw_bytes")))
    assert [r["status"] for r in integrity.chain_verified(bad).orderBy("seq").collect()] == ["Success", "HashMismatch", "HashMismatch", "HashMismatch"]
    head = evidence.orderBy(F.col("seq").desc()).first()["event_id"]
    assert integrity.walked(evidence, head).count() == 4
    assert R.replay(bad, R.BENCH, integrity.chain_verified(bad)).count() == 1


def test_replay_and_entities(spark, store):
    frames = R.replay(store.table(), R.BENCH)
    edges = entities.edges(frames)
    assert entities.lookup(edges, "ip", "10.1.1.5").count() == 3
    assert R.field_diff(frames, frames).count() == 0
    with pytest.raises(R.ConfigError):
        R.requested(("NewlineFramer", "1.0.0"), ("other", "1"), [], [])
    got = spark.createDataFrame([("2001:DB8::1",), ("fe80::1%eth0",), ("010.0.0.1",), (None,)], "a string").select(entities.normalized("ip", F.col("a")).alias("n"))
    assert [r["n"] for r in got.collect()] == ["2001:db8::1", None, None, None]


def test_relational_and_documents(spark, store, tmp_path):
    frames = R.replay(store.table(), R.BENCH)
    tables = sinks.Relational(spark, str(tmp_path / "tables"))
    for _ in range(2):
        tables.save(frames, entities.edges(frames))
    assert tables.table("frames").count() == 4 and tables.by_entity("IPv4", "10.1.1.5").count() == 3
    assert tables.exists(frames.first()["interpretation_id"]) and not tables.exists("none")
    docs = sinks.documents(frames, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert docs.count() == 4 and sinks.bulk_lines(docs, "logs").first()["value"].startswith('{"index":{"_index":"logs"')
    for bad in ("Upper", "a*b", "", "_x"):
        with pytest.raises(ValueError):
            sinks.index_name(bad)
    for answer in ((500, "{}"), (200, ""), (200, "x"), (200, '{"errors":true}')):
        with pytest.raises(OSError):
            sinks.bulk_outcome(*answer)
    objects = sinks.Objects(spark, str(tmp_path / "objects"))
    objects.put("a/b", b"1")
    objects.put("a/b", b"2")
    assert objects.get("a/b") == b"2"
    for key in ("../x", "/x", ""):
        with pytest.raises(ValueError):
            objects.put(key, b"")
    with pytest.raises(KeyError):
        objects.get("none")


def test_requests(spark):
    got = decode_requests(spark.createDataFrame([("s", "aGkK", "no"), ("s", None, "hi\n"), ("s", None, None), ("s", None, "")], "source_name string, evidence_base64 string, evidence_text string")).collect()
    assert [(bytes(r["raw_bytes"]) if r["raw_bytes"] is not None else None, r["error"]) for r in got] == [(b"hi\n", None), (b"hi\n", None), (None, "no evidence"), (b"", "empty evidence")]


def test_onboarding(spark):
    spec = onboarding.spec_for("Recognized", "generic-kv-space-eq")
    parser = spec.build()
    suite = onboarding.LabSuite([b"msg=hello"], [(b"msg=hello", ["msg", "message"])], [(b"msg=hello", [("msg", "hello")])], [b"nothing"], [b"msg=hello"], [b"\0=\1"], [b"msg=hello"])
    assert [k for k, ok in onboarding.evaluate(spark, parser, suite).items() if not ok] == ["semantic"]  # it has no mapping rules of its own
    report = onboarding.evaluate(spark, parser, suite, mapped_as="json-flat")
    assert all(report.values())
    registry = parsers.Registry()
    assert onboarding.Candidate(parser, report).approve(registry).stage == "Approved" and len(registry) == 1
    assert [k for k, ok in onboarding.evaluate(spark, parser, onboarding.LabSuite()).items() if ok] == ["security"]  # its inputs are its own
    lines = onboarding.spec_for("Recognized", "generic-csv-3col").build()
    want = [("col1", "a"), ("col2", "b"), ("col3", "c")]
    report = onboarding.evaluate(spark, lines, onboarding.LabSuite(golden=[(b"a,b,c", want)]))
    assert report["golden"] and report["mutation"] and not report["semantic"]
    many = b" ".join(b"k%d=v" % i for i in range(1500))
    report = onboarding.evaluate(spark, parser, onboarding.LabSuite(negative=[many], semantic=[(b"msg=hello", ["message_id"])]), mapped_as="json-flat")
    assert not report["negative"] and not report["semantic"]  # a limit is no refusal
    for bad in (dict(kind="key_value", separator="", pair_separator=" "), dict(kind="delimited", separator="\t", names=("a",)), dict(kind="delimited", separator=",", names=("a", " a")), dict(kind="key_value", separator="=", pair_separator="=")):
        with pytest.raises(onboarding.SpecError):
            onboarding.ParserSpec("x", "1", **bad).validate()
    with pytest.raises(onboarding.SpecError):
        onboarding.spec_for("Abstained", None)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("k", bytearray(b"hello\nworld\n")), ("k", bytearray(b"broken"))], "source string, raw_bytes binary").write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "evidence"))
    for _ in range(2):
        payloads = spark.readStream.schema("source string, raw_bytes binary").parquet(str(tmp_path / "in"))
        start(payloads, store, str(tmp_path / "bad"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert store.table().count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert KafkaConfig().options()["startingOffsets"] == "latest"
