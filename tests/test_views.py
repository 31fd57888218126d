"""What is shown of events, fixtures and results, and the store in memory."""

import base64
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.plans import queries, views
from tracewell.plans import replay as R
from tracewell.sources.evidence import MemoryStore, ingest, read_buffer
from tracewell.sources.sinks import Objects

LINES = b'{"src":"10.3.0.9","level":"warn"}\nplain words\n'


def test_memory_store_and_views(spark):
    store = MemoryStore(spark)
    assert ingest(spark, read_buffer(spark, LINES, "here"), store) == {"total": 2, "stored": 2}
    assert ingest(spark, read_buffer(spark, LINES, "here"), store)["stored"] == 0
    more = ingest(spark, read_buffer(spark, b"third\n", "there"), store)
    assert more == {"total": 1, "stored": 1} and [r["seq"] for r in store.events().collect()] == [0, 1, 2]
    first, _, last = views.event_view(store.table().orderBy("seq")).collect()
    assert base64.b64decode(first["payload_base64"]) == LINES[:34] and first["size_bytes"] == 34  # an event's bytes include its line end
    assert len(first["integrity"]["hash_hex"]) == 64 and first["integrity"]["previous_link"] is None and last["integrity"]["previous_link"]
    assert views.summary_view(store.table()).filter("has_integrity").count() == 3
    found = views.frame_view(R.replay(store.table(), R.BENCH)).collect()
    mapped = [json.loads(r["canonical"]) for r in found if r["canonical"]]
    assert any("source_ip" in m for m in mapped) and all("unmapped" not in m and "abstentions" not in m for m in mapped)


def test_bytes_and_confidence(spark):
    rows = spark.createDataFrame([(bytearray("é ok".encode()),), (bytearray(b"\xff\x00a"),), (bytearray(),), (None,)], "b binary")
    assert [r[0] for r in rows.select(views.shown(F.col("b"))).collect()] == ["é ok", "ff 00 61", "", ""]
    levels = spark.createDataFrame([("High",), ("CERTAIN",), ("probable",), ("heuristic",), ("none",), (None,)], "level string")
    assert [r[0] for r in levels.select(views.percentage(F.col("level"))).collect()] == [95, 95, 60, 25, 0, 0]


@pytest.mark.parametrize("name", ["q_shown_bytes", "q_percentiles"])
def test_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "events"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_percentiles_of_nothing_and_ties(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 5)], "k string, v int")
    got = {r["k"]: (r["p50"], r["p99"]) for r in views.percentiles(rows, ["k"], "v").collect()}
    assert got == {"a": (1, 2), None: (5, 5)} and views.percentiles(rows.limit(0), ["k"], "v").count() == 0


def test_fixtures_and_results(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.json").write_bytes(b'\xef\xbb\xbf{"a": 1}')
    (tmp_path / "in" / "deep" / "two.json").write_bytes(b'{"a": 2}')
    (tmp_path / "in" / "other.txt").write_bytes(b"no")
    assert sorted(json.loads(r["fixture"])["a"] for r in views.fixtures(spark, str(tmp_path / "in")).collect()) == [1, 2]
    views.put_results(spark, str(tmp_path / "out"), "results.json", {"p50": 3, "rate": 1.5})
    assert json.loads(Objects(spark, str(tmp_path / "out")).get("results.json")) == {"p50": 3, "rate": 1.5}
    with pytest.raises(ValueError):
        views.put_results(spark, str(tmp_path / "out"), "bad.json", {"rate": float("nan")})
