"""Telemetry lines rendered from the ``events`` table: six formats by event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.bytesx import event_id

#: The same rendering as SQL, for oracles: (event_id, user_id, event_type, ts, format, source, ip, lvl, line, eid).
SQL = r"""
r0 AS (
  SELECT event_id, user_id, event_type, ts, event_id % 6 AS format, 'app-' || (event_id % 6) AS source,
    '10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS ip,
    ['info', 'warn', 'error', 'debug', 'critical'][event_id % 5 + 1] AS lvl
  FROM events),
r1 AS (
  SELECT *, CASE format
    WHEN 0 THEN '{"src_ip":"' || ip || '","level":"' || lvl || '","message":"' || event_type || '"}'
    WHEN 1 THEN 'CEF:0|Acme|App|1.0|' || event_id || '|' || event_type || '|' || (event_id % 11) || '|src=' || ip || ' shost=host' || user_id
    WHEN 2 THEN '<' || (event_id % 192) || '>Jan ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S') || ' host' || user_id || ' app: ' || event_type
    WHEN 3 THEN 'user=' || user_id || ' type=' || event_type || ' id=' || event_id
    WHEN 4 THEN event_id || ',' || event_type || ',' || user_id
    ELSE 'note ' || event_type || ' by user ' || user_id END AS line
  FROM r0),
r AS (
  SELECT *, sha256(unhex(printf('%08x', strlen(source))) || encode(source) || unhex(printf('%016x', event_id)) || encode(line || chr(10))) AS eid
  FROM r1)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_id, source, raw_bytes, ts): one record for each event; seq is the event's number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ip = F.concat(F.lit("10.0."), (F.floor(u / 256) % 256).cast("string"), F.lit("."), (u % 256).cast("string"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("info", "warn", "error", "debug", "critical")]), (n % 5 + 1).cast("int"))
    day = F.lpad(F.dayofmonth("ts").cast("string"), 2, " ")
    line = (
        F.when(n % 6 == 0, F.concat(F.lit('{"src_ip":"'), ip, F.lit('","level":"'), level, F.lit('","message":"'), t, F.lit('"}')))
        .when(n % 6 == 1, F.concat(F.lit("CEF:0|Acme|App|1.0|"), n, F.lit("|"), t, F.lit("|"), n % 11, F.lit("|src="), ip, F.lit(" shost=host"), u))
        .when(n % 6 == 2, F.concat(F.lit("<"), n % 192, F.lit(">Jan "), day, F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.lit(" host"), u, F.lit(" app: "), t))
        .when(n % 6 == 3, F.concat(F.lit("user="), u, F.lit(" type="), t, F.lit(" id="), n))
        .when(n % 6 == 4, F.concat(n, F.lit(","), t, F.lit(","), u))
        .otherwise(F.concat(F.lit("note "), t, F.lit(" by user "), u))
    )
    source, raw = F.concat(F.lit("app-"), (n % 6).cast("string")), F.encode(F.concat(line, F.lit("\n")), "UTF-8")
    return e.select(n.cast("long").alias("seq"), event_id(source, n, raw).alias("event_id"), source.alias("source"), raw.alias("raw_bytes"), "ts")
