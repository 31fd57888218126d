"""Registered queries of the evidence engine and the SQL that computes the same from the source columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.bytesx import event_id
from tracewell.operators import drift, entities, integrity, mapping, parsers
from tracewell.operators.framing import frame_errors, frames
from tracewell.plans import replay as R
from tracewell.plans import views
from tracewell.plans.render import SQL, lines
from tracewell.session import ship
from tracewell.sources import sinks
from tracewell.sources.evidence import page

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name], ORACLES[name] = run, sql if not sql.lstrip().startswith("@") else f"WITH {SQL} {sql.lstrip()[1:]}"
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw_bytes"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lines(spark, sf_dir)
    return frames(e.select("seq", "event_id", "source", "raw_bytes", "ts"))


def interpreted(spark: SparkSession, sf_dir: str, config: R.PipelineConfig = R.BENCH) -> DataFrame:
    return R.interpret(_records(spark, sf_dir), config).withColumn("interpretation_id", R.interpretation_id(F.col("event_id"), config)).withColumn("config_hash", F.lit(config.identity()))


# Framing

_TEXT = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@_query("q_frames_documents", f"""
SELECT doc_id, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS n_frames,
  CAST(strlen(text) - strlen(string_split(text, chr(10))[-1]) - (len(string_split(text, chr(10))) - 1) AS BIGINT) AS frame_bytes
FROM ({_TEXT}) WHERE contains(text, chr(10))""")  # fmt: skip
def _(spark, sf_dir):
    return frames(_documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_frames"), F.sum(F.octet_length("frame_bytes")).alias("frame_bytes"))


@_query("q_frame_errors", f"""
SELECT doc_id, 'Incomplete' AS kind, strlen(string_split(text, chr(10))[-1]) || ' bytes without a line end' AS detail
FROM ({_TEXT}) WHERE strlen(string_split(text, chr(10))[-1]) > 0""")  # fmt: skip
def _(spark, sf_dir):
    return frame_errors(_documents(spark, sf_dir)).select("doc_id", "kind", "detail")


@_query("q_frames_length_prefix", "SELECT user_id, count(*) AS n_frames, CAST(sum(strlen(event_type)) AS BIGINT) AS frame_bytes FROM events GROUP BY user_id")
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("event_type").cast("long")), 8, "0")), F.col("event_type").cast("binary"))
    buffers = e.groupBy("user_id").agg(F.collect_list(one).alias("p")).select("user_id", F.unhex(F.array_join(F.transform("p", F.hex), "")).alias("raw_bytes"))
    return frames(buffers, "LengthPrefixFramer").groupBy("user_id").agg(F.count("*").alias("n_frames"), F.sum(F.octet_length("frame_bytes")).alias("frame_bytes"))


@_query("q_frames_json_objects", "SELECT user_id, count(*) AS n_frames, CAST(sum(strlen(props)) AS BIGINT) AS frame_bytes FROM events WHERE props IS NOT NULL GROUP BY user_id")
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("props is not null")
    buffers = e.groupBy("user_id").agg(F.encode(F.array_join(F.collect_list("props"), " \n"), "UTF-8").alias("raw_bytes"))
    return frames(buffers, "JsonObjectFramer").groupBy("user_id").agg(F.count("*").alias("n_frames"), F.sum(F.octet_length("frame_bytes")).alias("frame_bytes"))


# Identity and lineage


@_query("q_event_ids", "SELECT doc_id, sha256(unhex(printf('%08x', strlen(coalesce(source, '')))) || encode(coalesce(source, '')) || unhex(printf('%016x', doc_id)) || encode(coalesce(text, ''))) AS event_id FROM documents")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", event_id(F.col("source"), F.col("doc_id"), F.col("raw_bytes")).alias("event_id"))


@_query("q_content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", integrity.content_hash(F.col("raw_bytes")).alias("content_hash"))


@_query("q_chain_links", "@SELECT event_id AS seq, eid AS event_id, lag(eid) OVER (ORDER BY event_id) AS previous_link, sha256(line || chr(10)) AS content_hash FROM r")
def _(spark, sf_dir):
    return integrity.linked(lines(spark, sf_dir)).select("seq", "event_id", "previous_link", "content_hash")


@_query("q_chain_verify_tampered", """@, s AS (
  SELECT event_id, eid, CASE WHEN event_id % 997 = 500 THEN 'HashMismatch' WHEN event_id % 991 = 300 THEN 'BrokenLink' END AS bad FROM r)
SELECT event_id AS seq, eid AS event_id,
  coalesce(last_value(bad IGNORE NULLS) OVER w, 'Success') AS status,
  last_value(CASE WHEN bad IS NOT NULL THEN eid END IGNORE NULLS) OVER w AS failed_at
FROM s WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")  # fmt: skip
def _(spark, sf_dir):
    chain = integrity.linked(lines(spark, sf_dir))
    chain = chain.withColumn("raw_bytes", F.when(F.col("seq") % 997 == 500, F.encode(F.lit("tampered"), "UTF-8")).otherwise(F.col("raw_bytes")))
    return integrity.chain_verified(chain.withColumn("previous_link", F.when(F.col("seq") % 991 == 300, F.lit("nowhere")).otherwise(F.col("previous_link"))))


@_query("q_dedup_ingest", "@SELECT source, count(*) AS stored, CAST(2 * count(*) AS BIGINT) AS total FROM r GROUP BY source")
def _(spark, sf_dir):
    e = lines(spark, sf_dir)
    twice = e.unionByName(e.withColumn("seq", F.col("seq") + 1_000_000_000))
    totals = twice.groupBy("source").agg(F.count("*").alias("total"))
    return integrity.deduplicated(twice).groupBy("source").agg(F.count("*").alias("stored")).join(totals, "source").select("source", "stored", "total")


# Parsers


def _fields(spark, sf_dir, number: int, parser: parsers.Parser, names: list[str]) -> DataFrame:
    own = _records(spark, sf_dir).filter(F.col("seq") % 6 == number)
    got = own.select("seq", F.explode(F.array(parser.parse(F.col("frame_bytes")))).alias("p")).filter("p.status = 'Success'")
    ir = got.select("seq", mapping.to_ir(F.lit(parser.id), F.col("p.fields")).alias("m"))
    return ir.select("seq", *[F.try_element_at("m", F.lit(n))["value"].alias(n.replace(".", "_")) for n in names])


@_query("q_parse_json", "@SELECT event_id AS seq, ip AS src_ip, lvl AS level, event_type AS message FROM r WHERE format = 0")
def _(spark, sf_dir):
    return _fields(spark, sf_dir, 0, parsers.JSON, ["src_ip", "level", "message"])


@_query("q_parse_cef", """@SELECT event_id AS seq, '0' AS cef_version, 'Acme' AS cef_device_vendor, CAST(event_id AS VARCHAR) AS cef_signature_id, event_type AS cef_name,
  CAST(event_id % 11 AS VARCHAR) AS cef_severity, ip AS src, 'host' || user_id AS shost FROM r WHERE format = 1""")  # fmt: skip
def _(spark, sf_dir):
    return _fields(spark, sf_dir, 1, parsers.CEF, ["cef.version", "cef.device_vendor", "cef.signature_id", "cef.name", "cef.severity", "src", "shost"])


@_query("q_parse_syslog", """@SELECT event_id AS seq, CAST(event_id % 192 AS VARCHAR) AS syslog_priority, CAST((event_id % 192) // 8 AS VARCHAR) AS syslog_facility, CAST(event_id % 8 AS VARCHAR) AS syslog_severity,
  'Jan ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S') AS syslog_timestamp, 'host' || user_id AS syslog_hostname, 'app' AS syslog_tag, event_type AS syslog_message FROM r WHERE format = 2""")  # fmt: skip
def _(spark, sf_dir):
    return _fields(spark, sf_dir, 2, parsers.SYSLOG_PARSER, ["syslog.priority", "syslog.facility", "syslog.severity", "syslog.timestamp", "syslog.hostname", "syslog.tag", "syslog.message"])


@_query("q_parse_kv", "@SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS user, event_type AS type, CAST(event_id AS VARCHAR) AS id FROM r WHERE format = 3")
def _(spark, sf_dir):
    return _fields(spark, sf_dir, 3, parsers.KV, ["user", "type", "id"])


@_query("q_parse_csv", "@SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS col1, event_type AS col2, CAST(user_id AS VARCHAR) AS col3 FROM r WHERE format = 4")
def _(spark, sf_dir):
    return _fields(spark, sf_dir, 4, parsers.CSV, ["col1", "col2", "col3"])


@_query("q_event_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL")
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("props is not null")
    got = e.select("event_id", F.explode(F.array(parsers.json_flat(F.encode("props", "UTF-8")))).alias("p"))
    return got.select("event_id", F.get(F.filter("p.fields", lambda f: f["name"] == "k"), F.lit(0))["raw_value"].alias("k"))


# Dispatch and inference

_OUTCOME = "CASE format WHEN 0 THEN 'json-flat' WHEN 1 THEN 'cef' WHEN 2 THEN 'syslog-rfc3164' WHEN 3 THEN 'generic-kv-space-eq' WHEN 4 THEN 'generic-csv-3col' END"


@_query("q_dispatch_bench", f"@SELECT {_OUTCOME} AS parser_id, CASE WHEN format = 5 THEN 'Failed' ELSE 'Success' END AS outcome, CASE WHEN format = 5 THEN 'Malformed' END AS error, count(*) AS n FROM r GROUP BY ALL")
def _(spark, sf_dir):
    return interpreted(spark, sf_dir).groupBy("parser_id", F.col("parser_outcome").alias("outcome"), F.col("parser_error").alias("error")).agg(F.count("*").alias("n"))


@_query("q_dispatch_serve", """@SELECT CASE format WHEN 0 THEN 'json-flat' WHEN 2 THEN 'syslog-rfc3164' END AS parser_id, CASE WHEN format IN (0, 2) THEN 'Success' ELSE 'Failed' END AS outcome,
  CASE WHEN format NOT IN (0, 2) THEN 'Malformed' END AS error, count(*) AS n FROM r GROUP BY ALL""")  # fmt: skip
def _(spark, sf_dir):
    return interpreted(spark, sf_dir, R.SERVE).groupBy("parser_id", F.col("parser_outcome").alias("outcome"), F.col("parser_error").alias("error")).agg(F.count("*").alias("n"))


@_query("q_infer_decisions", f"""@SELECT event_id AS seq, CASE WHEN format = 5 THEN 'Abstained' ELSE 'Recognized' END AS decision, {_OUTCOME} AS parser_id,
  CASE WHEN format IN (0, 1, 2) THEN 'High' WHEN format IN (3, 4) THEN 'Medium' END AS confidence, CASE WHEN format = 5 THEN 'NoRecognizableStructure' END AS reason FROM r""")  # fmt: skip
def _(spark, sf_dir):
    from tracewell.operators.inference import infer

    return _records(spark, sf_dir).select("seq", F.explode(F.array(infer(F.col("frame_bytes"), R.BENCH.detectors))).alias("i")).select("seq", "i.decision", "i.parser_id", "i.confidence", "i.reason")


@_query("q_infer_documents", """SELECT CASE WHEN text IS NULL OR text = '' THEN 'EmptyInput' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY ALL""")
def _(spark, sf_dir):
    from tracewell.operators.inference import infer

    got = _documents(spark, sf_dir).select(F.explode(F.array(infer(F.col("raw_bytes"), R.BENCH.detectors))).alias("i"))
    return got.groupBy(F.when(F.col("i.reason") == "EmptyInput", "EmptyInput").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


# Mapping

_SEVERITY = """CASE format
  WHEN 0 THEN ['Info', 'Warning', 'Error', 'Debug', 'Critical'][event_id % 5 + 1]
  WHEN 1 THEN CASE WHEN event_id % 11 <= 3 THEN 'Info' WHEN event_id % 11 <= 6 THEN 'Warning' WHEN event_id % 11 <= 8 THEN 'Error' ELSE 'Critical' END
  WHEN 2 THEN ['Emergency', 'Alert', 'Critical', 'Error', 'Warning', 'Notice', 'Info', 'Debug'][event_id % 8 + 1] END"""


@_query("q_canonical_wide", f"""@SELECT event_id AS seq, {_SEVERITY} AS severity, CASE WHEN format IN (0, 1) THEN ip END AS source_ip,
  CASE WHEN format IN (1, 2) THEN 'host' || user_id END AS source_hostname, event_type AS message,
  CASE format WHEN 0 THEN 'Heuristic' WHEN 1 THEN 'Probable' ELSE 'Certain' END AS message_confidence FROM r WHERE format < 3""")  # fmt: skip
def _(spark, sf_dir):
    c = interpreted(spark, sf_dir).filter("canonical is not null")
    return c.select("seq", F.col("canonical.severity.value").alias("severity"), F.col("canonical.source_ip.value").alias("source_ip"), F.col("canonical.source_hostname.value").alias("source_hostname"), F.col("canonical.message.value").alias("message"), F.col("canonical.message.confidence").alias("message_confidence"))


@_query("q_severity_counts", f"@SELECT {_SEVERITY} AS severity, count(*) AS n FROM r WHERE format < 3 GROUP BY ALL")
def severity_counts(spark, sf_dir):
    return interpreted(spark, sf_dir).filter("canonical is not null").groupBy(F.col("canonical.severity.value").alias("severity")).agg(F.count("*").alias("n"))


@_query("q_abstentions", """SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'source_ip' WHEN event_id % 3 = 1 THEN 'severity' ELSE 'message' END AS target,
  CASE WHEN event_id % 3 = 0 THEN 'Ambiguous' WHEN event_id % 3 = 1 THEN 'TypeMismatch' ELSE 'InsufficientEvidence' END AS reason FROM events""")  # fmt: skip
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    line = F.when(n % 3 == 0, '{"src":"10.0.0.1","client":"10.0.0.2"}').when(n % 3 == 1, '{"level":"loud"}').otherwise('{"msg":" "}')
    got = R.interpret(e.select(n.alias("seq"), F.encode(line, "UTF-8").alias("frame_bytes")), R.BENCH)
    return got.select("seq", F.explode("canonical.abstentions").alias("a")).select("seq", "a.target", "a.reason")


@_query("q_unmapped_keys", """@, k AS (SELECT unnest(CASE format
  WHEN 1 THEN ['cef.version', 'cef.device_vendor', 'cef.device_product', 'cef.device_version', 'cef.signature_id']
  WHEN 2 THEN ['syslog.priority', 'syslog.facility', 'syslog.tag'] END) AS name FROM r WHERE format IN (1, 2))
SELECT name, count(*) AS n FROM k GROUP BY name""")  # fmt: skip
def _(spark, sf_dir):
    return interpreted(spark, sf_dir).filter("canonical is not null").select(F.explode(F.map_keys("canonical.unmapped")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@_query("q_provenance_slices", "@SELECT event_id AS seq, event_type AS message FROM r WHERE format < 3")
def _(spark, sf_dir):
    m = F.col("canonical.message")
    cut = F.substring(F.col("frame_bytes"), m["start"] + 1, m["end"] - m["start"]).cast("string")
    return interpreted(spark, sf_dir).filter("canonical is not null").select("seq", cut.alias("message"))


# Interpretations

_ID = f"sha256(unhex(printf('%08x', strlen(eid))) || encode(eid) || unhex('{R.BENCH.serialized().hex()}'))"


@_query("q_interpretation_ids", f"@SELECT event_id AS seq, {_ID} AS interpretation_id FROM r")
def _(spark, sf_dir):
    return lines(spark, sf_dir).select("seq", R.interpretation_id(F.col("event_id"), R.BENCH).alias("interpretation_id"))


@_query("q_config_diff", """@, f AS (
  SELECT eid, unnest(CASE format WHEN 0 THEN ['source_ip', 'severity', 'message'] END) AS field,
    unnest(CASE format WHEN 0 THEN [ip, ['Info', 'Warning', 'Error', 'Debug', 'Critical'][event_id % 5 + 1], event_type] END) AS old_value
  FROM r WHERE format = 0)
SELECT eid AS event_id, field, old_value, CAST(NULL AS VARCHAR) AS new_value FROM f""")  # fmt: skip
def _(spark, sf_dir):
    other = R.PipelineConfig((parsers.CEF, parsers.SYSLOG_PARSER), ("cef", "syslog"), "bench")
    return R.field_diff(interpreted(spark, sf_dir), interpreted(spark, sf_dir, other)).select("event_id", "field", "old_value", "new_value")


@_query("q_frame_diff", "@SELECT change, count(*) AS n FROM (SELECT unnest(CASE WHEN event_id % 10 = 0 THEN ['removed', 'added'] ELSE ['same'] END) AS change FROM r) GROUP BY change")
def _(spark, sf_dir):
    old = _records(spark, sf_dir)
    new = old.withColumn("frame_bytes", F.when(F.col("seq") % 10 == 0, F.encode(F.lit("changed"), "UTF-8")).otherwise(F.col("frame_bytes")))
    return R.frame_diff(old, new).groupBy("change").agg(F.count("*").alias("n"))


@_query("q_columnar_export", f"""@SELECT eid AS source_event_id, {_ID} AS interpretation_id, CAST(0 AS INTEGER) AS frame_index, hex(encode(line)) AS frame_hex, {_OUTCOME} AS parser_id, true AS integrity_verified, CAST(7 AS BIGINT) AS created_at_secs FROM r""")
def _(spark, sf_dir):
    return sinks.columnar(interpreted(spark, sf_dir), True, 7).withColumn("frame_bytes", F.hex("frame_bytes")).withColumnRenamed("frame_bytes", "frame_hex")


@_query("q_document_projection", f"@SELECT {_ID} || '_0' AS _id, event_type AS message, {_SEVERITY} AS severity FROM r WHERE format < 3")
def _(spark, sf_dir):
    docs = sinks.documents(interpreted(spark, sf_dir).filter("canonical is not null"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return docs.select("_id", F.get_json_object("document", "$.canonical.message").alias("message"), F.get_json_object("document", "$.canonical.severity").alias("severity"))


@_query("q_list_page", "@SELECT event_id AS seq, eid AS event_id, source FROM r ORDER BY seq LIMIT 50 OFFSET 100")
def _(spark, sf_dir):
    chain = lines(spark, sf_dir).withColumns({"size_bytes": F.octet_length("raw_bytes"), "content_hash": F.lit(""), "previous_link": F.lit("")})
    return page(chain, 50, 100).select("seq", "event_id", "source")


@_query("q_evidence_lookup", "@SELECT source, base64(encode(line || chr(10))) AS payload, CAST(strlen(line) + 1 AS BIGINT) AS size_bytes FROM r WHERE eid = (SELECT eid FROM r WHERE event_id = 42)")
def _(spark, sf_dir):
    e = lines(spark, sf_dir)
    wanted = e.filter("seq = 42").select(F.col("event_id").alias("wanted"))
    return e.join(F.broadcast(wanted), F.col("event_id") == F.col("wanted"), "left_semi").select("source", F.base64("raw_bytes").alias("payload"), F.octet_length("raw_bytes").cast("long").alias("size_bytes"))


# What is shown: documents with an odd id get a byte in front that no UTF-8 text has


@_query("q_shown_bytes", f"""
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text
  ELSE rtrim('ff ' || regexp_replace(lower(hex(encode(text))), '(..)', '\\1 ', 'g')) END) AS shown_sha256 FROM ({_TEXT})""")  # fmt: skip
def _(spark, sf_dir):
    data = F.when(F.col("doc_id") % 2 == 0, F.col("raw_bytes")).otherwise(F.concat(F.unhex(F.lit("ff")), "raw_bytes"))
    return _documents(spark, sf_dir).select("doc_id", F.sha2(views.shown(data), 256).alias("shown_sha256"))


@_query("q_percentiles", """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, v[n * 50 // 100 + 1] AS p50, v[n * 95 // 100 + 1] AS p95, v[n * 99 // 100 + 1] AS p99 FROM s""")
def _(spark, sf_dir):
    return views.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value"), ["event_type"], "value")


# Entities

_EDGES = """, e AS (
  SELECT event_id, eid, 'IPv4' AS entity_type, ip AS entity_value, 'SourceIp' AS role FROM r WHERE format IN (0, 1)
  UNION ALL SELECT event_id, eid, 'Hostname', 'host' || user_id, 'SourceHostname' FROM r WHERE format IN (1, 2))"""


@_query("q_entity_edges", f"@{_EDGES} SELECT eid AS event_id, entity_type, entity_value, role FROM e")
def _(spark, sf_dir):
    return entities.edges(interpreted(spark, sf_dir)).select("event_id", "entity_type", "entity_value", "role")


@_query("q_entity_lookup", f"@SELECT DISTINCT {_ID} AS interpretation_id FROM r WHERE format IN (0, 1) AND ip = '10.0.0.7'")
def _(spark, sf_dir):
    return entities.lookup(entities.edges(interpreted(spark, sf_dir)), "ip", " 10.0.0.7 ")


@_query("q_entity_degree", f"@{_EDGES} SELECT entity_type, entity_value, count(DISTINCT eid) AS degree FROM e GROUP BY ALL")
def _(spark, sf_dir):
    return entities.edges(interpreted(spark, sf_dir)).groupBy("entity_type", "entity_value").agg(F.countDistinct("event_id").alias("degree"))


# Drift: the first against the second half of January; events of type "error" have no JSON lines in the second.

_DRIFT = f""", c AS (SELECT *, {_SEVERITY} AS severity, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'old' ELSE 'new' END AS half FROM r WHERE format < 3),
o AS (
  SELECT half, 'total' AS dimension, '' AS field, 'events' AS key FROM c
  UNION ALL SELECT half, 'format', '', CASE format WHEN 0 THEN 'json-flat' WHEN 1 THEN 'cef' ELSE 'syslog-rfc3164' END FROM c
  UNION ALL SELECT half, 'structural', '', unnest(CASE format WHEN 0 THEN ['src_ip', 'level', 'message']
      WHEN 1 THEN ['cef.version', 'cef.device_vendor', 'cef.device_product', 'cef.device_version', 'cef.signature_id', 'src', 'shost', 'cef.name', 'cef.severity']
      ELSE ['syslog.priority', 'syslog.facility', 'syslog.tag', 'syslog.hostname', 'syslog.message', 'syslog.severity'] END) FROM c
  UNION ALL SELECT half, 'schema', '', unnest(CASE format WHEN 0 THEN ['source_ip', 'severity', 'message'] WHEN 1 THEN ['source_ip', 'source_hostname', 'severity', 'message'] ELSE ['source_hostname', 'severity', 'message'] END) FROM c
  UNION ALL SELECT half, 'semantic', '', unnest(CASE format WHEN 0 THEN ['src_ip->source_ip', 'level->severity', 'message->message']
      WHEN 1 THEN ['src->source_ip', 'shost->source_hostname', 'cef.severity->severity', 'cef.name->message']
      ELSE ['syslog.hostname->source_hostname', 'syslog.severity->severity', 'syslog.message->message'] END) FROM c
  UNION ALL SELECT half, 'vocabulary', 'severity', severity FROM c)"""


@_query("q_drift_profile", f"@{_DRIFT} SELECT half, dimension, field, key, count(*) AS cnt FROM o GROUP BY ALL")
def _(spark, sf_dir):
    half = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "old").otherwise("new")
    return drift.profile(interpreted(spark, sf_dir).withColumn("half", half), ["half"], "seq").withColumn("field", F.coalesce("field", F.lit("")))


@_query("q_drift_detect", f"""@{_DRIFT}, p AS (
  SELECT * FROM o WHERE half = 'old' UNION ALL SELECT * FROM o WHERE half = 'new' AND key NOT IN ('json-flat', 'Debug')
  UNION ALL SELECT half, dimension, field, key || '!' FROM o WHERE half = 'new' AND dimension = 'schema' AND key = 'source_ip'),
n AS (SELECT half, dimension, field, key, count(*) AS cnt FROM p GROUP BY ALL),
s AS (SELECT *, cnt / CASE dimension WHEN 'vocabulary' THEN sum(cnt) OVER (PARTITION BY half, dimension) ELSE (SELECT t.cnt FROM n t WHERE t.half = n.half AND t.dimension = 'total') END AS share FROM n),
j AS (SELECT coalesce(a.dimension, b.dimension) AS dimension, coalesce(a.field, b.field) AS field, coalesce(a.key, b.key) AS item, a.share AS x, b.share AS y, a.cnt AS m, b.cnt AS k
  FROM (SELECT * FROM s WHERE half = 'old') a FULL OUTER JOIN (SELECT * FROM s WHERE half = 'new') b ON a.dimension = b.dimension AND a.field = b.field AND a.key = b.key)
SELECT dimension, field, item, CASE WHEN x IS NULL THEN 'Added' WHEN y IS NULL THEN 'Removed' ELSE 'FrequencyChanged' END AS drift_type
FROM j WHERE dimension <> 'total' AND (x IS NULL OR y IS NULL OR abs(y - x) >= 0.15)
UNION ALL SELECT 'volume', '', 'events', 'VolumeChanged' FROM j WHERE dimension = 'total' AND abs(k - m) / m >= 0.5""")  # fmt: skip
def _(spark, sf_dir):
    half = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "old").otherwise("new")
    p = drift.profile(interpreted(spark, sf_dir).withColumn("half", half), ["half"], "seq")
    changed = F.when((F.col("half") == "new") & F.col("key").isin("json-flat", "Debug"), F.array().cast("array<string>"))
    changed = changed.when((F.col("half") == "new") & (F.col("dimension") == "schema") & (F.col("key") == "source_ip"), F.array("key", F.concat("key", F.lit("!"))))
    p = p.withColumn("key", F.explode(changed.otherwise(F.array("key"))))
    return drift.compare(p, "half").select("dimension", "field", "item", "drift_type")


@_query("q_accuracy", f"@SELECT CAST(count(*) FILTER (format < 5) AS BIGINT) AS detection_correct, CAST(count(*) FILTER (format = 5) AS BIGINT) AS correct_abstentions, CAST(0 AS BIGINT) AS false_attributions, CAST(count(*) FILTER (format IN (3, 4)) AS BIGINT) AS onboarded FROM r")
def _(spark, sf_dir):
    want = F.element_at(F.array(*[F.lit(x) for x in ("json-flat", "cef", "syslog-rfc3164", "generic-kv-space-eq", "generic-csv-3col")]), (F.col("seq") % 6 + 1).cast("int"))
    c = interpreted(spark, sf_dir).select("parser_id", "inference", F.when(F.col("seq") % 6 < 5, want).alias("want"))
    n = lambda x: F.count(F.when(x, 1)).alias
    return c.agg(
        n(F.col("parser_id") == F.col("want"))("detection_correct"), n(F.col("want").isNull() & F.col("parser_id").isNull())("correct_abstentions"),
        n(F.col("parser_id").isNotNull() & ~F.col("parser_id").eqNullSafe(F.col("want")))("false_attributions"), n(F.col("parser_id").startswith("generic-"))("onboarded"),
    )
