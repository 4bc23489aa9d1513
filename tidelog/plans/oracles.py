"""SQL for DuckDB that gives the rows of the registered queries, by name."""

from __future__ import annotations

from tidelog.operators.routing import ring
from tidelog.plans.queries import _LIMITS, SHARDS

_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({k}, ''), lambda c: ascii(c)::HUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""

#: The CRC-32 table by its rule, and the CRC of an ASCII text.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n))"""
_CRC = """lpad(lower(to_hex(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({k}, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT))), 8, '0')"""

_REC = f"""keys AS (SELECT user_id, {_FNV.format(k="'user-' || user_id")} AS hash FROM (SELECT DISTINCT user_id FROM events)),
rec AS (
  SELECT e.*, hash, CAST(hash % {SHARDS} AS INTEGER) AS shard, row_number() OVER (PARTITION BY hash % {SHARDS} ORDER BY event_id) - 1 AS sequence,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
    'agent-' || (user_id % 5) AS agent_id, event_type AS source_id, event_id AS source_offset, props AS payload
  FROM events e JOIN keys USING (user_id))"""
_WITH = f"WITH {_REC}\n"
_SHOWN = "shard, sequence, timestamp, level, payload, agent_id, source_id, source_offset"

_META = "'ts=' || timestamp || chr(9) || 'shard=' || shard || chr(9) || 'seq=' || sequence || chr(9) || 'level=' || level"
_LINES = f"""{_CRC_TABLE}, body AS (SELECT *, {_META} AS meta, {_META} || chr(9) || 'payload=' || payload AS body FROM rec),
full_lines AS (SELECT body.*, 'crc=' || {_CRC.format(k='body')} || chr(9) || body AS line FROM body, crc_table)"""

_SEGMENTS = """placed AS (
  SELECT shard || '.' || (sequence // 500) AS seg_path, sequence % 500 AS line_no, sequence, octet_length(encode(line)) + 1 AS size,
         sequence % 997 = 300 AS bad FROM full_lines),
cut AS (SELECT *, min(line_no) FILTER (bad) OVER (PARTITION BY seg_path) AS first_bad FROM placed)"""

#: Files of 500 lines; a checksum of its class adds so many bytes to a line; damage shows where there is one.
_STORED = f"""sized AS (
  SELECT *, sequence // 500 AS block, max(sequence // 500) OVER (PARTITION BY shard) AS last, sequence % 997 = 300 AND shard < 3 AS bad,
    octet_length(encode({_META} || chr(9) || 'payload=' || payload)) + 1 + CASE shard WHEN 0 THEN 13 WHEN 1 THEN 15 WHEN 2 THEN 32 ELSE 0 END AS size FROM rec),
stored AS (
  SELECT *, block <> last AS archived, CASE WHEN block = last THEN 'shard-' || shard || '.log'
    ELSE 'shard-' || shard || '.' || (block + 1000) || '.0.log' || CASE WHEN block % 2 = 0 THEN '.gz' ELSE '' END END AS file,
    min(sequence) FILTER (bad) OVER (PARTITION BY shard, block) AS first_bad FROM sized),
intact AS (SELECT * FROM stored WHERE first_bad IS NULL OR sequence < first_bad)"""
_INTACT = "shard, sequence, timestamp, level, payload, archived, file"

_FILES = """stems AS (
  SELECT *, '/var/log/shard-' || (o_custkey % 4) AS stem, '.' || (1000 + o_custkey % 50) || '.' || (o_orderkey % 9) AS stamp FROM orders),
files AS (
  SELECT DISTINCT CASE WHEN o_orderkey % 11 = 0 THEN stem || '.log' WHEN o_orderkey % 13 = 0 THEN stem || '.log.gz' WHEN o_orderkey % 17 = 0 THEN stem || 'x.log'
    WHEN o_orderstatus = 'F' THEN stem || stamp || '.log.gz' ELSE stem || stamp || '.log' END AS path FROM stems),
seg AS (
  SELECT path, CAST(regexp_extract(path, 'shard-([0-9]+)', 1) AS BIGINT) AS shard_id, regexp_matches(path, 'shard-[0-9]+[.][0-9]') AS archived, path LIKE '%.gz' AS compressed,
    coalesce(TRY_CAST(regexp_extract(path, 'shard-[0-9]+[.]([0-9]+)[.]', 1) AS BIGINT), 0) AS timestamp_ms,
    coalesce(TRY_CAST(regexp_extract(path, 'shard-[0-9]+[.][0-9]+[.]([0-9]+)[.]', 1) AS BIGINT), 0) AS rotation_index
  FROM files WHERE regexp_matches(path, '/shard-[0-9]+([.][0-9]+[.][0-9]+)?[.]log([.]gz)?$') AND NOT (path LIKE '%.gz' AND NOT regexp_matches(path, 'shard-[0-9]+[.][0-9]'))),
single AS (
  SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY shard_id, archived, timestamp_ms, rotation_index ORDER BY compressed, path) = 1)"""

_JS = "replace(replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
_Q = "('\"' || " + _JS + " || '\"')"


def _batches(size: int) -> str:
    return f"""batches AS (
  SELECT shard, CAST(sequence // {size} AS BIGINT) AS batch_no, min(sequence) AS first_sequence, max(sequence) + 1 AS next_sequence,
    count(*) AS n, string_agg(payload, chr(10) ORDER BY sequence) AS records, list(payload ORDER BY sequence) AS items
  FROM rec GROUP BY shard, sequence // {size})"""


def _delivery(agent: str) -> str:
    item = "'{\"sequence\":' || (first_sequence + i - 1) || ',\"message\":' || " + _Q.format(x="x") + " || '}'"
    return (
        "'{\"agent_id\":\"" + agent + "\",\"shard\":' || shard || ',\"first_sequence\":' || first_sequence || ',\"next_sequence\":' || next_sequence || ',\"records\":[' || "
        "array_to_string(list_transform(items, lambda x, i: " + item + "), ',') || ']}'"
    )


_OFFSETS = """offsets AS (
  SELECT r_regionkey AS shard, CASE WHEN r_regionkey IN (0, 3, 4) THEN r_regionkey * 4 + 11 ELSE r_regionkey * 12 + 7 END::BIGINT AS next_sequence FROM region)"""
_MINUTES = "m AS (SELECT event_type, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY ALL)"
_HEALTH = f"""{_MINUTES}, w AS (
  SELECT event_type, minute, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY minute RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent,
    CAST(sum(n) OVER (PARTITION BY event_type ORDER BY minute ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lifetime FROM m)"""
_COUNTERS = """c AS (
  SELECT event_id, CASE WHEN user_id % 31 = 0 THEN 1 ELSE 0 END AS ck, CASE WHEN user_id % 37 = 0 THEN 1 ELSE 0 END AS ga, user_id % 6 AS rf, user_id % 5 AS ge,
    user_id % 13 AS cs, user_id % 2 AS cl FROM events)"""
_PRESSURE = f"""bp AS (
  SELECT event_id, user_id, CASE WHEN user_id % 100 >= {_LIMITS['disk_quota']} THEN 'disk_quota' WHEN user_id % 70 >= {_LIMITS['pending_bytes']} THEN 'pending_bytes'
    WHEN user_id % 43 >= {_LIMITS['sink_backlog']} THEN 'sink_backlog' WHEN user_id % 11 >= {_LIMITS['sink_failures']} THEN 'sink_failures'
    WHEN value * 4 >= {_LIMITS['sink_latency_average']} THEN 'sink_latency_average' ELSE 'none' END AS reason FROM events)"""
_RING = ", ".join(f"({t}::HUGEINT, {s})" for t, s in ring(SHARDS, 64))
_ENVELOPE = (
    "'{\"message\":\"' || " + _JS.format(x="props") + " || '\",\"agent_id\":\"agent-1\"' || CASE WHEN user_id % 2 = 0 THEN ',\"source_id\":\"' || event_type || '\"' ELSE '' END"
    " || CASE WHEN user_id % 3 = 0 THEN ',\"source_offset\":' || event_id ELSE '' END"
    " || CASE WHEN user_id % 5 = 0 THEN ',\"attributes\":{\"host\":\"' || event_type || '\",\"zone\":\"b\"}' ELSE '' END || '}'"
)
_MEASURED = """m AS (SELECT l_returnflag AS scenario, l_linestatus AS target, l_linenumber * 64 AS payload, l_quantity AS submit_us, l_quantity * 3 AS p95_us, l_quantity * 8 AS p99_us,
  CASE WHEN l_suppkey % 7 = 0 OR floor(l_extendedprice) = 0 THEN 0 ELSE l_partkey * 1000000.0::DOUBLE / floor(l_extendedprice) END AS throughput FROM lineitem)"""
_PROFILE = "count(*) AS runs, round(avg(throughput), 2) AS throughput, round(avg(submit_us), 4) AS submit_us, round(avg(p95_us), 4) AS p95_us, round(avg(p99_us), 4) AS p99_us"
_RUNS = "runs AS (SELECT l_linenumber AS shards, l_returnflag AS scenario, l_quantity AS throughput FROM lineitem)"

ORACLES: dict[str, str] = {
    "records_shard_limit": f"{_WITH}SELECT {_SHOWN} FROM rec WHERE shard = 2 AND sequence BETWEEN 10 AND 500 ORDER BY shard, sequence LIMIT 100",
    "records_seq_range": f"{_WITH}SELECT {_SHOWN} FROM rec WHERE sequence BETWEEN 100 AND 300",
    "records_time_range": f"{_WITH}SELECT {_SHOWN} FROM rec WHERE timestamp >= '2024-01-02' AND timestamp <= '2024-01-03 12:00:00'",
    "records_by_source": f"{_WITH}SELECT {_SHOWN} FROM rec WHERE source_id = 'error'",
    "records_by_agent": f"{_WITH}SELECT {_SHOWN} FROM rec WHERE agent_id = 'agent-3' AND sequence <= 900",
    "records_empty_predicate": f"{_WITH}SELECT {_SHOWN} FROM rec WHERE source_id = '' ORDER BY shard, sequence LIMIT 100",
    "records_limit_zero": f"{_WITH}SELECT {_SHOWN} FROM rec LIMIT 0",
    "segments_read_back": f"{_WITH}, {_STORED} SELECT {_INTACT} FROM intact",
    "segments_file_order": f"{_WITH}, {_STORED} SELECT {_INTACT} FROM intact WHERE shard = 2 AND sequence >= 480 ORDER BY sequence LIMIT 100",
    "segments_active_only": f"{_WITH}, {_STORED} SELECT {_INTACT} FROM intact WHERE NOT archived",
    "segments_statistics": f"""{_WITH}, {_STORED} SELECT count(DISTINCT file) AS segments_read, count(DISTINCT file) FILTER (archived) AS archive_segments_read,
  count(DISTINCT file) FILTER (NOT archived) AS active_segments_read, count(*) FILTER (first_bad IS NULL OR sequence < first_bad) AS records_returned,
  count(*) FILTER (sequence = first_bad) AS corrupted_segments, count(*) FILTER (sequence = first_bad) AS corrupted_lines, 0::BIGINT AS gzip_read_errors FROM stored""",
    "segments_verify": f"""{_WITH}, {_STORED} SELECT file, count(*) AS valid_records, max(sequence) + 1 AS next_sequence, CAST(sum(size) AS BIGINT) AS valid_size FROM intact GROUP BY file""",
    "segments_recovery": f"""{_WITH}, {_STORED}, e AS (SELECT shard, max(sequence) + 1 AS next_sequence, CAST(sum(size) AS BIGINT) AS logical_size FROM intact WHERE NOT archived GROUP BY shard)
SELECT DISTINCT shard, 'full_scan_incomplete_checkpoint' AS mode, coalesce(next_sequence, 0) AS next_sequence, coalesce(logical_size, 0) AS logical_size FROM stored LEFT JOIN e USING (shard) WHERE NOT archived""",
    "encode_full_crc": f"{_WITH}, {_LINES} SELECT shard, sequence, line FROM full_lines",
    "encode_header_crc": f"{_WITH}, {_LINES} SELECT shard, sequence, 'crc=h:' || {_CRC.format(k='meta')} || chr(9) || body AS line FROM body, crc_table",
    "codec_roundtrip": f"{_WITH}SELECT event_id, timestamp, shard::BIGINT AS shard, sequence, level, payload FROM rec WHERE event_id % 7 <> 0",
    "sanitize_payload": "SELECT doc_id, replace(replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' '), chr(9), ' ') AS payload FROM documents",
    "verify_prefix": f"""{_WITH}, {_LINES}, {_SEGMENTS}
SELECT seg_path, count(*) AS valid_records, max(sequence) + 1 AS next_sequence, CAST(sum(size) AS BIGINT) AS valid_size
FROM cut WHERE first_bad IS NULL OR line_no < first_bad GROUP BY seg_path""",
    "reader_stats": f"""{_WITH}, {_LINES}, {_SEGMENTS}
SELECT count(DISTINCT seg_path) AS segments_read, count(*) FILTER (first_bad IS NULL OR line_no < first_bad) AS records_returned,
  count(DISTINCT seg_path) FILTER (first_bad IS NOT NULL) AS corrupted_segments FROM cut""",
    "segment_catalog": f"WITH {_FILES} SELECT path, shard_id, archived, compressed, timestamp_ms, rotation_index FROM seg",
    "archive_dedup": f"WITH {_FILES} SELECT path FROM single",
    "segment_sort": f"WITH {_FILES} SELECT path FROM single ORDER BY shard_id, archived DESC, timestamp_ms, rotation_index, path LIMIT 60",
    "retention_topn": f"""WITH {_FILES}, a AS (SELECT *, 1045000 - timestamp_ms * 1000 > 30000 AS old FROM single WHERE archived),
n AS (SELECT path, row_number() OVER (PARTITION BY shard_id ORDER BY timestamp_ms DESC, rotation_index DESC, path) AS n FROM a WHERE NOT old)
SELECT path FROM a WHERE old UNION ALL SELECT path FROM n WHERE n > 5""",
    "rotation_assign": f"""{_WITH}, {_LINES}, z AS (
  SELECT shard, sequence, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY shard ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS BIGINT) AS rotation_index
  FROM full_lines) SELECT shard, rotation_index, count(*) AS n, min(sequence) AS first_sequence FROM z GROUP BY shard, rotation_index""",
    "route_modulo": f"{_WITH}SELECT event_id, shard, hash::VARCHAR AS hash FROM rec",
    "route_ring_asof": f"""WITH h AS (SELECT c_custkey, {_FNV.format(k='c_name')} AS hash FROM customer), ring(token, shard) AS (VALUES {_RING}),
f AS (SELECT min(token) AS first FROM ring), x AS (SELECT c_custkey, min(token) AS token FROM h LEFT JOIN ring ON token >= hash GROUP BY c_custkey)
SELECT c_custkey, r.shard, r.token::VARCHAR AS token FROM x, f JOIN ring r ON r.token = coalesce(x.token, first)""",
    "route_empty_policy": f"""{_WITH}SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 3 ELSE shard END AS local_shard, user_id % 3 = 0 AS used_local_fallback,
  CASE WHEN user_id % 3 = 0 THEN CAST(event_id % 4 AS INTEGER) ELSE shard END AS round_robin_shard FROM rec""",
    "hash_text": f"WITH {_CRC_TABLE} SELECT n_nationkey, {_FNV.format(k='n_name')}::VARCHAR AS hash, {_CRC.format(k='n_name')} AS crc FROM nation, crc_table",
    "shard_counts": f"{_WITH}SELECT shard, count(*) AS n, max(sequence) AS last_sequence FROM rec GROUP BY shard",
    "sequence_assign": f"{_WITH}SELECT event_id, shard, sequence FROM rec",
    "delivery_batch": f"{_WITH}, {_batches(128)} SELECT shard, batch_no, first_sequence, next_sequence, n, records FROM batches",
    "offsets_merge": f"WITH {_OFFSETS} SELECT shard, next_sequence FROM offsets",
    "replay_from_offsets": f"""{_WITH}, {_OFFSETS}, p AS (
  SELECT rec.*, row_number() OVER (PARTITION BY shard ORDER BY sequence) AS n FROM rec LEFT JOIN offsets USING (shard) WHERE sequence >= coalesce(next_sequence, 0)),
b AS (SELECT shard, min(sequence) AS first_sequence, max(sequence) + 1 AS next_sequence, list(payload ORDER BY sequence) AS items FROM p WHERE n <= 50 GROUP BY shard)
SELECT shard, first_sequence, next_sequence, {_delivery('replay')} AS body FROM b""",
    "pending_counts": f"{_WITH}, {_OFFSETS} SELECT shard, count(*) AS n FROM rec LEFT JOIN offsets USING (shard) WHERE sequence >= coalesce(next_sequence, 0) GROUP BY shard",
    "sink_batch_json": f"{_WITH}, {_batches(20)} SELECT shard, batch_no, {_delivery('agent-1')} AS body FROM batches WHERE batch_no < 3",
    "kafka_envelope": f"""{_WITH}, {_batches(20)} SELECT shard, batch_no,
  '{{"topic":"logs","key":"' || shard || ':' || first_sequence || '","value":' || {_delivery('agent-1')} || '}}' AS body FROM batches WHERE batch_no < 3""",
    "object_manifest": f"""{_WITH}, {_batches(20)}, o AS (SELECT *, 'agent/shard-' || shard || '/' || first_sequence || '-' || next_sequence || '.json' AS name FROM batches WHERE batch_no < 3)
SELECT shard, batch_no, '{{"object":"' || name || '","commit_marker":"' || name || '.commit","body":' || {_delivery('agent-1')} || '}}' AS body FROM o""",
    "dedupe_delivery": f"{_WITH}, {_batches(64)} SELECT 'agent-1' AS agent_id, shard, first_sequence, next_sequence FROM batches",
    "envelope_render": f"SELECT event_id, {_ENVELOPE} AS body FROM events",
    "envelope_decode": """SELECT event_id, props AS payload, 'agent-1' AS agent_id, CASE WHEN user_id % 2 = 0 THEN event_type ELSE '' END AS source_id,
  CASE WHEN user_id % 3 = 0 THEN event_id END AS source_offset, CASE WHEN user_id % 5 = 0 THEN event_type ELSE '' END AS host FROM events""",
    "ingest_normalize": """WITH r AS (SELECT *, unnest(CASE WHEN event_id % 3 = 0 THEN [1, 2] ELSE [1] END) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' WHEN user_id % 2 = 0 THEN 'r-' || user_id ELSE 'svc-' || (user_id % 7) END AS route_key,
  CASE WHEN event_id % 3 <> 2 AND event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN event_id % 3 = 2 THEN event_type ELSE props END AS payload,
  CASE WHEN event_id % 3 = 2 THEN '' ELSE 'env=test,host=h1,service=svc-' || (user_id % 7) END AS attributes FROM r""",
    "multiline_merge": """WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn * 100000 + generate_subscripts(x, 1) - 1 AS ord, unnest(x) AS line FROM l),
g AS (SELECT *, sum(CASE WHEN starts_with(line, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY ord) AS g FROM p),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, g ORDER BY ord) - 1) // 3 AS part FROM g)
SELECT conv_id, min(ord) AS first, string_agg(line, chr(10) ORDER BY ord) AS record FROM n GROUP BY conv_id, g, part""",
    "source_limits": """WITH x AS (SELECT octet_length(encode(event_type || props)) AS size, sum(octet_length(encode(event_type || props))) OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS upto FROM events)
SELECT CASE WHEN size > 16 THEN 'message_too_large' WHEN upto > 1200 THEN 'buffer_too_large' ELSE 'accept' END AS decision, count(*) AS n FROM x GROUP BY 1""",
    "source_offset_running": """SELECT event_id, CAST(coalesce(sum(octet_length(encode(props)) + 1) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS source_offset FROM events""",
    "health_window": f"WITH {_HEALTH} SELECT * FROM w",
    "health_status": f"""WITH {_COUNTERS} SELECT event_id, CASE WHEN ck > 0 OR ga > 0 OR rf > 3 OR ge > 3 OR cs > 10 OR cl > 10 THEN 'unhealthy' WHEN rf > 0 OR ge > 0 OR cs > 0 OR cl > 0 THEN 'degraded' ELSE 'ok' END AS status,
  CASE WHEN ck > 0 THEN 'checkpoint_failures' WHEN ga > 0 THEN 'gzip_archive_failures' WHEN rf > 3 THEN 'recovery_fallbacks' WHEN ge > 3 THEN 'gzip_read_errors' WHEN cs > 10 THEN 'corrupted_segments' WHEN cl > 10 THEN 'corrupted_lines'
    WHEN rf > 0 THEN 'recovery_fallbacks' WHEN ge > 0 THEN 'gzip_read_errors' WHEN cs > 0 THEN 'corrupted_segments' WHEN cl > 0 THEN 'corrupted_lines' ELSE 'none' END AS reason FROM c""",
    "backpressure_decision": f"WITH {_PRESSURE} SELECT event_id, reason FROM bp",
    "ewma_latency": """WITH l AS (SELECT event_type, list(CAST(floor(value * 100) AS BIGINT) ORDER BY event_id) AS x FROM events WHERE event_id < 2000 GROUP BY event_type)
SELECT event_type, list_reduce(x, lambda a, v: CASE WHEN a = 0 THEN v ELSE (a * 7 + v) // 8 END) AS average FROM l""",
    "percentile_nearest_rank": """WITH l AS (SELECT event_type, list(value ORDER BY value) AS x FROM events GROUP BY event_type)
SELECT event_type, x[CAST(floor(0.5 * (len(x) - 1)) AS BIGINT) + 1] AS p50, x[CAST(floor(0.95::DOUBLE * (len(x) - 1)) AS BIGINT) + 1] AS p95, x[CAST(floor(0.99::DOUBLE * (len(x) - 1)) AS BIGINT) + 1] AS p99 FROM l""",
    "rate_alerts": f"""WITH {_HEALTH}, r AS (SELECT event_type, minute * 60 AS at_second, lifetime AS value, recent FROM w)
SELECT event_type, at_second, round((value - lag(value) OVER k) / (at_second - lag(at_second) OVER k), 9) AS rate,
  min(CASE WHEN recent > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY at_second RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) = 1 AS firing
FROM r WINDOW k AS (PARTITION BY event_type ORDER BY at_second)""",
    "pause_durations": f"""WITH {_PRESSURE}, c AS (SELECT user_id % 4 AS agent, event_id, reason, lag(reason) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS was FROM bp),
s AS (SELECT agent, reason, lead(event_id) OVER (PARTITION BY agent ORDER BY event_id) - event_id AS d FROM c WHERE was IS NULL OR was <> reason)
SELECT agent, reason, CAST(sum(d) AS BIGINT) AS seconds FROM s WHERE d IS NOT NULL GROUP BY agent, reason""",
    "scaling_efficiency": f"""WITH {_RUNS}, b AS (SELECT scenario, shards, avg(throughput) AS t FROM runs GROUP BY ALL)
SELECT b.scenario, b.shards, round(b.t / (b.shards * o.t), 9) AS efficiency FROM b JOIN b o ON o.scenario = b.scenario AND o.shards = 1""",
    "benchmark_rollup": f"WITH {_RUNS} SELECT scenario, shards, count(*) AS runs, round(avg(throughput), 6) AS average, min(throughput) AS least, max(throughput) AS most FROM runs GROUP BY ALL",
    "writer_metrics": f"{_WITH}, {_LINES} SELECT shard, count(*) AS submitted_messages, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS submitted_bytes FROM full_lines GROUP BY shard",
    "url_endpoints": """SELECT page_id, regexp_extract(url, '^https?://([^/:]*)', 1) AS host, 8080 AS port,
  CASE WHEN regexp_extract(url, '^https?://[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]*(/.*)$', 1) END AS path FROM pages""",
    "set_operations": """WITH a AS (SELECT user_id FROM events WHERE event_type = 'view'), b AS (SELECT user_id FROM events WHERE event_type = 'click'),
m AS (SELECT user_id FROM a EXCEPT ALL SELECT user_id FROM b)
SELECT user_id, 'either' AS kind FROM (SELECT user_id FROM a UNION SELECT user_id FROM b) UNION ALL SELECT DISTINCT user_id, 'more' AS kind FROM m""",
    "alert_rules": f"""WITH {_COUNTERS} SELECT event_id, 'checkpoint_write_failing' AS alert, 'critical' AS severity FROM c WHERE ck > 0
UNION ALL SELECT event_id, 'archive_compression_failing', 'warning' FROM c WHERE ga > 0 UNION ALL SELECT event_id, 'recovery_fallback_seen', 'warning' FROM c WHERE rf > 0
UNION ALL SELECT event_id, 'compressed_read_failing', 'warning' FROM c WHERE ge > 0 UNION ALL SELECT event_id, 'corrupted_segments_seen', 'warning' FROM c WHERE cs > 0
UNION ALL SELECT event_id, 'many_problems', 'critical' FROM c WHERE greatest(ck, ga, rf, ge, cs, cl) > 10""",
    "quota_decisions": """WITH q AS (SELECT event_id, user_id % 100 AS used, user_id % 2 = 0 AS waiting, CASE WHEN user_id % 4 = 0 THEN 0 ELSE 90 END AS quota, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 40 END AS low FROM events)
SELECT event_id, quota > 0 AND used >= quota AS exceeded, quota = 0 OR used <= CASE WHEN low = 0 THEN quota ELSE low END AS can_resume,
  quota > 0 AND CASE WHEN waiting THEN used > CASE WHEN low = 0 THEN quota // 2 ELSE low END ELSE used > quota END AS must_wait FROM q""",
    "directory_sizes": "SELECT regexp_replace(url, '/[^/]*$', '') AS folder, count(*) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages WHERE url IS NOT NULL GROUP BY 1",
    "query_jitter": """WITH o AS (SELECT o_orderstatus AS method, CAST(floor(o_totalprice) AS BIGINT) AS us, o_orderkey % 2 = 0 AS cold FROM orders),
l AS (SELECT method, list(us ORDER BY us) AS x FROM o GROUP BY method)
SELECT method, min(us) AS least, max(us) AS most, round(avg(us), 6) AS average, round(avg(us) FILTER (NOT cold) / avg(us) FILTER (cold), 9) AS warm_to_cold,
  any_value(x[CAST(floor(0.99::DOUBLE * (len(x) - 1)) AS BIGINT) + 1]) AS p99 FROM o JOIN l USING (method) GROUP BY method""",
    "header_filter": """SELECT p_partkey, 'X-Part: ' || p_name AS line FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 2 AND regexp_matches(p_name, '^[A-Za-z0-9-]+:')""",
    "regression_report": f"WITH {_MEASURED} SELECT scenario, target, {_PROFILE} FROM m GROUP BY ALL",
    "profile_report": f"WITH {_MEASURED} SELECT scenario, target, payload, {_PROFILE} FROM m GROUP BY ALL",
    "soak_report": f"""WITH {_MEASURED} SELECT {_PROFILE}, round(min(throughput), 2) AS least_throughput, round(max(throughput), 2) AS most_throughput,
  round(max(p99_us), 4) AS worst_p99_us FROM m""",
    "scanner_report": """WITH s AS (SELECT user_id % 40 AS run, CASE WHEN user_id % 40 % 3 = 0 THEN 1099511627776 ELSE 700 END AS messages, event_id + 40 AS at_ms,
  event_id AS committed, event_id - user_id % 9 AS sent, CAST(floor(value) AS BIGINT) AS backlog, user_id % 17 - 4 AS queue_batches, event_id % 5 AS active_workers FROM events),
e AS (SELECT *, min(at_ms) FILTER (committed >= messages AND sent >= messages) OVER (PARTITION BY run) AS done, max(at_ms) OVER (PARTITION BY run) AS last FROM s)
SELECT run, CAST(any_value(coalesce(done, last)) - run AS BIGINT) AS elapsed_ms, greatest(max(backlog), 0) AS peak_backlog, greatest(max(queue_batches), 0) AS peak_queue_batches,
  max(active_workers) AS peak_active_workers, CASE WHEN any_value(done) IS NULL THEN 'timeout' ELSE 'completed' END AS status,
  round(any_value(messages) * 1000.0::DOUBLE / (any_value(coalesce(done, last)) - run), 2) AS throughput
FROM e WHERE done IS NULL OR at_ms <= done GROUP BY run""",
    "queue_depths": """WITH d AS (SELECT user_id % 4 AS queue, sum(CASE WHEN event_type = 'view' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS depth FROM events)
SELECT queue, CAST(greatest(max(depth), 0) AS BIGINT) AS most FROM d GROUP BY queue""",
    "sequence_only": f"{_WITH} SELECT shard, sequence AS written, CASE WHEN sequence % 5 <> 0 AND sequence % 7 <> 0 THEN sequence END AS sequence FROM rec",
    "level_names": "SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARN' WHEN 2 THEN 'ERROR' ELSE 'UNKNOWN' END AS level FROM events",
    "aligned_sizes": """WITH s AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
w AS (SELECT *, CAST(CASE WHEN page_id % 4 = 0 THEN size ELSE (size + 4095) // 4096 * 4096 END AS BIGINT) AS written FROM s)
SELECT page_id, written, written - size AS padding FROM w""",
}

ORACLES["verify_totals"] = f"""SELECT count(*) AS segments, CAST(sum(valid_records) AS BIGINT) AS valid_records, CAST(sum(valid_size) AS BIGINT) AS valid_size
FROM ({ORACLES['verify_prefix']}) v"""
