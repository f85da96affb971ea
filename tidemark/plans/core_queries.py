"""Queries over the op-log, runs, logs, replication and commands, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import frames, record_bytes, wire
from tidemark.operators import bloom, cache, dispatch, lww, replication, runs, stats, wal
from tidemark.plans.store import Store
from tidemark.scratch import cut, scratch_path
from tidemark.sources.tables import event_oplog, table

_KV = ["key", "value", "seq", "op"]


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.flush(event_oplog(spark, folder))


def kv_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return lww.snapshot(event_oplog(spark, folder))


def kv_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    return lww.tombstones(event_oplog(spark, folder))


def kv_point_get(spark: SparkSession, folder: str) -> DataFrame:
    return lww.point_get(event_oplog(spark, folder), "user:000042")


def kv_multi_get(spark: SparkSession, folder: str) -> DataFrame:
    # Users who are also customers of the first nation.
    keys = table(spark, folder, "customer").where("c_nationkey = 0").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return lww.multi_get(event_oplog(spark, folder), keys)


def kv_range_scan(spark: SparkSession, folder: str) -> DataFrame:
    return lww.range_scan(event_oplog(spark, folder), "user:000020", "user:000080")


def kv_prefix_scan(spark: SparkSession, folder: str) -> DataFrame:
    return lww.prefix_scan(event_oplog(spark, folder), "user:00001")


def kv_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return lww.as_of(event_oplog(spark, folder), 600)


def kv_values(spark: SparkSession, folder: str) -> DataFrame:
    return lww.snapshot(event_oplog(spark, folder)).select("key", wire.shown_value(F.col("value")).isNotNull().alias("shown"), F.octet_length("value").alias("n_bytes"))


def kv_delete_existed(spark: SparkSession, folder: str) -> DataFrame:
    return lww.removal_results(event_oplog(spark, folder))


def kv_ls(spark: SparkSession, folder: str) -> DataFrame:
    files = _runs(spark, folder).withColumn("source", F.concat(F.lit("run_"), F.col("flush_id")))
    log = lww.lww(event_oplog(spark, folder))
    return lww.listing([("memtable", log), (None, files)])


def kv_memtable_size(spark: SparkSession, folder: str) -> DataFrame:
    return runs.memtable_size(event_oplog(spark, folder))


def kv_run_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder)


def kv_flush_files(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_meta(_runs(spark, folder))


def kv_sparse_index(spark: SparkSession, folder: str) -> DataFrame:
    return runs.sparse_index(_runs(spark, folder))


def kv_leader_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the leader's stored files; a row stored twice is one row of its file."""
    rows = table(spark, folder, "leader_sst").select("file_id", "key", "value", "seq", "op").distinct()
    return runs.sparse_index(rows, "file_id")


def kv_level_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return runs.level_sizes(table(spark, folder, "manifest"), ["store_id", "node_id"])


def kv_level_trigger(spark: SparkSession, folder: str) -> DataFrame:
    return runs.compaction_due(table(spark, folder, "manifest"), ["store_id", "node_id"])


def kv_compaction_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.compaction_inputs(table(spark, folder, "manifest"), ["store_id", "node_id"])


def kv_prune_files(spark: SparkSession, folder: str) -> DataFrame:
    return runs.may_hold(table(spark, folder, "manifest"), "cart.5").select("id", "store_id", "node_id", "level")


def kv_manifest_without(spark: SparkSession, folder: str) -> DataFrame:
    failed = table(spark, folder, "apply_runs").where("status <> 'ok' AND file_id IS NOT NULL").select(F.col("file_id").alias("id"))
    return runs.without(table(spark, folder, "manifest"), failed).select("id", "store_id", "level")


def kv_compact_l0_l1(spark: SparkSession, folder: str) -> DataFrame:
    return runs.compacted(_runs(spark, folder).select(*_KV), bottom=True)


def kv_compact_upper(spark: SparkSession, folder: str) -> DataFrame:
    return runs.compacted(_runs(spark, folder).select(*_KV), bottom=False)


def kv_amplification(spark: SparkSession, folder: str) -> DataFrame:
    return runs.amplification(event_oplog(spark, folder))


def kv_store_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """The log written in two halves to a store, flushed, compacted, reopened: its snapshot."""
    store, ops = Store(spark, scratch_path(spark, "store")), event_oplog(spark, folder)
    for half in ("flush_id % 2 = 0", "flush_id % 2 = 1"):
        store.write(ops.where(half).select(*_KV))
        store.flush()
    store.compact(0)
    return Store(spark, store.path).snapshot()


def lineitem_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return lww.latest(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"], ["l_quantity", "l_returnflag"]).where("l_returnflag <> 'R'").drop("l_shipdate")


def orders_latest(spark: SparkSession, folder: str) -> DataFrame:
    return lww.latest(table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).drop("o_orderdate")


def wal_checksums(spark: SparkSession, folder: str) -> DataFrame:
    return event_oplog(spark, folder).select("seq", record_bytes.wal_checksum(F.col("seq"), F.col("op"), F.col("key"), F.col("value")).alias("checksum"))


def wal_replay_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return wal.replay(event_oplog(spark, folder).select(*_KV), F.col("seq") % 997 == 0, "seq")


def wal_replay_stores(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "incoming_ops").select("store_id", "op_id", "key", "op")
    return wal.replay(log, F.col("key").isNull(), "op_id", ["store_id"])


def wal_recover_seq(spark: SparkSession, folder: str) -> DataFrame:
    return wal.next_seq(event_oplog(spark, folder))


def repl_index(spark: SparkSession, folder: str) -> DataFrame:
    ops = table(spark, folder, "incoming_ops").select("store_id", "op_id", "key")
    return replication.assign_index(ops, ["store_id"], "op_id").select("store_id", "op_id", "index")


def repl_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return replication.ingest(table(spark, folder, "repl_msgs"))


def repl_state(spark: SparkSession, folder: str) -> DataFrame:
    return replication.follower_state(table(spark, folder, "repl_msgs"))


def repl_prefix_end(spark: SparkSession, folder: str) -> DataFrame:
    return replication.contiguous_end(replication.ingest(table(spark, folder, "repl_msgs")), ["store_id"])


def repl_apply_prefix(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "repl_msgs")
    return replication.applied_prefix(cut(replication.follower_log(messages)), replication.follower_state(messages).select("store_id", "commit_index"), ["store_id"])


def repl_acks(spark: SparkSession, folder: str) -> DataFrame:
    ships = table(spark, folder, "apply_runs").select("store_id", F.col("node_id").alias("peer"), (F.col("status") == "ok").alias("ack"))
    return replication.acknowledged(ships, ["store_id"])


def repl_connected(spark: SparkSession, folder: str) -> DataFrame:
    peers = table(spark, folder, "apply_runs").groupBy("store_id", "node_id").agg(F.max(F.col("status") == "ok").alias("connected"))
    return replication.connected(peers)


def repl_divergence(spark: SparkSession, folder: str) -> DataFrame:
    feed = table(spark, folder, "repl_log").withColumn("put", F.upper("op").isin("PUT", "SET"))
    feed = feed.select("store_id", "term", "index", F.when(F.col("put"), "PUT").otherwise("DELETE").alias("op"), "key", F.when(F.col("put"), F.col("value")).otherwise("").alias("value"))
    order = ["term", "op", "key", "value"]
    leader = lww.latest(feed, ["store_id", "index"], order, order)
    return replication.divergence(leader, replication.follower_log(table(spark, folder, "repl_msgs").withColumn("entries", F.transform("entries", lambda e: e.withField("value", F.coalesce(e["value"], F.lit("")))))))


def repl_frames(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "repl_msgs")
    return m.select("delivery_id", frames.encode_message(F.col("term"), F.col("leader_commit"), F.col("entries")).alias("frame"))


def repl_frames_read(spark: SparkSession, folder: str) -> DataFrame:
    read = frames.decode_messages(repl_frames(spark, folder))
    return read.select("delivery_id", F.explode("entries").alias("e")).select("delivery_id", "e.term", "e.index", "e.op", "e.key", "e.value")


def lru_contents(spark: SparkSession, folder: str) -> DataFrame:
    return cache.contents(event_oplog(spark, folder), 100)


def lru_hits(spark: SparkSession, folder: str) -> DataFrame:
    return cache.hits(event_oplog(spark, folder), 100)


def lru_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    return cache.hit_rate(cache.hits(event_oplog(spark, folder), 100))


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return stats.percentiles(table(spark, folder, "events"), "value")


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.latency_summary(table(spark, folder, "orders"), "o_totalprice")


def op_rates(spark: SparkSession, folder: str) -> DataFrame:
    return stats.rates(event_oplog(spark, folder), ["key"])


def op_throughput(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    e = table(spark, folder, "events").agg(F.count("*").alias("n_ops"), F.floor((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1000).alias("millis"))
    return e.select("n_ops", "millis", stats.throughput(F.col("n_ops"), F.col("millis")).alias("ops_per_second"))


def scaling(spark: SparkSession, folder: str) -> DataFrame:
    # The first size of a part stands for the number of threads.
    measured = table(spark, folder, "part").groupBy(F.col("p_size").alias("threads")).agg(F.sum(F.col("p_partkey")).cast("double").alias("throughput"))
    return stats.scaling(measured)


def cmd_parse(spark: SparkSession, folder: str) -> DataFrame:
    return wire.with_command(_lines(spark, folder), "line").drop("line")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Command lines of many shapes, one per event."""
    ops = event_oplog(spark, folder)
    kind = F.col("seq") % 8
    line = (
        F.when(kind == 0, F.concat(F.lit("  put "), "key", F.lit("  "), "value", F.lit(" \r\n")))
        .when(kind == 1, F.concat(F.lit("SET "), "key", F.lit(" "), "value"))
        .when(kind == 2, F.concat(F.lit("Get "), "key", F.lit("\t\r\n")))
        .when(kind == 3, F.concat(F.lit("del "), "key"))
        .when(kind == 4, F.lit("PING"))
        .when(kind == 5, F.concat(F.lit("PUT "), "key"))
        .when(kind == 6, F.concat(F.lit("delete "), "key", F.lit(" with spaces")))
        .otherwise(F.concat(F.lit("INCR "), "key"))
    )
    return ops.select("seq", line.alias("line"))


def cmd_replies(spark: SparkSession, folder: str) -> DataFrame:
    return dispatch.replies(_lines(spark, folder))


def cmd_follower_replies(spark: SparkSession, folder: str) -> DataFrame:
    return dispatch.replies(_lines(spark, folder), role="follower").select("seq", "success", "message")


def cmd_read_replies(spark: SparkSession, folder: str) -> DataFrame:
    read = dispatch.replies(_lines(spark, folder)).select("seq", wire.parse_reply(F.col("line")).alias("r"))
    return read.select("seq", "r.success", "r.message", "r.value")


def cmd_calls(spark: SparkSession, folder: str) -> DataFrame:
    ops = event_oplog(spark, folder)
    kind = F.col("seq") % 5
    line = (
        F.when(kind == 0, F.concat(F.lit('put("'), "key", F.lit('", "x'), F.col("seq").cast("string"), F.lit('")')))
        .when(kind == 1, F.concat(F.lit('get("'), "key", F.lit('")')))
        .when(kind == 2, F.concat(F.lit('delete("'), "key", F.lit('")')))
        .when(kind == 3, F.lit("flush"))
        .otherwise(F.concat(F.lit('PUT("'), "key", F.lit('")')))
    )
    return ops.select("seq", wire.parse_call(line).alias("c")).select("seq", "c.verb", "c.key", "c.value")


def bloom_fp(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "leader_sst").select("key")
    others = table(spark, folder, "incoming_ops").select("key")
    return bloom.measure(rows, others, "key")


QUERIES = {
    f.__name__: f
    for f in (
        kv_snapshot, kv_tombstones, kv_point_get, kv_multi_get, kv_range_scan, kv_prefix_scan, kv_as_of, kv_values, kv_delete_existed, kv_ls,
        kv_memtable_size, kv_run_rows, kv_flush_files, kv_sparse_index, kv_leader_index, kv_level_sizes, kv_level_trigger, kv_compaction_inputs,
        kv_prune_files, kv_manifest_without, kv_compact_l0_l1, kv_compact_upper, kv_amplification, kv_store_cycle, lineitem_upsert, orders_latest,
        wal_checksums, wal_replay_prefix, wal_replay_stores, wal_recover_seq, repl_index, repl_ingest, repl_state, repl_prefix_end, repl_apply_prefix,
        repl_acks, repl_connected, repl_divergence, repl_frames, repl_frames_read, lru_contents, lru_hits, lru_hit_rate, latency_percentiles,
        latency_summary, op_rates, op_throughput, scaling, cmd_parse, cmd_replies, cmd_follower_replies, cmd_read_replies, cmd_calls, bloom_fp,
    )
}

_OPS = """WITH oplog AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value,
event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CAST(floor(event_id / 500) AS BIGINT) AS flush_id FROM events),
lww AS (SELECT key, max_by(value, seq) AS value, max(seq) AS seq, max_by(op, seq) AS op FROM oplog GROUP BY key),
runs AS (SELECT flush_id, key, max_by(value, seq) AS value, max(seq) AS seq, max_by(op, seq) AS op FROM oplog GROUP BY flush_id, key) """
_BYTES = "17 + strlen(key) + CASE WHEN op = 'PUT' THEN strlen(coalesce(value, '')) ELSE 0 END"
_SNAP = "SELECT key, value, seq FROM lww WHERE op = 'PUT'"
_INDEX = """SELECT {run}, key, CAST(coalesce(size, 0) AS BIGINT) AS byte_offset FROM (SELECT {run}, key,
sum(""" + _BYTES + """) OVER (PARTITION BY {run} ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS size,
row_number() OVER (PARTITION BY {run} ORDER BY key) - 1 AS i FROM {rows}) WHERE i % 16 = 0"""  # fmt: skip
_INGEST = """m AS (SELECT delivery_id, store_id, unnest(entries) AS e FROM repl_msgs),
n AS (SELECT store_id, e.term AS term, e."index" AS "index", e.op AS op, e.key AS key, e.value AS value FROM m) """
_LINES = """, k AS (SELECT seq, key, value, seq % 8 AS kind FROM oplog),
p AS (SELECT seq, CASE WHEN kind IN (0, 1) THEN CASE WHEN trim(value, ' ' || chr(9) || chr(13) || chr(10)) = '' THEN 'INVALID' ELSE 'PUT' END
WHEN kind = 2 THEN 'GET' WHEN kind IN (3, 6) THEN 'DELETE' WHEN kind = 4 THEN 'PING' WHEN kind = 5 THEN 'INVALID' ELSE 'UNKNOWN' END AS verb,
CASE WHEN kind = 6 THEN key || ' with spaces' ELSE key END AS key, trim(value, ' ' || chr(9) || chr(13) || chr(10)) AS value FROM k),
c AS (SELECT seq, verb, CASE WHEN verb IN ('PUT', 'GET', 'DELETE') THEN key END AS key, CASE WHEN verb = 'PUT' THEN value END AS value FROM p),
w AS (SELECT c.*, max(CASE WHEN verb IN ('PUT', 'DELETE') THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ws FROM c),
s AS (SELECT w.seq, w.verb, w.key, coalesce(b.verb = 'PUT', false) AS live, b.value AS old FROM w LEFT JOIN c b ON b.seq = w.ws AND w.key IS NOT NULL),
r AS (SELECT seq, verb, key, CASE WHEN verb IN ('PUT', 'PING', 'QUIT') THEN true WHEN verb IN ('GET', 'DELETE') THEN live ELSE false END AS success,
CASE WHEN verb = 'PUT' THEN 'STORED' WHEN verb = 'DELETE' THEN CASE WHEN live THEN 'DELETED' ELSE 'DELETE_FAILED' END
WHEN verb = 'GET' THEN CASE WHEN live THEN 'OK' ELSE 'NOT_FOUND' END WHEN verb = 'PING' THEN 'PONG' ELSE 'UNKNOWN_COMMAND' END AS message,
CASE WHEN verb = 'GET' AND live THEN old END AS value FROM s) """
_MANIFEST_SUM = "SELECT store_id, node_id, level, count(*) AS n_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes FROM manifest GROUP BY store_id, node_id, level"
_PCT = """(SELECT v[1 + least(CAST(floor(n * {p}) AS BIGINT), n - 1)] FROM (SELECT list_sort(list({c})) AS v, count(*) AS n FROM {t}))"""


def _percent(p: str, column: str, rows: str) -> str:
    return _PCT.format(p=p, c=column, t=rows)


SQL = {
    "kv_snapshot": _OPS + _SNAP,
    "kv_tombstones": _OPS + "SELECT key, seq FROM lww WHERE op = 'DELETE'",
    "kv_point_get": _OPS + _SNAP + " AND key = 'user:000042'",
    "kv_multi_get": _OPS + _SNAP + " AND key IN (SELECT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer WHERE c_nationkey = 0)",
    "kv_range_scan": _OPS + _SNAP + " AND key BETWEEN 'user:000020' AND 'user:000080'",
    "kv_prefix_scan": _OPS + _SNAP + " AND starts_with(key, 'user:00001')",
    "kv_as_of": _OPS + ", o AS (SELECT key, max_by(value, seq) AS value, max(seq) AS seq, max_by(op, seq) AS op FROM oplog WHERE seq <= 600 GROUP BY key) SELECT key, value, seq FROM o WHERE op = 'PUT'",
    "kv_values": _OPS + "SELECT key, true AS shown, CAST(strlen(value) AS INTEGER) AS n_bytes FROM lww WHERE op = 'PUT'",
    "kv_delete_existed": _OPS + ", p AS (SELECT key, seq, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS was FROM oplog) SELECT key, seq, coalesce(was = 'PUT', false) AS existed FROM p WHERE op = 'DELETE'",
    "kv_ls": _OPS + """, s AS (SELECT 'memtable' AS source, key, value, seq, op FROM lww UNION ALL SELECT 'run_' || flush_id, key, value, seq, op FROM runs)
SELECT source, key, CASE WHEN op = 'PUT' THEN value ELSE '<TOMBSTONE>' END AS value, seq FROM s""",
    "kv_memtable_size": _OPS + f"SELECT CAST(sum({_BYTES}) AS BIGINT) AS size_bytes, count(*) AS n_keys FROM lww",
    "kv_run_rows": _OPS + "SELECT flush_id, key, value, seq, op FROM runs",
    "kv_flush_files": _OPS + f"SELECT flush_id, min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq, CAST(sum({_BYTES}) AS BIGINT) AS size_bytes, count(*) AS n_rows FROM runs GROUP BY flush_id",
    "kv_sparse_index": _OPS + _INDEX.format(run="flush_id", rows="runs"),
    "kv_leader_index": _INDEX.format(run="file_id", rows="(SELECT DISTINCT file_id, key, value, seq, op FROM leader_sst)"),
    "kv_level_sizes": _MANIFEST_SUM,
    "kv_level_trigger": f"""SELECT *, CASE level WHEN 0 THEN n_files >= 4 WHEN 1 THEN size_bytes > 10485760 WHEN 2 THEN size_bytes > 104857600 ELSE false END AS due FROM ({_MANIFEST_SUM})""",
    "kv_compaction_inputs": """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, node_id, level ORDER BY min_key, id) AS n FROM manifest) WHERE level = 0 OR n = 1),
s AS (SELECT store_id, node_id, level, min(min_key) AS low, max(max_key) AS high FROM c GROUP BY store_id, node_id, level)
SELECT store_id, node_id, level AS source_level, id, level FROM c UNION ALL
SELECT m.store_id, m.node_id, s.level, m.id, m.level FROM manifest m JOIN s ON m.store_id = s.store_id AND m.node_id = s.node_id AND m.level = s.level + 1 WHERE NOT (m.max_key < s.low OR m.min_key > s.high)""",
    "kv_prune_files": "SELECT id, store_id, node_id, level FROM manifest WHERE coalesce(min_key <= 'cart.5', true) AND coalesce(max_key >= 'cart.5', true)",
    "kv_manifest_without": "SELECT id, store_id, level FROM manifest WHERE id NOT IN (SELECT file_id FROM apply_runs WHERE status <> 'ok' AND file_id IS NOT NULL)",
    "kv_compact_l0_l1": _OPS + "SELECT key, value, seq, op FROM lww WHERE op = 'PUT'",
    "kv_compact_upper": _OPS + "SELECT key, value, seq, op FROM lww",
    "kv_amplification": _OPS + """SELECT e AS n_entries, l AS n_live, e / l AS space_amplification, (e - l) * 100.0 / e AS reclaimed_percent
FROM (SELECT (SELECT count(*) FROM oplog) AS e, (SELECT count(*) FROM lww WHERE op = 'PUT') AS l)""",
    "kv_store_cycle": _OPS + _SNAP,
    "lineitem_upsert": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM (SELECT *, row_number() OVER
(PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1 AND l_returnflag <> 'R'""",
    "orders_latest": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "wal_replay_prefix": _OPS + "SELECT key, value, seq, op FROM oplog WHERE seq < coalesce((SELECT min(seq) FROM oplog WHERE seq % 997 = 0), 9223372036854775807)",
    "wal_replay_stores": """SELECT store_id, op_id, key, op FROM (SELECT *, sum(CASE WHEN key IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY store_id ORDER BY op_id) AS bad FROM incoming_ops) WHERE bad = 0""",
    "wal_recover_seq": _OPS + "SELECT max(seq) + 1 AS next_seq FROM oplog",
    "repl_index": 'SELECT store_id, op_id, row_number() OVER (PARTITION BY store_id ORDER BY op_id) AS "index" FROM incoming_ops',
    "repl_ingest": "WITH " + _INGEST + 'SELECT store_id, term, "index", op, key, value FROM n',
    "repl_state": "SELECT store_id, max(term) AS term, coalesce(max(leader_commit), 0) AS commit_index FROM repl_msgs GROUP BY store_id",
    "repl_prefix_end": "WITH " + _INGEST + """, d AS (SELECT DISTINCT store_id, "index" FROM n WHERE "index" % 211 <> 0), s AS (SELECT store_id, "index", row_number() OVER (PARTITION BY store_id ORDER BY "index") AS k FROM d)
SELECT store_id, coalesce(max(CASE WHEN k = "index" THEN k END), 0) AS applied FROM s GROUP BY store_id""",
    "repl_apply_prefix": "WITH " + _INGEST + """, f AS (SELECT store_id, "index", term, op, key, value, row_number() OVER (PARTITION BY store_id, "index" ORDER BY term DESC, op DESC, key DESC, value DESC NULLS LAST) AS n FROM n),
g AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY "index") AS k FROM f WHERE n = 1),
z AS (SELECT store_id, coalesce(max(leader_commit), 0) AS upto FROM repl_msgs GROUP BY store_id)
SELECT g.store_id, g."index", g.term, g.op, g.key, g.value FROM g JOIN z ON g.store_id = z.store_id WHERE g.k = g."index" AND g."index" <= z.upto""",
    "repl_acks": "SELECT store_id, count(node_id) AS n_peers, count(*) FILTER (node_id IS NOT NULL AND status = 'ok') AS n_acks, count(*) FILTER (node_id IS NOT NULL AND status = 'ok') > 0 OR count(node_id) = 0 AS replicated FROM apply_runs GROUP BY store_id",
    "repl_connected": "SELECT count(*) AS n_peers, count(*) FILTER (c) AS n_connected FROM (SELECT store_id, node_id, bool_or(status = 'ok') AS c FROM apply_runs GROUP BY store_id, node_id)",
    "repl_divergence": "WITH " + _INGEST + """, x AS (SELECT store_id, "index", term, op, key, coalesce(value, '') AS value FROM n),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, "index" ORDER BY term DESC, op DESC, key DESC, value DESC) AS k FROM x) WHERE k = 1),
y AS (SELECT store_id, "index", term, CASE WHEN upper(op) IN ('PUT', 'SET') THEN 'PUT' ELSE 'DELETE' END AS op, key, CASE WHEN upper(op) IN ('PUT', 'SET') THEN value ELSE '' END AS value FROM repl_log),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, "index" ORDER BY term DESC, op DESC, key DESC, value DESC) AS k FROM y) WHERE k = 1)
SELECT coalesce(a.store_id, b.store_id) AS store_id, coalesce(a."index", b."index") AS "index", CASE WHEN a.k IS NULL THEN 'missing_leader' WHEN b.k IS NULL THEN 'missing_follower' ELSE 'differs' END AS problem
FROM a FULL JOIN b ON a.store_id = b.store_id AND a."index" = b."index" WHERE a.k IS NULL OR b.k IS NULL OR (a.term, a.op, a.key, a.value) IS DISTINCT FROM (b.term, b.op, b.key, b.value)""",
    "repl_frames": """WITH m AS (SELECT delivery_id, term, leader_commit, list_transform(coalesce(entries, []), lambda e: e.term || '|' || e."index" || '|' || CASE WHEN e.op = 'PUT' THEN '1' ELSE '2' END || '|' || strlen(e.key) || '|' || e.key || '|' || strlen(coalesce(e.value, '')) || '|' || coalesce(e.value, '')) AS t FROM repl_msgs)
SELECT delivery_id, coalesce(term, 0) || '|' || coalesce(leader_commit, 0) || '|' || len(t) || coalesce('|' || nullif(array_to_string(list_transform(t, lambda x: strlen(x) || '|' || x), '|'), ''), '') AS frame FROM m""",
    "repl_frames_read": "WITH " + _INGEST + """SELECT delivery_id, e.term AS term, e."index" AS "index", e.op AS op, e.key AS key, coalesce(e.value, '') AS value FROM m""",
    "lru_contents": _OPS + "SELECT key, max(seq) AS last_access FROM oplog GROUP BY key ORDER BY last_access DESC, key LIMIT 100",
    "latency_percentiles": " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS p, {_percent(p, 'value', 'events')} AS value" for p in ("0.5", "0.95", "0.99", "0.999")),
    "latency_summary": "SELECT 'min' AS stat, min(o_totalprice) AS value FROM orders UNION ALL SELECT 'mean', round(avg(o_totalprice), 6) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders UNION ALL "
    + " UNION ALL ".join(f"SELECT '{n}', {_percent(p, 'o_totalprice', 'orders')}" for n, p in (("p50", "0.5"), ("p95", "0.95"), ("p99", "0.99"), ("p999", "0.999"))),
    "op_rates": _OPS + "SELECT key, count(*) AS n_ops, count(*) FILTER (op = 'PUT') AS n_puts, count(*) FILTER (op = 'DELETE') AS n_deletes, count(*) FILTER (op = 'PUT') / count(*) AS put_share FROM oplog GROUP BY key",
    "op_throughput": "SELECT n AS n_ops, t AS millis, n * 1000.0 / t AS ops_per_second FROM (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS t FROM events)",
    "scaling": """WITH m AS (SELECT p_size AS threads, CAST(sum(p_partkey) AS DOUBLE) AS throughput FROM part GROUP BY p_size), b AS (SELECT max(throughput) AS one FROM m WHERE threads = 1)
SELECT threads, throughput, throughput / one AS speedup, throughput / one / threads AS efficiency FROM m, b""",
    "cmd_parse": _OPS + _LINES + "SELECT seq, verb, key, value FROM c",
    "cmd_replies": _OPS + _LINES + "SELECT seq, verb, key, success, message, value, CASE WHEN value IS NOT NULL THEN '+VALUE ' || value WHEN success THEN '+OK ' || message ELSE '-ERR ' || message END || chr(13) || chr(10) AS line FROM r",
    "cmd_follower_replies": _OPS + _LINES + "SELECT seq, verb = 'PING' AS success, CASE WHEN verb IN ('PUT', 'DELETE') THEN 'NOT_LEADER - Write to leader at port 9000' WHEN verb = 'GET' THEN 'NOT_FOUND' WHEN verb = 'PING' THEN 'PONG' ELSE 'UNKNOWN_COMMAND' END AS message FROM c",
    "cmd_read_replies": _OPS + _LINES + "SELECT seq, success, message, value FROM r",
    "cmd_calls": _OPS + """SELECT seq, CASE seq % 5 WHEN 0 THEN 'PUT' WHEN 1 THEN 'GET' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'FLUSH' ELSE 'ERROR' END AS verb,
CASE WHEN seq % 5 < 3 THEN key END AS key, CASE WHEN seq % 5 = 0 THEN 'x' || seq END AS value FROM oplog""",
}
