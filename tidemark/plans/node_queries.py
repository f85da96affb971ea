"""Queries over what a node does: stores through their life, native logs, caches, replicas, settings. And their SQL."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.operators import bloom, cache, dispatch, lww, replication, wal
from tidemark.plans.core_queries import _BYTES, _INGEST, _KV, _OPS, _SNAP
from tidemark.plans.store import Store
from tidemark.scratch import scratch_path, shared_dir
from tidemark.sources import binary, settings
from tidemark.sources.tables import event_oplog, table
from tidemark.streaming import live


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch_path(spark, "store"))


def _quarters(ops: DataFrame) -> list[DataFrame]:
    """The log in four parts, one after the other."""
    last = ops.agg(F.max("seq")).first()[0] or 0
    return [ops.where((F.col("seq") > last * n // 4) & (F.col("seq") <= last * (n + 1) // 4)).select(*_KV) for n in range(4)]


def kv_run_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of one run with their places in key order, as they are stored."""
    store = _store(spark)
    store.load(event_oplog(spark, folder).select(*_KV))
    return store.positions(store.state["runs"][0]["id"])


def kv_store_get(spark: SparkSession, folder: str) -> DataFrame:
    """One key looked up in a store of a log, runs of level 0 and files of level 1."""
    store, parts = _store(spark), _quarters(event_oplog(spark, folder))
    store.load(parts[0])
    store.compact(0)
    store.load(parts[1])
    store.load(parts[2])
    store.write(parts[3])
    return store.get("user:000042")


def kv_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """A log that is flushed once it is large: after the second and fourth quarter. Its runs."""
    store = _store(spark)
    for n, part in enumerate(_quarters(event_oplog(spark, folder))):
        store.write(part)
        store.flush_if_large(1 if n % 2 else 1 << 60)
    return store.manifest().select("level", "min_key", "max_key", "max_seq", "size_bytes", "n_rows")


def kv_deep_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """What lies in which level after a merge to level 1, from there to level 2, and one more run."""
    store, parts = _store(spark), _quarters(event_oplog(spark, folder))
    for part in parts[:3]:
        store.load(part)
    store.compact(0)
    store.compact(1, files=len(store.state["runs"]))
    store.load(parts[3])
    rows = [store._read([r["path"]]).withColumn("level", F.lit(r["level"])) for r in store.state["runs"]]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def kv_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """A store that is opened again after a crash: half its operations are only in the log."""
    store, parts = _store(spark), _quarters(event_oplog(spark, folder))
    store.load(parts[0].unionByName(parts[1]))
    store.write(parts[2])
    store.write(parts[3])
    again = Store(spark, store.path)
    return again.snapshot().withColumn("next_seq", F.lit(again.recover()).cast("long"))


def kv_clear(spark: SparkSession, folder: str) -> DataFrame:
    """A store that was cleared in between: what came before is gone."""
    store, parts = _store(spark), _quarters(event_oplog(spark, folder))
    store.load(parts[0])
    store.write(parts[1])
    store.clear()
    store.write(parts[2])
    store.load(parts[3])
    return store.snapshot()


def kv_stream_into_store(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream of four files, one a batch, each a run, compacted as it falls due."""
    source, target = scratch_path(spark, "stream"), _store(spark).path
    for n, part in enumerate(_quarters(event_oplog(spark, folder))):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = live.read_stream(spark, source, "key string, value string, seq long, op string", files_per_batch=1)
    live.run_available(stream, live.into_store(target, "events"), f"{target}-checkpoint")
    return Store(spark, target).snapshot()


def kv_manifest_file(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest").where("id = 10").select("id", "store_id", "level", "min_key", "max_key")


def kv_json_values(spark: SparkSession, folder: str) -> DataFrame:
    """JSON values in one spelling, other values as they are: every second key's value is cut short, so it is none."""
    rows = lww.snapshot(event_oplog(spark, folder))
    value = F.when(F.col("seq") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit("x"), "value"))
    return rows.select("key", wire.shown_value(value).alias("shown"))


def wal_native_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log written as a native log file and replayed from it, up to its first bad record."""
    path = scratch_path(spark, "log")
    ops = event_oplog(spark, folder).select(*_KV).withColumns({"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary")})
    # The checkpoint folder is shared by all tasks, which the writer asks to be told.
    binary.append_log(ops.repartition(4, "key"), urlsplit(path).path, shared=bool(shared_dir(spark)))
    read = binary.read_logs(spark, path)
    good = wal.replay(read, ~F.col("good"), "offset", ["path"])
    return good.select("seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "checksum")


def repl_contiguous_end(spark: SparkSession, folder: str) -> DataFrame:
    """The contiguous end of each store's log over all of its entries."""
    return replication.contiguous_end(replication.ingest(table(spark, folder, "repl_msgs")), ["store_id"])


def repl_planted_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """A follower that lost every seventh entry and changed the value of every eleventh, against its own full log."""
    whole = replication.follower_log(table(spark, folder, "repl_msgs").withColumn("entries", F.transform("entries", lambda e: e.withField("value", F.coalesce(e["value"], F.lit(""))))))
    value = F.when(F.col("index") % 11 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    damaged = whole.where("index % 7 <> 0").withColumn("value", value)
    return replication.divergence(whole, damaged)


def repl_shipped(spark: SparkSession, folder: str) -> DataFrame:
    """One batch shipped to two replicas that take it and one that fails: acknowledgements and rows there."""
    base, ops = scratch_path(spark, "replicas"), event_oplog(spark, folder).select(*_KV)
    peers = [f"{base}/a", f"{base}/b", "nosuch://replica/c"]
    live.to_replicas(peers, f"{base}/acks")(ops, 0)
    said = spark.read.schema("batch long, peer string, ack boolean").parquet(f"{base}/acks").select(F.element_at(F.split("peer", "/"), -1).alias("peer"), "ack")
    there = [spark.read.parquet(f"{p}/batch=0").agg(F.count("*").alias("n_rows")).withColumn("peer", F.lit(p[-1])) for p in peers[:2]]
    return said.join(there[0].unionByName(there[1]), "peer", "left").select("peer", "ack", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def cache_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Puts and invalidations of a cache that is never full."""
    op = F.when(F.col("op") == "PUT", "put").otherwise("invalidate")
    trace = event_oplog(spark, folder).select(F.lit(1).alias("cache"), "seq", op.alias("op"), "key")
    return cache.replay(trace, 1 << 40).select("seq", "outcome", "evicted")


def bloom_missed(spark: SparkSession, folder: str) -> DataFrame:
    """What doesn't depend on the hash: keys, bits, and that no key is missed."""
    return bloom.measure(table(spark, folder, "leader_sst").select("key"), table(spark, folder, "incoming_ops").select("key"), "key").select("n_keys", "n_bits", "missed", "n_others")


def node_status(spark: SparkSession, folder: str) -> DataFrame:
    r = replication.follower_state(table(spark, folder, "repl_msgs")).where("store_id = 1").first()
    return dispatch.status(spark, 2, "follower", r.term, r.commit_index, 3)


def cfg_unquoted(spark: SparkSession, folder: str) -> DataFrame:
    """Settings as they stand in a file: some in quotes, with blanks around."""
    ops = event_oplog(spark, folder)
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.lit('\t "'), "key", F.lit('" \r'))).when(F.col("seq") % 3 == 1, F.concat(F.lit('"'), "key")).otherwise(F.concat(F.lit(" "), "key", F.lit(" ")))
    return ops.select("seq", settings.unquoted(text).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        kv_run_positions, kv_store_get, kv_rotation, kv_deep_compaction, kv_recovery, kv_clear, kv_stream_into_store, kv_manifest_file, kv_json_values, wal_native_log,
        repl_contiguous_end, repl_planted_divergence, repl_shipped, cache_outcomes, bloom_missed, node_status, cfg_unquoted,
    )
}

_QUARTER = "(SELECT max(seq) FROM oplog)"
_ROTATED = """, q AS (SELECT *, CASE WHEN seq <= (SELECT max(seq) FROM oplog) * 2 // 4 THEN 0 ELSE 1 END AS half FROM oplog),
h AS (SELECT half, key, max_by(value, seq) AS value, max(seq) AS seq, max_by(op, seq) AS op FROM q GROUP BY half, key) """
_LATE = """, q AS (SELECT key, max_by(value, seq) AS value, max(seq) AS seq, max_by(op, seq) AS op FROM oplog WHERE seq {} {} GROUP BY key) """
# CRC-32 over the bytes of a record: its head, lowest bytes first, then key and value, which are ASCII here.
_CRC = """, t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
b AS (SELECT *, list_transform(range(8), lambda i: (seq >> (8 * i)) & 255) || [CASE WHEN op = 'PUT' THEN 1 ELSE 2 END] || list_transform(range(4), lambda i: (strlen(key) >> (8 * i)) & 255)
|| list_transform(range(4), lambda i: (strlen(value) >> (8 * i)) & 255) || list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)) || CASE WHEN value = '' THEN [] ELSE list_transform(string_split(value, ''), lambda x: CAST(ascii(x) AS BIGINT)) END AS bytes FROM oplog),
crc AS (SELECT seq, op, key, value, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(tab[CAST(xor(a, x) & 255 AS INTEGER) + 1], a >> 8)), 4294967295) AS checksum FROM b, t) """
_DISTANCES = """, r AS (SELECT key, seq, row_number() OVER (ORDER BY seq) AS i FROM oplog), a AS (SELECT *, lag(i) OVER (PARTITION BY key ORDER BY i) AS p FROM r),
d AS (SELECT a.key, a.seq, CASE WHEN a.p IS NOT NULL THEN count(b.i) END AS distance FROM a LEFT JOIN a b ON b.i > a.p AND b.i < a.i AND coalesce(b.p, 0) < a.p GROUP BY a.key, a.seq, a.p),
j AS (SELECT key, seq, distance, coalesce(distance < 100, false) AS hit FROM d) """

SQL = {
    "kv_run_positions": _OPS + "SELECT row_number() OVER (ORDER BY key) - 1 AS position, key, value, seq, op FROM lww",
    "kv_store_get": _OPS + _SNAP + " AND key = 'user:000042'",
    "kv_rotation": _OPS + _ROTATED + f"SELECT 0 AS level, min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq, CAST(sum({_BYTES}) AS BIGINT) AS size_bytes, count(*) AS n_rows FROM h GROUP BY half",
    "kv_deep_compaction": _OPS + _LATE.format("<=", f"{_QUARTER} * 3 // 4") + ", z" + _LATE.format(">", f"{_QUARTER} * 3 // 4")[3:] + "SELECT 2 AS level, key, value, seq, op FROM q WHERE op = 'PUT' UNION ALL SELECT 0, key, value, seq, op FROM z",
    "kv_recovery": _OPS + "SELECT key, value, seq, (SELECT max(seq) + 1 FROM oplog) AS next_seq FROM lww WHERE op = 'PUT'",
    "kv_clear": _OPS + _LATE.format(">", f"{_QUARTER} * 2 // 4") + "SELECT key, value, seq FROM q WHERE op = 'PUT'",
    "kv_stream_into_store": _OPS + _SNAP,
    "kv_manifest_file": "SELECT id, store_id, level, min_key, max_key FROM manifest WHERE id = 10",
    "kv_json_values": _OPS + "SELECT key, CASE WHEN seq % 2 = 0 THEN CAST(json(value) AS VARCHAR) ELSE 'x' || value END AS shown FROM lww WHERE op = 'PUT'",
    "wal_native_log": _OPS + _CRC + "SELECT seq, op, key, value, checksum FROM crc",
    "wal_checksums": _OPS + _CRC + "SELECT seq, checksum FROM crc",
    "repl_contiguous_end": "WITH " + _INGEST + """, d AS (SELECT DISTINCT store_id, "index" FROM n), s AS (SELECT store_id, "index", row_number() OVER (PARTITION BY store_id ORDER BY "index") AS k FROM d)
SELECT store_id, coalesce(max(CASE WHEN k = "index" THEN k END), 0) AS applied FROM s GROUP BY store_id""",
    "repl_planted_divergence": "WITH " + _INGEST + """, d AS (SELECT DISTINCT store_id, "index" FROM n)
SELECT store_id, "index", CASE WHEN "index" % 7 = 0 THEN 'missing_follower' ELSE 'differs' END AS problem FROM d WHERE "index" % 7 = 0 OR "index" % 11 = 0""",
    "repl_shipped": "SELECT p AS peer, p <> 'c' AS ack, CASE WHEN p = 'c' THEN 0 ELSE (SELECT count(*) FROM events) END AS n_rows FROM (SELECT unnest(['a', 'b', 'c']) AS p)",
    "cache_outcomes": _OPS + """SELECT seq, CASE WHEN op = 'PUT' THEN CASE WHEN was = 'PUT' THEN 'updates' ELSE 'inserts' END WHEN was = 'PUT' THEN 'removes' ELSE 'absent' END AS outcome, CAST(NULL AS VARCHAR) AS evicted
FROM (SELECT seq, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS was FROM oplog)""",
    "lru_hits": _OPS + _DISTANCES + "SELECT key, seq, distance, hit FROM j",
    "lru_hit_rate": _OPS + _DISTANCES + "SELECT count(*) AS n_accesses, count(*) FILTER (hit) AS n_hits, count(*) FILTER (hit) / count(*) AS hit_rate FROM j",
    "bloom_missed": """WITH k AS (SELECT DISTINCT key FROM leader_sst WHERE key IS NOT NULL), o AS (SELECT DISTINCT key FROM incoming_ops WHERE key IS NOT NULL)
SELECT (SELECT count(*) FROM k) AS n_keys, CAST(floor(-(SELECT count(*) FROM k) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS n_bits, CAST(0 AS BIGINT) AS missed, (SELECT count(*) FROM o WHERE key NOT IN (SELECT key FROM k)) AS n_others""",
    "node_status": """WITH s AS (SELECT max(term) AS term, coalesce(max(leader_commit), 0) AS c FROM repl_msgs WHERE store_id = 1)
SELECT 2 AS node_id, 'FOLLOWER' AS role, term, c AS commit_index, 3 AS connections, 'Node ID: 2' || chr(10) || 'Role: FOLLOWER' || chr(10) || 'Term: ' || term || chr(10) || 'Commit Index: ' || c || chr(10) || 'Active Connections: 3' AS text FROM s""",
    "cfg_unquoted": _OPS + "SELECT seq, CASE WHEN seq % 3 = 1 THEN '\"' || key ELSE key END AS value FROM oplog",
}
