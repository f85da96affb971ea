"""Queries p1 to p4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changefeed, delivery, incremental, reconcile
from tidemark.operators.feedstore import FeedStore
from tidemark.scratch import scratch_path
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.surplus_copies(table(spark, folder, "repl_msgs"), unnamed=True)


def p1_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.accepted_entries(table(spark, folder, "repl_msgs"), unnamed=True)


def p1_entries(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.delivered_once(table(spark, folder, "repl_msgs"))


def p1_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.seen_ranges(table(spark, folder, "repl_msgs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    marks = incremental.watermarks(table(spark, folder, "apply_runs"), table(spark, folder, "manifest"))
    runs = incremental.RunStore(spark, scratch_path(spark, "p2"))
    return runs.output(runs.run(table(spark, folder, "repl_log"), marks)).select("store_id", "node_id", "index")


def p2_increments(spark: SparkSession, folder: str) -> DataFrame:
    """Four runs as the feed grows by quarters; the second one's first attempt dies, and node 2 appears with the third."""
    marks = incremental.watermarks(table(spark, folder, "apply_runs"), table(spark, folder, "manifest"))
    log, runs = table(spark, folder, "repl_log"), incremental.RunStore(spark, scratch_path(spark, "p2"))
    last, parts = log.agg(F.max("feed_pos")).first()[0] or 0, []
    for n in range(1, 5):
        so_far, followers = log.where(F.col("feed_pos") <= last * n // 4), marks if n > 2 else marks.where("node_id <> 2")
        if n == 2:
            try:
                runs.run(so_far, followers, fail_before_commit=True)
            except RuntimeError:
                pass
        parts.append(runs.output(runs.run(so_far, followers)).select(F.lit(n).alias("run"), "store_id", "node_id", "index", "term"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def p2_watermarks(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.watermarks(table(spark, folder, "apply_runs"), table(spark, folder, "manifest"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.live_rows(table(spark, folder, "repl_log")).select("store_id", "key", "index")


def p3_state(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.live_rows(table(spark, folder, "repl_log"))


def p3_increments(spark: SparkSession, folder: str) -> DataFrame:
    """The live keys after five increments in order of arrival, each with half of the one before again."""
    feed, store = table(spark, folder, "repl_log"), FeedStore(spark, scratch_path(spark, "p3"))
    last = feed.agg(F.max("feed_pos")).first()[0] or 0
    for n in range(1, 6):
        store.apply(feed.where((F.col("feed_pos") > last * (2 * n - 3) // 10) & (F.col("feed_pos") <= last * n // 5)), batch=("repl_log", n))
    return store.live()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.differences(table(spark, folder, "leader_sst"), table(spark, folder, "follower_sst"))


def p4_summary(spark: SparkSession, folder: str) -> DataFrame:
    return p4_found(spark, folder).groupBy("store_id", "field").agg(F.count("*").alias("n_cases"))


QUERIES = {f.__name__: f for f in (p1_found, p1_accepted, p1_entries, p1_ranges, p2_found, p2_increments, p2_watermarks, p3_found, p3_state, p3_increments, p4_found, p4_summary)}

_COPIES = """WITH e AS (SELECT delivery_id, store_id, unnest(generate_series(0, len(entries) - 1)) AS p, entries FROM repl_msgs WHERE len(entries) > 0),
c AS (SELECT delivery_id, CAST(p AS INTEGER) AS pos, store_id, entries[p + 1].term AS term, entries[p + 1]."index" AS "index" FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY store_id, term, "index" ORDER BY delivery_id, pos) AS n FROM c) """
_FORCE = """WITH f AS (SELECT store_id, "index", max_by(seq, term) AS seq, max(term) AS term, max_by(key, term) AS key,
max_by(upper(op) IN ('PUT', 'SET'), term) AS put, max_by(coalesce(value, ''), term) AS value FROM repl_log GROUP BY store_id, "index"), """
_MARKS = """o AS (SELECT store_id, node_id, max(CASE WHEN status = 'ok' THEN run_id END) AS run_id FROM apply_runs GROUP BY store_id, node_id),
a AS (SELECT DISTINCT run_id, file_id, hi_term FROM apply_runs WHERE status = 'ok'),
w AS (SELECT o.store_id, o.node_id, coalesce(m.max_seq, -4611686018427387904) AS max_seq, coalesce(a.hi_term, -4611686018427387904) AS hi_term
FROM o LEFT JOIN a ON a.run_id = o.run_id LEFT JOIN manifest m ON m.id = a.file_id) """
_CASES = """WITH l AS (SELECT DISTINCT store_id, key, value, seq, op FROM leader_sst), f AS (SELECT DISTINCT store_id, key, value, seq, op FROM follower_sst),
j AS (SELECT coalesce(l.store_id, f.store_id) AS store_id, coalesce(l.key, f.key) AS key, l.key IS NULL AS nl, f.key IS NULL AS nf,
l.value IS DISTINCT FROM f.value AS dv, l.seq IS DISTINCT FROM f.seq AS ds, l.op IS DISTINCT FROM f.op AS dp
FROM l FULL JOIN f ON l.store_id = f.store_id AND l.key = f.key),
c AS (SELECT store_id, key, 'missing_leader' AS field FROM j WHERE nl UNION ALL SELECT store_id, key, 'missing_follower' FROM j WHERE nf
UNION ALL SELECT store_id, key, 'value' FROM j WHERE NOT nl AND NOT nf AND dv UNION ALL SELECT store_id, key, 'seq' FROM j WHERE NOT nl AND NOT nf AND ds
UNION ALL SELECT store_id, key, 'op' FROM j WHERE NOT nl AND NOT nf AND dp) """
_LIVE = """g AS (SELECT store_id, key, max("index") AS "index", max_by(put, "index") AS put, max_by(value, "index") AS value FROM f GROUP BY store_id, key) """

SQL = {
    "p1_found": _COPIES + "SELECT delivery_id, pos FROM r WHERE n > 1",
    "p1_accepted": _COPIES + 'SELECT store_id, term, "index", delivery_id, pos FROM r WHERE n = 1',
    "p1_entries": _COPIES + """SELECT r.store_id, r.delivery_id, r.pos, r.term, r."index", m.entries[r.pos + 1].op AS op, m.entries[r.pos + 1].key AS key, m.entries[r.pos + 1].value AS value
FROM r JOIN repl_msgs m ON m.delivery_id = r.delivery_id WHERE r.n = 1""",
    "p1_ranges": _COPIES
    + """, i AS (SELECT store_id, term, "index", "index" - row_number() OVER (PARTITION BY store_id, term ORDER BY "index") AS island FROM r WHERE n = 1)
SELECT store_id, term, min("index") AS lo, max("index") AS hi FROM i GROUP BY store_id, term, island""",
    "p2_found": _FORCE + _MARKS + 'SELECT w.store_id, w.node_id, f."index" FROM w JOIN f ON f.store_id = w.store_id WHERE f.seq > w.max_seq OR f.term > w.hi_term',
    "p2_increments": """WITH u AS (SELECT run, (SELECT max(feed_pos) FROM repl_log) * run // 4 AS upto, (SELECT max(feed_pos) FROM repl_log) * (run - 1) // 4 AS since FROM (SELECT unnest([1, 2, 3, 4]) AS run)),
f AS (SELECT run, since, store_id, "index", term, seq, feed_pos, row_number() OVER (PARTITION BY run, store_id, "index" ORDER BY term DESC, feed_pos) AS n FROM repl_log JOIN u ON feed_pos <= upto), """ + _MARKS
    + """SELECT f.run, w.store_id, w.node_id, f."index", f.term FROM w JOIN f ON f.store_id = w.store_id AND f.n = 1
WHERE CASE WHEN f.run = (CASE w.node_id WHEN 2 THEN 3 ELSE 1 END) THEN f.seq > w.max_seq OR f.term > w.hi_term WHEN f.run > (CASE w.node_id WHEN 2 THEN 3 ELSE 1 END) THEN f.feed_pos > f.since ELSE false END""",
    "p2_watermarks": "WITH " + _MARKS + "SELECT store_id, node_id, max_seq, hi_term FROM w",
    "p3_found": _FORCE + _LIVE + 'SELECT store_id, key, "index" FROM g WHERE put',
    "p3_state": _FORCE + _LIVE + 'SELECT store_id, key, "index", value FROM g WHERE put',
    "p3_increments": _FORCE + _LIVE + 'SELECT store_id, key, "index", value FROM g WHERE put',
    "p4_found": _CASES + "SELECT store_id, key, field FROM c",
    "p4_summary": _CASES + "SELECT store_id, field, count(*) AS n_cases FROM c GROUP BY store_id, field",
}
