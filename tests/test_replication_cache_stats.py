import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bloom, cache, replication, stats
from tidemark.streaming import live

LOG = "store_id int, term long, index long, op string, key string, value string"


def log(spark, items):
    return spark.createDataFrame([(s, 1, i, "PUT", f"k{i}", "v") for s, i in items], LOG)


def test_prefix(spark, rows):
    size = 1 << replication.BLOCK_BITS
    items = [(1, i) for i in (1, 2, 3, 3, 5)] + [(2, 2)] + [(3, 1)] + [(5, None), (5, 0)]
    many = spark.range(1, size + 11).where(f"id <> {size + 5}").selectExpr("4 store_id", "1L term", "id index", "'PUT' op", "'k' key", "'v' value")
    exact = spark.range(1, size + 1).selectExpr("6 store_id", "1L term", "id index", "'PUT' op", "'k' key", "'v' value")
    df = log(spark, items).unionByName(many).unionByName(exact)
    assert rows(replication.contiguous_end(df, ["store_id"])) == [(1, 3), (2, 0), (3, 1), (4, size + 4), (5, 0), (6, size)]
    commits = spark.createDataFrame([(1, 2), (2, 9), (4, size + 2)], "store_id int, commit_index long")
    applied = replication.applied_prefix(df, commits, ["store_id"])
    assert rows(applied.groupBy("store_id").max("index")) == [(1, 2), (4, size + 2)]
    assert rows(replication.applied_prefix(df, commits, ["store_id"], after=size + 1), "index") == [(size + 2,)]
    assert replication.contiguous_end(log(spark, []), ["store_id"]).isEmpty()


def test_numbering(spark, rows):
    r = random.Random(1)
    at = r.sample(range(1_000_000), 200)
    df = spark.createDataFrame([(a % 2, a) for a in at], "s int, at long")
    want = [(s, a, i + 11) for s in (0, 1) for i, a in enumerate(sorted(x for x in at if x % 2 == s))]
    assert rows(replication.assign_index(df, ["s"], "at", last=10)) == sorted(want, key=repr)
    assert rows(replication.assign_index(df, [], "at"), "index") == sorted([(i + 1,) for i in range(200)], key=repr)


def test_follower(spark, rows):
    entry = "array<struct<term: long, index: long, op: string, key: string, value: string>>"
    m = spark.createDataFrame([(1, 1, 3, [(1, 1, "PUT", "a", "x"), (1, 2, "PUT", "b", "y")]), (1, 2, None, [(2, 2, "DELETE", "b", None)]), (2, 1, None, None)], f"store_id int, term long, leader_commit long, entries {entry}")
    assert rows(replication.follower_state(m)) == [(1, 2, 3), (2, 1, 0)]
    assert rows(replication.follower_log(m), "index", "term", "op") == [(1, 1, "PUT"), (2, 2, "DELETE")]
    other = log(spark, [(1, 1), (1, 9)])
    assert rows(replication.divergence(replication.follower_log(m), other.drop("x"))) == [(1, 1, "differs"), (1, 2, "missing_follower"), (1, 9, "missing_leader")]
    ships = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (3, None, None)], "i int, peer int, ack boolean")
    assert rows(replication.acknowledged(ships, ["i"])) == [(1, 2, 1, True), (2, 1, 0, False), (3, 0, 0, True)]
    assert rows(replication.connected(spark.createDataFrame([(True,), (False,), (None,)], "connected boolean"))) == [(3, 1)]


def lru(trace, capacity):
    held, out = OrderedDict(), []
    for k, t in trace:
        distance = list(reversed(held)).index(k) if k in held else None
        held.pop(k, None)
        held[k] = t
        out.append((k, t, distance, distance is not None and distance < capacity))
    return out, held


def test_cache_against_a_real_one(spark, rows, monkeypatch):
    r = random.Random(4)
    trace = [(f"k{min(r.randrange(60), r.randrange(60))}", 3 * t + r.randrange(3)) for t in range(1500)]
    want, held = lru(trace, 10)
    df = spark.createDataFrame(trace, "key string, seq long").repartition(3)
    assert rows(cache.hits(df, 10)) == sorted(want, key=repr)
    monkeypatch.setattr(cache, "LEAST_SLICE", 16)  # many slices
    judged = cache.hits(df, 10)
    assert rows(judged) == sorted(want, key=repr)
    n = sum(w[3] for w in want)
    assert rows(cache.hit_rate(judged)) == [(1500, n, n / 1500)]
    assert rows(cache.contents(df, 10)) == sorted([(k, t) for k, t in list(held.items())[-10:]], key=repr)
    assert cache.hits(df.limit(0)).isEmpty() and cache.contents(df.limit(0)).isEmpty()


def test_cache_cases(spark, rows):
    trace = lambda ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "key string, seq long")
    assert rows(cache.contents(trace("12314"), 3), "key") == [("1",), ("3",), ("4",)]
    assert rows(cache.contents(trace("01234432105"), 5), "key") == [("0",), ("1",), ("2",), ("3",), ("5",)]


def test_percentiles(spark, rows):
    df = spark.range(1, 1001).selectExpr("id * 1.0D v")
    assert rows(stats.percentiles(df, "v")) == [(0.5, 501.0), (0.95, 951.0), (0.99, 991.0), (0.999, 1000.0)]
    r = random.Random(3)
    xs = [r.choice([1.0, 2.5, r.random() * 100, -7.0]) for _ in range(777)] + [None]
    vs = sorted(x for x in xs if x is not None)
    got = dict(rows(stats.percentiles(spark.createDataFrame([(x,) for x in xs], "v double"), "v")))
    assert got == {p: vs[min(int(len(vs) * p), len(vs) - 1)] for p in stats.PERCENTILES}
    one = spark.createDataFrame([(5.0,)], "v double")
    assert {v for _, v in rows(stats.percentiles(one, "v"))} == {5.0}
    assert rows(stats.latency_summary(one.limit(0), "v")) == []


def test_percentiles_of_skewed_values(spark, rows):
    df = spark.range(20_000).selectExpr("if(id = 7, 1e12, id * 1e-3) v").repartition(3)
    vs = sorted([1e12] + [i * 1e-3 for i in range(20_000) if i != 7])
    assert dict(rows(stats.percentiles(df, "v"))) == {p: vs[int(20_000 * p)] for p in stats.PERCENTILES}


def test_counting_by_merging():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 500, 3000):
        v = r.integers(0, n // 2 + 1, n)
        assert cache.smaller_before(v).tolist() == [int((v[:i] < v[i]).sum()) for i in range(n)]


def test_cache_replay(spark, rows):
    r, trace, held = random.Random(5), [], {1: OrderedDict(), None: OrderedDict()}
    want = []
    for i in range(600):
        c, op, k = r.choice([1, None]), r.choice(["get", "PUT", "put", "invalidate", "what"]), r.choice([None, *"abcdef"])
        trace.append((c, i, op, k))
        h, out, said = held[c], None, {"get": ("miss", "hit"), "put": ("inserts", "updates"), "invalidate": ("absent", "removes"), "what": ("unknown",) * 2}[op.lower()][k in held[c]]
        if op == "invalidate":
            h.pop(k, None)
        elif op.lower() == "put" or op == "get" and k in h:
            h.pop(k, None)
            h[k] = i
            if len(h) > 3:
                out = h.popitem(last=False)[0]
        want.append((c, i, said, out))
    df = spark.createDataFrame([*trace, (1, None, "get", "a")], "cache int, seq long, op string, key string").repartition(5)
    assert rows(cache.replay(df, 3)) == sorted(want, key=repr)
    assert rows(cache.replay(df.limit(0), 3)) == []


def test_scaling(spark, rows):
    df = spark.createDataFrame([(1, 10.0), (4, 30.0)], "threads int, throughput double")
    assert rows(stats.scaling(df)) == [(1, 10.0, 1.0, 1.0), (4, 30.0, 3.0, 0.75)]


def test_bloom(spark, rows, monkeypatch):
    keys = spark.range(1000).selectExpr("concat('key', id) k")
    others = spark.range(10_000).selectExpr("concat('other', id) k").unionByName(spark.createDataFrame([(None,)], "k string"))
    r = bloom.measure(keys, others, "k").first()
    assert (r.n_keys, r.n_others, r.missed) == (1000, 10_000, 0) and r.false_positives < 300
    assert [bloom.sized(n)[0] for n in (0, 1000, 2000)] == [1, 9585, 19170] and bloom.sized(1000, 0.001)[0] > 9585
    m, k = bloom.sized(10)
    none = bloom.build(keys.limit(0), "k", m, k)
    assert rows(bloom.probe(keys.limit(2), "k", none, m, k), "maybe") == [(False,), (False,)]
    m, k = bloom.sized(1000)
    filled, asked = bloom.build(keys, "k", m, k), keys.unionByName(others).withColumn("maybe2", F.lit(1))
    sent = rows(bloom.probe(asked, "k", filled, m, k))
    again, *sizes = bloom.load(spark, bloom.dump(filled, m, k))
    assert sizes == [m, k] and rows(again) == rows(filled)
    monkeypatch.setattr(bloom, "MAX_BITS", 1)  # too large to send: joined
    assert rows(bloom.probe(asked, "k", filled, m, k)) == sent


def test_streams(spark, rows, tmp_path):
    schema = "key string, value string, seq long, op string"
    write = lambda items: spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    from tidemark.plans.store import Store

    path, states = f"file://{tmp_path}/store", []
    sink = live.into_store(path, "s")
    collect = lambda batch, n: states.append({r.key: (r.value, r.seq) for r in batch.collect()})
    for items in ([("a", "1", 1, "PUT"), ("b", "2", 2, "PUT")], [("b", "old", 0, "PUT"), ("a", "", 3, "DELETE")]):
        write(items)
        live.run_available(live.read_stream(spark, f"{tmp_path}/in", schema), sink, f"{tmp_path}/c1")
        live.run_available(live.live_state(live.read_stream(spark, f"{tmp_path}/in", schema)), collect, f"{tmp_path}/c2", "update")
    assert rows(Store(spark, path).snapshot()) == [("b", "2", 2)]
    assert states[0] == {"a": ("1", 1), "b": ("2", 2)} and states[1] == {"a": ("", 3), "b": ("2", 2)}
    before = Store(spark, path).version
    sink(spark.createDataFrame([("z", "1", 9, "PUT")], schema), 1)  # a batch that was committed comes again
    assert rows(Store(spark, path).snapshot(), "key") == [("b",)] and Store(spark, path).version == before
    live.run_available(live.read_stream(spark, f"{tmp_path}/in", schema, 1), live.to_replicas([f"{tmp_path}/r1", f"{tmp_path}/r2"]), f"{tmp_path}/c3")
    assert spark.read.parquet(f"{tmp_path}/r1").count() == spark.read.parquet(f"{tmp_path}/r2").count() == 4


def test_replicas_that_fail(spark, rows, tmp_path):
    batch = spark.range(3)
    (tmp_path / "bad").write_text("no folder")
    good, bad, acks = f"file://{tmp_path}/good", f"file://{tmp_path}/bad", f"file://{tmp_path}/acks"
    live.to_replicas([bad, good], acks)(batch, 0)
    live.to_replicas([], acks)
    said = spark.read.schema("batch long, peer string, ack boolean").parquet(acks)
    assert rows(said, "batch", "peer", "ack") == [(0, bad, False), (0, good, True)]
    assert rows(replication.acknowledged(said.withColumn("s", F.lit(1)), ["s"])) == [(1, 2, 1, True)]
    with pytest.raises(Exception, match="bad"):
        live.to_replicas([bad])(batch, 1)
    (tmp_path / "bad").unlink()
    assert live.catch_up(spark, acks) == 1 and live.catch_up(spark, acks) == 0
    assert rows(spark.read.parquet(f"{bad}/batch=0")) == rows(batch)


def test_prefix_end_goes_by_gaps_alone(spark, rows, tmp_path):
    from tidemark.plans import registry

    entry = "array<struct<term: long, index: long, op: string, key: string, value: string>>"
    put = lambda indexes: [(1, i, "PUT", f"k{i}", "v") for i in indexes]
    # Store 1 holds all of 1 to 500, in two orders; store 2 lacks 300, store 3 lacks 1, store 4 lacks 211.
    messages = [(1, put(range(400, 501))), (1, put(range(1, 420))), (2, put(range(301, 400))), (2, put(range(1, 300))), (3, put(range(2, 9))), (4, put([*range(1, 211), 212])), (4, None)]
    spark.createDataFrame(messages, f"store_id int, entries {entry}").write.parquet(f"file://{tmp_path}/repl_msgs.parquet")
    assert rows(registry.QUERIES["repl_prefix_end"](spark, f"file://{tmp_path}")) == [(1, 500), (2, 299), (3, 0), (4, 210)]
