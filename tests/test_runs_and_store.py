import random

import pytest

from tidemark.operators import lww, runs
from tidemark.plans.store import Store

OPLOG = "key string, value string, seq long, op string"
MANIFEST = "id long, level int, min_key string, max_key string, max_seq long, size_bytes long, s int"


def ops(spark, items, start=1):
    return spark.createDataFrame([(k, v, start + i, "DELETE" if v is None else "PUT") for i, (k, v) in enumerate(items)], OPLOG)


def test_sizes_and_index(spark, rows):
    assert rows(runs.memtable_size(ops(spark, [("ab", "cd")]))) == [(21, 1)]
    assert rows(runs.memtable_size(ops(spark, [("ab", "cd"), ("ab", None)]))) == [(19, 1)]
    assert rows(runs.memtable_size(ops(spark, []))) == [(0, 0)]
    from pyspark.sql import functions as F

    run = ops(spark, [(f"key{i:03d}", "é") for i in range(40)]).withColumn("flush_id", F.lit(1))
    size = 17 + 6 + 2
    assert rows(runs.sparse_index(run)) == [(1, "key000", 0), (1, "key016", 16 * size), (1, "key032", 32 * size)]
    assert rows(runs.run_meta(run)) == [(1, "key000", "key039", 40, 40 * size, 40)]


def test_compaction_choice(spark, rows):
    files = [(1, 0, "a", "f", 1, 5 << 20, 1), (2, 0, "c", "k", 1, None, 1), (3, 1, "a", "b", 1, 6 << 20, 1), (4, 1, "m", "z", 1, 6 << 20, 1), (5, 2, "a", "a", 1, 1, 1), (6, 2, "c", "d", 1, 1, 1)]
    m = spark.createDataFrame(files, MANIFEST)
    assert rows(runs.compaction_due(m)) == [(0, 2, 5 << 20, False), (1, 2, 12 << 20, True), (2, 2, 2, False)]
    assert rows(runs.compaction_inputs(m, ["s"]), "source_level", "id") == [(0, 1), (0, 2), (0, 3), (1, 3), (1, 5), (2, 5)]
    assert rows(runs.may_hold(m, "d"), "id") == [(1,), (2,), (6,)]
    assert rows(runs.without(m, m.where("level = 0")), "id") == [(3,), (4,), (5,), (6,)]
    assert rows(runs.amplification(ops(spark, [("a", "1"), ("a", "2"), ("b", None)]))) == [(3, 1, 3.0, pytest.approx(66.6666667))]
    assert rows(runs.amplification(ops(spark, []))) == [(0, 0, None, None)]


def test_store_life(spark, rows, tmp_path):
    """Random operations against a dict, through flushes, compactions of all levels, and reopening."""
    r, state, seq = random.Random(5), {}, 0
    store = Store(spark, f"file://{tmp_path}/store")
    for step in range(5):
        items = [(f"k{r.randrange(40):02d}", r.choice([None, "", f"v{step}"])) for _ in range(30)]
        store.write(ops(spark, items, seq + 1))
        seq += len(items)
        for k, v in items:
            state.pop(k, None) if v is None else state.__setitem__(k, v)
        if step != 4:
            store.flush()
        if step == 2:
            store.compact(0)
            store.compact(1)
    want = sorted(state.items())
    assert rows(store.snapshot(), "key", "value") == want
    again = Store(spark, f"file://{tmp_path}/store")
    assert rows(again.snapshot(), "key", "value") == want and again.recover() == seq + 1 == again.state["next_seq"]
    assert {r["level"] for r in again.state["runs"]} == {0, 2}
    again.compact(0)  # above level 2: removals must stay
    assert rows(again.snapshot(), "key", "value") == want
    again.compact(1)  # to the bottom: they go
    assert again._read([x["path"] for x in again.state["runs"] if x["level"] == 2]).where("op = 'DELETE'").isEmpty()
    assert rows(again.snapshot(), "key", "value") == want
    k = want[0][0]
    assert rows(again.get(k), "key", "value") == [want[0]]
    assert rows(again.scan("k10", "k20"), "key") == [(x,) for x, _ in want if "k10" <= x <= "k20"]
    with pytest.raises(RuntimeError):  # another writer was faster
        store.put("x", "y")
    version = again.version
    assert again.delete(k) and not again.delete("none")
    assert again.get(k).isEmpty() and rows(Store(spark, again.path, version).get(k), "value") == [(want[0][1],)]
    assert ("memtable", "none", "<TOMBSTONE>") in rows(again.listing(), "source", "key", "value")
    again.clear()
    assert again.snapshot().isEmpty()
    assert again.vacuum(keep=1) and again.vacuum(keep=1) == []


def test_deleted_key_does_not_come_back(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put("key1", "old")
    store.flush(), store.compact(0), store.compact(1)
    assert [r["level"] for r in store.state["runs"]] == [2]
    store.delete("key1")
    store.flush(), store.compact(0)
    assert sorted(r["level"] for r in store.state["runs"]) == [1, 2] and store.get("key1").isEmpty()
    store.compact(1)  # nothing is left, and the inputs are gone all the same
    assert store.state["runs"] == [] and store.snapshot().isEmpty()


def test_triggers_and_numbering(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t")
    for i in range(4):
        store.put(f"key{i}", "v")
        store.flush()
    store.pause()
    assert store.compact_due() == 0
    store.resume()
    assert store.compact_due() == 1 and len(store.state["runs"]) == 1
    store.flush_if_large()
    batch = spark.createDataFrame([("n2", "v", "PUT", 20), ("n1", None, "PUT", 10), ("key0", "x", "DELETE", 30)], "key string, value string, op string, at long")
    store.write(batch, order="at", batch=("stream", 0))
    store.write(batch, order="at", batch=("stream", 0))
    assert rows(store.memtable()) == [("key0", "", 7, "DELETE"), ("n1", "", 5, "PUT"), ("n2", "v", 6, "PUT")]


def test_load_is_write_and_flush(spark, rows, tmp_path):
    data = ops(spark, [("a", "1"), ("b", "2"), ("a", None), ("c", "")])
    one, two = Store(spark, f"file://{tmp_path}/one"), Store(spark, f"file://{tmp_path}/two")
    one.write(data)
    one.flush()
    two.load(data, batch=("s", 0))
    two.load(data, batch=("s", 0))
    facts = lambda s: [{k: v for k, v in r.items() if k != "path"} for r in s.state["runs"]]
    assert facts(one) == facts(two) and rows(one.rows()) == rows(two.rows()) and one.state["next_seq"] == two.state["next_seq"] == 5
    two.load(data.limit(0))
    with pytest.raises(Exception, match="NULL keys"):
        two.load(ops(spark, [(None, "x")], 9))
    assert len(two.state["runs"]) == 1


def test_broken_segment_is_replayed_to_the_first_bad_record(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/b")
    store.write(ops(spark, [("a", "1"), ("b", "2"), ("c", "3")]))
    name = store.state["segments"][0]
    bad = spark.read.parquet(f"{store.path}/{name}").selectExpr("key", "if(seq = 2, 'X', value) value", "seq", "op", "checksum").collect()
    spark.createDataFrame(bad, OPLOG + ", checksum long").write.mode("overwrite").parquet(f"{store.path}/{name}")
    spark.catalog.clearCache()
    assert rows(Store(spark, store.path).snapshot(), "key") == [("a",)]


def test_lww_of_runs_is_their_merge(spark, rows):
    a, b = ops(spark, [("a", "1"), ("b", "1")]), ops(spark, [("a", None), ("c", "2")], 3)
    assert rows(lww.merge_runs(a, b)) == [("a", None, 3, "DELETE"), ("b", "1", 2, "PUT"), ("c", "2", 4, "PUT")]


def test_compaction_writes_files_that_do_not_meet(spark, rows, tmp_path, monkeypatch):
    from tidemark.plans import store as module

    monkeypatch.setattr(module, "FILE_BYTES", 800)
    monkeypatch.setattr(runs, "LEVEL_BYTES", {1: 2000, 2: 100 << 20})
    store, r, state = Store(spark, f"file://{tmp_path}/f"), random.Random(3), {}
    for step in range(4):
        items = [(f"k{r.randrange(200):03d}", f"v{step}" if r.random() < 0.8 else None) for _ in range(60)]
        store.load(ops(spark, items, 1 + 60 * step))
        state |= dict(items)
    assert store.due_levels() == [0] and not store.wait_for_compaction(0.1)
    store.compact(0)
    level = [x for x in store.state["runs"] if x["level"] == 1]
    assert len(level) > 2 and all(a["max_key"] < b["min_key"] for a, b in zip(level, level[1:])) and sum(x["n_rows"] for x in level) == sum(v is not None for v in state.values())
    want = sorted((k, v) for k, v in state.items() if v is not None)
    assert rows(store.snapshot(), "key", "value") == want
    first = level[0]
    assert [x.key for x in store.pull(first["id"])] == sorted(k for k, _ in want if k <= first["max_key"]) and store.file(first["id"]) == first and store.file(-1) is None
    assert [(x.key, x.value) for x in store.pull()] == want
    # A merge of a narrow run rewrites only the files it meets.
    store.load(ops(spark, [(level[1]["min_key"], "new")], 1000))
    store.compact(0)
    kept = {x["id"] for x in store.state["runs"]}
    assert {x["id"] for x in level} - kept == {level[1]["id"]}
    assert store.compact_due() == 1 and store.wait_for_compaction(0.1)  # as many files as are over the limit, in one go
    assert rows(store.snapshot(), "key", "value") == sorted((dict(want) | {level[1]["min_key"]: "new"}).items())
    store.pause()
    assert Store(spark, store.path).paused and Store(spark, store.path).compact_due() == 0
    Store(spark, store.path).resume()
    store = Store(spark, store.path)
    (tmp_path / "f/runs/run_of_a_failed_write").mkdir()
    assert "runs/run_of_a_failed_write" in store.vacuum(keep=1, unfinished=True)
    assert rows(store.snapshot(), "key", "value") == sorted((dict(want) | {level[1]["min_key"]: "new"}).items()) and store.log.numbers() == [store.version]
