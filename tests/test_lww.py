import random

import pytest

from tidemark.operators import lww

OPLOG = "key string, value string, seq long, op string, extra string, best int"
# The behaviours of a keyed store, as logs and the state they leave.
CASES = {
    "put": ([("user42", "123", "PUT")], {"user42": "123"}),
    "overwrite": ([("user42", "123", "PUT"), ("user42", "new123", "PUT")], {"user42": "new123"}),
    "missing": ([], {}),
    "delete": ([("user42", "123", "PUT"), ("user42", "", "DELETE")], {}),
    "delete absent": ([("nonexistent", "", "DELETE")], {}),
    "re-insert": ([("key1", "value1", "PUT"), ("key1", "", "DELETE"), ("key1", "value2", "PUT")], {"key1": "value2"}),
    "recover": ([("key1", "value1", "PUT"), ("key2", "value2", "PUT"), ("key1", "", "DELETE")], {"key2": "value2"}),
    "mixed": ([("key1", "a", "PUT"), ("key2", "b", "PUT"), ("key1", "", "DELETE"), ("key3", "c", "PUT"), ("key1", "value1_new", "PUT"), ("key2", "", "DELETE")], {"key1": "value1_new", "key3": "c"}),
    "empty key, empty and long values": ([("", "x", "PUT"), ("e", "", "PUT"), ("long", "v" * 10_000, "PUT"), (None, "null", "PUT")], {"": "x", "e": "", "long": "v" * 10_000, None: "null"}),
    "bytes": ([("key!@#$%", "1", "PUT"), ("key\n\t", "2", "PUT"), ("key with spaces", "3", "PUT"), ("é", "4", "PUT")], {"key!@#$%": "1", "key\n\t": "2", "key with spaces": "3", "é": "4"}),
}


def log(spark, ops):
    return spark.createDataFrame([(k, v, i + 1, op, "x", 0) for i, (k, v, op) in enumerate(ops)], OPLOG)


@pytest.mark.parametrize("name", CASES)
def test_store_behaviours(spark, name):
    ops, state = CASES[name]
    assert {r.key: r.value for r in lww.snapshot(log(spark, ops)).collect()} == state


def test_random_log_against_a_dict(spark, rows):
    r = random.Random(7)
    ops = [(r.choice(["a", "b", "", None, "hot", "hot"]) , str(i), r.choice(["PUT", "PUT", "DELETE"])) for i in range(800)]
    state, existed = {}, []
    for i, (k, v, op) in enumerate(ops):
        if op == "PUT":
            state[k] = (v, i + 1)
        else:
            existed.append((k, i + 1, k in state))
            state.pop(k, None)
    df = log(spark, ops)
    assert rows(lww.snapshot(df)) == sorted(((k, *v) for k, v in state.items()), key=repr)
    assert rows(lww.snapshot(df.unionByName(df))) == rows(lww.snapshot(df))
    assert rows(lww.removal_results(df.unionByName(df.limit(50)))) == sorted(existed, key=repr)


def test_previous_over_blocks(spark, rows):
    r = random.Random(1)
    seqs = r.sample(range(1_000_000), 300)
    data = [(r.choice(["a", None]), s, r.choice([str(s), None])) for s in seqs]
    last, want = {}, []
    for k, s, v in sorted(data, key=lambda x: x[1]):
        want.append((k, s, v, last.get(k)))
        last[k] = v
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "key string, seq long, v string")
    assert rows(lww.previous(df, ["key"], "seq", F.col("v"), "was")) == sorted(want, key=repr)


def test_lookups(spark, rows):
    df = log(spark, [(f"key{i}", str(i), "PUT") for i in range(12)] + [("key5", "", "DELETE")])
    assert rows(lww.point_get(df, "key7"), "value") == [("7",)]
    assert rows(lww.point_get(df, "key5")) == []
    keys = spark.createDataFrame([("key1",), ("key1",), ("key5",), ("none",), (None,)], "key string")
    assert rows(lww.multi_get(df, keys), "key") == [("key1",)]
    # By bytes key10 comes before key2.
    assert rows(lww.range_scan(df, "key1", "key2"), "key") == [("key1",), ("key10",), ("key11",), ("key2",)]
    assert rows(lww.prefix_scan(df, "key1"), "key") == [("key1",), ("key10",), ("key11",)]
    assert rows(lww.as_of(df, 2), "key") == [("key0",), ("key1",)]
    assert ("run", "key5", "<TOMBSTONE>", 13) in rows(lww.listing([("run", df)]))


def test_filter_reaches_the_scan(spark, tmp_path):
    path = f"{tmp_path}/log"
    log(spark, [("a", "1", "PUT")]).write.parquet(path)
    plan = lww.point_get(spark.read.parquet(path), "a")._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan and "extra" not in plan.rpartition("ReadSchema")[2]
