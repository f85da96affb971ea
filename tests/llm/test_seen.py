import random

from tidemark.llm import seen

ARRIVING = "op_id long, store_id int, key string, op string, arrival long"


def brute(stored, arriving):
    known, out = set(stored), {}
    for i, s, k, *_ in sorted(arriving):
        out[i] = "no key" if k is None else "repeat" if (s, k) in known else "first"
        if k is not None:
            known.add((s, k))
    return out


def write(spark, path, data, schema, files=3):
    spark.createDataFrame(data, schema).repartition(files).write.mode("append").parquet(str(path))


def arrivals(r, n, start=0):
    return [(start + i, r.choice([1, 2, None]), r.choice(["hot"] * 5 + [f"k{r.randrange(60)}", "", "K1 ", None, "x" * 3000]), "PUT", 5) for i in range(n)]


def test_against_brute_force(spark, rows, tmp_path):
    r = random.Random(1)
    a = arrivals(r, 400)
    stored = [(1, "k1"), (2, ""), (1, None), (1, "k1")]
    write(spark, tmp_path / "ops", [*a, (None, 1, "k1", "PUT", 5), (None, 1, "k61", "PUT", 5)], ARRIVING)
    write(spark, tmp_path / "old", stored, "store_id int, key string", 1)
    state = seen.SeenKeys(spark, f"file://{tmp_path}/state")
    state.advance(f"{tmp_path}/ops", (f"{tmp_path}/old",))
    df = spark.read.parquet(f"{tmp_path}/ops")
    want = brute({(s, k) for s, k in stored if k is not None}, a)
    assert dict(rows(state.verdicts())) == want
    assert rows(state.repeats()) == sorted([(i,) for i, v in want.items() if v == "repeat"], key=repr)
    exact = seen.exact_repeats(df, spark.createDataFrame(stored, "store_id int, key string"))
    assert rows(exact) == rows(state.repeats())
    keyed = sum(v != "no key" for v in want.values())
    assert rows(seen.error_rate(df, state.verdicts(), exact)) == [(keyed, sum(v == "repeat" for v in want.values()), 0, 0.0)]
    wrong = state.verdicts().withColumn("verdict", __import__("pyspark").sql.functions.lit("first"))
    assert seen.error_rate(df, wrong, exact).first().n_wrong == sum(v == "repeat" for v in want.values())


def test_goes_on_from_its_checkpoint(spark, rows, tmp_path):
    r = random.Random(2)
    late, early = arrivals(r, 150, 1000), arrivals(r, 150, 0)
    for i, part in enumerate((late, early)):  # earlier arrivals come in a later batch
        write(spark, tmp_path / "ops", part, ARRIVING, 2)
        seen.SeenKeys(spark, f"file://{tmp_path}/state").advance(f"{tmp_path}/ops", files_per_batch=1 if i else None)
    state, df = seen.SeenKeys(spark, f"file://{tmp_path}/state"), spark.read.parquet(f"{tmp_path}/ops")
    assert dict(rows(state.verdicts())) == brute(set(), late + early)


def test_a_single_file_and_no_rows(spark, rows, tmp_path):
    write(spark, tmp_path / "ops", [], ARRIVING, 1)
    state = seen.SeenKeys(spark, f"file://{tmp_path}/state")
    state.advance(f"{tmp_path}/ops")
    df = spark.read.parquet(f"{tmp_path}/ops")
    assert rows(state.repeats()) == [] and rows(state.verdicts()) == []
    assert rows(seen.error_rate(df, state.verdicts(), state.repeats())) == [(0, 0, 0, None)]
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"op_id": pa.array([1, 2], pa.int64()), "store_id": pa.array([1, 1], pa.int32()), "key": ["a", "a"]}), f"{tmp_path}/one.parquet")
    state = seen.SeenKeys(spark, f"file://{tmp_path}/state2")
    state.advance(f"{tmp_path}/one.parquet")
    assert rows(state.repeats()) == [(2,)]
