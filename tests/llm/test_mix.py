import math
import os

import pytest

from tidemark.llm import mix

DOCS = "doc_id long, source string, tokens long, share double, size string, slice string"
TARGETS = "source string, target_share double, max_repeats int"


def make(spark, sizes):
    return spark.createDataFrame([(i, s, t, 0.0, "x", "y") for i, (s, t) in enumerate(sizes)], DOCS)


def model(rows, docs, targets, budget):
    """The same order from one list, with the shuffles the result shows."""
    share = {s.strip().lower(): w for s, w, _ in targets}
    runs = {}
    for r in rows:
        runs.setdefault(r.source, []).append(r)
    for s, rs in runs.items():
        rs.sort(key=lambda r: r.finish_time)
        total = 0
        for r in rs:
            total += r.tokens
            assert r.finish_time == pytest.approx(total / share[s])
    return runs


def test_shares_caps_and_budget(spark):
    sizes = [("big", 10 + i % 7) for i in range(600)] + [("mid", 20)] * 200 + [("tiny", 5 + i) for i in range(4)] + [(None, 9), ("unlisted", 9), ("big", 0)]
    targets = [("Big ", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("none", 0.1, 5)]
    df, t = make(spark, sizes), spark.createDataFrame(targets, TARGETS)
    out = mix.mixture(df, t)
    rows = out.collect()
    budget = sum(x for s, x in sizes if s in ("big", "mid", "tiny"))
    assert budget - 30 < sum(r.tokens for r in rows) <= budget
    assert [r.finish_time for r in rows] == sorted(r.finish_time for r in rows)
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in uses.values())
    assert max(len(c) for (s, _), c in uses.items() if s == "tiny") == 3 == min(len(c) for (s, _), c in uses.items() if s == "tiny")
    assert max(len(c) for (s, _), c in uses.items() if s == "big") == 1
    model(rows, sizes, targets, budget)
    got = {r.source: r for r in mix.shares(out, t).collect()}
    assert got["none"].tokens == 0 and got["none"].actual_share == 0 and got["tiny"].most_uses == 3
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    # The two sources that never run out keep their proportion within one document of each.
    assert got["big"].tokens / got["mid"].tokens == pytest.approx(5 / 3, rel=0.03)


def test_exact_shares_where_the_sources_suffice(spark):
    sizes = [("a", 3)] * 500 + [("b", 7)] * 50
    t = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 4)], TARGETS)
    total = mix.largest_exact_total(mix.source_sizes(make(spark, sizes), t))
    assert total == math.floor(1400 / 0.75)
    got = {r.source: r.actual_share for r in mix.shares(mix.mixture(make(spark, sizes), t, total), t).collect()}
    assert got["a"] == pytest.approx(0.25, abs=0.01) and got["b"] == pytest.approx(0.75, abs=0.01)


def test_level(spark):
    sizes = spark.createDataFrame([("a", 0.5, 1, 10, 100), ("b", 0.25, 2, 5, 40), ("c", 0.25, 0, 5, 40)], "source string, share double, passes int, n long, size long")
    for budget, want in ((0, 0), (75, 100), (150, 200), (180, 320)):  # a ends at 200, b at 320
        assert want <= mix.finish_level(sizes, budget) <= want + 0.01
    assert math.isinf(mix.finish_level(sizes, 181)) and math.isinf(mix.finish_level(sizes.limit(0), 1))
    assert mix.largest_exact_total(sizes) == 200 and mix.largest_exact_total(sizes.limit(0)) == 0


def test_many_slices_give_the_same(spark, monkeypatch, rows):
    df = make(spark, [("a", 1 + i % 9) for i in range(400)] + [("b", 4)] * 30)
    t = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 5)], TARGETS)
    totals = []
    for n in (50_000, 7):
        monkeypatch.setattr(mix, "SLICE_ROWS", n)
        totals.append(mix.mixture(df, t, 1000, seed=3).groupBy("source").sum("tokens").collect())
        assert mix.mixture(df, t, 10**9).groupBy("source").agg({"tokens": "sum"}).count() == 2
    assert {r[0]: abs(r[1] - 600) <= 9 or abs(r[1] - 400) <= 9 for x in totals for r in x} == {"a": True, "b": True}
    everything = mix.mixture(df, t, 10**9)
    assert everything.count() == 400 * 2 + 30 * 5


def test_odd_inputs(spark):
    t = spark.createDataFrame([("a", 1.0, None), (None, 0.5, 1), ("b", None, 1), ("c", 0.2, 0)], TARGETS)
    assert mix.mixture(make(spark, []), t).count() == 0
    assert mix.mixture(make(spark, [("a", 5), ("c", 5)]), t).select("source").collect() == [("a",)]
    assert mix.mixture(make(spark, [("a", 5)]), t.limit(0)).count() == 0
    assert mix.mixture(make(spark, [("a", 5)]), t, 4).count() == 0
    with pytest.raises(ValueError):
        mix.mixture(make(spark, []), spark.createDataFrame([("a", 0.5, 1), ("A ", 0.5, 1)], TARGETS))
    assert mix.shares(mix.mixture(make(spark, []), t), t).where("actual_share <> 0").isEmpty()


@pytest.mark.skipif(not os.path.exists(mix.VOCABULARY), reason="no vocabulary here")
def test_tokens(spark):
    df = spark.createDataFrame([(1, " Parlrec ", "Hello world, hello."), (2, None, ""), (3, "X", None), (4, "x", "é" * 5000), (5, "x", "<|endoftext|>")], "doc_id long, source string, text string")
    got = {r.doc_id: (r.source, r.tokens) for r in mix.with_tokens(df.withColumn("tokens", df.doc_id)).collect()}
    assert got[1] == ("parlrec", 5) and got[2] == (None, 0) and got[3] == ("x", 0) and got[4][1] > 0 and got[5][1] > 1


@pytest.mark.skipif(not os.path.exists(mix.VOCABULARY), reason="no vocabulary here")
def test_registered_exact_mixture(spark, tmp_path):
    from tidemark.llm import queries

    texts = [(i, "big", "one two three") for i in range(300)] + [(1000 + i, "tiny", "one two three") for i in range(10)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 4)], TARGETS)
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    targets.write.parquet(f"file://{tmp_path}/mix_targets.parquet")
    out = queries.QUERIES["p7_exact_mixture"](spark, f"file://{tmp_path}")
    assert {r.source: (r.tokens, r.most_uses) for r in mix.shares(out, targets).collect()} == {"big": (120, 1), "tiny": (120, 4)}
    assert set(out.columns) == {"doc_id", "copy", "source", "tokens", "finish_time"}
