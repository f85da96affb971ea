import random

import pytest
from test_changefeed import FEED, brute, feed

from tidemark.operators import changefeed
from tidemark.operators.feedstore import FeedStore


def replaced(seed):
    """A feed in which higher terms give places of the log to other keys."""
    r, out = random.Random(seed), {}
    for _ in range(500):
        i, t = r.randrange(1, 120), r.choice([1, 1, 2, 3, None])
        k = r.choice(["hot", "hot", "a", "b", "", None])
        out.setdefault((1, t, i), (1, t, i, r.choice(["PUT", "set", "DEL"]), k, f"{t}/{i}", i, 0, 0))
    rows = list(out.values())
    rows += r.choices(rows, k=100)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_of, seed, buckets", [(replaced, 1, None), (replaced, 2, 5), (lambda s: feed(s, 300_000), 3, 5)])
def test_increments_equal_the_whole(spark, rows, tmp_path, monkeypatch, rows_of, seed, buckets):
    f = rows_of(seed)
    if buckets:
        monkeypatch.setattr("tidemark.operators.feedstore.ENTRIES_PER_BUCKET", max(1, len(f) // 3 // buckets))
    store, size = FeedStore(spark, f"file://{tmp_path}/f"), len(f) // 3
    for n in range(3):
        part = f[max(0, n * size - 60) : (n + 1) * size if n < 2 else None]  # some rows of the part before again
        store.apply(spark.createDataFrame(part, FEED), batch=("feed", n))
        store.apply(spark.createDataFrame(f, FEED), batch=("feed", n))  # this batch is there already
        assert rows(store.live()) == brute(f[: (n + 1) * size if n < 2 else None])
        if n == 1:
            store.compact()
            assert store.vacuum() and rows(store.live()) == brute(f[: 2 * size])
    assert rows(store.live()) == rows(changefeed.live_rows(spark.createDataFrame(f, FEED)))


def test_removed_key_stays_removed(spark, rows, tmp_path):
    df = lambda *f: spark.createDataFrame([(*x, 0, 0) for x in f], FEED)
    store = FeedStore(spark, f"file://{tmp_path}/f")
    store.apply(df((1, 1, 1, "PUT", "k", "x", 1), (1, 1, 2, "DEL", "k", None, 2), (1, 1, 3, "PUT", "z", "y", 3)))
    store.apply(df((1, 1, 1, "PUT", "k", "x", 1)))
    assert rows(store.live()) == [(1, "z", 3, "y")]
    store.apply(df((1, 2, 2, "PUT", "q", "new", 2)))  # takes the removal's place: the put before it counts again
    assert rows(store.live()) == [(1, "k", 1, "x"), (1, "q", 2, "new"), (1, "z", 3, "y")]


def test_settled_positions(spark, rows, tmp_path):
    f = replaced(7)
    early, late = [x for x in f if x[2] <= 60], [x for x in f if x[2] > 60]
    store = FeedStore(spark, f"file://{tmp_path}/f")
    store.apply(spark.createDataFrame(early + late[:50], FEED))
    store.compact(spark.createDataFrame([(1, 60), (None, 5)], "store_id int, upto long"))
    kept = store._entries(store._state()["parts"]).where("index <= 60").count()
    assert kept <= 5  # of each key the last one
    store.apply(spark.createDataFrame(early[:40] + late, FEED))
    assert rows(store.live()) == brute(f)


def test_no_rows(spark, rows, tmp_path):
    store = FeedStore(spark, f"file://{tmp_path}/f")
    assert rows(store.live()) == []
    store.apply(spark.createDataFrame([], FEED))
    store.apply(spark.createDataFrame([(None, 1, 1, "PUT", "a", "", 1, 0, 0), (1, 1, None, "PUT", "a", "", 1, 0, 0)], FEED))
    assert rows(store.live()) == []
