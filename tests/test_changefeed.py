import random

import pytest

from tidemark.operators import changefeed

FEED = "store_id int, term long, index long, op string, key string, value string, seq long, block long, copies int"


def brute(feed):
    force = {}
    for s, t, i, op, k, v, *_ in feed:
        if s is None or i is None:
            continue
        put = (op or "").strip(" ").upper() in ("PUT", "SET")
        new = (-1 if t is None else t, put, v if put else None, k)
        if (s, i) not in force or tuple((x is not None, x) for x in new) > tuple((x is not None, x) for x in force[s, i]):
            force[s, i] = new
    last = {}
    for (s, i), (_, put, v, k) in sorted(force.items()):
        last[s, k] = (i, put, v)
    return sorted(((s, k, i, v) for (s, k), (i, put, v) in last.items() if put), key=repr)


def feed(seed, span):
    r, out = random.Random(seed), []
    for _ in range(600):
        i = r.randrange(span)
        k = r.choice(["hot", "hot", "hot", "a", "", None, "é", "long" * 500])
        key = f"{k}{i % 3}" if k not in (None, "hot") else k
        put = random.Random(i).random() < 0.6
        row = (r.choice([1, 2]), r.choice([1, 1, 1, 2]), i, r.choice(["PUT", "set", " Put "]) if put else r.choice(["DEL", "delete", None]), key, f"v{i}" if put else r.choice(["", None]), i, 3, 4)
        out += [row] * r.choice([1, 1, 2])
    # Copies of one entry agree.
    seen = {}
    out = [seen.setdefault((x[0], x[1], x[2]), x) for x in out]
    r.shuffle(out)
    return out


def test_against_brute_force(spark, rows):
    for seed, span in ((1, 200), (2, 300_000), (3, 1_000_000)):  # several blocks of log positions
        f = feed(seed, span)
        assert rows(changefeed.live_rows(spark.createDataFrame(f, FEED))) == brute(f)


def test_order_and_repeats_do_not_matter(spark, rows):
    f = feed(4, 400_000)
    once = rows(changefeed.live_rows(spark.createDataFrame(f, FEED)))
    assert rows(changefeed.live_rows(spark.createDataFrame(f[::-1] + f, FEED).repartition(7))) == once


def test_base_and_changes(spark, rows):
    base = spark.createDataFrame([(1, 1, 5, "a", "old", 5), (1, 1, 6, "b", "old", 6), (1, 1, 7, "c", "old", 7)], "store_id int, term long, index long, key string, value string, seq long")
    changes = spark.createDataFrame([(1, 1, 9, "PUT", "a", "new", 9, 0, 0), (1, 1, 10, "DEL", "b", None, 10, 0, 0), (1, 1, 7, "PUT", "c", "old", 7, 0, 0), (1, 2, 70_000, "SET", "d", None, 11, 0, 0)], FEED)
    assert rows(changefeed.live_rows(changes, base)) == [(1, "a", 9, "new"), (1, "c", 7, "old"), (1, "d", 70_000, None)]


def test_empty_and_odd_rows(spark, rows):
    assert rows(changefeed.live_rows(spark.createDataFrame([], FEED))) == []
    odd = [(None, 1, 1, "PUT", "a", "x", 1, 0, 0), (1, 1, None, "PUT", "a", "x", 1, 0, 0), (1, None, 2, "PUT", None, "", 1, 0, 0), (1, None, 3, "PUT", "", None, 1, 0, 0)]
    assert rows(changefeed.live_rows(spark.createDataFrame(odd, FEED))) == sorted([(1, None, 2, ""), (1, "", 3, None)], key=repr)


def test_base_keeps_removals(spark, rows):
    df = lambda *f: spark.createDataFrame([(*x, 0, 0) for x in f], FEED)
    early = df((1, 1, 8, "PUT", "a", "x", 8), (1, 1, 9, "PUT", "b", "y", 9), (1, 1, 10, "DEL", "a", None, 10), (2, 1, 1, "SET", None, "z", 1))
    base = changefeed.last_entries(early)
    assert rows(base, "store_id", "term", "index", "op", "key") == sorted([(1, 1, 9, "PUT", "b"), (1, 1, 10, "DELETE", "a"), (2, 1, 1, "PUT", None)], key=repr)
    # A put of a removed key comes again: the key stays removed, also in the next base.
    again = df((1, 1, 8, "PUT", "a", "x", 8), (1, 1, 11, "PUT", "c", "w", 11), (2, 1, 2, "DEL", None, None, 2))
    assert rows(changefeed.live_rows(again, base)) == [(1, "b", 9, "y"), (1, "c", 11, "w")]
    assert rows(changefeed.live_rows(again.limit(0), changefeed.last_entries(again, base))) == [(1, "b", 9, "y"), (1, "c", 11, "w")]
    # A higher term for the same key replaces the entry in place.
    assert rows(changefeed.live_rows(df((1, 2, 9, "PUT", "b", "new", 9)), base), "key", "value") == [("b", "new"), (None, "z")]
    assert rows(changefeed.live_rows(df((1, 0, 9, "PUT", "q", "old", 9)), base), "key", "value") == [("b", "y"), (None, "z")]


@pytest.mark.parametrize("change", [(1, 2, 9, "PUT", "q", "x", 9), (1, 2, 9, "PUT", "a", "x", 9), (1, 1, 7, "PUT", "q", "x", 7)])
def test_changes_the_base_cannot_place(spark, change):
    base = spark.createDataFrame([(1, 1, 9, "PUT", "b", "y", 9), (1, 1, 10, "DELETE", "a", None, 10)], "store_id int, term long, index long, op string, key string, value string, seq long")
    with pytest.raises(ValueError):
        changefeed.live_rows(spark.createDataFrame([(*change, 0, 0)], FEED), base)


def test_base_in_parts_equals_the_whole(spark, rows):
    f = sorted(feed(5, 300_000), key=lambda x: x[2])
    head, tail = f[: len(f) // 2], f[len(f) // 2 :]
    cut = head[-1][2]
    tail = [x for x in tail if x[2] > cut]
    base = changefeed.last_entries(spark.createDataFrame(head, FEED))
    assert rows(changefeed.live_rows(spark.createDataFrame(tail, FEED), base)) == brute(head + tail)
