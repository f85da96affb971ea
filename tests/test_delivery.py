import random

import numpy as np
import pytest

from tidemark.operators import delivery

SCHEMA = "delivery_id long, store_id int, entries array<struct<term: long, index: long, op: string, key: string, value: string>>, index string, block long"


def brute(messages):
    first, surplus, kept = {}, [], []
    copies = sorted((d if d is not None else -1, p, s, e) for d, s, es, *_ in messages for p, e in enumerate(es or []) if e is not None and (e[0], e[1]) != (None, None))
    for d, p, s, e in copies:
        name = (s, e[0], e[1])
        (surplus if name in first else kept).append((d, p) if name in first else (s, e[0], e[1], d, p))
        first.setdefault(name, (d, p))
    return sorted(surplus), kept


def message(d, s, *names):
    return (d, s, [(t, i, "PUT", "k", None) for t, i in names], "other", 7)


@pytest.fixture(scope="module")
def messages():
    r, out = random.Random(3), []
    for d in range(400):
        s = r.choice([1, 1, 1, 2, None])
        base = r.choice([0, 65_500, 131_000, 10**7])
        out.append(message(d, s, *[(r.choice([1, 1, 2, None]), r.choice([base + r.randrange(80), 5, -3, None, (1 << 40) - 1, 1 << 50])) for _ in range(r.randrange(6))]))
    out += [(900, 1, None, "x", 1), (901, 1, [], "x", 1), (902, 1, [None], "x", 1)]
    r.shuffle(out)
    return out


def test_against_brute_force(spark, rows, messages):
    df = spark.createDataFrame(messages, SCHEMA).repartition(5)
    surplus, kept = brute(messages)
    assert rows(delivery.surplus_copies(df)) == sorted(surplus, key=repr)
    assert rows(delivery.accepted_entries(df)) == sorted(kept, key=repr)


def test_hot_identifier(spark, rows):
    many = [message(d, 1, (1, 1), (1, 2 + d % 3)) for d in range(500)]
    df = spark.createDataFrame(many, SCHEMA).repartition(7)
    assert rows(delivery.surplus_copies(df)) == sorted(brute(many)[0], key=repr)
    # After the first pass each partition holds one row of the hot identifier that is not known yet.
    assert delivery.accepted_entries(df).count() == 4


def test_whole_entries(spark, rows, messages):
    whole = [m for m in messages if m[0] is not None]
    got = delivery.delivered_once(spark.createDataFrame(whole, SCHEMA))
    assert rows(got, "store_id", "term", "index", "delivery_id", "pos") == rows(delivery.accepted_entries(spark.createDataFrame(whole, SCHEMA), unnamed=True))
    assert got.select("op", "key").distinct().count() == 1


def test_memory_begins_anew(monkeypatch):
    """The passes give the same when they may keep few producers and odd identifiers."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    n = 4000
    store, lo = np.sort(r.integers(0, 300, n)).astype(np.int32), r.integers(0, 20, n)
    order = np.lexsort((lo, store))
    kind = np.where(store % 50 == 49, delivery.ODD, delivery.ENTRY).astype(np.int8)
    order = order[np.argsort(kind[order], kind="stable")]
    columns = [kind, store, np.ones(n, np.int64), np.where(kind == delivery.ODD, lo, 0), lo, lo, np.arange(n), np.zeros(n, np.int32)]
    batches = pa.Table.from_arrays([pa.array(c[order]) for c in columns], schema=delivery.FLOW_ARROW).to_batches(max_chunksize=97)
    monkeypatch.setattr(delivery, "CHUNK", 97)
    second = delivery._second_pass(frozenset(("accepted", "surplus", "range")))
    both = lambda: pa.Table.from_batches(list(second(iter(batches)))).to_pylist()
    want = both()
    monkeypatch.setattr(delivery, "MAX_PRODUCERS", 3)
    monkeypatch.setattr(delivery, "MAX_ODD", 3)
    assert sorted(map(repr, both())) == sorted(map(repr, want)) and sum(x["outcome"] == "accepted" for x in want) == len(set(zip(store.tolist(), lo.tolist())))
    known = pa.Table.from_batches(list(delivery._first_pass(iter(batches))))
    assert len(known) == n and known.column("kind").to_pylist().count(delivery.KNOWN) <= n - len(set(zip(store.tolist(), lo.tolist())))


def test_ranges_carry_over(spark, rows, messages):
    messages = [m for m in messages if m[1] is not None]
    early, late = [m for m in messages if m[0] < 200], [m for m in messages if m[0] >= 200]
    early, late = (spark.createDataFrame(m, SCHEMA) for m in (early, late))
    seen = delivery.seen_ranges(early)
    fine = {(s, t, i) for _, s, es, *_ in messages for t, i, *_ in filter(None, es or []) if t is not None and i is not None and 0 <= i <= delivery.TOP}
    after = delivery.seen_ranges(late, seen).collect()
    assert {(r.store_id, r.term, i) for r in after for i in range(r.lo, r.hi + 1)} == fine
    by = {}
    for r in sorted(after):
        assert by.get((r.store_id, r.term), -2) + 1 < r.lo  # disjoint, and touching ones are joined
        by[r.store_id, r.term] = r.hi
    both = brute(messages)[0]
    odd = delivery.surplus_copies(late).count()
    assert rows(delivery.surplus_copies(late, seen).where("delivery_id >= 200")).__len__() >= odd
    known = {(d, p) for d, p in both}
    for d, p in rows(delivery.surplus_copies(late, seen)):
        assert (d, p) in known


def test_empty_and_ranges_at_block_borders(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(delivery.surplus_copies(empty)) == [] and rows(delivery.seen_ranges(empty)) == []
    size = 1 << delivery.BLOCK_BITS
    dense = spark.createDataFrame([message(d, 1, *[(1, i) for i in range(d * 1000, d * 1000 + 1000)]) for d in range(140)], SCHEMA)
    assert rows(delivery.seen_ranges(dense)) == [(1, 1, 0, 139_999)] and 139_999 > 2 * size


def test_range_book():
    book, seen, r = delivery.RangeBook(), set(), np.random.default_rng(1)
    for _ in range(50):
        keys = r.integers(0, 300, 40)
        new = book.accept(keys)
        for k, n in zip(keys, new):
            assert n == (int(k) not in seen)
            seen.add(int(k))
    assert {i for a, b in zip(book.lo, book.hi) for i in range(a, b + 1)} == seen
    assert (book.lo[1:] > book.hi[:-1] + 1).all()


def test_registered_queries_count_unnamed_entries(spark, rows, tmp_path):
    from tidemark.plans import registry

    m = [message(1, 1, (None, None), (1, 1), (None, None)), message(2, 1, (1, 1), (None, None), (None, 4)), message(3, None, (None, None)), (4, 1, [None, (None, None, "PUT", "k", None)], "other", 7), (5, 1, [None], "other", 7)]
    spark.createDataFrame(m, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/repl_msgs.parquet")
    got = {n: rows(registry.QUERIES[n](spark, f"file://{tmp_path}")) for n in ("p1_found", "p1_accepted")}
    assert got["p1_found"] == [(1, 2), (2, 0), (2, 1), (4, 1)]
    assert got["p1_accepted"] == sorted([(1, None, None, 1, 0), (1, 1, 1, 1, 1), (1, None, 4, 2, 2), (None, None, None, 3, 0)], key=repr)
