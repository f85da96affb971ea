import random

import numpy as np
import pytest

from tidemark.functions import field
from tidemark.operators import reconcile

SIDE = "store_id int, key string, value string, seq long, op string, bucket string, hash string"


def side(d):
    return [(s, k, *v, "x", "y") for (s, k), v in d.items()]


def brute(a, b):
    out = [(s, k, "missing_follower") for s, k in a.keys() - b.keys()] + [(s, k, "missing_leader") for s, k in b.keys() - a.keys()]
    for n in a.keys() & b.keys():
        out += [(*n, f) for f, x, y in zip(("value", "seq", "op"), a[n], b[n]) if x != y]
    return sorted(out, key=repr)


def copies(n, differing, seed):
    r = random.Random(seed)
    a = {(r.randrange(3), f"k{i}" if i else None): (r.choice(["v", "", None, "w" * 3000]), i, r.choice(["PUT", "DELETE"])) for i in range(n)}
    b = dict(a)
    for name in r.sample(sorted(a, key=repr), differing):
        kind = r.randrange(4)
        if kind == 0:
            del b[name]
        elif kind == 1:
            del a[name]
        else:
            v, s, o = b[name]
            b[name] = (r.choice([None, "", "other"]) if kind == 2 else v, s + r.randrange(2), "PUT" if kind == 3 else o)
    return a, b


@pytest.mark.parametrize("n, differing", [(1, 0), (1, 1), (300, 3), (2000, 100), (600, 580)])
def test_against_brute_force(spark, rows, n, differing):
    a, b = copies(n, differing, n)
    # Some rows are stored twice.
    x, y = side(a) + side(a)[:5], side(b) + side(b)[-5:]
    assert rows(reconcile.differences(*(spark.createDataFrame(s, SIDE) for s in (x, y)))) == brute(a, b)


def test_one_side_empty(spark, rows):
    a, _ = copies(50, 0, 9)
    x, none = spark.createDataFrame(side(a), SIDE), spark.createDataFrame([], SIDE)
    assert rows(reconcile.differences(x, none)) == brute(a, {})
    assert rows(reconcile.differences(none, x, ("l", "f")), "field") == [("missing_l",)] * 50
    assert rows(reconcile.differences(none, none)) == []


def test_more_differences_than_the_last_bound(spark, rows):
    # Many different rows of one key fall into one bucket; the greatest is compared.
    a = spark.createDataFrame([(1, "k", str(i), i, "PUT", "", "") for i in range(200)], SIDE)
    b = spark.createDataFrame([(1, "k", str(i), i, "PUT", "", "") for i in range(400, 500)], SIDE)
    assert rows(reconcile.differences(a, b)) == [(1, "k", "seq"), (1, "k", "value")]


def test_hot_copies(spark, rows):
    a = spark.createDataFrame([(1, "hot", "v", 1, "PUT", "", "")] * 500 + [(1, f"k{i}", "v", 1, "PUT", "", "") for i in range(100)], SIDE)
    b = spark.createDataFrame([(1, "hot", "w", 1, "PUT", "", "")] * 3 + [(1, f"k{i}", "v", 1, "PUT", "", "") for i in range(100)], SIDE)
    assert rows(reconcile.differences(a, b)) == [(1, "hot", "value")]


def test_recover_finds_both_sides_and_knows_when_it_fails():
    r, z = np.random.default_rng(2), reconcile.sample_points(8)
    for n, m in ((0, 0), (1, 0), (0, 3), (2, 2), (5, 3), (4, 4), (8, 0), (5, 4), (9, 9)):
        common, left, right = (r.integers(0, field.P, k, dtype=np.uint64) for k in (20, n, m))
        a, b = (field.products(field.sub(np.broadcast_to(z, (len(s), len(z))), s[:, None]), np.array([0, len(s)])) for s in (np.concatenate([common, left]), np.concatenate([common, right])))
        found, solved = reconcile.recover(np.array([20 + n]), np.array([20 + m]), a, b, z)
        assert solved[0] == (n + m <= 8)
        assert sorted(found[0]) == (sorted(map(int, [*left, *right])) if solved[0] else [])


def test_field():
    r = np.random.default_rng(5)
    a, b = (np.concatenate([r.integers(0, field.P, 500, dtype=np.uint64), np.array([0, 1, field.P - 1], np.uint64)]) for _ in range(2))
    assert [int(x) for x in field.mul(a, b)] == [int(x) * int(y) % field.P for x, y in zip(a, b)]
    assert (field.mul(a[a > 0], field.inverse(a[a > 0])) == 1).all()
    wanted = sorted(int(x) for x in r.integers(0, field.P, 9))
    f = [1]
    for w in wanted:
        f = [(y - w * x) % field.P for x, y in zip([*f, 0], [0, *f])]
    assert sorted(field.roots(f)) == wanted
    assert field.roots([1, 0, 0, 0, 1]) is None or len(field.roots([1, 0, 0, 0, 1])) == 4
