import pytest

from tidemark.operators import incremental as inc

LOG = "feed_pos long, store_id int, term long, index long, seq long, node_id string"
RUNS = "run_id long, store_id int, node_id int, status string, hi_term long, file_id long, seq long"
FILES = "id long, max_seq long, store_id int"


def test_watermark_is_of_the_last_good_run(spark, rows):
    runs = spark.createDataFrame(
        [(1, 1, 1, "ok", 1, 10, 0), (3, 1, 1, "failed", 9, 12, 0), (2, 1, 1, "ok", 2, 11, 0), (2, 1, 1, "ok", 2, 11, 0), (4, 1, 2, "running", 1, None, 0), (5, 2, 1, "ok", 1, None, 0), (6, 2, 2, "ok", None, 99, 0)], RUNS
    )
    files = spark.createDataFrame([(10, 5, 1), (11, 8, 1), (12, 50, 1)], FILES)
    low = inc.LOWEST
    assert rows(inc.watermarks(runs, files)) == sorted([(1, 1, 8, 2), (1, 2, low, low), (2, 1, low, 1), (2, 2, low, low)], key=repr)


def test_entries_above_watermark(spark, rows):
    log = spark.createDataFrame(
        [(1, 1, 1, 1, 10, ""), (2, 1, 1, 2, 20, ""), (3, 1, 2, 1, 10, ""), (4, 1, 1, 2, 20, ""), (5, 1, 1, 3, None, ""), (6, 2, 1, 1, 5, ""), (7, 1, 1, None, 90, ""), (8, None, 1, 1, 90, "")], LOG
    )
    marks = spark.createDataFrame([(1, 1, 10, 1), (1, 2, 20, 2), (2, 1, inc.LOWEST, inc.LOWEST)], "store_id int, node_id int, max_seq long, hi_term long")
    found = inc.changed_entries(log, marks)
    # The entry of index 1 was replaced by term 2; index 3 has no seq and is always due.
    assert rows(found, "store_id", "node_id", "index") == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 2, 3), (2, 1, 1)]
    assert inc.changed_entries(log, marks, upto=1).isEmpty()
    assert inc.changed_entries(log.limit(0), marks).isEmpty() and inc.changed_entries(log, marks.limit(0)).isEmpty()


def test_runs_neither_skip_nor_repeat(spark, rows, tmp_path):
    marks = spark.createDataFrame([(1, 1, inc.LOWEST, inc.LOWEST)], "store_id int, node_id int, max_seq long, hi_term long")
    log = [(1, 1, 1, 1, 10, ""), (2, 1, 1, 3, 30, "")]
    store = inc.RunStore(spark, f"file://{tmp_path}/runs")
    df = lambda: spark.createDataFrame(log, LOG)
    assert store.run(df(), marks) == 1
    assert rows(store.output(1), "index", "term") == [(1, 1), (3, 1)]
    # A late entry of low seq, a repeated row, and a replacement; the first attempt dies before its commit.
    log += [(3, 1, 1, 2, 20, ""), (4, 1, 1, 1, 10, ""), (5, 1, 2, 3, 30, "")]
    with pytest.raises(RuntimeError):
        store.run(df(), marks, fail_before_commit=True)
    assert store.log.numbers() == [1]
    assert store.run(df(), marks) == 2
    assert rows(store.output(2), "index", "term") == [(2, 1), (3, 2)]
    assert rows(store.marks()) == [(1, 1, 30, 2)]
    assert store.run(df(), marks) == 3 and store.output(3).isEmpty()
    assert len(store.vacuum()) == 1 and store.vacuum() == [] and store.output(2).count() == 2
    store.compact()
    assert store.output(4).isEmpty() and rows(store.marks()) == [(1, 1, 30, 2)]
    log += [(6, 1, 1, 3, 30, ""), (7, 1, 3, 1, 10, ""), (8, 1, 1, 4, 40, "")]  # term 2 of index 3 is kept, so term 1 is old
    assert store.run(df(), marks) == 5 and rows(store.output(5), "index", "term") == [(1, 3), (4, 1)]
    with pytest.raises(RuntimeError):
        store.log.publish(3, {})


MARKS = "store_id int, node_id int, max_seq long, hi_term long"


def test_followers_that_appear_between_runs(spark, rows, tmp_path):
    low = inc.LOWEST
    store = inc.RunStore(spark, f"file://{tmp_path}/runs")
    log = [(1, 1, 1, 1, 10, ""), (2, 1, 1, 2, 20, "")]
    df = lambda: spark.createDataFrame(log, LOG)
    first = [(1, 1, low, low), (None, 1, low, low)]
    store.run(df(), spark.createDataFrame(first, MARKS))
    # A follower that has index 1 already, and a store whose first row came with the run before it was known.
    log += [(3, 2, 1, 1, 5, ""), (4, 1, 1, 3, 30, "")]
    first += [(1, 2, 10, 1)]
    store.run(df(), spark.createDataFrame(first, MARKS))
    assert rows(store.output(2), "store_id", "node_id", "index") == [(1, 1, 3), (1, 2, 2), (1, 2, 3)]
    first += [(2, 1, low, low)]
    store.run(df(), spark.createDataFrame(first, MARKS))
    assert rows(store.output(3), "store_id", "node_id", "index") == [(2, 1, 1)]
    assert rows(store.marks()) == sorted([(1, 1, 30, 1), (1, 2, 30, 1), (2, 1, 5, 1), (None, 1, low, low)], key=repr)
    store.run(df(), spark.createDataFrame(first, MARKS))
    assert store.output(4).isEmpty()


def test_rows_without_feed_position(spark, rows, tmp_path):
    marks = spark.createDataFrame([(1, 1, inc.LOWEST, inc.LOWEST)], MARKS)
    store = inc.RunStore(spark, f"file://{tmp_path}/runs")
    log = [(1, 1, 1, 1, 10, ""), (None, 1, 1, 2, 20, "")]
    df = lambda: spark.createDataFrame(log, LOG)
    store.run(df(), marks)
    assert rows(store.output(1), "index") == [(1,), (2,)]
    # Index 1 came before; indexes 2 and 3 have no position yet and come out until a copy has one.
    log += [(None, 1, 1, 1, 10, ""), (None, 1, 1, 3, 30, "")]
    store.run(df(), marks)
    assert rows(store.output(2), "index") == [(2,), (3,)]
    log += [(2, 1, 1, 2, 20, ""), (3, 1, 1, 3, 30, "")]
    store.run(df(), marks)
    store.run(df(), marks)
    assert rows(store.output(3), "index") == [(2,), (3,)] and store.output(4).isEmpty()
