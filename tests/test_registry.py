import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    from tidemark.plans import registry

    assert set(registry.SQL) <= set(registry.QUERIES)
    assert all(f"p{n}_found" in registry.QUERIES for n in range(1, 5))


def test_core_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tidemark"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tidemark.llm" not in path.read_text()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["kv_snapshot", "kv_store_cycle", "lineitem_upsert", "repl_apply_prefix", "cmd_replies", "p1_found", "p1_ranges", "p2_found", "p3_state", "p4_found"])
def test_queries_against_sql(spark, name):
    import duckdb

    from tidemark.plans import registry

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    want = c.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, c.sql(f"SELECT {', '.join(f'\"{x}\"' for x in columns)} FROM ({registry.SQL[name]})").fetchall()))
