import json

import pytest

from tidemark import client
from tidemark.functions import frames
from tidemark.streaming import commands


def test_client_and_shell(spark, tmp_path):
    c = client.Client(spark, f"file://{tmp_path}/s")
    assert c.get("a") is None and c.ping() == "PONG"
    c.set("a", '{"x": 1}')
    assert c.get("a") == '{"x": 1}'
    assert [c.call(x) for x in ('put("b","")', 'get("b")', "flush", 'get("b")', 'delete("b")', 'delete("b")', 'get("b")', "nonsense")] == ["OK", "", "OK", "", "DELETED", "DELETE_FAILED", "NOT_FOUND", "ERROR"]
    assert "memtable b = <TOMBSTONE> [4]" in c.call("ls").splitlines() and 'run_1 a = {"x": 1} [1]' in c.call("ls").splitlines()
    assert c.status()["runs"] == 1 and c.status()["next_seq"] == 5
    follower = client.Client(spark, f"file://{tmp_path}/s", role="follower")
    assert follower.get("a") and pytest.raises(PermissionError, follower.set, "a", "b")
    assert c.call("clear") == "OK" and c.get("a") is None


def test_formats(spark, capsys):
    assert client.show_value("k", '{"b":1}') == '{\n  "b": 1\n}' and client.show_value("k", "é x") == "é x"
    assert client.show_value("k", None) == "Key not found: k"
    assert json.loads(client.show_value("k", "[1]", "json")) == {"success": True, "key": "k", "value": [1]}
    assert json.loads(client.show_value("k", None, "json"))["error"] == "key not found"
    assert client.show_message("no", False) == "Error: no" and json.loads(client.show_message("ok", form="json")) == {"success": True, "message": "ok"}
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert client.show_rows(df) == ["1\t"] and client.show_rows(df, "json") == ['{"a":1}']
    assert client.main(["config"]) == 0 and json.loads(capsys.readouterr().out)["port"] == 9000


def test_streams_of_lines(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("PUT k v w\nget k\n" + "PUT k " + "x" * (1 << 20) + "\n")
    got = []
    sink = lambda b, n: got.extend(map(tuple, b.collect()))
    stream = commands.requests(commands.lines(spark, f"{tmp_path}/in"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(got, key=repr) == sorted([("PUT", "k", "v w"), ("GET", "k", None), ("INVALID", None, None)], key=repr)
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames" / "a.txt").write_text("3|1|1|14|3|1|1|1|k|2|ab\nbroken\n")
    read = []
    stream = commands.messages(commands.lines(spark, f"{tmp_path}/frames"))
    stream.writeStream.foreachBatch(lambda b, n: read.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.term, r.ack) for r in read if r.ack) == [(3, "+OK")] and frames.decode(b"3|1|1|14|3|1|1|1|k|2|ab")[2][0]["value"] == "ab"


def test_generated_log(spark):
    from tidemark.sources.oplogs import random_oplog

    a = random_oplog(spark, 500, 50, value_bytes=100, seed=1)
    assert a.where("length(value) <> 100").isEmpty() and a.select("key").distinct().count() <= 50
    assert a.repartition(3).exceptAll(random_oplog(spark, 500, 50, 100, 1)).isEmpty()
