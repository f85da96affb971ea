import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import frames, wire
from tidemark.operators import dispatch

COMMANDS = {
    "PUT k v": ("PUT", "k", "v"),
    "  set k  a b  c \r\n": ("PUT", "k", "a b  c"),
    "PUT k": ("INVALID", None, None),
    "PUT  ": ("INVALID", None, None),
    "put k \t\r\n": ("INVALID", None, None),
    "GET a b": ("GET", "a b", None),
    "get": ("INVALID", None, None),
    "DEL x": ("DELETE", "x", None),
    "delete  é ": ("DELETE", "é", None),
    "ping": ("PING", None, None),
    "PING now": ("PING", None, None),
    "Exit": ("QUIT", None, None),
    "status": ("STATUS", None, None),
    "INCR x": ("UNKNOWN", None, None),
    "": ("INVALID", None, None),
    None: ("INVALID", None, None),
    "put a\tb c\nd": ("PUT", "a\tb", "c\nd"),
}
CALLS = {
    'put("k","v")': ("PUT", "k", "v"),
    'put("k", "a b")x': ("PUT", "k", "a b"),
    'put("","")': ("PUT", "", ""),
    'put("k")': ("ERROR", None, None),
    'get("k")': ("GET", "k", None),
    'get("k': ("ERROR", None, None),
    'delete("k")': ("DELETE", "k", None),
    "ls": ("LS", None, None),
    "ls ": ("ERROR", None, None),
    "flush": ("FLUSH", None, None),
    "clear": ("CLEAR", None, None),
    'PUT("k","v")': ("ERROR", None, None),
    None: ("ERROR", None, None),
}
REPLIES = {"+VALUE a b\r\n": (True, "OK", "a b"), "+OK STORED\r\n": (True, "STORED", None), "+PONG": (True, "PONG", None), "-ERR NOT_FOUND": (False, "NOT_FOUND", None), "-BAD": (False, "BAD", None), "what": None, "": None, None: None}


@pytest.mark.parametrize("cases, parse", [(COMMANDS, wire.parse_command), (CALLS, wire.parse_call), (REPLIES, wire.parse_reply)])
def test_parsers(spark, cases, parse):
    lines = list(cases)
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", parse(F.col("line")).alias("p"))
    for r in df.collect():
        assert (None if r.p is None else tuple(r.p)) == cases[lines[r.i]], lines[r.i]


def model(lines, role):
    state, out = {}, []
    for line in lines:
        verb, key, value = COMMANDS[line] if line in COMMANDS else line
        refused = role == "follower" and verb in ("PUT", "DELETE")
        if refused:
            out.append((False, wire.NOT_LEADER, None))
        elif verb == "PUT":
            state[key] = value
            out.append((True, "STORED", None))
        elif verb == "DELETE":
            out.append((True, "DELETED", None) if key in state else (False, "DELETE_FAILED", None))
            state.pop(key, None)
        elif verb == "GET":
            out.append((True, "OK", state[key]) if key in state else (False, "NOT_FOUND", None))
        else:
            out.append({"PING": (True, "PONG", None), "QUIT": (True, "BYE", None), "STATUS": (True, "OK", "fine")}.get(verb, (False, "UNKNOWN_COMMAND", None)))
    return out


@pytest.mark.parametrize("role", ["standalone", "follower"])
def test_replies_in_order(spark, role):
    r = random.Random(2)
    lines = [r.choice([x for x in COMMANDS if x is not None] + ["PUT k v", "GET a b", "DEL x", "set k  a b  c"]) for _ in range(300)]
    COMMANDS["set k  a b  c"] = ("PUT", "k", "a b  c")
    seqs = sorted(r.sample(range(500_000), 300))  # several blocks
    df = dispatch.replies(spark.createDataFrame(list(zip(seqs, lines)), "seq long, line string"), role, "fine")
    got = [(x.success, x.message, x.value) for x in df.orderBy("seq").collect()]
    assert got == model(lines, role)
    back = df.select("seq", wire.parse_reply(F.col("line")).alias("p")).orderBy("seq")
    assert [x.p.success for x in back.collect()] == [x[0] for x in got]


def test_status_text(spark):
    assert dispatch.status(spark, 1, "leader", 0, 5, 2).first().text == "Node ID: 1\nRole: LEADER\nTerm: 0\nCommit Index: 5\nActive Connections: 2"
    assert "Term" not in dispatch.status(spark, 1, "standalone", 0, 0, 0).first().text


def test_frames_round_trip(spark):
    entry = "array<struct<term: long, index: long, op: string, key: string, value: string>>"
    data = [
        (1, 3, 2, [(3, 1, "PUT", "a|b", "x|1|"), (3, 2, "DELETE", "é", "")]),
        (2, 1, None, []),
        (3, None, 7, None),
        (4, 1, 1, [(1, 1, "PUT", "", "v" * 5000), (1, 2, "DELETE", "k", None)]),
    ]
    df = spark.createDataFrame(data, f"i int, term long, leader_commit long, entries {entry}")
    coded = df.select("i", frames.encode_message(F.col("term"), F.col("leader_commit"), F.col("entries")).alias("frame"))
    assert coded.where("i = 1").first().frame == "3|2|2|18|3|1|1|3|a|b|4|x|1||13|3|2|2|2|é|0|"
    back = {r.i: (r.term, r.leader_commit, None if r.entries is None else [tuple(e) for e in r.entries]) for r in frames.decode_messages(coded).collect()}
    for i, term, commit, entries in data:
        assert back[i] == (term or 0, commit or 0, [(*e[:4], e[4] or "") for e in entries or []])


def test_malformed_frames(spark):
    bad = ["", "x", "1|2", "1|2|1", "1|2|1|99|1|1|1|1|k|1|v", "1|2|one|", None]
    assert all(r.term is None and r.entries is None for r in frames.decode_messages(spark.createDataFrame([(b,) for b in bad], "frame string")).collect())
    assert frames.decode(b"1|2|0\n") == (1, 2, [])


def test_shown_value(spark):
    df = spark.createDataFrame([('{"b": 1,  "a": [1, 2]}',), ("not json",), ("",), (None,)], "v string").select(wire.shown_value(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ['{"a":[1,2],"b":1}', "not json", "", None]


def test_commands_answered_batch_by_batch(spark, rows, tmp_path):
    from tidemark.plans.store import Store
    from tidemark.streaming import commands, live

    path, out = f"file://{tmp_path}/store", f"file://{tmp_path}/replies"
    sink = commands.answer(path, out, "s")
    batches = [["PUT a 1", "GET a", "GET b", "DEL a", "GET a", "PUT b x y"], ["GET b", "DEL b", "DEL b", "PING", "what", "SET a 2"], ["GET a", "GET b"]]
    for n, lines in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(lines))
        live.run_available(commands.lines(spark, f"{tmp_path}/in"), sink, f"{tmp_path}/checkpoint")
    said = [[r.line.strip() for r in spark.read.parquet(f"{out}/batch={n}").orderBy("seq").collect()] for n in range(3)]
    assert said == [
        ["+OK STORED", "+VALUE 1", "-ERR NOT_FOUND", "+OK DELETED", "-ERR NOT_FOUND", "+OK STORED"],
        ["+VALUE x y", "+OK DELETED", "-ERR DELETE_FAILED", "+OK PONG", "-ERR UNKNOWN_COMMAND", "+OK STORED"],
        ["+VALUE 2", "-ERR NOT_FOUND"],
    ]
    version = Store(spark, path).version
    sink(spark.createDataFrame([("PUT z 1",)], "value string"), 1)  # a batch that is there already
    assert Store(spark, path).version == version and rows(Store(spark, path).snapshot(), "key", "value") == [("a", "2")]
    follower = commands.answer(path, f"{out}2", "f", "follower")
    follower(spark.createDataFrame([("PUT a 3",), ("GET a",)], "value string").coalesce(1), 0)
    assert [r.line.strip() for r in spark.read.parquet(f"{out}2/batch=0").orderBy("seq").collect()] == [f"-ERR {wire.NOT_LEADER}", "+VALUE 2"]
