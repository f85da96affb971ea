import pytest

from tidemark.functions import record_bytes
from tidemark.operators import wal
from tidemark.sources import binary, settings


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    spark.dataSource.register(binary.LogFiles)
    spark.dataSource.register(binary.RunFiles)


def write_log(path, *records):
    path.write_bytes(b"".join(binary.log_record(*r) for r in records))


THREE = [(1, "PUT", b"a", b"1"), (2, "PUT", b"b", b"2"), (3, "DELETE", b"a", b"")]


def test_log_in_order(spark, rows, tmp_path):
    write_log(tmp_path / "log.bin", *THREE)
    df = spark.read.format("tidemark_log").load(f"{tmp_path}/log.bin")
    assert [(r.seq, r.op, bytes(r.key), bytes(r.value), r.good) for r in df.orderBy("offset").collect()] == [(*r, True) for r in THREE]
    from pyspark.sql import functions as F

    check = record_bytes.wal_checksum(F.col("seq"), F.col("op"), F.col("key").cast("string"), F.col("value").cast("string"))
    assert df.where(check != F.col("checksum")).isEmpty()


@pytest.mark.parametrize("damage", ["corrupt", "truncated", "head", "empty"])
def test_damaged_log(spark, tmp_path, damage):
    write_log(tmp_path / "log.bin", *THREE)
    data = bytearray((tmp_path / "log.bin").read_bytes())
    cut = {"corrupt": data[:27] + b"\xff" + data[28:], "truncated": data[:-1], "head": data[:30], "empty": b""}[damage]
    (tmp_path / "log.bin").write_bytes(bytes(cut))
    from pyspark.sql import functions as F

    df = spark.read.format("tidemark_log").load(f"{tmp_path}/log.bin")
    good = wal.replay(df, ~F.col("good"))
    assert sorted(r.seq for r in good.collect()) == {"corrupt": [1], "truncated": [1, 2], "head": [1], "empty": []}[damage]
    assert wal.is_empty(df) == (damage == "empty")


def test_log_written_by_spark_reads_back(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, "PUT" if i % 3 else "DELETE", f"kéy{i}".encode(), b"v" * i) for i in range(20)], "seq long, op string, key binary, value binary")
    for part in ("seq < 10", "seq >= 10"):
        df.where(part).coalesce(2).write.format("tidemark_log").mode("append").save(f"{tmp_path}/log")
    back = spark.read.format("tidemark_log").load(f"{tmp_path}/log")
    assert back.where("NOT good").isEmpty() and back.count() == 20
    assert sorted((r.seq, bytes(r.key)) for r in back.collect()) == sorted((r.seq, bytes(r.key)) for r in df.collect())
    binary.append_log(df.where("seq < 3"), f"{tmp_path}/log")
    again = binary.read_logs(spark, f"file://{tmp_path}/log")
    assert again.where("NOT good").isEmpty() and again.count() == 23 and rows(again.drop("path").where("seq >= 3")) == rows(back.where("seq >= 3"))


def test_run_files(spark, tmp_path):
    for n in range(3):
        binary.write_run(f"{tmp_path}/run_{n}.bin", [(f"key{n}{i:03d}".encode(), b"x" * (i % 5), i, "DELETE" if i % 7 == 0 else "PUT") for i in range(100)])
    meta = binary.RunMeta(f"{tmp_path}/run_1.bin")
    assert (meta.low, meta.high, len(meta.index)) == (b"key1000", b"key1099", 7)
    bloom = binary.Bloom.load(meta.bloom)
    assert all(f"key1{i:03d}".encode() in bloom for i in range(100)) and sum(f"other{i}".encode() in bloom for i in range(1000)) < 30
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("tidemark_run").load(str(tmp_path))
        assert df.count() == 300
        found = df.where("key = cast('key1050' as binary)").collect()
        assert [(bytes(r.key), r.seq, r.op) for r in found] == [(b"key1050", 50, "PUT")]
        assert df.where("key > cast('key1097' as binary) AND key <= cast('key2001' as binary)").count() == 4
        assert df.where("key = cast('nothing' as binary)").isEmpty()
        asked = spark.read.format("tidemark_run").option("own_bloom", "true").load(str(tmp_path))
        assert asked.where("key = cast('key1050' as binary)").count() == 1 and asked.where("key = cast('key1050x' as binary)").isEmpty()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


NODE = """
logging:
  level: warn
storage:
  cache_size: 12
  data_dir:
# the nodes of this house
peers:
  - port: 7311
    host: oak
  - port: 7312
server:
\tthreads: 3
\tport: "7300"
node:
    role:   leader
    id: 41
"""


def test_settings(tmp_path):
    (tmp_path / "node.yaml").write_text(NODE)
    s = settings.node_settings(f"{tmp_path}/node.yaml", threads=8, port=None)
    assert (s.node_id, s.role, s.host, s.port, s.replication_port, s.threads, s.data_dir, s.cache_size, s.log_level) == (41, "leader", "0.0.0.0", 7300, 0, 8, "data", 12, "warn")
    assert s.peers == (("oak", 7311),)
    for wrong in ({"port": 0}, {"role": "king"}, {"colour": "red"}):
        with pytest.raises(ValueError):
            settings.node_settings(**wrong)
    (tmp_path / "kv.yaml").write_text("host: example\nport: 7\n")
    c = settings.client_settings(f"{tmp_path}/kv.yaml", {"KV_PORT": "8"})
    assert (c.host, c.port, c.format) == ("example", 8, "text")
    with pytest.raises(ValueError):
        settings.client_settings(None, {"KV_FORMAT": "xml"})
    file = tmp_path / "made" / "client.yaml"
    assert settings.create_client_settings(file) and not settings.create_client_settings(file)
    assert settings.client_settings(str(file), {}) == settings.ClientSettings()


def test_unquoted(spark):
    from pyspark.sql import functions as F

    texts = ["", " ", '"', '""', ' "a" ', '"a', 'a"b', '\t"x "\r\n', "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.u for r in df.select(settings.unquoted(F.col("t")).alias("u")).collect()] == list(map(settings.unquote, texts))
