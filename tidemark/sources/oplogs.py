"""Op-logs made from other tables, and generated ones for measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def lineitem_oplog(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as puts ``key, value, seq, op``: key is order and line, later ship dates overwrite.

    ``seq`` rises with ``(l_shipdate, l_partkey, l_suppkey)``; it is packed from them, so no numbering pass is needed.
    """
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seq = F.shiftleft(day, 44) + F.shiftleft(F.col("l_partkey"), 20) + F.col("l_suppkey")
    value = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_shipdate").cast("string"))
    return table(spark, folder, "lineitem").select(F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("key"), value.alias("value"), seq.alias("seq"), F.lit("PUT").alias("op"))


def random_oplog(spark: SparkSession, n: int, keys: int, value_bytes: int = 100, seed: int = 0) -> DataFrame:
    """``n`` puts of alphanumeric values to ``key_<i>``, the same for the same seed whatever the partitions."""
    h = F.xxhash64(F.lit(seed), "id")
    text = F.substring(F.repeat(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256), -(-value_bytes // 64)), 1, value_bytes)
    return spark.range(n).select(F.concat(F.lit("key_"), F.pmod(h, F.lit(keys)).cast("string")).alias("key"), text.alias("value"), (F.col("id") + 1).alias("seq"), F.lit("PUT").alias("op"))
