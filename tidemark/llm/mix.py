"""Sources mixed to target weights by weighted fair queueing.

Every source sends its documents in shuffled order, pass after pass up to its
cap. A copy's virtual finish time is the source's tokens up to and with it,
divided by the source's weight; the copies of all sources in order of that time
keep every share on target at any cut. The order is cut at the total budget.
Running sums are taken in two steps, within slices and over slice totals, so no
source and no mixture is summed in one task.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import cut

#: The session setting that names the vocabulary file, and where it lies without that.
VOCABULARY_SETTING, VOCABULARY = "spark.tidemark.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 8 << 20  # what may be sent to every task
# Fixed value: how the vocabulary's texts are split before pairs are merged.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of a slice, on average; a source of any size has as many slices as it needs.
SLICE_ROWS = 50_000
CUT_SLICES = 4096
#: Times that are tried at once, and how often, to find where the budget is sent.
GRID, ROUNDS = 32, 3
_encoders: dict[int, object] = {}


def with_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, tokens``: texts sized by the byte-pair vocabulary in the file ``vocabulary``, or in the one the session names.

    The driver reads the file and sends it to the tasks; its size is checked.
    NULL and empty texts have 0 tokens. ``source`` comes out in lower case
    without outer blanks.
    """
    vocabulary = vocabulary or documents.sparkSession.conf.get(VOCABULARY_SETTING, VOCABULARY)
    data = Path(vocabulary).read_bytes()
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is too large to send to every task")
    sent, key = documents.sparkSession.sparkContext.broadcast(data), hash(data)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
            _encoders[key] = tiktoken.Encoding("mix", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        encode = _encoders[key].encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    source = F.lower(F.btrim("source")).alias("source")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source, "text").mapInArrow(count, "doc_id long, source string, tokens long")


def read_targets(targets: DataFrame) -> DataFrame:
    """``source, share, passes``: one row for each source with a positive share, spelled in any case; raises if one has two."""
    rows = targets.where("source IS NOT NULL AND target_share > 0").select(
        F.lower(F.btrim("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.greatest(F.lit(0), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1))).alias("passes")
    )
    twice = rows.groupBy("source").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"two targets for source {twice.source!r}")
    return rows


def source_sizes(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, share, passes, n, size``: documents and tokens of each listed source that has any."""
    sums = documents.where("tokens > 0").groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("size"))
    return read_targets(targets).join(sums, "source")


def largest_exact_total(sizes: DataFrame) -> int:
    """The most tokens at which every source that has documents (see ``source_sizes``) still gives its share."""
    return sizes.where("passes > 0").agg(F.floor(F.min(F.col("size") * F.col("passes") / F.col("share")))).first()[0] or 0


def finish_level(sizes: DataFrame, budget: int) -> float:
    """A virtual time at which all sources together have sent ``budget`` tokens, hardly later than need be; infinite if they can't.

    What has been sent rises with the time, so it is looked for among ``GRID``
    times at once, one aggregation over the sources for each of ``ROUNDS``.
    """
    end = F.col("size") * F.col("passes") / F.col("share")
    total, high = sizes.agg(F.sum(F.col("size") * F.col("passes")), F.max(end)).first()
    if total is None or total < budget:
        return math.inf
    low = 0.0
    for _ in range(ROUNDS):
        times = [low + (high - low) * (i + 1) / GRID for i in range(GRID)]
        sent = sizes.agg(*[F.sum(F.least(end, F.lit(x)) * F.col("share")) for x in times]).first()
        i = next((i for i in range(GRID) if sent[i] >= budget), GRID - 1)
        low, high = (times[i - 1] if i else low), times[i]
    return high


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """The mixture in order: ``doc_id, copy, source, tokens, finish_time``.

    ``documents`` has ``doc_id, source, tokens`` (see ``with_tokens``). The
    result is the longest beginning of the fair order with at most
    ``total_tokens`` tokens; by default, the tokens of all documents of the
    listed sources, each counted once. Copy c of a document (from 1) belongs to
    its source's c-th pass, and no document is used more than ``max_repeats``
    times. A source that runs out leaves its share to the others in proportion;
    ``shares`` tells what was reached. Documents of no listed source (NULL too)
    and documents of 0 tokens take no part. Ties go by source, document, copy.
    """
    # Sizes are written once, as the texts must not be split into tokens for each sum below.
    rows = cut(documents.where("tokens > 0").select("doc_id", "source", "tokens").join(read_targets(targets).select("source", "share"), "source"))
    sizes = cut(source_sizes(rows.select("source", "tokens"), targets))
    n_sources, most, least, tokens = sizes.agg(F.count("*"), F.max("n"), F.min("share"), F.sum("size")).first()
    budget = (tokens or 0) if total_tokens is None else total_tokens
    level = finish_level(sizes, budget)
    largest = rows.agg(F.max("tokens")).first()[0] or 0
    # No copy that is kept finishes much above the level: each source may be one document off it.
    bound = level + (n_sources + 1) * largest / (least or 1.0)
    needed = F.least("passes", F.ceil(F.lit(bound) * F.col("share") / F.col("size"))) if math.isfinite(bound) else F.col("passes")
    slices = max(1, math.ceil((most or 1) / SLICE_ROWS))
    facts = sizes.select("source", "size", needed.cast("int").alias("needed"))

    copies = (
        rows.join(facts, "source")
        .where("needed > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "needed")))
        .withColumn("turn", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long"))
        .withColumn("slice", F.pmod(F.shiftrightunsigned("turn", 20), F.lit(slices)))
    )
    lane = ("source", "copy", "slice")
    totals = copies.groupBy(*lane).agg(F.sum("tokens").alias("sum"))
    ahead = totals.select(*lane, F.coalesce(F.sum("sum").over(Window.partitionBy("source", "copy").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.sum("tokens").over(Window.partitionBy(*lane).orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    finish = ((F.col("copy") - 1) * F.col("size") + F.col("ahead") + F.col("within")) / F.col("share")
    timed = copies.withColumn("within", within).join(ahead, list(lane)).select("doc_id", "copy", "source", "tokens", finish.alias("finish_time")).where(F.col("finish_time") <= bound if math.isfinite(bound) else F.lit(True))
    return _cut(cut(timed), budget).orderBy("finish_time", "source", "doc_id", "copy")


def _cut(timed: DataFrame, budget: int) -> DataFrame:
    """The longest beginning, by finish time, of at most ``budget`` tokens.

    Only slice totals reach the driver, ``CUT_SLICES`` at most; the one slice
    that holds the cut is summed row by row.
    """
    last = timed.agg(F.max("finish_time")).first()[0]
    if last is None:
        return timed
    timed = timed.withColumn("slice", F.floor(F.col("finish_time") / F.lit(last) * (CUT_SLICES - 1)))
    before, edge = 0, None
    for r in timed.groupBy("slice").agg(F.sum("tokens").alias("sum")).orderBy("slice").collect():
        if before + r["sum"] > budget:
            edge = r["slice"]
            break
        before += r["sum"]
    if edge is None:
        return timed.drop("slice")
    order = Window.partitionBy("slice").orderBy("finish_time", "source", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    part = timed.where(F.col("slice") == edge).withColumn("sum", F.sum("tokens").over(order)).where(F.col("sum") <= budget - before)
    return timed.where(F.col("slice") < edge).unionByName(part.drop("sum")).drop("slice")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: ``source, target_share, actual_share, tokens, n_documents, n_copies, most_uses``.

    Sources without documents come out with zeros.
    """
    used = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    got = used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_documents"), F.sum("uses").alias("n_copies"), F.max("uses").alias("most_uses"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = targets.select(F.lower(F.btrim("source")).alias("source"), "target_share").join(got, "source", "left")
    sums = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_total")).withColumn("_one", F.lit(1))  # one row, sent to every task
    total = F.col("_total")
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(sums), "_one")
    return rows.select("source", "target_share", F.when(total > 0, zero("tokens") / total).otherwise(0.0).alias("actual_share"), *(zero(c).alias(c) for c in ("tokens", "n_documents", "n_copies", "most_uses")))
