"""A keyed store of sorted Parquet runs below one folder, with a versioned manifest.

Writes go to log segments; a flush reduces them to a sorted run of level 0;
compaction merges runs into the next level. Every change is one new manifest
version: readers keep the version they opened, and files are only deleted by
``vacuum``, once no kept version names them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.record_bytes import wal_checksum
from tidemark.operators import lww, replication, runs, wal
from tidemark.schema import MANIFEST, OPLOG
from tidemark.sources.commitlog import CommitLog

MEMTABLE_BYTES = 8 << 20
LAST_LEVEL = 3
#: Bytes of records of a file that a compaction writes; below that, as many files as there are cores, of LEAST_BYTES.
FILE_BYTES, LEAST_BYTES = 128 << 20, 4 << 20
COLUMNS = ["key", "value", "seq", "op"]


class Store:
    """The store at ``path``; ``version`` opens an older manifest for reading."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/manifest")
        self._stops: dict[str, int | None] = {}
        n, entry = self.log.latest()
        if version is not None:
            n, entry = version, self.log.read(version)
        self.version = n
        self.state = entry or {"runs": [], "segments": [], "next_id": 1, "next_seq": 1, "batches": {}}

    def _publish(self, **changes) -> None:
        """The next version. The caller's version must be the newest, or this raises and nothing changes."""
        self.log.publish(self.version + 1, {**self.state, **changes})
        self.version, self.state = self.version + 1, {**self.state, **changes}

    # Reading

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[c] for c in ("id", "level", "min_key", "max_key", "max_seq", "size_bytes", "n_rows", "path")) for r in self.state["runs"]], MANIFEST)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], OPLOG)

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(OPLOG).parquet(*[f"{self.path}/{n}" for n in names]) if names else self._empty()

    def _first_bad(self) -> dict[str, int | None]:
        """For each segment the first sequence number of a bad record, or None. A segment is checked once by a ``Store``, not by each read."""
        new = [n for n in self.state["segments"] if n not in self._stops]
        if new:
            # One folder per segment; the records of a segment are checked by their own column.
            rows = self.spark.read.schema(OPLOG + ", checksum long").parquet(*[f"{self.path}/{n}" for n in new]).withColumn("segment", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
            bad = F.coalesce(F.col("checksum") != wal_checksum(F.col("seq"), F.col("op"), F.col("key"), F.col("value")), F.lit(True))
            found = {r.segment: r.stop for r in rows.where(bad).groupBy("segment").agg(F.min("seq").alias("stop")).collect()}  # one row a broken segment
            self._stops |= {n: found.get(n.rpartition("/")[2]) for n in new}
        return self._stops

    def memtable(self) -> DataFrame:
        """Operations not flushed yet: of each segment what comes before its first bad record."""
        stops = self._first_bad()
        out = self._read([n for n in self.state["segments"] if stops[n] is None])
        for n in self.state["segments"]:
            if stops[n] is not None:
                out = out.unionByName(self._read([n]).where(F.col("seq") < stops[n]))
        return out.where("seq IS NOT NULL").select(*COLUMNS)

    def files_for(self, low: str | None, high: str | None) -> list[dict]:
        """The runs whose key range meets ``[low, high]``, chosen from the manifest without opening any."""
        met = []
        for r in self.state["runs"]:
            below = high is not None and r["min_key"] is not None and r["min_key"].encode() > high.encode()
            above = low is not None and r["max_key"] is not None and r["max_key"].encode() < low.encode()
            if not below and not above:
                met.append(r)
        return met

    def rows(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """All stored operations that may concern keys in the range, unmerged."""
        out = self._read([r["path"] for r in self.files_for(low, high)]).unionByName(self.memtable())
        if low is not None:
            out = out.where(F.col("key") >= low)
        return out.where(F.col("key") <= high) if high is not None else out

    def snapshot(self) -> DataFrame:
        return lww.snapshot(self.rows())

    def get(self, key: str) -> DataFrame:
        """``key, value, seq`` of the key, or no row. The deepest levels come last but all candidates are compared by seq."""
        return lww.snapshot(self.rows(key, key))

    def scan(self, low: str | None = None, high: str | None = None) -> DataFrame:
        return lww.snapshot(self.rows(low, high))

    def file(self, id: int) -> dict | None:
        """The manifest's entry of a file, or None."""
        return next((r for r in self.state["runs"] if r["id"] == id), None)

    def pull(self, id: int | None = None) -> Iterator[Row]:
        """Rows ``key, value, seq, op`` one by one in key order: of the file ``id``, removals too, or the live ones of the whole store.

        Parts are fetched as they are needed; the driver holds one at a time.
        """
        if id is not None:
            entry = self.file(id)
            if entry is None:
                raise KeyError(f"this version has no file {id}")
            return self._read([entry["path"]]).orderBy("key").toLocalIterator()
        return lww.lww(self.rows()).where(lww.LIVE).orderBy("key").toLocalIterator()

    def positions(self, id: int) -> DataFrame:
        """``position, key, value, seq, op`` of a run: its rows with their places in key order from 0, as they are stored.

        Parts of a run are in the order of their names, so a row's place is its
        place in its part, raised by the parts before; nothing is sorted.
        """
        path = self.file(id)["path"]
        parts, before = [], 0
        for name, facts in sorted(self.log.footers(f"{self.path}/{path}").items()) if not path.endswith(".parquet") else [(path.rpartition("/")[2], None)]:
            parts.append((name, before))
            before += facts["n_rows"] if facts else 0
        ahead = self.spark.createDataFrame(parts, "_name string, _ahead long")
        rows = self._read([path]).select(*COLUMNS, F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_row"))
        return rows.join(F.broadcast(ahead), "_name").select((F.col("_row") + F.col("_ahead")).alias("position"), *COLUMNS)

    def listing(self) -> DataFrame:
        """Every stored row with its source, the log first, then runs from the newest; unmerged."""
        parts = [("memtable", self.memtable())] + [(f"run_{r['id']}", self._read([r["path"]])) for r in sorted(self.state["runs"], key=lambda r: -r["id"])]
        return lww.listing(parts)

    # Writing

    def write(self, ops: DataFrame, order: str = "seq", batch: tuple[str, int] | None = None) -> None:
        """Append operations ``key, value, op`` with ``seq``, or numbered in the order of column ``order``.

        NULL values are stored as ``''``, as removals' are. A NULL key fails the
        batch and nothing of it is kept, as key ranges of files couldn't tell it.
        ``batch`` names a stream and its batch: one that was committed before is
        not written again.
        """
        if self._known(batch):
            return
        rows = self._numbered(ops, order)
        name = f"log/{uuid.uuid4().hex}"
        seen = Observation()
        rows = rows.withColumn("checksum", wal_checksum(F.col("seq"), F.col("op"), F.col("key"), F.col("value"))).observe(seen, F.max("seq").alias("top"))
        rows.write.parquet(f"{self.path}/{name}")
        top = seen.get["top"]
        self._stops[name] = None
        self._publish(segments=[*self.state["segments"], name], next_seq=max(self.state["next_seq"], (top or 0) + 1), batches=self._batches(batch))

    def load(self, ops: DataFrame, order: str = "seq", batch: tuple[str, int] | None = None) -> None:
        """As ``write`` and ``flush`` of one batch, without the log between: the run's commit is what makes it durable."""
        if self._known(batch):
            return
        run = self._write_run(lww.lww(self._numbered(ops, order)).repartitionByRange("key"), 0)
        top = max([r["max_seq"] for r in run], default=0)
        self._publish(runs=[*self.state["runs"], *run], next_id=self.state["next_id"] + 1, next_seq=max(self.state["next_seq"], top + 1), batches=self._batches(batch))

    def wrote(self, name: str, n: int) -> bool:
        """Whether batch ``n`` of stream ``name`` is in the store."""
        return self._known((name, n))

    def _known(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.state["batches"].get(batch[0], -1) >= batch[1]

    def _batches(self, batch: tuple[str, int] | None) -> dict[str, int]:
        return {**self.state["batches"], **({batch[0]: batch[1]} if batch else {})}

    def _numbered(self, ops: DataFrame, order: str) -> DataFrame:
        if order != "seq":
            ops = replication.assign_index(ops, [], order, self.state["next_seq"] - 1).withColumn("seq", F.col("index"))
        value = F.when(F.col("op") == "PUT", F.coalesce("value", F.lit(""))).otherwise("")
        key = F.coalesce("key", F.raise_error(F.lit("a store has no NULL keys")).cast("string"))
        return ops.select(key.alias("key"), value.alias("value"), F.col("seq").cast("long").alias("seq"), "op")

    def put(self, key: str, value: str) -> None:
        self.write(self.spark.createDataFrame([(key, value, "PUT", self.state["next_seq"])], "key string, value string, op string, seq long"))

    def delete(self, key: str) -> bool:
        """Write a removal; returns whether the key was live."""
        live = not self.get(key).isEmpty()
        self.write(self.spark.createDataFrame([(key, "", "DELETE", self.state["next_seq"])], "key string, value string, op string, seq long"))
        return live

    def _write_run(self, rows: DataFrame, level: int) -> list[dict]:
        """Write rows, range-partitioned by key, as a run in key order; none if there are no rows. Its facts are gathered as it is written."""
        n, seen = self.state["next_id"], Observation()
        name = f"runs/run_{n:08d}_{uuid.uuid4().hex[:8]}"
        facts = runs.facts()
        self._sink(rows.sortWithinPartitions("key").observe(seen, facts[0], *facts[1:]), name)
        meta = seen.get
        if not meta["n_rows"]:
            return []
        return [{"id": n, "level": level, "path": name} | {c: meta[c] for c in ("min_key", "max_key", "max_seq", "size_bytes", "n_rows")}]

    def _write_files(self, rows: DataFrame, level: int, row_bytes: float) -> list[dict]:
        """Write sorted, range-partitioned rows; every file is an entry of its own, with its own key range.

        Facts come from the files' footers; ``size_bytes`` is the rows' number
        times ``row_bytes``, as adding up their sizes while writing would cost more than the merge.
        """
        name = f"runs/run_{self.state['next_id']:08d}_{uuid.uuid4().hex[:8]}"
        self._sink(rows, name)
        found = {f: m for f, m in self.log.footers(f"{self.path}/{name}").items() if m}
        if any("min_key" not in m for m in found.values()):
            files = runs.file_facts(self._read([name]))
        else:
            files = [{"file": f} | m | {"size_bytes": round(m["n_rows"] * row_bytes)} for f, m in sorted(found.items(), key=lambda x: x[1]["min_key"].encode())]
        return [{"id": self.state["next_id"] + i, "level": level, "path": f"{name}/{r.pop('file')}"} | r for i, r in enumerate(files)]

    def _sink(self, rows: DataFrame, name: str) -> None:
        rows.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", "0.01").parquet(f"{self.path}/{name}")

    def memtable_bytes(self) -> int:
        return runs.memtable_size(self.memtable()).first()["size_bytes"]

    def flush(self) -> None:
        """The log's operations become a run of level 0. Run and emptied log are published as one."""
        if self.state["segments"]:
            run = self._write_run(lww.lww(self.memtable()).repartitionByRange("key"), 0)
            self._publish(runs=[*self.state["runs"], *run], segments=[], next_id=self.state["next_id"] + 1)

    def flush_if_large(self, limit: int = MEMTABLE_BYTES) -> None:
        if self.memtable_bytes() >= limit:
            self.flush()

    # Compaction

    def due_levels(self) -> list[int]:
        """Levels over their limit: level 0 by its runs, others by their bytes (see ``runs.compaction_due``)."""
        level = lambda n: [r for r in self.state["runs"] if r["level"] == n]
        due = [n for n, limit in runs.LEVEL_BYTES.items() if sum(r["size_bytes"] or 0 for r in level(n)) > limit]
        return [0, *due] if len(level(0)) >= runs.L0_FILES else due

    @property
    def paused(self) -> bool:
        return self.state.get("paused", False)

    def pause(self) -> None:
        """Stop ``compact_due`` for every reader of the manifest, until ``resume``."""
        self._publish(paused=True)

    def resume(self) -> None:
        self._publish(paused=False)

    def wait_for_compaction(self, seconds: float = 5.0) -> bool:
        """Wait until the newest version has no level due; whether it came to that in time."""
        until = time.monotonic() + seconds
        while Store(self.spark, self.path).due_levels():
            if time.monotonic() >= until:
                return False
            time.sleep(0.1)
        return True

    def _inputs(self, level: int, files: int) -> list[dict]:
        """All runs of level 0, or the first ``files`` of a deeper level, and what they meet in the next level."""
        own = sorted((r for r in self.state["runs"] if r["level"] == level), key=lambda r: (r["min_key"].encode(), r["id"]))
        own = own if level == 0 else own[:files]
        if not own:
            return []
        low, high = min(r["min_key"].encode() for r in own), max(r["max_key"].encode() for r in own)
        return own + [r for r in self.state["runs"] if r["level"] == level + 1 and not (r["max_key"].encode() < low or r["min_key"].encode() > high)]

    def compact(self, level: int, files: int = 1) -> None:
        """Merge level 0, or the first ``files`` files of a deeper level, with what they meet in the next level.

        The result is cut into files of some ``FILE_BYTES`` with key ranges that
        don't meet, so a later merge rewrites only the files it meets. Removals
        are dropped only if no level below holds a file that meets the merged
        range. A merge that leaves nothing still drops its inputs.
        """
        inputs = self._inputs(level, files) if level < LAST_LEVEL else []
        if not inputs:
            return
        chosen = {r["id"] for r in inputs}
        low, high = (f(r[c].encode() for r in inputs).decode() for f, c in ((min, "min_key"), (max, "max_key")))
        bottom = not any(r["level"] > level + 1 for r in self.files_for(low, high) if r["id"] not in chosen)
        size = sum(r["size_bytes"] or 0 for r in inputs)
        n = max(1, -(-size // FILE_BYTES), min(self.spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
        # A key has one row per input, so it needs no reduction before the shuffle: one range shuffle serves merge and order.
        rows = self._read([r["path"] for r in inputs]).repartitionByRange(n, "key")
        made = self._write_files(runs.merged(rows, bottom), level + 1, size / max(1, sum(r["n_rows"] for r in inputs)))
        kept = [r for r in self.state["runs"] if r["id"] not in chosen]
        kept = sorted([*kept, *made], key=lambda r: (r["level"], r["min_key"].encode() if r["level"] else b"", r["id"]))
        self._publish(runs=kept, next_id=self.state["next_id"] + max(1, len(made)))

    def compact_due(self) -> int:
        """Compact until no level is due; returns the number of compactions. Does nothing while paused.

        Of a deeper level, as many files go at once as bring it below its limit.
        """
        n = 0
        while not self.paused and (due := self.due_levels()):
            level, files = due[0], 1
            if level:
                own = sorted((r for r in self.state["runs"] if r["level"] == level), key=lambda r: (r["min_key"].encode(), r["id"]))
                over = sum(r["size_bytes"] or 0 for r in own) - runs.LEVEL_BYTES[level]
                while over > 0 and files <= len(own):
                    over -= own[files - 1]["size_bytes"] or 0
                    files += 1
                files -= 1
            self.compact(level, files)
            n += 1
        return n

    # Versions

    def recover(self) -> int:
        """The next sequence number as runs and log tell it; restarts read everything else from the manifest."""
        top = max([r["max_seq"] for r in self.state["runs"]], default=0)
        return max(top + 1, wal.next_seq(self.memtable()).first()[0])

    def clear(self) -> None:
        """An empty version; sequence numbers and ids go on."""
        self._publish(runs=[], segments=[])

    def vacuum(self, keep: int = 2, unfinished: bool = False) -> list[str]:
        """Delete files that none of the last ``keep`` versions names, and the versions before; returns the files' names.

        ``unfinished`` also deletes files that no version ever named, as failed
        writes leave them; only while nobody is writing.
        """
        versions = [self.log.read(n) for n in self.log.numbers()]
        named = lambda v: {r["path"] for r in v["runs"]} | set(v["segments"])
        live, known = (set().union(*map(named, vs)) for vs in (versions[-keep:], versions))
        if unfinished:
            live_folders = {n.rpartition("/")[0] if n.endswith(".parquet") else n for n in live}
            for where in ("runs", "log"):
                if self.log.exists(f"{self.path}/{where}"):
                    known |= {f"{where}/{f}" for f in self.log.folders(f"{self.path}/{where}")} - live_folders
        gone = [n for n in sorted(known - live) if self.log.exists(f"{self.path}/{n}")]
        for n in gone:
            self.log.delete(f"{self.path}/{n}")
        self.log.trim(keep)
        return gone
