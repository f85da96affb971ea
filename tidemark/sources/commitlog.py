"""A folder of numbered commit files: the one step that makes written data visible."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession


class CommitLog:
    """``<path>/<n>.json`` for n = 1, 2, ...; readers know only what these name.

    A commit is written under another name and then given its own without
    overwriting: by a hard link on a local disk, else by a rename that fails if
    the name is taken (atomic on HDFS). Of two writers of one number exactly one
    succeeds. Object stores without such a rename need one committer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, n: int) -> dict:
        stream = self._fs.open(self._at(f"{n}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def publish(self, n: int, entry: dict) -> None:
        """Create commit ``n``; raises if it is there."""
        self._fs.mkdirs(self._at(""))
        temporary, final = self._at(f".{uuid.uuid4().hex}"), self._at(f"{n}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                nio = [self._jvm.java.io.File(x.toUri().getPath()).toPath() for x in (final, temporary)]
                self._jvm.java.nio.file.Files.createLink(*nio)
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = SparkContext._gateway.new_array(none.getClass(), 1)
                options[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri()).rename(temporary, final, options)
        except Py4JJavaError as e:
            raise RuntimeError(f"commit {n} was made by another writer") from e
        finally:
            self._fs.delete(temporary, False)

    def is_file(self, path: str) -> bool:
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self._conf)
        return fs.exists(at) and fs.getFileStatus(at).isFile()

    def folders(self, path: str) -> list[str]:
        """Names of the folders in ``path``."""
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return sorted(s.getPath().getName() for s in at.getFileSystem(self._conf).listStatus(at) if s.isDirectory())

    def footers(self, path: str) -> dict[str, dict | None]:
        """Of each Parquet file in ``path``: ``min_key, max_key, max_seq, n_rows`` as its footer tells it.

        None for a file without rows. The driver reads footers only. Keys too
        long for a footer leave ``min_key`` out.
        """
        reader, at = self._jvm.org.apache.parquet.hadoop.ParquetFileReader, self._jvm.org.apache.hadoop.fs.Path(path)

        def read(status) -> tuple[str, dict | None]:
            facts, keys = {"n_rows": 0, "max_seq": None}, []
            for block in reader.readFooter(self._conf, status.getPath()).getBlocks():
                facts["n_rows"] += block.getRowCount()
                stats = {c.getPath().toDotString(): c.getStatistics() for c in block.getColumns()}
                if not (stats["key"].hasNonNullValue() and stats["seq"].hasNonNullValue()):
                    keys.append(None)
                    continue
                keys += [stats["key"].genericGetMin().toStringUsingUTF8(), stats["key"].genericGetMax().toStringUsingUTF8()]
                facts["max_seq"] = max(facts["max_seq"] or stats["seq"].genericGetMax(), stats["seq"].genericGetMax())
            if keys and None not in keys:
                facts |= {"min_key": min(keys, key=str.encode), "max_key": max(keys, key=str.encode)}
            return status.getPath().getName(), facts if facts["n_rows"] else None

        files = [s for s in at.getFileSystem(self._conf).listStatus(at) if s.getPath().getName().endswith(".parquet")]
        with ThreadPoolExecutor(16) as pool:
            return dict(pool.map(read, files))

    def trim(self, keep: int) -> None:
        """Forget all but the last ``keep`` commits; what only they name must be deleted before."""
        for n in self.numbers()[: -max(1, keep)]:
            self._fs.delete(self._at(f"{n}.json"), False)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
