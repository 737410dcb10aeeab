"""Tables of sorted runs under a folder, for operators that keep state between sessions.

``Catalogue`` is a small JSON document on the same storage as the tables: a change writes the next version and then deletes older
ones, so a reader, or a session that comes later, finds the newest complete one.

``Runs`` keeps rows by a 64-bit key. Each append writes one run: files in buckets, which are ranges of the key, sorted by the key
within. The number of buckets follows the number of rows, so a bucket holds about ``bucket_rows`` rows whatever has
been stored before, and looking up a batch reads the buckets its keys fall into and nothing else. When ``FAN``
runs of like size have come together they are merged into one, so a row is written again once for each FAN-fold growth.

``Bucket`` runs inside tasks: it reads, through Arrow's file systems, the row groups of one bucket's files that may hold the asked keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.scratch import delete

FAN = 8
#: Rows of a row group: what a task holds of a run at once.
GROUP_ROWS = 1 << 16
#: Rows of a bucket up to which a task keeps what it has read of it; of a larger one it holds one row group.
HELD_ROWS = 1 << 20
#: Pairs of a key and a row that are handed over at once.
PAIRS = 1 << 21


class Catalogue:
    """Versions of one JSON document in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path, 0

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        _, at, fs = self._fs()
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[8:-5]) for n in names if n.startswith("version-") and n.endswith(".json"))

    def load(self) -> dict | None:
        """The newest document, None if there is none."""
        found = self._versions()
        if not found:
            return None
        self.version = found[-1]
        jvm, _, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/version-{self.version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def save(self, document: dict) -> None:
        jvm, _, fs = self._fs()
        old, self.version = self._versions(), self.version + 1
        whole = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version-{self.version:09d}.json")
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.version-{self.version:09d}.part")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(document).encode()))
        stream.close()
        if not fs.rename(part, whole):
            raise RuntimeError(f"another writer saved version {self.version} of {self.path}")
        for v in old:
            if v < self.version - 1:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/version-{v:09d}.json"), False)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, so that it means the same in every task."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def bucket_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def bits_for(rows: int, bucket_rows: int) -> int:
    return max(0, (max(1, rows) - 1) // bucket_rows).bit_length()


class Runs:
    """Rows (key BIGINT, ...) of one schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_rows: int = 1 << 18):
        self.spark, self.path, self.schema, self.bucket_rows = spark, qualified(spark, path), schema, bucket_rows
        self.catalogue = Catalogue(spark, f"{self.path}/catalogue")
        self.state = self.catalogue.load() or {"next": 0, "runs": []}

    def _write(self, rows: DataFrame, n: int) -> dict:
        bits, name = bits_for(n, self.bucket_rows), f"run-{self.state['next']}"
        columns = [c.split()[0] for c in self.schema.split(", ")]
        # by size, not by key alone: a bucket of many rows is several files
        placed = rows.select(*columns).withColumn("bucket", bucket_of(F.col("key"), bits)).hint("rebalance", "bucket")
        placed.sortWithinPartitions("bucket", "key").write.option("parquet.block.row.count.limit", GROUP_ROWS).partitionBy("bucket").parquet(f"{self.path}/{name}")
        self.state["next"] += 1
        return {"name": name, "rows": n, "bits": bits}

    def append(self, rows: DataFrame, n: int) -> None:
        """Adds rows, of which there are about n. Nothing stored before is read, but for merges."""
        self.state["runs"].append(self._write(rows, n))
        tier = lambda r: max(1, r["rows"]).bit_length() // 3
        stale = []
        while True:
            last = tier(self.state["runs"][-1])
            like = [r for r in self.state["runs"] if tier(r) <= last]
            if len(like) < FAN:
                break
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(f"{self.path}/{r['name']}").drop("bucket") for r in like]), sum(r["rows"] for r in like))
            self.state["runs"] = [r for r in self.state["runs"] if r not in like] + [merged]
            stale += like
        self.state["stale"] = [*self.state.get("stale", []), *(r["name"] for r in stale)]
        self.catalogue.save(self.state)

    def vacuum(self) -> None:
        """Deletes runs that merges have replaced; frames made before may not be read any more."""
        for name in self.state.pop("stale", []):
            delete(self.spark, f"{self.path}/{name}")
        self.catalogue.save(self.state)

    @property
    def bits(self) -> int:
        """Of the finest run: the ranges by which a batch is handed to tasks."""
        return max([r["bits"] for r in self.state["runs"]], default=0)

    def places(self) -> list[tuple[str, int]]:
        """Path and bits of each run, for ``lookup``."""
        return [(f"{self.path}/{r['name']}", r["bits"]) for r in self.state["runs"]]


class Bucket:
    """The row groups of all runs that cover one range of keys (``number`` of 2 ** bits ranges)."""

    def __init__(self, places: list[tuple[str, int]], number: int, bits: int):
        self.files, self.held, self.rows, self.bytes = [], {}, 0, 0
        for path, own in places:
            fs, at = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
            folder = f"{at}/bucket={number >> (bits - own)}"
            for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if f.base_name.endswith(".parquet"):
                    file = pq.ParquetFile(fs.open_input_file(f.path))
                    self.rows += file.metadata.num_rows
                    at_key = file.schema_arrow.names.index("key")
                    spans = [file.metadata.row_group(g).column(at_key).statistics for g in range(file.metadata.num_row_groups)]
                    self.files.append((file, [(s.min, s.max) if s is not None and s.has_min_max else (-(2**63), 2**63 - 1) for s in spans]))

    def _group(self, i: int, g: int) -> pa.RecordBatch:
        """A row group, kept as long as the bucket is small enough to be held as a whole."""
        if (i, g) not in self.held:
            if self.rows > HELD_ROWS:
                self.held.clear()
            file = self.files[i][0]
            self.held[i, g] = file.read_row_group(g).combine_chunks().to_batches()[0]
            self.bytes += file.metadata.row_group(g).total_byte_size
        return self.held[i, g]

    def lookup(self, keys: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """For sorted keys: (rows of a group, positions in keys, rows that hold them), a group at a time."""
        for i, (_, spans) in enumerate(self.files):
            for g, (low, high) in enumerate(spans):
                a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
                if a == b:
                    continue
                rows = self._group(i, g)
                held = rows["key"].to_numpy()
                left = np.searchsorted(held, keys[a:b], "left")
                n = np.searchsorted(held, keys[a:b], "right") - left
                stop = np.r_[0, np.cumsum(n)]
                # a key of many rows meets many: some keys at a time
                cuts = np.unique(np.r_[np.searchsorted(stop, np.arange(0, stop[-1], PAIRS)), b - a])
                for s, e in zip(cuts, cuts[1:], strict=False):
                    mine = np.repeat(np.arange(s, e), n[s:e])
                    yield rows, a + mine, np.arange(len(mine)) + np.repeat(left[s:e] - (stop[s:e] - stop[s]), n[s:e])

    def close(self) -> None:
        for file, _ in self.files:
            file.close(force=True)
