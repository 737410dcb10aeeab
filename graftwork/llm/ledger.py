"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

``text_key`` and ``json_keys`` reduce a record to a key that formatting does not change. ``Ledger`` keeps, for each
key, how many copies were seen and the earliest of them, in buckets by key, in a folder that outlives the session. ``add`` aggregates a
new batch (before it is shuffled, so a key that fills a third of the batch costs one row a task), joins it
in full with the buckets it touches and writes only those anew; other buckets are not read.

Defined results: records without letters (null, empty, blank, marks only) and bodies that do not parse or
are no objects have no key and are left out; a redelivered row (same id) counts once; ties for the earliest go to
the smallest id; an empty batch changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.words import letters
from graftwork.runs import Catalogue, bits_for
from graftwork.scratch import Scratch, delete

_GAPS = regex.compile(r"[^\p{L}\p{N}]+")
STATE = "key binary, first_id long, n_copies long"


def text_key(c: Column) -> Column:
    """16 bytes that stand for the letters of a text; null if it has none."""
    own = letters(c)
    return F.when(own != "", F.unhex(F.md5(F.encode(own, "UTF-8"))))


def canonical(value: object) -> object:
    """A JSON value with strings and numbers reduced to their letters, lists unordered, keys sorted."""
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return sorted((canonical(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    return _GAPS.sub("", value if isinstance(value, str) else repr(value)).lower()


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _object_key(body: str | None) -> bytes | None:
    try:
        value = json.loads(body or "", parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    return hashlib.md5(json.dumps(canonical(value), ensure_ascii=False).encode("utf-8", "surrogatepass")).digest()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_object_key(x) for x in b.column(1).to_pylist()], pa.binary())], ["id", "key"])


def json_keys(df: DataFrame, id_: str, body: str) -> DataFrame:
    """id, key of JSON objects; the key is null for other bodies."""
    return df.select(F.col(id_).cast("long").alias("id"), F.col(body).alias("body")).mapInArrow(_keyed, "id long, key binary")


class Ledger:
    """Counts of canonical keys in a folder: buckets are ranges of the key, and the catalogue names the newest version of each.

    The number of buckets doubles when they hold more than ``bucket_rows`` keys each, so a batch reads and writes about as many rows as its keys touch
    buckets times ``bucket_rows``, however large the ledger is. A session that opens the folder later goes on with it. Versions that
    were replaced stay until ``vacuum``."""

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = 1 << 18):
        self.spark, self.bucket_rows = spark, bucket_rows
        self.path = path or Scratch(spark, "ledger").path()
        self.catalogue = Catalogue(spark, f"{self.path}/catalogue")
        self.state = self.catalogue.load() or {"bits": 0, "keys": 0, "next": 0, "at": {}, "stale": []}

    def _read(self, buckets: list[int]) -> DataFrame:
        paths = sorted({f"{self.path}/{self.state['at'][str(b)]}/bucket={b}" for b in buckets if str(b) in self.state["at"]})
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def _bucket(self, bits: int) -> Column:
        """The first bits of a key (32 of them are enough to tell buckets apart)."""
        return F.shiftright(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), 32 - bits).cast("int")

    def _write(self, rows: DataFrame, bits: int) -> tuple[str, dict[int, int]]:
        """Writes the rows in buckets; gives the folder and the rows of each bucket."""
        name = f"version-{self.state['next']}"
        self.state["next"] += 1
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        slices = max(1, parts >> bits)  # a bucket is written by several tasks while there are fewer buckets than tasks
        placed = rows.withColumn("bucket", self._bucket(bits)).repartition(max(parts, 1 << min(bits, 14)), "bucket", F.pmod(F.xxhash64("key"), F.lit(slices)))
        placed.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(STATE + ", bucket int").parquet(f"{self.path}/{name}").groupBy("bucket").agg(F.count("*").alias("n")).collect()  # one row a bucket
        return name, {r.bucket: r.n for r in written}

    def add(self, rows: DataFrame) -> None:
        """Adds a batch of (id, key) rows; ids of one record are equal in every delivery and lie in one batch."""
        seen = rows.where("key IS NOT NULL AND id IS NOT NULL").select("key", "id").distinct()
        scratch = Scratch(self.spark, "ledger-batch")
        batch = scratch.keep(seen.groupBy("key").agg(F.min("id").alias("first_new"), F.count("*").alias("n_new")))
        bits = self.state["bits"]
        hit = {r.bucket: r.n for r in batch.groupBy(self._bucket(bits).alias("bucket")).agg(F.count("*").alias("n")).collect()}  # one row a bucket
        if not hit:
            return
        if (self.state["keys"] + sum(hit.values())) > self.bucket_rows << bits:
            self._split(bits_for(self.state["keys"] + sum(hit.values()), self.bucket_rows))
            bits = self.state["bits"]
            hit = {r.bucket: r.n for r in batch.groupBy(self._bucket(bits).alias("bucket")).agg(F.count("*").alias("n")).collect()}
        merged = batch.join(self._read(list(hit)), "key", "full_outer").select("key", F.least("first_new", "first_id").alias("first_id"), (F.coalesce("n_new", F.lit(0)) + F.coalesce("n_copies", F.lit(0))).alias("n_copies"))
        name, written = self._write(merged, bits)
        self._enter(name, written)
        scratch.clear()

    def _enter(self, name: str, written: dict[int, int]) -> None:
        sizes = self.state.setdefault("sizes", {})
        self.state["stale"] += [f"{self.state['at'][str(b)]}/bucket={b}" for b in written if str(b) in self.state["at"]]
        self.state["at"] |= {str(b): name for b in written}
        sizes |= {str(b): n for b, n in written.items()}
        self.state["keys"] = sum(sizes.values())
        self.catalogue.save(self.state)

    def _split(self, bits: int) -> None:
        """Cuts every bucket into more: once for each doubling, so a key is rewritten a few times at most over the ledger's life."""
        if self.state["at"]:
            name, written = self._write(self.records(), bits)
            self.state["stale"] += [f"{v}/bucket={b}" for b, v in self.state["at"].items()]
            self.state |= {"at": {}, "sizes": {}, "bits": bits}
            self._enter(name, written)
        else:
            self.state["bits"] = bits

    def vacuum(self) -> None:
        """Deletes replaced versions; frames made before may not be read any more."""
        for at in self.state["stale"]:
            delete(self.spark, f"{self.path}/{at}")
        self.state["stale"] = []
        self.catalogue.save(self.state)

    def records(self) -> DataFrame:
        """key, first_id, n_copies of everything added so far."""
        return self._read([int(b) for b in self.state["at"]])
