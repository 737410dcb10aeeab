"""References to records that do not exist.

``orphan_references`` lists the references whose record is missing, was already retired or comes
only later; ``orphan_report`` counts them by table and period.

The parents are stored once, range-partitioned by a mixed key and sorted within (``Runs``): a range is an array of about
``RANGE_KEYS`` rows at every size of the table. The references are read once, packed into vectors by range, and each vector is
probed by binary search in its range's array, whose row groups the task reads from storage. Any task can read any range, so vectors
are handed out by size, not by key: those of a key that a third of all rows name are spread over as many tasks as they fill
(adaptive rebalancing splits them; nothing is counted first).

Defined results: null reference: no case. A value that is no UUID: a case. Null time: a case (nothing
is known to exist then). Null accepted_at: the record never exists. Repeated rows (same table,
row id and field, null row ids among them): one case. Empty parents: every non-null reference is a case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.functions.ids import hex_digits
from graftwork.runs import Bucket, Runs
from graftwork.scratch import Scratch

RANGE_KEYS = 1 << 17
NEVER, NO_ROW = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: References of one packed vector, at most; and those that a task gathers before it packs them.
VECTOR, GATHERED = 1 << 16, 1 << 18
REFERENCE = np.dtype([("key", "<i8"), ("high", "<i8"), ("low", "<i8"), ("at", "<i8"), ("row_id", "<i8")])
PARENT = "key long, high long, low long, since long, until long"


def _micros(c: Column, missing: int) -> Column:
    return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(missing))


def _halves(hex_: Column) -> list[Column]:
    """A key in mixed order, and the two halves of the id."""
    return [F.xxhash64(hex_).alias("key"), *(F.conv(F.substring(hex_, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "high"), (17, "low")))]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Larger batches: with many ranges a small one would fall apart into vectors of single rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _packed(bits: int):
    """src_table, ref_field, key, high, low, at, row_id -> the same by bucket (-1: no key), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            kinds = [b[c].dictionary_encode() for c in ("src_table", "ref_field")]
            kind = kinds[0].indices.to_numpy().astype(np.int64) * max(1, len(kinds[1].dictionary)) + kinds[1].indices.to_numpy()
            rows = np.zeros(b.num_rows, REFERENCE)
            for c in REFERENCE.names:
                rows[c] = b[c].fill_null(NO_ROW if c == "row_id" else 0).to_numpy(zero_copy_only=False)
            bucket = (rows["key"].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rows), np.int64)
            bucket[b["key"].is_null().to_numpy(zero_copy_only=False)] = -1
            order = np.lexsort((rows["key"], bucket, kind))
            rows, bucket, kind = rows[order], bucket[order], kind[order]
            first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])]) if len(rows) else np.empty(0, np.int64)
            cuts = [range(s, e, VECTOR) for s, e in zip(first, np.r_[first[1:], len(rows)], strict=False)]
            start = np.array([x for c in cuts for x in c], np.int64)
            vectors = [rows[s : min(s + VECTOR, c.stop)].tobytes() for c in cuts for s in c]
            one, two = (k.dictionary.take(pa.array(x)) for k, x in zip(kinds, np.divmod(kind[start], max(1, len(kinds[1].dictionary))), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), one, two, pa.array(vectors, pa.binary())], ["bucket", "src_table", "ref_field", "vector"])

    return run


def _probed(places: list[tuple[str, int]], bits: int, all_rows: bool):
    """Vectors by bucket -> src_table, row_id, ref_field, at, orphan of the orphans (or of all references)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        for b in batches:
            for number, table, field, vector in zip(*(b[c].to_pylist() for c in ("bucket", "src_table", "ref_field", "vector")), strict=True):
                refs = np.frombuffer(vector, REFERENCE)
                found = np.zeros(len(refs), bool)
                if number >= 0:
                    if number != at:
                        if bucket is not None:
                            bucket.close()
                        at, bucket = number, Bucket(places, number, bits)
                    for rows, mine, theirs in bucket.lookup(refs["key"]):
                        high, low, since, until = (rows[c].to_numpy()[theirs] for c in ("high", "low", "since", "until"))
                        own = refs[mine]
                        found[mine[(high == own["high"]) & (low == own["low"]) & (since <= own["at"]) & (until > own["at"])]] = True
                shown = refs if all_rows else refs[~found]
                orphan = ~found if all_rows else np.ones(len(shown), bool)
                columns = [pa.array([table] * len(shown), pa.string()), pa.array(np.ascontiguousarray(shown["row_id"]), mask=shown["row_id"] == NO_ROW), pa.array([field] * len(shown), pa.string()), pa.array(np.ascontiguousarray(shown["at"])), pa.array(orphan)]
                yield pa.RecordBatch.from_arrays(columns, ["src_table", "row_id", "ref_field", "at", "orphan"])

    return run


def reference_rows(df: DataFrame, table: str, row_id: str, time: str, fields: list[str]) -> DataFrame:
    """One row for each non-null reference: src_table, row_id, ref_field, ref, at."""
    refs = F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("ref")) for f in fields)))
    rows = df.select(F.col(row_id).alias("row_id"), F.col(time).alias("at"), refs.alias("r"))
    return rows.select(F.lit(table).alias("src_table"), "row_id", "r.ref_field", "r.ref", "at").where("ref IS NOT NULL")


def _judged(refs: DataFrame, parents: DataFrame, key: str, start: str, end: str, range_keys: int, all_rows: bool) -> DataFrame:
    spark = refs.sparkSession
    known = parents.select(hex_digits(F.col(key)).alias("hex"), _micros(F.col(start), NEVER).alias("since"), _micros(F.col(end), NEVER).alias("until")).where("hex IS NOT NULL")
    stored = Runs(spark, Scratch(spark, "parents").path(), PARENT, range_keys)
    stored.append(known.select(*_halves(F.col("hex")), "since", "until"), parents.count())
    asked = refs.select("src_table", "ref_field", hex_digits(F.col("ref")).alias("hex"), _micros(F.col("at"), -NEVER).alias("at"), F.col("row_id").cast("long").alias("row_id"))
    key_, high, low = _halves(F.col("hex"))
    asked = asked.select("src_table", "ref_field", F.when(F.col("hex").isNotNull(), key_).alias("key"), high, low, "at", "row_id")
    vectors = asked.mapInArrow(_packed(stored.bits), "bucket int, src_table string, ref_field string, vector binary")
    spread = vectors.hint("rebalance", "bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(_probed(stored.places(), stored.bits, all_rows), "src_table string, row_id long, ref_field string, at long, orphan boolean")


def orphan_references(refs: DataFrame, parents: DataFrame, key: str = "id", start: str = "accepted_at", end: str = "retired_at", range_keys: int = RANGE_KEYS) -> DataFrame:
    """src_table, row_id, ref_field of every reference of ``reference_rows`` without a parent at its time."""
    return _judged(refs, parents, key, start, end, range_keys, False).select("src_table", "row_id", "ref_field").distinct()


def orphan_report(refs: DataFrame, parents: DataFrame, key: str = "id", start: str = "accepted_at", end: str = "retired_at", range_keys: int = RANGE_KEYS) -> DataFrame:
    """src_table, month, n_references, n_orphans: counts by table and month of the reference's time; a repeated row counts once."""
    month = F.when(F.col("at") != -NEVER, F.date_format(F.timestamp_micros("at"), "yyyy-MM")).alias("month")
    rows = _judged(refs, parents, key, start, end, range_keys, True).groupBy("src_table", "row_id", "ref_field", month).agg(F.max("orphan").alias("orphan"))
    return rows.groupBy("src_table", "month").agg(F.count("*").alias("n_references"), F.count_if("orphan").alias("n_orphans"))
