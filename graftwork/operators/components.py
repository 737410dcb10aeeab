"""Connected components of an undirected graph.

Each partition joins its own links by a disjoint-set forest and keeps one star for each of its components; the stars
are merged eight partitions into one as long as a merge task stays under ``merge_rows`` links. What
is left between larger partitions is joined by rounds of large-star and small-star, which are plain aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.scratch import Scratch

MERGE_ROWS = 2_000_000
STARS = "node string, rep string"


def unite(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number in each number's component."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        if np.array_equal(x, y):
            return up
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, up[up]):
            up = up[up]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    names = np.array(sorted({*t["node"].to_pylist(), *t["rep"].to_pylist()}), dtype=object)
    at = {x: i for i, x in enumerate(names.tolist())}
    a, b = (np.array([at[x] for x in t[c].to_pylist()], np.int64) for c in ("node", "rep"))
    up = unite(a, b, len(names))
    for s in range(0, len(names), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[s : s + 50_000].tolist(), pa.string()), pa.array(names[up[s : s + 50_000]].tolist(), pa.string())], ["node", "rep"])


def components(links: DataFrame, a: str, b: str, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """node, rep: every node with the smallest name in its component. Links with a null end are left out."""
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("rep")).where("node IS NOT NULL AND rep IS NOT NULL")
    level = scratch.keep(pairs.mapInArrow(_stars, STARS))
    parts, least = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-level.count() // merge_rows))
    while parts > least:
        parts = max(least, parts // 8)
        new = scratch.keep((level.repartition(parts, "rep") if parts > 1 else level.coalesce(1)).mapInArrow(_stars, STARS))
        scratch.drop(level)
        level = new
    if least == 1:
        return level
    before = None
    while True:
        both = level.select("node", "rep").union(level.select(F.col("rep"), F.col("node")))
        low = both.groupBy("node").agg(F.min(F.least("node", "rep")).alias("low"))
        # large star: neighbours above a node move to the lowest it knows; small star: so do those below
        large = both.join(low, "node").where("rep > node").select(F.col("rep").alias("node"), F.col("low").alias("rep"))
        down = large.select(F.greatest("node", "rep").alias("node"), F.least("node", "rep").alias("rep")).distinct()
        lowest = down.groupBy("node").agg(F.min("rep").alias("low"))
        small = down.join(lowest, "node").select(F.col("rep").alias("node"), F.col("low").alias("rep")).union(lowest.select("node", F.col("low").alias("rep")))
        nodes = level.select("node").union(level.select("rep")).distinct()
        level = scratch.keep(small.union(nodes.select("node", F.col("node").alias("rep"))).distinct())
        now = level.agg(F.count("*"), F.sum(F.xxhash64("node", "rep").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return level.groupBy("node").agg(F.min("rep").alias("rep"))
