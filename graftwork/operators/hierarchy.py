"""Parent-child links to full hierarchies.

``resolve_hierarchy`` gives the root and depth of every node and finds cycles:

1. links are reduced to one row a child while they are shuffled (a repeated link costs nothing more);
2. every partition runs a weighted disjoint-set forest over its own links: a node points to the
   farthest ancestor that the partition knows, and the offset is the number of links between;
3. only pointers of nodes that others point to ("boundary") move on. They are merged level by
   level, eight partitions into one, down to as few partitions as hold ``merge_rows`` links each; what is left between
   those is resolved by doubling joins. There are as many first partitions as links fill, too, so no task holds more than
   about ``merge_rows`` links (children are unique, so a hash spreads them evenly), however large the table is;
4. nodes whose pointers never end lie on a cycle or below one; their own links are looked at alone.

``hierarchy_paths`` materialises root-to-node paths by following stored pointers whose reach doubles
each round, and ``hierarchy_closure`` unfolds them to (ancestor, descendant) pairs.

Defined results: null ends and self-repeats: links with a null end are left out; repeated links count
once; a node given several parents keeps the smallest one; a node linked to itself is a cycle; an empty
table gives an empty result; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.functions.ids import pack_id, unpack_id
from graftwork.scratch import Scratch

#: Links that one merge task may hold (about 100 bytes each in a Python worker).
MERGE_ROWS = 2_000_000
POINTERS = "node binary, anc binary, dist long"


def compress(parent: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted path compression. parent[i] < 0: i is a root here. Gives root and offset of each
    entry, and which entries never end at a root (they keep their own pointer)."""
    n = len(parent)
    up = np.where(parent < 0, np.arange(n), parent)
    off = np.where(parent < 0, 0, dist)
    for _ in range(max(1, n).bit_length() + 1):
        new = up[up]
        if np.array_equal(new, up):
            break
        off = off + off[up]
        up = new
    lost = parent[up] >= 0
    return np.where(lost, parent, up), np.where(lost, dist, off), lost


def _encode(node: pa.ChunkedArray, anc: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    both = pa.concat_arrays([*node.cast(pa.binary()).chunks, *anc.cast(pa.binary()).chunks]).dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False)
    return codes[: len(node)], codes[len(node) :], both.dictionary


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The disjoint-set forest of one partition."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    node, anc, ids = _encode(t["node"], t["anc"])
    parent = np.full(len(ids), -1, np.int64)
    dist = np.zeros(len(ids), np.int64)
    parent[node] = anc
    dist[node] = t["dist"].to_numpy()
    up, off, _ = compress(parent, dist)
    for a in range(0, len(node), 50_000):
        mine = node[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), ids.take(pa.array(up[mine])), pa.array(off[mine])], ["node", "anc", "dist"])


def parent_links(df: DataFrame, parent: str, child: str) -> DataFrame:
    """One row a child: node, anc (its parent), dist 1; hash-partitioned by the child."""
    rows = df.select(pack_id(F.col(child)).alias("node"), pack_id(F.col(parent)).alias("p")).where("node IS NOT NULL AND p IS NOT NULL")
    return rows.groupBy("node").agg(F.min("p").alias("anc")).withColumn("dist", F.lit(1).cast("long"))


def _ends(pointers: DataFrame) -> DataFrame:
    """Doubling by joins: each round a pointer takes over the pointer of the node it points to.
    A round that brings no further pointer to its end leaves only nodes on or below cycles; they
    come out with a null root."""
    scratch = Scratch(pointers.sparkSession, "ends")
    state, before, old = pointers, -1, None
    while True:
        other = state.select(F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("dist").alias("d2"))
        step = state.join(other, F.col("anc") == F.col("n2"), "left")
        step = scratch.keep(step.select("node", F.coalesce("a2", "anc").alias("anc"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.col("n2").isNull().alias("ended")))
        scratch.drop(old)
        left, old = step.where("NOT ended").count(), step
        if left in (0, before):
            return step.select("node", F.when(F.col("ended"), F.col("anc")).alias("root"), F.col("dist").alias("depth"))
        before, state = left, step.select("node", "anc", "dist")


def _merged(boundary: DataFrame, merge_rows: int, parts: int) -> DataFrame:
    """node, root (null: never ends), depth of the boundary pointers."""
    spark = boundary.sparkSession
    scratch = Scratch(spark, "merge")
    level = scratch.keep(boundary)
    n = level.count()
    least = max(1, -(-n // merge_rows))
    while parts > least:
        parts = max(least, parts // 8)
        # ranges of one hash: the partitions of a level are unions of those of the level below
        slot = F.floor(F.shiftrightunsigned(F.xxhash64("node"), 33) * parts / F.lit(2**31)).cast("int")
        new = scratch.keep((level.repartitionById(parts, slot) if parts > 1 else level.coalesce(1)).mapInArrow(_local, POINTERS))
        scratch.drop(level)
        level = new
    if least == 1:
        # all pointers were in one task: a pointer that still ends at a node with a pointer is lost
        return level.alias("a").join(level.select(F.col("node").alias("n2")), F.col("a.anc") == F.col("n2"), "left").select("node", F.when(F.col("n2").isNull(), F.col("anc")).alias("root"), F.col("dist").alias("depth"))
    return _ends(level)


def _cycle_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cycle nodes (-1), nodes below (-2) and the smallest id of their cycle, of links that all lead to cycles."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    both = pa.concat_arrays([*t["node"].chunks, *t["anc"].chunks]).dictionary_encode()
    codes, names = both.indices.to_numpy(zero_copy_only=False), np.array(both.dictionary.to_pylist(), dtype=object)
    n = len(names)
    up = np.empty(n, np.int64)
    up[codes[: len(t)]] = codes[len(t) :]
    order = np.argsort(np.array([x.encode() for x in names], dtype=object), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    far, low = up.copy(), np.minimum(rank, rank[up])
    for _ in range(n.bit_length() + 1):
        low = np.minimum(low, low[far])
        far = far[far]
    on = np.zeros(n, bool)
    on[far] = True
    # below a cycle the walk also met nodes of the tail; what its far end met is the cycle alone
    low = np.where(on, low, low[far])
    yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(names[order[low]].tolist(), pa.string()), pa.array(np.where(on, -1, -2).astype(np.int32))], ["node_id", "root_id", "depth"])


def _cycles(links: DataFrame, merge_rows: int) -> DataFrame:
    """node_id, root_id, depth (-1 on a cycle, -2 below one) of links (node_id, parent_id) that all lead to cycles."""
    scratch = Scratch(links.sparkSession, "cycles")
    links = scratch.keep(links.select(F.col("node_id").alias("node"), F.col("parent_id").alias("anc")))
    n = links.count()
    if n <= merge_rows:
        return links.coalesce(1).mapInArrow(_cycle_batch, "node_id string, root_id string, depth int")
    state = links.select("node", F.col("anc").alias("far"), F.least("node", "anc").alias("low"))
    images = -1
    while True:  # the nodes that walks of 2^k steps reach become fewer until only cycles are left
        other = state.select(F.col("node").alias("n2"), F.col("far").alias("f2"), F.col("low").alias("l2"))
        step = scratch.keep(state.join(other, F.col("far") == F.col("n2")).select("node", F.col("f2").alias("far"), F.least("low", "l2").alias("low")))
        scratch.drop(state)
        state = step
        now = state.select("far").distinct().count()
        if now == images:
            break
        images = now
    on = state.select(F.col("far").alias("node")).distinct()
    ring = state.join(on, "node", "left_semi")
    for _ in range(ring.count().bit_length()):  # on a cycle the smallest id settles once walks go all round
        other = ring.select(F.col("node").alias("n2"), F.col("far").alias("f2"), F.col("low").alias("l2"))
        step = scratch.keep(ring.join(other, F.col("far") == F.col("n2")).select("node", F.col("f2").alias("far"), F.least("low", "l2").alias("low")))
        scratch.drop(ring)
        ring = step
    lows = ring.select(F.col("node").alias("n2"), F.col("low").alias("ring_low"))
    below = state.join(lows, F.col("far") == F.col("n2")).join(on.withColumn("is_on", F.lit(True)), "node", "left")
    mine = ring.select(F.col("node"), F.col("low").alias("own_low"))
    return below.join(mine, "node", "left").select(F.col("node").alias("node_id"), F.coalesce("own_low", "ring_low").alias("root_id"), F.when(F.col("is_on"), -1).otherwise(-2).cast("int").alias("depth"))


def _resolve(df: DataFrame, parent: str, child: str, merge_rows: int) -> tuple[DataFrame, DataFrame]:
    """The links (node, anc), and node, root (null: on or below a cycle), depth of every child."""
    scratch = Scratch(df.sparkSession, "hierarchy")
    links = scratch.keep(parent_links(df, parent, child))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // merge_rows))
    local = scratch.keep(links.repartition(parts, "node").mapInArrow(_local, POINTERS))
    ancs = local.select(F.col("anc").alias("node")).distinct()
    ends = scratch.keep(_merged(local.join(ancs, "node", "left_semi"), merge_rows, parts))
    found = local.join(ends.select(F.col("node").alias("n2"), "root", "depth"), F.col("anc") == F.col("n2"), "left")
    # anc without an end of its own is a root; anc with a null root leads to a cycle
    found = found.select("node", F.when(F.col("n2").isNull(), F.col("anc")).otherwise(F.col("root")).alias("root"), (F.col("dist") + F.coalesce("depth", F.lit(0))).cast("int").alias("depth"))
    return links, scratch.keep(found)


def resolve_hierarchy(df: DataFrame, parent: str, child: str, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """node_id, root_id, depth of every id at either end of a link (see the module's text)."""
    links, found = _resolve(df, parent, child, merge_rows)
    roots = found.where("root IS NOT NULL").select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    tree = found.where("root IS NOT NULL").unionByName(roots).select(unpack_id(F.col("node")).alias("node_id"), unpack_id(F.col("root")).alias("root_id"), "depth")
    lost = links.join(found.where("root IS NULL").select("node"), "node", "left_semi").select(unpack_id(F.col("node")).alias("node_id"), unpack_id(F.col("anc")).alias("parent_id"))
    return tree.unionByName(_cycles(lost, merge_rows))


def hierarchy_paths(df: DataFrame, parent: str, child: str, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """node_id, path ARRAY<STRING> from the root to the node itself. Nodes on or below cycles have no path."""
    links, found = _resolve(df, parent, child, merge_rows)
    scratch = Scratch(df.sparkSession, "paths")
    tree = links.join(found.where("root IS NOT NULL").select("node"), "node", "left_semi")
    # round k: the stored pointer reaches 2^k links up, and seg holds the nodes on the way
    state = scratch.keep(tree.select("node", "anc", F.array("anc").alias("seg")))
    while True:
        other = state.select(F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("seg").alias("s2"))
        step = state.join(other, F.col("anc") == F.col("n2"), "left")
        ended = F.col("n2").isNull()
        step = scratch.keep(step.select("node", F.coalesce("a2", "anc").alias("anc"), F.when(ended, F.col("seg")).otherwise(F.concat("s2", "seg")).alias("seg"), ended.alias("ended")))
        scratch.drop(state)
        if step.where("NOT ended").isEmpty():
            break
        state = step
    paths = step.select("node", F.concat("seg", F.array("node")).alias("path"))
    roots = paths.select(F.element_at("path", 1).alias("node")).distinct().select("node", F.array("node").alias("path"))
    return paths.unionByName(roots).select(unpack_id(F.col("node")).alias("node_id"), F.transform("path", unpack_id).alias("path"))


def hierarchy_closure(paths: DataFrame) -> DataFrame:
    """node_id, below_id, distance: one row for each node and each node below it."""
    rows = paths.select(F.col("node_id").alias("below_id"), F.size("path").alias("n"), F.posexplode("path").alias("i", "node_id"))
    return rows.where("i < n - 1").select("node_id", "below_id", (F.col("n") - 1 - F.col("i")).cast("int").alias("distance"))
