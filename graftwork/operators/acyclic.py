"""Order-dependent acyclic admission, and other questions on directed graphs.

An edge is refused when the edges accepted before it already lead from its head back to its tail. The decision
depends on order, but only among edges that could lie on one cycle: ``peel`` drops edges that lie on none (they are always accepted), what is
left falls into components, and each is replayed in order on its own (``closing``). Proposals that can't be accepted anyway are asked
the same question in the same replay.

A replay keeps a topological order and repairs it as edges come (only between the two ends of an edge that goes against it), after
strong components have been cut out, so its cost does not follow the depth of the graph. Up to ``ONE_TASK`` edges, peeling and
components cost more than they save and one task replays all; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.operators.components import components
from graftwork.scratch import Scratch

#: Rounds of peeling. More rounds leave fewer edges to replay; the result is the same.
PEEL_ROUNDS = 6
STORED = -1
#: Edges that one task may hold (about 300 bytes each).
ONE_TASK = 200_000
#: Kinds of events in a replay.
THERE, PROPOSED, ASKED = 0, 1, 2


def peel(edges: DataFrame, rounds: int) -> DataFrame:
    """Drops edges whose tail nothing leads to or whose head leads nowhere, round by round. Every edge on a cycle stays."""
    scratch = Scratch(edges.sparkSession, "peel")
    left, n = scratch.keep(edges), -1
    for _ in range(rounds):
        now = left.count()
        if now in (0, n):
            break
        n = now
        inner = left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi")
        kept = scratch.keep(inner.join(left.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi").select(*edges.columns))
        scratch.drop(left)
        left = kept
    return left


def _neighbours(tail: np.ndarray, head: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Heads by tail: where each node's begin, and the heads."""
    order = np.argsort(tail, kind="stable")
    return np.searchsorted(tail[order], np.arange(n + 1)).tolist(), head[order].tolist()


def strong_components(tail: np.ndarray, head: np.ndarray, n: int) -> np.ndarray:
    """A number for each node's strong component; edges lead from higher numbers to lower ones."""
    start, heads = _neighbours(tail, head, n)
    index, low, out = [0] * n, [0] * n, [-1] * n
    count = done = 0
    open_: list[int] = []
    for root in range(n):
        if index[root]:
            continue
        count += 1
        index[root] = low[root] = count
        open_.append(root)
        walk = [(root, start[root])]
        while walk:
            x, k = walk.pop()
            end = start[x + 1]
            while k < end:
                y = heads[k]
                k += 1
                if not index[y]:
                    count += 1
                    index[y] = low[y] = count
                    open_.append(y)
                    walk.append((x, k))
                    walk.append((y, start[y]))
                    break
                if out[y] < 0:
                    low[x] = min(low[x], index[y])
            else:
                if low[x] == index[x]:
                    while True:
                        y = open_.pop()
                        out[y] = done
                        if y == x:
                            break
                    done += 1
                if walk:
                    up = walk[-1][0]
                    low[up] = min(low[up], low[x])
    return np.array(out, np.int64)


def likely_order(tail: np.ndarray, head: np.ndarray, n: int) -> list[int]:
    """A place for each node so that edges go upward, but for those that close a cycle in a depth-first walk."""
    start, heads = _neighbours(tail, head, n)
    place, seen, last = [0] * n, [False] * n, n
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        walk = [(root, start[root])]
        while walk:
            x, k = walk.pop()
            end = start[x + 1]
            while k < end and seen[heads[k]]:
                k += 1
            if k < end:
                seen[heads[k]] = True
                walk.append((x, k + 1))
                walk.append((heads[k], start[heads[k]]))
            else:
                last -= 1
                place[x] = last
    return place


class Order:
    """A topological order of a growing graph: an edge that goes with it is free, one that goes against it moves only nodes between its ends."""

    def __init__(self, place: list[int]):
        n, self.place = len(place), place
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.into: list[list[int]] = [[] for _ in range(n)]

    def _ahead(self, start: int, goal: int) -> set[int] | None:
        """What start leads to before goal's place; None if it leads to goal."""
        place, last = self.place, self.place[goal]
        seen, stack = {start}, [start]
        while stack:
            for y in self.out[stack.pop()]:
                if y == goal:
                    return None
                if place[y] < last and y not in seen:
                    seen.add(y)
                    stack.append(y)
        return seen

    def leads(self, start: int, goal: int) -> bool:
        return start == goal or (self.place[start] < self.place[goal] and self._ahead(start, goal) is None)

    def add(self, tail: int, head: int) -> bool:
        """Adds an edge; False, and nothing is added, if it would close a cycle."""
        place = self.place
        if tail == head:
            return False
        if place[head] < place[tail]:
            ahead = self._ahead(head, tail)
            if ahead is None:
                return False
            first, behind, stack = place[head], {tail}, [tail]
            while stack:
                for y in self.into[stack.pop()]:
                    if place[y] > first and y not in behind:
                        behind.add(y)
                        stack.append(y)
            moved = sorted(behind, key=place.__getitem__) + sorted(ahead, key=place.__getitem__)
            for x, k in zip(moved, sorted(place[x] for x in moved), strict=True):
                place[x] = k
        self.out[tail].append(head)
        self.into[head].append(tail)
        return True


def replay(group: pd.DataFrame) -> pd.DataFrame:
    """seq of the proposed edges that are refused, and of the asked ones whose head leads to their tail, when events are taken in order of seq; edges that
    are there (THERE) were never refused, whatever they close."""
    seq, kind = group["seq"].to_numpy(), group["kind"].to_numpy()
    codes, names = pd.factorize(np.concatenate([group["from_id"].to_numpy(object), group["to_id"].to_numpy(object)]))
    tail, head = codes[: len(seq)], codes[len(seq) :]
    part = strong_components(tail, head, len(names)) if len(seq) else codes
    inside = part[tail] == part[head] if len(seq) else np.zeros(0, bool)  # others lie on no cycle
    seq, kind, tail, head = seq[inside], kind[inside], tail[inside], head[inside]
    there = kind == THERE
    # cycles of edges that are there: one node each
    node = strong_components(tail[there], head[there], len(names))
    tail, head = node[tail], node[head]
    added = kind != ASKED
    order = Order(likely_order(tail[added], head[added], int(node.max(initial=-1)) + 1))
    for t, h in zip(tail[there].tolist(), head[there].tolist(), strict=True):
        if t != h:
            order.add(t, h)
    out = []
    at = np.lexsort((kind, seq))
    at = at[~there[at]]
    for s, k, t, h in zip(seq[at].tolist(), kind[at].tolist(), tail[at].tolist(), head[at].tolist(), strict=True):
        if order.leads(h, t) if k == ASKED else not order.add(t, h):
            out.append(s)
    return pd.DataFrame({"seq": pd.Series(out, dtype="int64")})


def _whole(step):
    """A step on all rows of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield step(pd.concat(parts, ignore_index=True))

    return run


def _by_component(edges: DataFrame, step, schema: str, trim: bool) -> DataFrame:
    """The step on each group of edges that hang together; ``edges`` is a table that was written."""
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInPandas(_whole(step), schema)
    scratch = Scratch(edges.sparkSession, "parts")
    left = scratch.keep(peel(edges, PEEL_ROUNDS)) if trim else edges
    comp = components(left, "from_id", "to_id").select(F.col("node").alias("from_id"), F.col("rep").alias("component"))
    return left.join(comp, "from_id").groupBy("component").applyInPandas(lambda g: step(g.drop(columns="component")), schema)


def closing(stored: DataFrame, proposed: DataFrame, asked: DataFrame) -> DataFrame:
    """seq of the proposed edges (seq, from_id, to_id) that close a cycle when they are added in order to the stored ones (from_id, to_id), and
    of the asked edges that would close one at their time but are not added."""
    event = lambda df, kind: df.select("seq", "from_id", "to_id", F.lit(kind).alias("kind"))
    there = stored.select(F.lit(STORED).cast("long").alias("seq"), "from_id", "to_id").distinct()
    events = event(there, THERE).unionByName(event(proposed, PROPOSED)).unionByName(event(asked, ASKED))
    kept = Scratch(stored.sparkSession, "events").keep(events.where("from_id IS NOT NULL AND to_id IS NOT NULL"))
    return _by_component(kept, replay, "seq long", True)


def cycle_witness(accepted: DataFrame, asked: DataFrame) -> DataFrame:
    """seq, witness: for each asked row one shortest path head -> ... -> tail over accepted edges of smaller seq (the least by its ids).
    For rows that are known to close a cycle; others come out empty-handed after the walk."""
    scratch = Scratch(asked.sparkSession, "witness")
    back = accepted.select(F.col("to_id").alias("at"), F.col("from_id").alias("before"), F.col("seq").alias("edge"))
    front = asked.select("seq", "to_id", F.col("from_id").alias("at"), F.array("from_id").alias("witness"))
    seen, found = front.select("seq", "at"), []
    while True:
        step = front.join(back, "at").where("edge < seq").select("seq", "to_id", F.col("before").alias("at"), F.concat(F.array("before"), "witness").alias("witness"))
        step = scratch.keep(step.groupBy("seq", "to_id", "at").agg(F.min("witness").alias("witness")).join(seen, ["seq", "at"], "left_anti"))
        if step.isEmpty():
            break
        hit = step.where("at = to_id").select("seq", "witness")
        found.append(hit)
        front = scratch.keep(step.join(hit.select("seq"), "seq", "left_anti").select("seq", "to_id", "at", "witness"))
        seen = scratch.keep(seen.union(front.select("seq", "at")))
    out = asked.select("seq", F.array().cast("array<string>").alias("witness")).where("false")
    for hit in found:
        out = out.unionByName(hit)
    return out


def _has_cycle(group: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(np.concatenate([group["from_id"].to_numpy(object), group["to_id"].to_numpy(object)]))
    tail, head = codes[: len(group)], codes[len(group) :]
    part = strong_components(tail, head, len(names))
    return pd.DataFrame({"cyclic": [bool((part[tail] == part[head]).any())]})


def is_acyclic(edges: DataFrame) -> DataFrame:
    """One row: prereq_dag_ok. An empty graph is acyclic."""
    kept = Scratch(edges.sparkSession, "dag").keep(edges.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct())
    return _by_component(kept, _has_cycle, "cyclic boolean", True).agg((F.count_if("cyclic") == 0).alias("prereq_dag_ok"))


def reachable(edges: DataFrame) -> DataFrame:
    """from_id, to_id: every pair with a path of at least one edge. Each round doubles the length of the paths covered and joins only
    what the last round found."""
    scratch = Scratch(edges.sparkSession, "reach")
    known = new = scratch.keep(edges.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct())
    parts = [new]
    while True:
        on = lambda a, b: a.select("from_id", F.col("to_id").alias("via")).join(b.select(F.col("from_id").alias("via"), "to_id"), "via").select("from_id", "to_id")
        further = on(new, known) if len(parts) == 1 else on(new, known).union(on(known, new))
        new = scratch.keep(further.distinct().join(known, ["from_id", "to_id"], "left_anti"))
        if new.isEmpty():
            return known
        parts.append(new)
        known = parts[0]
        for p in parts[1:]:
            known = known.union(p)


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """from_id, to_id, reaches: for each distinct pair whether a path of edges leads from the one to the other (a node reaches itself only on a cycle).
    Pairs are answered without the closure: only those whose ends hang together are walked, between their places in a topological order."""
    scratch = Scratch(edges.sparkSession, "pairs")
    asked = scratch.keep(pairs.select("from_id", "to_id").distinct().withColumn("seq", F.monotonically_increasing_id()))
    loops = asked.where("from_id = to_id").select("seq")
    # a pair is the edge back, which closes a cycle if there is a path; a loop is asked by way of a node of its own
    back = asked.where("from_id <> to_id").select("seq", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    hit = closing(edges.select("from_id", "to_id"), back.where("false"), back)
    ring = _on_cycles(edges).join(asked.where("from_id = to_id"), "from_id").select("seq")
    found = hit.unionByName(ring.join(loops, "seq")).distinct().withColumn("hit", F.lit(True))
    return asked.join(found, "seq", "left").select("from_id", "to_id", F.coalesce("hit", F.lit(False)).alias("reaches"))


def _ring_nodes(group: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(np.concatenate([group["from_id"].to_numpy(object), group["to_id"].to_numpy(object)]))
    tail, head = codes[: len(group)], codes[len(group) :]
    part = strong_components(tail, head, len(names))
    return pd.DataFrame({"from_id": np.unique(names[tail[part[tail] == part[head]]].astype(object))})


def _on_cycles(edges: DataFrame) -> DataFrame:
    """from_id: nodes that lie on a cycle."""
    kept = Scratch(edges.sparkSession, "rings").keep(edges.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct())
    return _by_component(kept, _ring_nodes, "from_id string", True)


def longest_path_rank(edges: DataFrame) -> DataFrame:
    """id, rank of every node at an end of an edge: 0 without incoming edges, else one more than the highest rank before it.
    Nodes on cycles and behind them have a null rank. What hangs together is ranked in one task."""
    kept = Scratch(edges.sparkSession, "rank").keep(edges.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct())
    return _by_component(kept, _ranks, "id string, rank long", False)


def _ranks(group: pd.DataFrame) -> pd.DataFrame:
    """Nodes leave when all before them have left; each leaves its rank plus one to those behind."""
    out: dict[str, list[str]] = {}
    waiting: dict[str, int] = {}
    for tail, head in group[["from_id", "to_id"]].itertuples(index=False):
        out.setdefault(tail, []).append(head)
        waiting[head] = waiting.get(head, 0) + 1
        waiting.setdefault(tail, 0)
    rank = {x: 0 for x, n in waiting.items() if n == 0}
    ready = list(rank)
    best = dict.fromkeys(waiting, 0)
    while ready:
        x = ready.pop()
        for y in out.get(x, ()):
            best[y] = max(best[y], rank[x] + 1)
            waiting[y] -= 1
            if waiting[y] == 0:
                rank[y] = best[y]
                ready.append(y)
    return pd.DataFrame({"id": pd.Series(list(waiting), dtype=object), "rank": pd.array([rank.get(x) for x in waiting], dtype="Int64")})
