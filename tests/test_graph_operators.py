import random

import pytest

from graftwork.operators import acyclic
from graftwork.operators.components import components
from graftwork.operators.hierarchy import hierarchy_closure, hierarchy_paths, resolve_hierarchy
from graftwork.operators.references import orphan_references, orphan_report, reference_rows

LINKS = "from_id string, to_id string, node string, dist long, root string"


def forest(seed, n=400):
    rng = random.Random(seed)
    name = [f"{rng.getrandbits(128):032x}" if rng.random() < 0.9 else f"odd-{i}" for i in range(n)]
    parent = {}
    for i in range(1, n):
        if rng.random() < 0.9:
            parent[name[i]] = name[rng.randrange(max(0, i - 3), i)]
    for size in (1, 2, 5):
        ring = [name[0]] if size == 1 else [f"{rng.getrandbits(128):032x}" for _ in range(size)]
        for x, y in zip(ring, ring[1:] + ring[:1], strict=True):
            parent[y] = x
        for k in range(3):
            parent[f"below-{size}-{k}"] = ring[-1] if k == 0 else f"below-{size}-{k - 1}"
    return parent


def dashed(x):
    return f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}" if len(x) == 32 else x


def expected(parent):
    out = {}
    for x in set(parent) | set(parent.values()):
        walk = [x]
        while walk[-1] in parent and parent[walk[-1]] not in walk:
            walk.append(parent[walk[-1]])
        if walk[-1] not in parent:
            out[dashed(x)] = (dashed(walk[-1]), len(walk) - 1)
        else:
            ring = walk[walk.index(parent[walk[-1]]) :]
            out[dashed(x)] = (min(map(dashed, ring)), -1 if x in ring else -2)
    return out


@pytest.mark.parametrize("merge_rows", [2_000_000, 20])
def test_hierarchy(spark, merge_rows):
    parent = forest(5)
    rows = [(p, c, "x", 7, "y") for c, p in parent.items()] + [(None, "a" * 32, None, None, None), ("b" * 32, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:50], LINKS)
    got = {r.node_id: (r.root_id, r.depth) for r in resolve_hierarchy(df, "from_id", "to_id", merge_rows).collect()}
    assert got == expected(parent)
    paths = {r.node_id: r.path for r in hierarchy_paths(df, "from_id", "to_id", merge_rows).collect()}
    assert set(paths) == {x for x, (_, d) in got.items() if d >= 0}
    up = {dashed(c): dashed(p) for c, p in parent.items()}
    for x, path in paths.items():
        assert path[-1] == x
        assert (path[0], len(path) - 1) == got[x]
        assert all(up[b] == a for a, b in zip(path, path[1:], strict=False))


def test_hierarchy_empty_and_two_parents(spark):
    none = spark.createDataFrame([], LINKS)
    assert resolve_hierarchy(none, "from_id", "to_id").count() == 0
    assert hierarchy_paths(none, "from_id", "to_id").count() == 0
    two = spark.createDataFrame([("b", "x", None, None, None), ("a", "x", None, None, None), ("x", "z", None, None, None)], LINKS)
    assert {(r.node_id, r.root_id, r.depth) for r in resolve_hierarchy(two, "from_id", "to_id").collect()} == {("a", "a", 0), ("x", "a", 1), ("z", "a", 2)}
    below = {tuple(r) for r in hierarchy_closure(hierarchy_paths(two, "from_id", "to_id")).collect()}
    assert below == {("a", "x", 1), ("a", "z", 2), ("x", "z", 1)}


@pytest.mark.parametrize("merge_rows", [2_000_000, 10])
def test_components(spark, merge_rows):
    rng = random.Random(2)
    links = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(80)] + [("a", "a"), (None, "q")]
    got = {r.node: r.rep for r in components(spark.createDataFrame(links, "a string, b string"), "a", "b", merge_rows).collect()}
    rep = {x: x for p in links if None not in p for x in p}
    for _ in range(200):
        for x, y in links:
            if x is not None:
                rep[x] = rep[y] = min(rep[x], rep[y])
    assert got == rep


def test_references(spark):
    rng = random.Random(4)
    ids = [f"{rng.getrandbits(128):032x}" for _ in range(60)]
    when = lambda k: f"2026-01-{k:02d} 00:00:00"
    nodes = [(x, rng.randrange(1, 28), rng.choice([None, 28])) for x in ids[:40]] + [(ids[0].upper(), 1, 2), (None, 1, None)]
    parents = spark.createDataFrame([(x, when(a), when(b) if b else None, "extra") for x, a, b in nodes], "id string, accepted_at string, retired_at string, hex string").selectExpr("id", "CAST(accepted_at AS TIMESTAMP) accepted_at", "CAST(retired_at AS TIMESTAMP) retired_at", "hex")
    rows = [(i, rng.choice([*ids, None, "LO-1", "{" + ids[1] + "}"]), rng.choice([ids[0]] * 5 + ids), rng.choice([None, *range(1, 29)])) for i in range(500)]
    df = spark.createDataFrame([(i, f, t, when(k) if k else None) for i, f, t, k in rows], "k long, from_id string, to_id string, at string").selectExpr("k", "from_id", "to_id", "CAST(at AS TIMESTAMP) at")
    refs = reference_rows(df.union(df), "t", "k", "at", ["from_id", "to_id"])

    def there(x, k):
        x = x.strip("{}").lower()
        return k is not None and any(n and n.lower() == x and a <= k and (b is None or b > k) for n, a, b in nodes)

    want = {("t", i, c) for i, f, t, k in rows for c, x in (("from_id", f), ("to_id", t)) if x is not None and not there(x, k)}
    for size in (1 << 15, 4):
        assert {tuple(r) for r in orphan_references(refs, parents, range_keys=size).collect()} == want
    assert {tuple(r) for r in orphan_references(refs, parents.where("false")).collect()} == {("t", i, c) for i, f, t, k in rows for c, x in (("from_id", f), ("to_id", t)) if x is not None}
    assert orphan_references(refs.where("false"), parents).count() == 0
    report = {r.month: (r.n_references, r.n_orphans) for r in orphan_report(refs, parents).collect()}
    assert sum(n for _, n in report.values()) == len(want)
    assert sum(n for n, _ in report.values()) == sum(x is not None for _, f, t, _ in rows for x in (f, t))
    # a key that fills most of the table, and rows without an id
    hot = spark.range(30_000).selectExpr("IF(id % 100 = 0, NULL, id) k", f"'{ids[50]}' from_id", "CAST(NULL AS STRING) to_id", "TIMESTAMP '2026-01-05 00:00:00' at")
    cases = orphan_references(reference_rows(hot, "t", "k", "at", ["from_id", "to_id"]), parents, range_keys=4)
    assert cases.count() == 29_701 and cases.where("row_id IS NULL").count() == 1


@pytest.mark.parametrize("limit", [200_000, 0])
def test_graph_queries(spark, monkeypatch, limit):
    monkeypatch.setattr(acyclic, "ONE_TASK", limit)
    edge = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z")], "from_id string, to_id string")
    assert not acyclic.is_acyclic(edge).first()[0]
    assert acyclic.is_acyclic(edge.where("from_id < 'x'")).first()[0]
    assert acyclic.is_acyclic(edge.where("false")).first()[0]
    assert {tuple(r) for r in acyclic.longest_path_rank(edge).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("x", None), ("y", None), ("z", None)}
    closed = {tuple(r) for r in acyclic.reachable(edge).collect()}
    assert closed == {("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d"), ("b", "d"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y"), ("x", "z"), ("y", "z")}
    pairs = [(a, b) for a in "abcdxyzq" for b in "abcdxyzq"]
    asked = spark.createDataFrame(pairs + pairs[:5], "from_id string, to_id string")
    assert {(r.from_id, r.to_id) for r in acyclic.reaches(edge, asked).collect() if r.reaches} == closed
    graph = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (9, "a", "c")], "seq long, from_id string, to_id string")
    asked = spark.createDataFrame([(5, "c", "a"), (10, "c", "a")], "seq long, from_id string, to_id string")
    assert {(r.seq, tuple(r.witness)) for r in acyclic.cycle_witness(graph, asked).collect()} == {(5, ("a", "b", "c")), (10, ("a", "c"))}


def greedy(stored, events):
    """Refused and closing seqs by walks, edge by edge."""
    out, told = {}, set()

    def leads(a, b):
        stack, seen = [a], {a}
        while stack:
            x = stack.pop()
            if x == b:
                return True
            for y in out.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        return False

    for a, b in stored:
        out.setdefault(a, []).append(b)
    for seq, a, b, added in sorted(events):
        if leads(b, a):
            told.add(seq)
        elif added:
            out.setdefault(a, []).append(b)
    return told


@pytest.mark.parametrize("limit", [200_000, 0])
def test_replay_against_walks(spark, monkeypatch, limit):
    monkeypatch.setattr(acyclic, "ONE_TASK", limit)
    rng = random.Random(11)
    node = lambda k: f"n{rng.randrange(k)}"
    stored = [(node(30), node(30)) for _ in range(25)] + [("s", "s"), ("u", "v"), ("v", "u")]
    events = [(i, node(30) if i % 9 else "u", node(30) if i % 7 else "v", rng.random() < 0.8) for i in range(250)]
    frame = lambda rows: spark.createDataFrame([r[:3] for r in rows], "seq long, from_id string, to_id string")
    got = acyclic.closing(spark.createDataFrame(stored, "from_id string, to_id string"), frame([e for e in events if e[3]]), frame([e for e in events if not e[3]]))
    want = greedy(stored, events)
    assert 50 < len(want) < 250
    assert {r.seq for r in got.collect()} == want


def test_a_long_chain(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("CAST(id AS STRING) from_id", "CAST(id + 1 AS STRING) to_id")
    assert acyclic.is_acyclic(chain).first()[0]
    top = acyclic.longest_path_rank(chain).agg({"rank": "max", "id": "count"}).first()
    assert sorted(top) == [n, n + 1]
    asked = spark.createDataFrame([(n + 5, str(n), "0"), (n + 6, "0", str(n))], "seq long, from_id string, to_id string")
    proposed = chain.selectExpr("CAST(from_id AS BIGINT) seq", "from_id", "to_id")
    assert [r.seq for r in acyclic.closing(chain.where("false"), proposed, asked).collect()] == [n + 5]
