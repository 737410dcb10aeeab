import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from graftwork.operators import acyclic
from graftwork.operators.components import unite
from graftwork.operators.hierarchy import compress

PAIRS = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=40)


@settings(deadline=None)
@given(st.lists(st.integers(-1, 14), min_size=15, max_size=15))
def test_compress_finds_roots_and_offsets(parent):
    parent = np.array(parent)
    up, off, lost = compress(parent, np.ones(len(parent), np.int64))
    for i in range(len(parent)):
        x, n, seen = i, 0, {i}
        while parent[x] >= 0 and parent[x] not in seen:
            x, n = parent[x], n + 1
            seen.add(x)
        assert lost[i] == (parent[x] >= 0)
        if not lost[i]:
            assert (up[i], off[i]) == (x, n)


@settings(deadline=None)
@given(PAIRS)
def test_unite_gives_the_smallest_of_each_component(pairs):
    got = unite(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64), 10)
    rep = list(range(10))
    for _ in range(10):
        for a, b in pairs:
            rep[a] = rep[b] = min(rep[a], rep[b])
    assert got.tolist() == rep


def leads(out, start, goal):
    stack, seen = [start], {start}
    while stack:
        x = stack.pop()
        if x == goal:
            return True
        for y in out.get(x, ()):
            if y not in seen:
                seen.add(y)
                stack.append(y)
    return False


@settings(deadline=None)
@given(PAIRS, st.lists(st.sampled_from([acyclic.THERE, acyclic.PROPOSED, acyclic.ASKED]), min_size=40, max_size=40))
def test_replay_refuses_what_walks_refuse(pairs, kinds):
    rows = [(acyclic.STORED if k == acyclic.THERE else i, f"n{a}", f"n{b}", k) for i, ((a, b), k) in enumerate(zip(pairs, kinds, strict=False))]
    told = set(acyclic.replay(pd.DataFrame(rows, columns=["seq", "from_id", "to_id", "kind"]))["seq"])
    out: dict[str, list[str]] = {}
    for _, a, b, k in rows:
        if k == acyclic.THERE:
            out.setdefault(a, []).append(b)
    for seq, a, b, k in rows:
        if k != acyclic.THERE:
            assert (seq in told) == leads(out, b, a)
            if k == acyclic.PROPOSED and seq not in told:
                out.setdefault(a, []).append(b)


@settings(deadline=None)
@given(PAIRS)
def test_strong_components_are_mutual_and_ordered(pairs):
    tail, head = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    part = acyclic.strong_components(tail, head, 10)
    out: dict[int, list[int]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    for a in range(10):
        for b in range(10):
            assert (part[a] == part[b]) == (leads(out, a, b) and leads(out, b, a))
    assert all(part[a] >= part[b] for a, b in pairs)


@settings(deadline=None)
@given(PAIRS)
def test_ranks_rise_along_edges(pairs):
    edges = [(f"n{min(p)}", f"n{max(p)}") for p in set(pairs) if p[0] != p[1]]
    got = acyclic._ranks(pd.DataFrame(edges, columns=["from_id", "to_id"]))
    rank = dict(zip(got["id"], got["rank"], strict=True))
    for x in rank:
        before = [rank[a] for a, b in edges if b == x]
        assert rank[x] == (max(before) + 1 if before else 0)
