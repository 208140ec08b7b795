import random
from collections import defaultdict, deque

import pytest

from twintable.operators.hierarchy import hierarchy


def brute(links):
    out = defaultdict(set)
    for a, b in links:
        if a and b and a != b:
            out[a].add(b)
    nodes = set(out) | {b for v in out.values() for b in v}
    targets = {b for v in out.values() for b in v}

    def walk(r):
        d, q = {r: 0}, deque([r])
        while q:
            x = q.popleft()
            for y in out.get(x, ()):
                if y not in d:
                    d[y] = d[x] + 1
                    q.append(y)
        return d

    reach = {n: walk(n) for n in nodes}
    info = {n: (int(any(n in out.get(m, ()) for m in reach[n])), len(reach[n]) - 1) for n in nodes}
    rows, seen = set(), set()
    for r in nodes - targets:
        for n, k in reach[r].items():
            rows.add((n, r, k, *info[n]))
            seen.add(n)
    return rows | {(n, "", -1, *info[n]) for n in nodes - seen}


def run(spark, links, **options):
    df = spark.createDataFrame([(*x, "clash", 1) for x in links], "a string, b string, node string, depth int")
    rows = hierarchy(df, "a", "b", paths=True, **options).collect()
    known = set(links)
    for r in rows:
        if r.depth >= 0:
            assert r.path[0] == r.root and r.path[-1] == r.node and len(r.path) == r.depth + 1
            assert all(p in known for p in zip(r.path, r.path[1:]))
    got = [(r.node, r.root, r.depth, r.on_cycle, r.n_descendants) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def test_nulls_self_links_repeats_and_empty(spark):
    links = [("a", "a"), ("a", "b"), ("a", "b"), (None, "c"), ("d", None)]
    assert run(spark, links) == {("a", "a", 0, 0, 1), ("b", "a", 1, 0, 0)}
    assert run(spark, []) == set()
    assert run(spark, [(None, None)]) == set()


def test_cycles_diamonds_and_chains(spark):
    links = [("x", "y"), ("y", "x"), ("r", "p"), ("p", "q"), ("q", "p"), ("q", "e"), ("r", "f"), ("f", "e"), ("e", "g")]
    links += [(f"c{i}", f"c{i + 1}") for i in range(8)]
    links += [(f"ring{i}", f"ring{(i + 1) % 7}") for i in range(7)] + [("ring3", "leaf1"), ("ring5", "leaf2"), ("leaf1", "leaf3")]
    assert run(spark, links) == brute(links)


@pytest.mark.parametrize("seed", [0, 2, 3])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([8, 20, 40])
    links = [(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(int(n * rnd.choice([0.9, 1.2, 2])))]
    assert run(spark, links) == brute(links)


def test_shared_nodes_below_a_chain(spark):
    links = [(f"t{i // 2}", f"t{i}") for i in range(1, 40)] + [("t3", "t20"), ("t30", "t1")]
    links += [(f"k{i}", f"k{i + 1}") for i in range(12)] + [(f"k{i}", f"s{j}") for i in (2, 5, 9) for j in (1, 2)] + [("s1", "s3"), ("k9", "s3")]
    core = [(f"c{i}", f"c{j}") for i in range(4) for j in range(4) if i != j]
    links += core + [(f"c{i}", f"below{j:02}") for i in range(4) for j in range(5)] + [("k12", "c0")]
    assert run(spark, links) == brute(links)


def steps_of(spark, links, monkeypatch):
    from twintable.operators import hierarchy as module

    seen, real = [], module.contract
    monkeypatch.setattr(module, "contract", lambda *a: seen.append(real(*a)) or seen[-1])
    rows = {(r.node, r.root, r.depth, r.on_cycle, r.n_descendants) for r in hierarchy(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    return rows, len(seen[0][0])


def test_long_chain_and_ring_take_few_rounds(spark, monkeypatch):
    n = 5000
    links = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [(f"r{i}", f"r{(i + 1) % 900}") for i in range(900)]
    rows, steps = steps_of(spark, links, monkeypatch)
    assert 1 <= steps <= 6
    assert rows == {(f"n{i}", "n0", i, 0, n - i) for i in range(n + 1)} | {(f"r{i}", "", -1, 1, 899) for i in range(900)}


def test_binary_tree_takes_a_round_per_level(spark, monkeypatch):
    n = 1 << 9
    rows, steps = steps_of(spark, [(f"n{i // 2}", f"n{i}") for i in range(2, n)], monkeypatch)
    below = [0] * (2 * n)
    for i in range(n - 1, 0, -1):
        below[i] = sum(1 + below[c] for c in (2 * i, 2 * i + 1) if c < n)
    assert 1 <= steps <= 10
    assert rows == {(f"n{i}", "n1", i.bit_length() - 1, 0, below[i]) for i in range(1, n)}


def test_rounds_inside_a_core_release_what_they_held(spark, monkeypatch):
    from twintable.operators import hierarchy as module

    released, real = [], module.release
    monkeypatch.setattr(module, "release", lambda s: released.append(real(s)))
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "b"), ("x", "y"), ("y", "x"), ("c", "x"), ("in", "a"), ("y", "out")]
    df = spark.createDataFrame([(*x, 1) for x in links], "src string, dst string, w int")
    nodes = df.selectExpr("src as n").union(df.selectExpr("dst")).distinct()
    parts = {r.n: r.part for r in module.strong_parts(nodes, df).collect()}
    assert set(parts) == {"a", "b", "c", "x", "y"} and parts["x"] == parts["y"] != parts["a"] == parts["b"] == parts["c"]
    assert len(released) >= 4
    assert module.strong_parts(nodes, df.limit(0)).isEmpty()
