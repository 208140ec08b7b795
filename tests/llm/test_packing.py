import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from twintable.llm.packing import best_fit_decreasing, bound_of, certified, lower_bound, pack, pieces_of


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=30))
def test_bound_and_fill(sizes):
    s = np.array(sizes)
    box = best_fit_decreasing(s, 20)
    load = np.bincount(box, weights=s)
    assert load.max() <= 20 and load.min() > 0
    assert max(-(-s.sum() // 20), (s > 10).sum()) <= lower_bound(s, 20) <= len(load)


def check(rows, sizes, capacity):
    load, held = {}, {}
    for r in rows:
        held[r.id] = held.get(r.id, 0) + r.size
        if r.size:
            load[r.container] = load.get(r.container, 0) + r.size
        if r.piece < max(0, -(-max(sizes[r.id] or 0, 0) // capacity) - 1):
            assert r.size == capacity
    assert held == {i: max(s or 0, 0) for i, s in sizes.items()}
    assert all(v <= capacity for v in load.values())
    if load:
        assert sorted(load) == list(range(len(load)))
    return len(load)


def test_many_partitions_come_close_to_the_bound(spark):
    rnd = random.Random(4)
    sizes = {i: rnd.choice([rnd.randrange(1, 400), rnd.randrange(1, 2500), 0, None, 2048, 4096, -3]) for i in range(4000)}
    df = spark.createDataFrame([(i, s, 1, "c") for i, s in sizes.items()], "k bigint, n int, piece int, id string")
    used = check(pack(df, "k", "n", 2048, part_items=300).collect(), sizes, 2048)
    pieces = [2048] * sum((s or 0) // 2048 for s in sizes.values() if s and s > 0) + [s % 2048 for s in sizes.values() if s and s > 0 and s % 2048]
    assert used <= 1.01 * lower_bound(np.array(pieces), 2048) + 1


def test_empty_and_zero(spark):
    df = spark.createDataFrame([], "k bigint, n int")
    assert pack(df, "k", "n", 10).count() == 0
    zero = spark.createDataFrame([(1, 0), (2, None)], "k bigint, n int")
    assert {(r.id, r.piece, r.size, r.container) for r in pack(zero, "k", "n", 10).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}


def test_repeated_rows_are_items_of_their_own(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (1, 25), (2, 6), (2, 6), (2, 6)], "k bigint, n int")
    rows = pack(df, "k", "n", 10).collect()
    load = {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.size
    assert sorted(load.values()) == [5, 6, 6, 6, 10, 10, 10, 10]


def test_certificate(spark):
    rnd = random.Random(7)
    sizes = {f"i{i}": rnd.randrange(1, 700) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "k string, n int")
    rows, proof = certified(df, "k", "n", 1000, part_items=200)
    used = check(rows.collect(), sizes, 1000)
    proof = proof.collect()
    assert all(0 < r.bound <= r.containers <= r.items for r in proof)
    assert sum(r["items"] for r in proof if r.level == 0) == 3000 and len({r.level for r in proof}) > 3
    bound = bound_of(pieces_of(df, "k", "n", 1000), 1000)
    assert bound == lower_bound(np.array(list(sizes.values())), 1000) and bound <= used <= 1.01 * bound + 1
