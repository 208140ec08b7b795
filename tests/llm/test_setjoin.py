import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twintable.llm.setjoin import similar_sets, t_occurrence


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30)), max_size=7), st.integers(0, 12), st.integers(1, 7))
def test_t_occurrence_counts_like_brute_force(sets, start, t):
    lists = [sorted(s) for s in sets if s]
    want = [x for x in range(31) if x >= start and sum(x in s for s in sets) >= t]
    assert t_occurrence(lists, start, t) == want


def brute(sets, share, least):
    out = set()
    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        small = min(len(sets[a]), len(sets[b]))
        if k >= least and k >= share * small - 1e-9:
            out.add((a, b, k, round(k / small, 9)))
    return out


def run(spark, sets, extra=(), **options):
    rows = [(k, v, "c", 1) for k, s in sets.items() for v in s] + [(*x, "c", 1) for x in extra]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v string, id string, size int")
    got = [(r.a, r.b, r.common, round(r.ratio, 9)) for r in similar_sets(df, "k", "v", **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block_values": 6, "class_rows": 2})])
def test_random_sets_with_a_hot_value(spark, seed, options):
    rnd = random.Random(seed)
    sets = {}
    for i in range(90):
        base = sets[rnd.choice(list(sets))] if sets and rnd.random() < 0.6 else set()
        s = {x for x in base if rnd.random() < 0.9} | {f"v{rnd.randrange(60)}" for _ in range(rnd.randrange(5))}
        sets[f"t{i:02}"] = s | ({"hot"} if rnd.random() < 0.5 else set())
    sets["t05"] = set(sets["t04"])
    sets["t06"] = set(sets["t04"])
    want = brute(sets, 0.8, 3)
    assert len(want) > 10
    assert run(spark, sets, **options) == want


def test_nulls_repeats_and_empty(spark):
    sets = {"a": {"x", "y", "z"}, "b": {"x", "y", "z"}, "c": {"x"}}
    extra = [("a", "x"), (None, "x"), ("a", None), (None, None)]
    assert run(spark, sets, extra) == {("a", "b", 3, 1.0)}
    assert run(spark, {}) == set()


def test_large_sets_and_large_classes(spark):
    sets = {f"same{i:03}": {f"v{j}" for j in range(4)} for i in range(60)}
    sets |= {f"near{i}": {f"v{j}" for j in range(4)} | {f"own{i}"} for i in range(5)}
    sets["huge"] = {f"v{j}" for j in range(4)} | {f"h{j}" for j in range(3000)}
    sets["half"] = {f"h{j}" for j in range(0, 3000, 2)} | {"x"}
    got = run(spark, sets, block_values=50, class_rows=7)
    assert got == brute(sets, 0.8, 3)
