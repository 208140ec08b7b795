import random

from twintable.llm.components import connected_groups


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent}


def run(spark, pairs, **options):
    df = spark.createDataFrame([(*p, "v", 1) for p in pairs], "a string, b string, v string, root int")
    got = [(r.member, r.group_id) for r in connected_groups(df, "a", "b", **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_nulls_self_repeats_reversed_empty(spark):
    assert run(spark, [("b", "a"), ("a", "b"), ("a", "b"), ("c", "c"), (None, "d"), ("e", None)]) == {("a", "a"), ("b", "a")}
    assert run(spark, []) == set()


def test_crowded_cells_are_sliced(spark):
    pairs = [("hub", f"leaf{i}") for i in range(3000)] + [(f"leaf{i}", f"tail{i}") for i in range(0, 3000, 7)]
    assert run(spark, pairs, cell_links=60) == brute(pairs)


def test_chain_hub_and_random_over_a_fine_grid(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(150)]
    hub = [("hub", f"leaf{i}") for i in range(200)]
    rnd = random.Random(5)
    loose = [(f"x{rnd.randrange(90)}", f"x{rnd.randrange(90)}") for _ in range(70)]
    pairs = chain + hub + loose
    assert run(spark, pairs, cell_links=30) == brute(pairs)
