import numpy as np

from twintable.llm.knn import AnisotropicIndex, nearest


def brute(names, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = set()
    for i, a in enumerate(names):
        best = sorted(((-s[i, j], b) for j, b in enumerate(names) if j != i and s[i, j] >= least))[:k]
        out |= {(a, b) for _, b in best}
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "n string, e array<float>, name string, id int")
    return {(r.name, r.neighbour) for r in nearest(df, "n", "e", **options).collect()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 64))
    x = (centres[rng.integers(0, 150, 1500)] + 0.35 * rng.standard_normal((1500, 64))).astype(np.float32)
    names = [f"t{i:04}" for i in range(1500)]
    want = brute(names, x.astype(float), 5, 0.8)
    got = run(spark, [(n, v.tolist()) for n, v in zip(names, x)], cell_rows=100)
    assert len(want & got) / len(want) >= 0.95
    assert len(got - want) <= 0.05 * len(got)


def test_recall_in_a_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2400, 64))
    x[:800] = rng.standard_normal(64) + 0.15 * rng.standard_normal((800, 64))
    x[800:] = x[800 + rng.integers(0, 200, 1600)] + 0.35 * rng.standard_normal((1600, 64))
    x = x.astype(np.float32)
    names = [f"t{i:04}" for i in range(len(x))]
    got = run(spark, [(n, v.tolist()) for n, v in zip(names, x)], cell_rows=600)
    want = brute(names, x.astype(float), 5, 0.8)
    group = {w for w in want if w[0] < "t0800"}
    assert len(group) == 4000 and got == want


def test_recall_of_near_copies_in_many_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2400, 64))
    x[:800] = rng.standard_normal(64) + 0.15 * rng.standard_normal((800, 64))
    x = x.astype(np.float32)
    names = [f"t{i:04}" for i in range(len(x))]
    want = brute(names, x.astype(float), 5, 0.8)
    got = run(spark, [(n, v.tolist()) for n, v in zip(names, x)], cell_rows=10)
    assert len(want & got) / len(want) >= 0.9


def test_divided_cells_and_exact_search(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((100, 64))
    x = (centres[rng.integers(0, 100, 1200)] + 0.35 * rng.standard_normal((1200, 64))).astype(np.float32)
    names = [f"t{i:04}" for i in range(1200)]
    want = brute(names, x.astype(float), 5, 0.8)
    rows = [(n, v.tolist()) for n, v in zip(names, x)]
    got = run(spark, rows, cell_rows=10, most_cells=20)
    assert len(want & got) / len(want) >= 0.95
    assert run(spark, rows, cell_rows=10, most_cells=20, probes=None) == want


def test_margin_leaves_most_queries_few_cells():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64))[rng.integers(0, 300, 6000)] + 0.3 * rng.standard_normal((6000, 64))
    x[:2000] = rng.standard_normal(64) + 0.15 * rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    index = AnisotropicIndex(x[:3000], 200)
    near = index.scores(x)
    asked = (near >= near.max(1, keepdims=True) - index.margin(x[:3000], 5, 0.8)).sum(1)
    assert np.median(asked) <= 10 and asked.mean() <= 50


def test_unusable_vectors_ties_and_copies(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(f"same{i}", [2 * x for x in v] if i % 2 else v) for i in range(9)]
    rows += [("nul", None), ("short", [1.0]), ("zero", [0.0] * 4), ("nan", [float("nan"), 1.0, 1.0, 1.0]), ("inf", [float("inf"), 1.0, 1.0, 1.0]), (None, v), ("hole", [None, 1.0, 1.0, 1.0])]
    rows += [("far", [-1.0, 0.0, 0.0, 0.0]), ("same0", v)]
    names = [f"same{i}" for i in range(9)]
    want = {(a, b) for a in names for b in [n for n in names if n != a][:5]}
    assert run(spark, rows, dims=4) == want


def test_empty(spark):
    assert run(spark, []) == set()
