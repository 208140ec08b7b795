import itertools
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from twintable.functions.names import clean_name
from twintable.functions.vectors import cosine, cosine_of_distance, distance_of_cosine, is_usable, normalize
from twintable.operators import candidates, embedding, lineage, recommend, schema_text, similarity
from twintable.plans.pipeline import Config, ConsolidationAnalysis, report
from twintable.sources.metadata import SCHEMAS, MetadataSource, names_frame, save_table, split_name

D = datetime
E = "cat.s."


def source(spark, edges=(), **more):
    rows = [(E + s if s else None, "cat", "s", s, E + t if t else None, "JOB", j, D(2026, 5, d)) for s, t, j, d in edges]
    return MetadataSource(spark, {"lineage": spark.createDataFrame(rows, SCHEMAS["lineage"]), **more}, "2026-05-31")


@pytest.fixture(scope="module")
def demo(spark):
    edges = [("a", "x", "j1", 20), ("b", "x", "j1", 21), ("a", "y", "j2", 22), ("b", "y", "j2", 23), ("a", "z", "j3", 24), ("c", "z", "j3", 24)]
    edges += [("x", None, "j9", 25), (None, "y", "j9", 1), ("a", "x", "j1", 30), ("a", "x", "j1", 2)]
    cols = [("cat", "s", t, c, "INT", None, None, None if c == "id" else "c", i) for t in "xyz" for i, c in enumerate(["id", f"v_{t if t == 'z' else 'w'}"])]
    tables = [("cat", "s", t, "VIEW" if t == "z" else "MANAGED", "me", None, None) for t in "xyz"]
    audit = [(D(2026, 5, 3), "createTable", {"full_name_arg": "cat.s.x"}, ("bob",)), (D(2026, 5, 2), "createTable", {"full_name_arg": "cat.s.y"}, ("amy",)), (D(2026, 5, 29), "readTable", {"full_name_arg": "cat.s.x"}, ("bob",)), (D(2026, 5, 29), "readTable", {"other": "x"}, None)]
    more = {"columns": spark.createDataFrame(cols, SCHEMAS["columns"]), "tables": spark.createDataFrame(tables, SCHEMAS["tables"]), "audit": spark.createDataFrame(audit, SCHEMAS["audit"])}
    return source(spark, edges, **more)


def test_names(spark):
    df = spark.createDataFrame([(" `A`.b.C\t\n",), ("  ",), ("``",), (None,)], "n string")
    assert [r[0] for r in df.select(clean_name("n")).collect()] == ["a.b.c", None, None, None]
    assert split_name("a.b.c") == ("a", "b", "c")
    with pytest.raises(ValueError):
        split_name("a.b")


def test_rollup_window_and_catalog(spark, demo):
    r = {(x.source_table_name, x.target_table_full_name[-1]): (x.event_count, x.first_seen.day, x.last_seen.day) for x in lineage.rollup(demo, 15).collect()}
    assert r["a", "x"] == (2, 20, 30) and len(r) == 6
    assert lineage.rollup(demo, 15, "other").count() == 0
    assert lineage.rollup(MetadataSource(spark), 15).count() == 0


@pytest.mark.parametrize("slice_rows", [10_000, 4])
def test_common_ancestors_against_plain_sets(spark, slice_rows):
    import random

    rnd = random.Random(2)
    edges = [(f"s{rnd.randrange(9)}", f"t{rnd.randrange(14):02}", "j", 20) for _ in range(60)] + [("hot", f"t{i:02}", "j", 20) for i in range(14)]
    edges += [(s, "copy", "j", 20) for s, t, *_ in edges if t == "t03"] + [("alone", "lonely", "j", 20)]
    sets = {}
    for s, t, *_ in edges:
        sets.setdefault(E + t, set()).add(E + s)
    r = lineage.rollup(source(spark, edges), 30)
    for t in (0.0, 0.5, 0.8, 1.0):
        want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= t}
        got = lineage.common_ancestors(r, t, with_sources=True, slice_rows=slice_rows).collect()
        assert want and {(p.table_a, p.table_b, p.common_source_count) for p in got} == want and len(got) == len(want)
        assert all(p.common_sources == sorted(sets[p.table_a] & sets[p.table_b]) and p.sources_a == sorted(sets[p.table_a]) for p in got)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert df.select(normalize("a")).first()[0] == [0.6, 0.8]
    assert round(distance_of_cosine(0.8), 3) == 0.632
    assert round(df.select(cosine_of_distance(F.lit(distance_of_cosine(0.8)))).first()[0], 9) == 0.8
    assert [r[0] for r in df.select(is_usable("a", 2)).collect()] == [True, True, False, False]


def test_pairs_neighbours_and_hashing(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 6))
    x[7] = x[8]
    x[9] = 0
    names = [f"t{i:02}" for i in range(40)]
    rows = [(n, v.tolist(), "c") for n, v in zip(names, x)] + [("null", None, "c"), (None, [1.0] * 6, "c"), ("short", [1.0], "c")]
    df = spark.createDataFrame(rows, "full_table_name string, embedding array<double>, side string")
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    s = u @ u.T
    want = {(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if s[i, j] >= 0.5}
    got = {(r.table_a, r.table_b) for r in similarity.cosine_pairs(df, threshold=0.5).collect()}
    assert got == want
    some = df.where("full_table_name like 't%'")
    assert {(r.table_a, r.table_b) for r in similarity.lsh_pairs(some, threshold=0.5).collect()} <= want
    near = similarity.top_neighbors(some, k=3, threshold=None)
    best = {(a, b) for i, a in enumerate(names) for b in sorted((n for n in names if n != a), key=lambda n: (-round(s[i, names.index(n)], 9), n))[:3]}
    assert {(r.source_table, r.target_table) for r in near.collect()} == best
    assert similarity.top_neighbors(some, k=0).count() == 0
    assert similarity.top_neighbors(some, k=99, threshold=None).count() == 40 * 39
    assert similarity.clusters(some).groupBy("cluster_id").count().where("count < 2").isEmpty()
    assert similarity.projection(some).count() == 40


def test_column_overlap(spark):
    df = spark.createDataFrame([(["A", "b"], ["a", "c", "d"]), ([], [])], "a array<string>, b array<string>")
    got = [tuple(r) for r in df.select(*similarity.overlap_columns("a", "b")).collect()]
    assert got[0] == (1 / 3, ["a"], ["b", "c", "d"]) and got[1] == (0.0, [], [])


def test_texts(spark, demo):
    t = {r.full_table_name: r.schema_text for r in schema_text.schema_texts(demo, names_frame(spark, ["cat.s.x", "cat.s.x", "no.no.no"])).collect()}
    assert t == {"cat.s.x": "Table: cat.s.x\nColumns:\n  - id (INT)\n  - v_w (INT): c"}
    c = {r.column_text for r in schema_text.column_texts(demo).collect()}
    assert "Column: id | Type: INT" in c and "Column: v_w | Type: INT | Description: c" in c
    e = {r.full_table_name: r for r in schema_text.signatures(schema_text.enriched_metadata(demo, 15)).collect()}
    assert set(e) == {"cat.s.x", "cat.s.y"} and e["cat.s.x"].usage_score == 1 and e["cat.s.y"].usage_score == 0
    assert e["cat.s.x"].signature == "Table: cat.s.x Comment:  Columns: id, v_w Lineage Parents: cat.s.a cat.s.b"
    assert [r.column_name for r in schema_text.column_metadata(demo, "cat.s.x").collect()] == ["id", "v_w"]
    assert schema_text.table_metadata(demo, "cat", "s").count() == 3 and schema_text.table_metadata(demo, "cat", "q").count() == 0


def test_usage_and_creation(spark, demo):
    u = {r.full_table_name[-1]: r for r in recommend.usage_stats(demo, names_frame(spark, ["cat.s.x", "cat.s.a", "cat.s.new"])).collect()}
    assert (u["x"].read_count, u["x"].write_count, u["x"].total_job_count, u["x"].last_write.day) == (1, 4, 2, 30)
    assert (u["a"].read_count, u["w"].read_count, u["w"].last_read) == (5, 0, None)  # cat.s.new has no events
    assert [r.created_by for r in recommend.creation_info(demo, names_frame(spark, ["cat.s.x"])).collect()] == ["bob"]


def plain_choice(a, b, ra, rb, wa, wb, ca, cb):
    pa = pb = 0
    pa += 2 * (ra > rb)
    pb += 2 * (rb > ra)
    if wa and wb:
        pa, pb = (pa + 1, pb) if wa > wb else (pa, pb + 1)
    if ca and cb:
        pa, pb = (pa + 1, pb) if ca < cb else (pa, pb + 1)
    return pa, pb, a if pa >= pb else b, {0: "LOW", 1: "MEDIUM"}.get(abs(pa - pb), "HIGH")


def test_choice_of_source_of_truth_in_all_cases(spark):
    days = [None, D(2026, 1, 1), D(2026, 1, 2)]
    pairs, usage, made, want = [], [], [], {}
    for i, (ra, rb, wa, wb, ca, cb) in enumerate(itertools.product([1, 2], [1, 2], days, days, days, days)):
        a, b = f"a{i:03}", f"b{i:03}"
        pairs.append((a, b))
        usage += [(a, ra, 0, None, wa, 0), (b, rb, 0, None, wb, 0)]
        made += [(t, c, "x") for t, c in ((a, ca), (b, cb)) if c]
        want[a] = plain_choice(a, b, ra, rb, wa, wb, ca, cb)
    u = spark.createDataFrame(usage, "full_table_name string, read_count bigint, write_count bigint, last_read timestamp, last_write timestamp, total_job_count bigint")
    m = spark.createDataFrame(made, "table_name string, created_at timestamp, created_by string")
    d = recommend.sot_decision(spark.createDataFrame(pairs, "table_a string, table_b string"), u, m)
    rows = d.collect()
    assert {r.table_a: (r.score_a, r.score_b, r.sot_table, r.sot_confidence) for r in rows} == want
    assert max(len(r.reasons) for r in rows) == 4 and all((r.reasons[-1] == "Tie-breaker: alphabetical order") == (r.score_a == r.score_b) for r in rows)


def test_fusion_levels(spark):
    s = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8)], "table_a string, table_b string, cosine_similarity double")
    l = spark.createDataFrame([("a", "b", 2, 0.5), ("b", "c", 1, 0.8), ("b", "d", 1, 0.6)], "table_a string, table_b string, common_source_count bigint, source_overlap_ratio double")
    got = {r.table_a + r.table_b: (r.confidence_level, round(r.combined_score, 6)) for r in candidates.fuse(s, l).collect()}
    assert got == {"ab": ("HIGH", 0.74), "ac": ("MEDIUM", 0.48), "bc": ("MEDIUM", 0.32), "bd": ("LOW", 0.24)}


def test_providers(spark):
    for name in ("simple", "HASHING"):
        p = embedding.provider(name, dimension=32)
        df = spark.createDataFrame([("a", "x_y z"), ("b", "x_y z"), ("c", "other"), ("d", None)], "k string, t string")
        v = {r.k: r.embedding for r in embedding.embed_texts(df, "t", p).collect()}
        assert v["a"] == v["b"] != v["c"] and v["d"] is None and round(sum(x * x for x in v["a"]), 9) == 1
    assert embedding.provider("endpoint", call=lambda t: [[1.0]] * len(t), dimension=1, batch=2).embed(["a"] * 5).shape == (5, 1)
    with pytest.raises(ValueError):
        embedding.provider("nope")
    with pytest.raises(ValueError):
        embedding.provider("remote", call=None, dimension=1)


def test_pipeline_and_sink(spark, demo, tmp_path):
    run = ConsolidationAnalysis(demo, Config(days_back=30, similarity_threshold=0.9, with_sources=True, cost_per_write=1.5))
    recs = {(r.table_a[-1], r.table_b[-1]): r for r in run.recommendations.collect()}
    assert set(recs) == {("x", "y"), ("x", "z"), ("y", "z")} and recs["x", "y"].confidence_level == "HIGH"
    assert "derived from the same source (cat.s.a, cat.s.b)." in recs["x", "y"].recommendation
    assert recommend.summary_dict(run.recommendations)["total_recommendations"] == 3
    assert set(run.run_full()) >= {"candidates", "viz_map"} and set(run.run_similarity()) == {"table_viz_map", "table_similarity"}
    assert run.viz_map.columns == ["full_table_name", "vis_x", "vis_y", "schema_text", "usage_score"]
    assert report(run).count() >= 3
    empty = recommend.summary(run.recommendations.limit(0)).first()
    assert empty.total_recommendations == 0 and empty.total_storage_savings_gb == 0
    with pytest.raises(ValueError):
        save_table(run.candidates, "x", "append-ish")


def test_schema_texts_of_many_requested_names(spark):
    names = [f"cat.s.t{i:02}" for i in range(40)]
    columns = [("cat", "s", n.split(".")[2], f"c{k}", "INT", k, None) for n in names for k in range(3)]
    types = "table_catalog string, table_schema string, table_name string, column_name string, data_type string, ordinal_position int, comment string"
    source = MetadataSource(spark, {"columns": spark.createDataFrame(columns, types)})
    every = {r.full_table_name: r.schema_text for r in schema_text.schema_texts(source).collect()}
    asked = names_frame(spark, names[::2] + names[:6] + [f"no.such.t{i}" for i in range(9)])
    got = schema_text.schema_texts(source, asked).collect()
    assert len(every) == 40 and len(got) == len({*names[::2], *names[:6]})
    assert {r.full_table_name: r.schema_text for r in got} == {n: every[n] for n in {*names[::2], *names[:6]}}


def test_hashing_prunes_and_finds(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 64))[rng.integers(0, 60, 600)] + 0.45 * rng.standard_normal((600, 64))
    df = spark.createDataFrame([(f"t{i:03}", v.tolist()) for i, v in enumerate(x)], "full_table_name string, embedding array<double>")
    exact = {(r.table_a, r.table_b) for r in similarity.cosine_pairs(df, threshold=0.8).collect()}
    found = {(r.table_a, r.table_b) for r in similarity.lsh_pairs(df, threshold=0.8).collect()}
    assert len(exact) > 500 and found <= exact and len(found) >= 0.9 * len(exact)
    tried = similarity.lsh_candidates(df.select(F.col("full_table_name").alias("name"), F.col("embedding").alias("v")), 30, 10, 42).count()
    assert tried < 0.12 * 600 * 599 / 2


def moved(spark, run):
    """Rows that ``run`` writes to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def grouped(spark, n=400):
    rng = np.random.default_rng(18)
    x = rng.standard_normal((n // 5, 16))[rng.integers(0, n // 5, n)] + 0.3 * rng.standard_normal((n, 16))
    return spark.createDataFrame([(f"t{i:03}", v.tolist()) for i, v in enumerate(x)], "full_table_name string, embedding array<double>"), x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_neighbours_are_found_without_copies_of_the_vectors(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    df, u = grouped(spark)
    s = u @ u.T
    want = {(f"t{i:03}", f"t{j:03}") for i in range(400) for j in [j for j in np.lexsort((np.arange(400), -np.round(s[i], 9))) if j != i][:5] if threshold is None or s[i, j] >= threshold}
    got = []
    assert moved(spark, lambda: got.extend(similarity.top_neighbors(df, k=5, threshold=threshold).collect())) < 400 * 10
    assert {(r.source_table, r.target_table) for r in got} == want and len(got) == len(want)
    assert any(r.similarity_score != round(r.similarity_score, 9) for r in got)  # rounded by the caller, once


def test_pairs_and_hashing_without_copies_of_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "GROUP_BYTES", 30_000)
    df, u = grouped(spark)
    s, names = u @ u.T, [f"t{i:03}" for i in range(400)]
    want = {(names[i], names[j]) for i, j in itertools.combinations(range(400), 2) if s[i, j] >= 0.8}
    keys = similarity._keys(u, 3, 6, 42)
    share = {(a, b) for a, b in want if (keys[names.index(a)] == keys[names.index(b)]).any()}
    pairs, hashed = [], []
    assert moved(spark, lambda: pairs.extend(similarity.cosine_pairs(df, threshold=0.8).collect())) < 400 * 5 + len(want)
    assert moved(spark, lambda: hashed.extend(similarity.lsh_pairs(df, threshold=0.8, tables=3, bits=6).collect())) < 400 * 5 + len(want)
    assert {(r.table_a, r.table_b) for r in pairs} == want and len(pairs) == len(want)
    assert {(r.table_a, r.table_b) for r in hashed} == share and len(hashed) == len(share) and 0 < len(share) < len(want)


def test_floats_are_stored_as_floats(spark, monkeypatch):
    written, real = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: written.append(df.schema["v"].dataType.simpleString()) or real(df))
    wide, _ = grouped(spark, 200)
    floats = wide.selectExpr("full_table_name", "cast(embedding as array<float>) as embedding")
    near = [sorted(map(tuple, similarity.top_neighbors(x, k=5, threshold=0.5).collect())) for x in (floats, floats.selectExpr("full_table_name", "cast(embedding as array<double>) as embedding"), wide)]
    assert written == ["array<float>", "array<double>", "array<double>"]
    assert near[0] == near[1] and len(near[0]) > 200
