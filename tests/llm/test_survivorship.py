import random
from datetime import datetime

from pyspark.sql import functions as F

from twintable.llm.survivorship import best_values, judged_values, latent_truth, recency_claims, surviving_records

D = datetime


def values(df, fields, at="at"):
    return best_values(judged_values(recency_claims(df, "t", at, {f: (F.col(f), F.col(f) >= 0) for f in fields})), fields)


def test_latest_usable_value_field_by_field(spark):
    rows = [("a", 5, 1, D(2026, 1, 1)), ("a", None, 2, D(2026, 1, 2)), ("a", -1, None, D(2026, 1, 3)), ("b", None, None, D(2026, 1, 1)), (None, 9, 9, D(2026, 1, 1)), ("c", 3, 3, None)]
    df = spark.createDataFrame([(*r, "clash", 0.0) for r in rows], "t string, reads bigint, jobs bigint, at timestamp, source string, value double")
    assert {(r.key, r.reads, r.jobs) for r in values(df, ["reads", "jobs"]).collect()} == {("a", 5, 2)}


def test_the_model_agrees_with_the_latest_value(spark):
    rnd = random.Random(6)
    rows = [(f"t{i % 400}", rnd.choice([None, -1, rnd.randrange(50), 7]), rnd.randrange(9), D(2026, 1, rnd.randrange(1, 29), rnd.randrange(24))) for i in range(2000)]
    df = spark.createDataFrame(rows, "t string, reads bigint, jobs bigint, at timestamp")
    want = {t: [max(((r[3], r[k]) for r in rows if r[0] == t and r[k] is not None and r[k] >= 0), default=(0, None))[1] for k in (1, 2)] for t in {r[0] for r in rows}}
    got = {r.key: [r.reads, r.jobs] for r in values(df, ["reads", "jobs"]).collect()}
    assert sum(got.get(t) == w for t, w in want.items()) >= 0.99 * len(want)


def test_survivor_ranks_fills_and_breaks_ties(spark):
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("p", "p"), ("q", "p")], "member string, group_id string")
    known = spark.createDataFrame([("a", 5, None), ("b", 7, None), ("c", None, 3), ("x", 1, 1), ("y", 1, 1)], "t string, reads bigint, jobs bigint")
    got = {r.group_id: (r.survivor, r.reads, r.jobs) for r in surviving_records(groups, known, "t", ["reads", "jobs"]).collect()}
    assert got == {"a": ("b", 7, 3), "x": ("x", 1, 1), "p": ("p", None, None)}


def test_latent_truth_finds_bad_source_and_several_true_values(spark):
    rows = []
    for e in range(60):
        for s in ("good1", "good2", "good3"):
            rows += [(f"e{e}", "t1", s), (f"e{e}", "t2", s)]
        rows.append((f"e{e}", f"wrong{e}", "bad"))
    rows += [(None, "t1", "good1"), ("e0", None, "good1"), ("e0", "t1", None), ("e0", "t1", "good1")]
    truth, quality = latent_truth(spark.createDataFrame(rows, "entity string, value string, source string"))
    p = {(r.entity, r.value): r.probability for r in truth.collect()}
    assert p["e3", "t1"] > 0.9 and p["e3", "t2"] > 0.9 and p["e3", "wrong3"] < 0.1
    q = {r.source: (r.sensitivity, r.specificity) for r in quality.collect()}
    assert q["good1"][0] > 0.9 > 0.2 > q["bad"][0]
    assert q["bad"][1] < q["good1"][1]


def test_empty(spark):
    truth, quality = latent_truth(spark.createDataFrame([], "entity string, value string, source string"), rounds=1)
    assert truth.count() == 0 and quality.count() == 0


def test_empty_tables_ties_and_repeats(spark):
    groups = spark.createDataFrame([("b", "a"), ("a", "a"), ("b", "a")], "member string, group_id string")
    none = values(spark.createDataFrame([], "t string, reads bigint, at timestamp"), ["reads"])
    assert [r.survivor for r in surviving_records(groups, none, "key", ["reads"]).collect()] == ["a"]
    assert surviving_records(groups.limit(0), none, "key", ["reads"]).count() == 0
    at = D(2026, 1, 1)
    same = spark.createDataFrame([("a", 3, at), ("a", 4, at), ("a", 4, at), ("a", 9, None)], "t string, reads bigint, at timestamp")
    assert [r.reads for r in values(same, ["reads"]).collect()] == [4]
