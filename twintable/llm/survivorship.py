"""One surviving record per group of duplicates, its fields judged by a model of the quality of their sources."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.runtime import cut, release, scratch

#: Prior belief in the newest record of a field and in older ones: (sensitivity, rate of false statements), counted as so many statements.
TRUST_NEWEST, TRUST_OLDER, TRUST_WEIGHT = (0.95, 0.05), (0.5, 0.5), 20.0


def recency_claims(records: DataFrame, key: str, order: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``key, field, value, at, source``: what every usable field of every record states, and which kind of record states it.

    ``fields`` gives each field's value, as a bigint, and whether it is usable. The source is the field and the
    record's age: 'new' for the latest usable one (of equal times the larger value), else the magnitude of the
    number of days it is behind that. So there are some 20 sources a field, whatever the number of records.
    One aggregation with map-side partials finds the latest; a key with very many records is no hot task.
    """
    col = F.col
    said = [F.struct(F.lit(f).alias("field"), F.when(ok, v).cast("bigint").alias("value")) for f, (v, ok) in fields.items()]
    rows = records.where(col(key).isNotNull() & col(order).isNotNull()).select(col(key).alias("key"), F.unix_micros(col(order).cast("timestamp")).alias("at"), F.inline(F.array(*said)))
    rows = rows.where("value is not null").distinct()
    newest = rows.groupBy("key", "field").agg(F.max(F.struct("at", "value")).alias("m"))
    days = F.floor(F.log2((col("m.at") - col("at")) / 86_400_000_000 + 1)).cast("int")
    age = F.when((col("at") == col("m.at")) & (col("value") == col("m.value")), "new").otherwise(days.cast("string"))
    return rows.join(newest, ["key", "field"]).select("key", "field", "value", "at", F.concat_ws(" ", "field", age).alias("source"))


def judged_values(claims: DataFrame, **options) -> DataFrame:
    """``key, field, value, at, probability`` of every different value that ``recency_claims`` found, judged by ``latent_truth``.

    The newest record of a field is trusted beforehand, older ones are not; how much either deserves it is inferred.
    """
    col = F.col
    new = col("source").endswith(" new")
    priors = claims.select("source").distinct().select(
        "source", F.when(new, TRUST_NEWEST[0]).otherwise(TRUST_OLDER[0]).alias("sens"), F.when(new, TRUST_NEWEST[1]).otherwise(TRUST_OLDER[1]).alias("fpr")
    )
    entity = F.struct("key", "field").alias("entity")
    truth, _ = latent_truth(claims.select(entity, "value", "source"), priors=priors, weight=TRUST_WEIGHT, **options)
    last = claims.groupBy(entity, "value").agg(F.max("at").alias("at"))
    return truth.join(last, ["entity", "value"]).select("entity.key", "entity.field", "value", "at", "probability")


def best_values(judged: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``key`` and a column per field: the latest of the values judged true, the most probable one where none is.

    A field without any usable value is null. Map-side partials, so no key is a hot task.
    """
    col = F.col
    true = col("probability") >= 0.5
    merit = F.struct(true.alias("t"), F.when(true, 0.0).otherwise(col("probability")).alias("p"), "at", "value")
    picks = [F.max(F.when(col("field") == f, merit)).getField("value").alias(f) for f in fields]
    return judged.groupBy("key").agg(*picks)


def surviving_records(groups: DataFrame, values: DataFrame, key: str, rank: Sequence[str]) -> DataFrame:
    """``group_id, survivor`` and the chosen fields of each group.

    ``groups`` has ``member, group_id``. The survivor is the member with the highest fields in the order of
    ``rank``, nulls below any value, then the smallest name. Its null fields are filled from the next best
    member in that order that has one. Members without a record take part with nulls.
    """
    rows = groups.join(values.withColumnRenamed(key, "member"), "member", "left")
    merit = [F.struct(F.col(f).isNotNull().alias("has"), F.col(f).alias("v")).alias(f) for f in rank]
    # The smallest name wins ties: max_by needs an increasing key, so ties are cut first and min() takes the name.
    best = rows.groupBy("group_id").agg(F.max(F.struct(*merit)).alias("m"))
    same = rows.join(best, "group_id").where(F.struct(*merit).eqNullSafe(F.col("m")))
    filled = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.struct(*merit), F.col(f).alias("x")))).getField("x").alias(f"best_{f}") for f in rank]
    chosen = same.groupBy("group_id").agg(F.min("member").alias("survivor"), *[F.first(f).alias(f) for f in rank])
    return chosen.join(rows.groupBy("group_id").agg(*filled), "group_id").select(
        "group_id", "survivor", *[F.coalesce(f, f"best_{f}").alias(f) for f in rank]
    )


def latent_truth(claims: DataFrame, rounds: int = 60, tolerance: float = 1e-3, prior_true: float = 0.5, priors: DataFrame | None = None, weight: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Which claimed values are true, and how good each source is, by expectation-maximisation.

    ``claims``: ``entity, value, source``, one row per statement "the field of entity has value". A source that
    speaks about an entity without naming one of its claimed values denies that value, so each source has a
    sensitivity (it names true values) and a specificity (it doesn't name false ones). ``priors`` gives the belief
    about them beforehand (``source, sens, fpr``; else 0.6 and 0.1), which counts as ``weight`` statements.
    Every value has its own truth variable: several, or none, of an entity's values may be true.

    Ends as soon as no source's figures move by more than ``tolerance``, after ``rounds`` rounds at most. Returns
    ``(entity, value, probability)`` and ``(source, sensitivity, specificity)``. Rows with a null in any of the
    three columns are left out, repeated rows count once, no rows give no rows.

    Entities on which the same sources agree and differ in the same way are alike to the model, so they are counted
    once, as a pattern: which sets of sources name how many of the entity's values each. Rounds run over patterns
    and are linear in them, however many entities there are. Denials are never listed: the values of a pattern
    share the sum of all its speakers' denials, and a value adds what changes for the sources that name it.
    """
    col = F.col
    with scratch(claims.sparkSession):
        stated = claims.select("entity", "value", "source").na.drop().distinct().groupBy("entity", "value").agg(F.array_sort(F.collect_set("source")).alias("by"))
        stated = cut(stated)
        sets = stated.groupBy("entity", "by").agg(F.count("*").alias("k")).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("by", "k"))).alias("pattern"))
        shapes = cut(sets.withColumn("shape", F.md5(F.to_json("pattern"))))
        cells = shapes.groupBy("shape").agg(F.first("pattern").alias("pattern"), F.count("*").alias("m")).select("shape", "m", F.inline("pattern"))
        cells = cells.select("shape", "by", (col("m") * col("k")).alias("n"))
        names = cut(cells.select("shape", "by", "n", F.explode("by").alias("source")))
        speaks = cut(names.select("shape", "source").distinct())
        known = speaks.select("source").distinct()
        if priors is not None:
            known = known.join(priors, "source", "left")
        else:
            known = known.withColumns({"sens": F.lit(None).cast("double"), "fpr": F.lit(None).cast("double")})
        believed = known.select("source", F.coalesce("sens", F.lit(0.6)).alias("sens0"), F.coalesce("fpr", F.lit(0.1)).alias("fpr0"))
        quality = cut(believed.select("source", "sens0", "fpr0", col("sens0").alias("sens"), col("fpr0").alias("fpr")))
        deny = F.log((1 - col("sens")) / (1 - col("fpr")))
        share = log(prior_true / (1 - prior_true))

        def judge(q: DataFrame) -> DataFrame:
            denied = speaks.join(q, "source").groupBy("shape").agg(F.sum(deny).alias("base"))
            named = names.join(q, "source").groupBy("shape", "by").agg(F.first("n").alias("n"), F.sum(F.log(col("sens") / col("fpr")) - deny).alias("more"))
            return named.join(denied, "shape").select("shape", "by", "n", (1 / (1 + F.exp(-(col("base") + col("more") + share)))).alias("p"))

        for turn in range(rounds):
            p = cut(judge(quality))
            said = p.select("n", "p", F.explode("by").alias("source")).groupBy("source").agg(F.sum(col("n") * col("p")).alias("t1"), F.sum(col("n") * (1 - col("p"))).alias("f1"))
            whole = p.groupBy("shape").agg(F.sum(col("n") * col("p")).alias("t"), F.sum(col("n") * (1 - col("p"))).alias("f"))
            spoke = speaks.join(whole, "shape").groupBy("source").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
            new = cut(
                said.join(spoke, "source").join(quality.withColumnsRenamed({"sens": "s", "fpr": "q"}), "source").select(
                    "source", "sens0", "fpr0",
                    ((col("t1") + weight * col("sens0")) / (col("t") + weight)).alias("sens"),
                    ((col("f1") + weight * col("fpr0")) / (col("f") + weight)).alias("fpr"), "s", "q",
                )
            )
            moved = new.agg(F.max(F.greatest(F.abs(col("sens") - col("s")), F.abs(col("fpr") - col("q"))))).first()[0]
            quality = new.drop("s", "q")
            if moved is None or moved <= tolerance:
                break
            if turn % 2:
                release(claims.sparkSession)
        judged = judge(quality).select("shape", "by", col("p").alias("probability"))
        truth = stated.join(shapes.select("entity", "shape"), "entity").join(judged, ["shape", "by"]).select("entity", "value", "probability")
        return cut(truth, keep=True), cut(quality.select("source", col("sens").alias("sensitivity"), (1 - col("fpr")).alias("specificity")), keep=True)
