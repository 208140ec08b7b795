"""All pairs of records whose sets of values overlap enough."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twintable.runtime import cut, parallelism, scratch

#: Values of index rows, and of probes, that one partition of the lists holds on average.
BLOCK_VALUES = 100_000
#: Members of a class of equal sets that one task expands.
CLASS_ROWS = 1_000


def needed(size: int, share: float, least: int) -> int:
    """Common values that a pair needs whose smaller set has this size."""
    return max(least, ceil(share * size - 1e-9))


def t_occurrence(lists: list[list[int]], start: int, t: int) -> list[int]:
    """Positions >= ``start`` that occur in at least ``t`` of the sorted lists, by merging with skips.

    The ``t - 1`` longest lists at most are left out of the merge and only searched by bisection: t / (0.0085 log2
    of the longest + 1), the rule of thumb of "Efficient merging and filtering algorithms for approximate string
    searches" (ICDE 2008) for lists that are merged and skipped. The others are merged over a heap: a position that occurs too rarely makes the merge pop as many lists as could still
    not reach the threshold together and move all of them forward to the next position left on the heap.
    """
    lists = sorted(lists, key=len)
    total = len(lists)
    if total < t:
        return []
    longest = len(lists[-1])
    keep_long = min(t - 1, int(t / (0.0085 * longest.bit_length() + 1)))
    short, long = lists[: total - keep_long], lists[total - keep_long :]
    need = t - keep_long
    at = [bisect_left(x, start) for x in short]
    heap = [(x[i], k) for k, (x, i) in enumerate(zip(short, at)) if i < len(x)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        top = heap[0][0]
        same = []
        while heap and heap[0][0] == top:
            same.append(heapq.heappop(heap)[1])
        n = len(same)
        if n >= need:
            hits = n
            for k, x in enumerate(long):
                if hits + len(long) - k < t:
                    break
                i = bisect_left(x, top)
                hits += i < len(x) and x[i] == top
            if hits >= t:
                found.append(top)
            target = top + 1
        else:
            while heap and len(same) < need - 1:
                same.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for k in same:
            i = at[k] = bisect_left(short[k], target, at[k])
            if i < len(short[k]):
                heapq.heappush(heap, (short[k][i], k))
    return found


def _probe_lists(share: float, least: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Probes of one partition against its inverted lists, whose positions are in order of (size, id)."""
        index = block[block.role == 0].sort_values(["size", "id"])
        probes = block[block.role == 1]
        ids, sizes = index.id.tolist(), index["size"].tolist()
        order = list(zip(sizes, ids))
        lists: dict[int, list[int]] = {}
        for i, items in enumerate(index["items"]):
            for x in items:
                lists.setdefault(x, []).append(i)
        sets = dict(enumerate(map(set, index["items"])))
        a, b, common = [], [], []
        for p, size, items in zip(probes.id, probes["size"], probes["items"]):
            mine = [lists[x] for x in items if x in lists]
            for i in t_occurrence(mine, bisect_right(order, (size, p)), needed(size, share, least)):
                a.append(p)
                b.append(ids[i])
                common.append(sum(x in sets[i] for x in items))
        return pd.DataFrame({"a": a, "b": b, "common": common}).astype({"a": "int64", "b": "int64", "common": "int32"})

    return run


def overlapping_classes(sets: DataFrame, share: float, least: int, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``a, b, common`` (ids) of all pairs of different rows of ``sets`` (``id bigint, items array<bigint>``).

    The inverted lists are partitioned by record: every record is in one partition, with all of its values. A
    probe looks for sets at least as large as its own, in the partitions that can hold one. ``items`` are
    distinct, rarest value first, so a pair that overlaps enough shares a value of the first
    ``size - needed + 1`` of its smaller set (its prefix); which partitions hold a value is known from
    (value, partition) rows. So what is shuffled is a row per value and partition, every set once, and each
    probe once per partition that holds a value of its prefix. Partitions that many probes come to are read by
    several tasks, each with a part of the probes.
    """
    spark, col = sets.sparkSession, F.col
    size = F.size("items")
    want = F.greatest(F.lit(least), F.ceil(F.lit(share) * size - F.lit(1e-9)).cast("int"))
    base = sets.select("id", "items", size.alias("size"), want.alias("t")).where("size >= t")
    total = base.agg(F.sum("size")).first()[0] or 0
    parts = max(parallelism(spark), ceil(total / block_values))
    base = base.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    held = base.select("part", "size", F.explode("items").alias("value")).groupBy("value", "part").agg(F.max("size").alias("most"), F.count("*").alias("n"))
    asks = base.select("id", "size", col("part").alias("home"), F.explode(F.slice("items", F.lit(1), col("size") - col("t") + 1)).alias("value"))
    asks = asks.join(held, "value").where((col("most") >= col("size")) & ((col("part") != col("home")) | (col("n") > 1)))
    asks = cut(asks.select("id", "size", "part").distinct())
    load = cut(asks.groupBy("part").agg(F.ceil(F.sum("size") / block_values).cast("int").alias("slices")))
    index = base.join(load, "part").select("id", "items", "size", "part", F.explode(F.sequence(F.lit(0), col("slices") - 1)).alias("slice"), F.lit(0).alias("role"))
    probes = base.select("id", "items", "size").join(asks.drop("size"), "id").join(load, "part")
    probes = probes.select("id", "items", "size", "part", F.pmod(F.xxhash64("id"), col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"))
    return index.unionByName(probes).groupBy("part", "slice").applyInPandas(_probe_lists(share, least), "a bigint, b bigint, common int")


def similar_sets(rows: DataFrame, key: str, value: str, share: float = 0.8, least: int = 3, block_values: int = BLOCK_VALUES, class_rows: int = CLASS_ROWS) -> DataFrame:
    """``a, b, common, ratio`` for all pairs ``a < b`` of records whose sets overlap enough.

    ``rows`` has one row per record and value. A pair counts if it has at least ``least`` common values and
    common values / size of the smaller set >= ``share``; ``ratio`` is that number. Records with equal sets are
    one class: the join runs over classes, whose pairs and members are then expanded, the members of large
    classes in slices, so that no task expands a whole class.

    Defined cases: null keys and values count for nothing, repeated rows once; a record without values is in no
    pair; sets of any size and values of any frequency are handled whole; no rows give no pairs.
    """
    col = F.col
    with scratch(rows.sparkSession):
        r = cut(rows.select(col(key).alias("k"), col(value).alias("v")).where("k is not null and v is not null").distinct())
        # Ranks make values integers, rarest first. Numbers are given per range partition plus an offset: no global sort in one task.
        ranks = _ranks(r.groupBy("v").agg(F.count("*").alias("n")))
        sets = r.join(ranks, "v").groupBy("k").agg(F.array_sort(F.collect_list("rank")).alias("items"))
        classes = cut(sets.groupBy("items").agg(F.min("k").alias("name"), F.count("*").alias("n")))
        numbered = cut(_numbered(classes, "name").select("id", "items", "n"))
        slices = F.ceil(col("n") / class_rows).cast("int")
        members = sets.join(numbered.select("items", "id", "n"), "items").select("k", "id", "n", F.size("items").alias("size"), slices.alias("slices"))
        members = cut(members.withColumn("slice", F.pmod(F.xxhash64("k"), col("slices")).cast("int")))
        pairs = overlapping_classes(numbered.select("id", "items"), share, least, block_values)
        every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
        wide = cut(numbered.where(col("n") > class_rows).select("id", slices.alias("slices")))
        for x in "ab":
            pairs = pairs.join(wide.select(col("id").alias(x), col("slices").alias(f"s{x}")), x, "left").withColumn(f"s{x}", every(col(f"s{x}")))
        side = lambda x: members.select(col("id").alias(x), col("slice").alias(f"s{x}"), col("k").alias(f"k{x}"), col("size").alias(f"n{x}"))
        across = pairs.join(side("a"), ["a", "sa"]).join(side("b"), ["b", "sb"]).select("ka", "kb", "common", F.least("na", "nb").alias("smaller"))
        twin = members.where((col("n") > 1) & (col("size") >= least))
        left = twin.select("id", "size", col("k").alias("ka"), col("slice").alias("i"), every(col("slices")).alias("j"))
        right = twin.select("id", col("k").alias("kb"), every(col("slices")).alias("i"), col("slice").alias("j"))
        within = left.join(right, ["id", "i", "j"]).where("ka < kb").select("ka", "kb", col("size").alias("common"), col("size").alias("smaller"))
        return cut(
            across.unionByName(within).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "common", (col("common") / col("smaller")).alias("ratio")),
            keep=True,
        )


def _ranks(counts: DataFrame) -> DataFrame:
    """``v, rank``: dense numbers by rising count, then value."""
    return _numbered(counts, "n", "v").select("v", F.col("id").alias("rank"))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """``id``: 0, 1, 2 ... in this order. Range partitions are numbered by themselves; only their sizes go to the driver."""
    spark = df.sparkSession
    parts = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = [r for r in parts.groupBy("part").agg(F.count("*").alias("k")).orderBy("part").collect()]
    offsets, seen = [], 0
    for r in sizes:
        offsets.append((r["part"], seen))
        seen += r["k"]
    start = spark.createDataFrame(offsets or [(0, 0)], "part int, start bigint")
    w = Window.partitionBy("part").orderBy(*order)
    return parts.join(F.broadcast(start), "part").withColumn("id", F.row_number().over(w) - 1 + F.col("start")).drop("part", "start")
