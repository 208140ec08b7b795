"""Filling containers of fixed capacity with items of different length."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twintable.runtime import cut, parallelism

#: Items of a partition on average.
PART_ITEMS = 20_000
#: Partitions whose containers are counted together.
GROUP = 1_000


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(sizes[sizes > 0], minlength=capacity + 1)[: capacity + 1], capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """Containers that any packing of so many items of each size needs, by dual feasible functions.

    For each threshold t up to half the capacity: items above capacity - t fill a container each, items up to
    capacity - t but above half of it are in different containers, items from t to half can only use the room
    that these leave.
    """
    many, mass = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    t = np.arange(0, half + 1)
    huge = many[capacity] - many[capacity - t]
    large = many[capacity - t] - many[half]
    large_mass = mass[capacity - t] - mass[half]
    below = np.maximum(t - 1, 0)
    middle_mass = mass[half] - mass[below]
    extra = np.maximum(0, -(-(middle_mass - (large * capacity - large_mass)) // capacity))
    return int((huge + large + extra).max(initial=0))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, each into the fullest container that has room."""
    out = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: there is a container with room r
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fit = open_rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            box = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, box = capacity, used
            used += 1
        out[i] = box
        left = room - size
        rooms[left].append(box)
        open_rooms |= 1 << left
    return out


def _pack(capacity: int, last: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        """Packs one partition. Containers beyond the proven bound, the emptiest, are opened again for exchange."""
        part = part.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = part["size"].to_numpy(np.int64)
        box = best_fit_decreasing(sizes, capacity)
        n = int(box.max()) + 1
        gap = n - lower_bound(sizes, capacity)
        load = np.bincount(box, weights=sizes, minlength=n)
        free = np.zeros(n, bool)
        if not last:
            # Full containers stay; a partition that meets its bound still offers its least filled one, for the others to use.
            order = np.argsort(load, kind="stable")[: max(1, 4 * gap)]
            free[order] = load[order] < capacity
        return part[["id", "piece", "size", "part"]].assign(box=box, placed=~free[box], bins=n, gap=gap)

    return run


def pieces_of(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``id, piece, size``: items whole, longer ones cut into pieces of ``capacity`` and a rest; a null or negative size counts as 0."""
    col = F.col
    base = items.select(col(key).alias("id"), F.greatest(F.coalesce(col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("whole"))
    last = F.greatest(F.ceil(col("whole") / capacity).cast("int") - 1, F.lit(0))
    return base.select("id", "whole", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "id", "piece", F.least(F.lit(capacity), col("whole") - col("piece") * capacity).cast("int").alias("size")
    )


def bound_of(pieces: DataFrame, capacity: int) -> int:
    """Containers that any packing of all ``pieces`` needs. At most ``capacity`` counts come to the driver, whatever the number of pieces."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.where(F.col("size") > 0).groupBy("size").agg(F.count("*").alias("n")).collect():
        counts[r["size"]] = r["n"]
    return bound_of_counts(counts, capacity)


def pack(items: DataFrame, key: str, size: str, capacity: int, part_items: int = PART_ITEMS) -> DataFrame:
    """``id, piece, size, container``: every item in a container of ``capacity``, whole unless longer than it. See ``certified``."""
    return certified(items, key, size, capacity, part_items)[0]


def certified(items: DataFrame, key: str, size: str, capacity: int, part_items: int = PART_ITEMS) -> tuple[DataFrame, DataFrame]:
    """The assignment ``id, piece, size, container``, and what certifies it: ``level, part, items, containers, bound``.

    Longer items are cut into pieces of exactly ``capacity``, which fill a container each, and a rest. Items are
    spread over partitions by hash. Each packs its own by best-fit decreasing and compares the number of
    containers with a lower bound from dual feasible functions: where ``containers`` equals ``bound``, the
    packing of that partition is certified optimal. The least filled containers, four for each one above the
    bound, are opened again, their items go to half as many partitions (the next level), and these pack anew;
    the last of the log2 rounds leaves one partition. What moves is a few containers per partition, so that no
    round but the first handles more than a small share of the items.

    Containers are numbered 0, 1, 2 ... Defined cases: a null or negative size counts as 0; items of size 0 take
    no room and go into container 0; equal items are placed in order of key; repeated keys and rows are items of
    their own; an empty table gives no rows.
    """
    spark, col = items.sparkSession, F.col
    kind = items.schema[key].dataType.simpleString()
    pieces = cut(pieces_of(items, key, size, capacity))
    full = pieces.where(col("size") == capacity)
    todo = pieces.where((col("size") > 0) & (col("size") < capacity))
    n = todo.count()
    parts = 1
    while parts < max(n / part_items, min(parallelism(spark), n / 1000)):
        parts *= 2
    first_parts = parts
    spread = lambda k, salt: F.pmod(F.xxhash64("id", "piece", F.lit(salt)), F.lit(k)).cast("int")
    schema = f"id {kind}, piece int, size int, part int, box bigint, placed boolean, bins bigint, gap bigint"
    done: list[DataFrame] = []
    proofs: list[DataFrame] = []
    todo, level = todo.withColumn("part", spread(parts, 0)), 0
    while True:
        packed = cut(todo.groupBy("part").applyInPandas(_pack(capacity, parts == 1), schema))
        done.append(packed.where("placed").select("id", "piece", "size", F.lit(level).alias("level"), "part", "box"))
        proof = packed.groupBy("part").agg(F.count("*").alias("items"), F.max("bins").alias("containers"), F.max(col("bins") - col("gap")).alias("bound"))
        proofs.append(proof.select(F.lit(level).alias("level"), "part", "items", "containers", "bound"))
        if parts == 1:
            break
        parts, level = parts // 2, level + 1
        todo = packed.where("not placed").select("id", "piece", "size", spread(parts, level).alias("part"))
    rows = reduce(DataFrame.unionByName, done).select("*", F.lit(None).cast(kind).alias("i"), F.lit(0).alias("j"))
    alone = full.select("id", "piece", "size", F.lit(-1).alias("level"), spread(first_parts, -1).alias("part"), F.lit(0).cast("bigint").alias("box"), col("id").alias("i"), col("piece").alias("j"))
    # Dense numbers: containers are numbered within their partition, partitions start where the ones before end.
    w = Window.partitionBy("level", "part").orderBy("box", "i", "j")
    number = F.when(col("level") < 0, F.row_number().over(w)).otherwise(F.dense_rank().over(w))
    ranked = cut(rows.unionByName(alone).withColumn("r", number - 1))
    counts = cut(ranked.groupBy("level", "part").agg((F.max("r") + 1).alias("m")).withColumn("group", F.floor(col("part") / GROUP)))
    # Sums before a partition in two steps: only a row per GROUP partitions is ever in one task.
    groups = counts.groupBy("level", "group").agg(F.sum("m").alias("k"))
    groups = groups.select("level", "group", (F.sum("k").over(Window.orderBy("level", "group")) - col("k")).alias("base"))
    inside = F.sum("m").over(Window.partitionBy("level", "group").orderBy("part")) - col("m")
    starts = counts.withColumn("inside", inside).join(groups, ["level", "group"]).select("level", "part", (col("base") + col("inside")).alias("start"))
    numbered = ranked.join(starts, ["level", "part"]).select("id", "piece", "size", (col("start") + col("r")).cast("bigint").alias("container"))
    nothing = pieces.where("size = 0").select("id", "piece", "size", F.lit(0).cast("bigint").alias("container"))
    return numbered.unionByName(nothing), reduce(DataFrame.unionByName, proofs)
