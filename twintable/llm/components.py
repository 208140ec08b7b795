"""Groups of records that are linked directly or through others."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.runtime import cut, parallelism, scratch

#: Links that one cell of the grid holds on average.
CELL_LINKS = 100_000


def _local_union_find(cell: pd.DataFrame) -> pd.DataFrame:
    """(v, root) for every vertex of one block-pair partition; the root is the smallest of its local group."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(cell.a, cell.b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    names = list(parent)
    return pd.DataFrame({"v": names, "root": [find(x) for x in names]})


def connected_groups(pairs: DataFrame, a: str, b: str, cell_links: int = CELL_LINKS) -> DataFrame:
    """``member, group_id`` for every record in a group of at least two; ``group_id`` is the smallest name.

    Vertices are hashed into g blocks, links into the g x g grid of block pairs. Each round every cell runs
    union-find over its links; a vertex then takes the smallest of the representatives that its row and its
    column of cells name, and all links are rewritten to representatives. Rounds go on until no link is left,
    that is, until parents are stable; the parents of all rounds, applied last round first, give the group.
    Representatives are compared by hash first, so that chains in name order shrink as fast as others.

    The links of a hub lie in a whole row and column of cells, so no task holds all of them; cells that are
    crowded nevertheless are sliced (at most a quarter as many as there are cells, so their list is small). A
    vertex sends at most one row per slice of its row and column. Defined cases: a null end, a record paired with
    itself, repeated and reversed pairs add no link; no pairs give no rows; other columns are ignored.
    """
    with scratch(pairs.sparkSession):
        return cut(_grouped(pairs, a, b, cell_links), keep=True)


def _grouped(pairs: DataFrame, a: str, b: str, cell_links: int) -> DataFrame:
    spark, col = pairs.sparkSession, F.col
    key = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), col(c))
    links = (
        pairs.select(col(a).alias("a"), col(b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(key("a").alias("a"), key("b").alias("b"))
    )
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parents: list[DataFrame] = []
    while n := links.count():
        g = max(ceil(sqrt(n / cell_links)), ceil(sqrt(min(parallelism(spark), n / 1000))), 1)
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(g))
        cells = links.withColumn("row", block("a")).withColumn("column", block("b"))
        cells = cells.withColumn("slice", F.lit(0))
        if n > 4 * cell_links:
            crowded = cells.groupBy("row", "column").agg(F.count("*").alias("k")).where(col("k") > 4 * cell_links)
            slices = F.broadcast(cut(crowded.select("row", "column", F.ceil(col("k") / cell_links).cast("int").alias("slices"))))
            spread = F.pmod(F.xxhash64("a", "b"), F.coalesce("slices", F.lit(1))).cast("int")
            cells = cells.join(slices, ["row", "column"], "left").withColumn("slice", spread)
        stars = cut(cells.groupBy("row", "column", "slice").applyInPandas(_local_union_find, "v string, root string").distinct())
        up = cut(stars.groupBy("v").agg(F.min("root").alias("p")))
        parents.append(up.where("v <> p"))
        seen = stars.join(up, "v").select(col("p").alias("a"), col("root").alias("v")).distinct()
        seen = seen.join(up, "v").select("a", col("p").alias("b")).where("a <> b")
        links = cut(seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not parents:
        return pairs.select(col(a).alias("member"), col(b).alias("group_id")).limit(0)
    final = parents[-1]
    for up in reversed(parents[:-1]):
        final = cut(up.join(final.select(col("v").alias("p"), col("p").alias("top")), "p", "left").select("v", F.coalesce("top", "p").alias("p")).unionByName(_missing(final, up)))
    tops = final.select("p").distinct().select(col("p").alias("v"), "p")
    members = final.unionByName(tops).select(F.substring("v", 17, 1 << 30).alias("member"), "p")
    least = members.groupBy("p").agg(F.min("member").alias("group_id"))
    return members.join(least, "p").select("member", "group_id")


def _missing(final: DataFrame, up: DataFrame) -> DataFrame:
    """Vertices that got a parent only in a later round."""
    return final.join(up.select("v"), "v", "left_anti").select("v", "p")
