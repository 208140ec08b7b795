"""Similar pairs, neighbours, clusters and maps of embedded tables."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import cached_property
from math import ceil, floor, sqrt

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from twintable.functions.vectors import as_doubles, normalize
from twintable.runtime import checkpoint_dir, cut, parallelism, release, scratch

#: Vectors and bytes of a block at most; vectors of one of several at least.
BLOCK, BLOCK_BYTES, LEAST_BLOCK = 16_384, 8 << 20, 4_096
#: Products held at a time; columns that are looked through together, once their largest product is high enough.
PRODUCTS, LANES = 1 << 21, 256
#: Bytes of vectors in double precision (half as many where single holds them) for a task of the hashing, unless one bucket alone has more.
GROUP_BYTES = 128 << 20


def embedding_array(df: DataFrame, column: str = "embedding") -> Column:
    """An embedding given as an ML vector or an array of numbers, as array<double>."""
    return vector_to_array(column) if df.schema[column].dataType.typeName() == "vectorudt" else as_doubles(column)


def _vectors(df: DataFrame, name: str, vector: str, narrow: bool = False) -> DataFrame:
    """``name, v``: vectors without null entries; others can be similar to nothing. ``narrow`` leaves those of floats as they are."""
    floats = narrow and df.schema[vector].dataType.simpleString() == "array<float>"
    v = df.select(F.col(name).alias("name"), (F.col(vector) if floats else embedding_array(df, vector)).alias("v"))
    return v.where(F.col("name").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


class _Block:
    """Some vectors, in order of their names: ``at`` is the place of each among all of its length."""

    def __init__(self, row: Row):
        self.dims, self.first, self.n, self._row = row.dims, row.first, row.n, row

    @cached_property
    def raw(self) -> np.ndarray:
        return np.frombuffer(self._row.m, np.float32 if self._row.single else np.float64).reshape(self.n, self.dims)

    @cached_property
    def x(self) -> np.ndarray:
        return _unit(self.raw)

    @cached_property
    def x32(self) -> np.ndarray:
        return self.x.astype(np.float32)

    @cached_property
    def names(self) -> np.ndarray:
        out = np.empty(self.n, object)
        out[:] = pickle.loads(self._row.names)
        return out

    @cached_property
    def at(self) -> np.ndarray:
        return self.first + np.arange(self.n)

    def keys(self, tables: int, bits: int) -> np.ndarray:
        return np.frombuffer(self._row.keys, _key_type(bits)).reshape(self.n, tables)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _margin(dims: int) -> float:
    """More than a product of unit vectors in single precision can be off."""
    return 1.2e-7 * (dims + 8)


def _key_type(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.int64


def _keys(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """For each vector and draw of planes, the sides on which it lies."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    side = (x @ planes > 0).reshape(len(x), tables, bits)
    return (side * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def _blocks(v: DataFrame, hashes: tuple[int, int, int] | None = None) -> tuple[RDD, int]:
    """All vectors once, in blocks in order of length and name, with their keys where ``hashes`` (tables, bits, seed) are given; and the bytes of the vectors.

    Numbers that single precision holds exactly are kept so.
    """
    spark = v.sparkSession
    with scratch(spark):
        v = cut(v.where(F.forall("v", lambda x: F.abs(x) < F.lit(float("inf")))).withColumn("dims", F.size("v")))
        n, dims = v.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(1))).first()
        release(spark)  # the shuffles that made the vectors, once their job is done with
        size = min(BLOCK, max(1, BLOCK_BYTES // (8 * dims)), max(LEAST_BLOCK, ceil(n / (3 * parallelism(spark)))))
        most = size + size // 2  # ranges are about equal

        def pack(part: pd.DataFrame) -> dict:
            x = np.stack(part.v.to_numpy()).astype(float)
            x32 = x.astype(np.float32)
            single = bool((x32 == x).all())
            keys = _keys(_unit(x), *hashes).astype(_key_type(hashes[1])).tobytes() if hashes else b""
            return {"dims": x.shape[1], "first": part["at"].iloc[0], "n": len(part), "single": single, "names": pickle.dumps(part.name.tolist()), "m": (x32 if single else x).tobytes(), "keys": keys}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for b in batches:
                for _, part in b.groupby("dims"):
                    if held is not None and held.dims.iloc[0] != part.dims.iloc[0]:
                        yield pd.DataFrame([pack(held)])
                        held = None
                    held = part if held is None else pd.concat([held, part], ignore_index=True)
                    while len(held) > most:
                        yield pd.DataFrame([pack(held[:most])])
                        held = held[most:]
            if held is not None:
                yield pd.DataFrame([pack(held)])

        ordered = v.repartitionByRange(max(1, ceil(n / size)), "dims", "name").sortWithinPartitions("dims", "name").withColumn("at", F.monotonically_increasing_id())
        blocks = ordered.mapInPandas(run, "dims int, first bigint, n int, single boolean, names binary, m binary, keys binary")
        path = f"{checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
        blocks.rdd.saveAsPickleFile(path, 1)  # as the workers read them, so that reading anew costs a copy of bytes
    release(spark)  # what brought the vectors together
    return spark.sparkContext.pickleFile(path), n * dims * 8


def _by_all(left: RDD, blocks: RDD) -> RDD:
    """Each of ``left`` with all blocks, one after another in one task. They are read anew each time, so nothing is copied to disk."""
    return left.cartesian(blocks.coalesce(1))


def _block_pairs(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple[_Block, _Block]]:
    known: dict[int, _Block] = {}
    for left, right in pairs:
        if left.dims == right.dims:
            if left.first not in known:
                if len(known) >= 16:
                    known.clear()
                known[left.first] = _Block(left)
            yield known[left.first], _Block(right)


def _products(a: _Block, b: _Block) -> Iterator[tuple[slice, np.ndarray]]:
    """Products in single precision of some rows of ``a`` with all of ``b``, columns up to a multiple of LANES, those beyond at -3."""
    wide = -(-b.n // LANES) * LANES
    step = max(1, PRODUCTS // wide)
    out = np.full((min(step, a.n), wide), -3, np.float32)
    for i in range(0, a.n, step):
        part = slice(i, min(i + step, a.n))
        s = out[: part.stop - i]
        np.matmul(a.x32[part], b.x32.T, out=s[:, : b.n])
        yield part, s


def _high(s: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, in order, and columns of what is at least its row's ``least``."""
    lanes = s.reshape(len(s), -1, LANES)
    row, lane = np.nonzero(lanes.max(axis=1) >= least[:, None])
    if len(row) * lanes.shape[1] > s.size // 4:
        return np.nonzero(s >= least[:, None])
    hit, k = np.nonzero(lanes[row, :, lane] >= least[row][:, None])
    return row[hit], k * LANES + lane[hit]


def _exact(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the vectors at ``i`` and ``j``, some at a time."""
    out = np.empty(len(i))
    for k in range(0, len(i), 50_000):
        some = slice(k, k + 50_000)
        out[some] = np.einsum("ij,ij->i", x[i[some]], y[j[some]])
    return out


def cosine_pairs(df: DataFrame, name: str = "full_table_name", vector: str = "embedding", threshold: float = 0.8) -> DataFrame:
    """``table_a, table_b, cosine_similarity`` of all pairs ``table_a < table_b`` at or above the threshold, exactly, the most similar first.

    Block pairs are multiplied as matrices, in single precision; what may reach the threshold is computed in double
    precision. A null vector is in no pair, a zero vector has cosine 0; vectors of different length are not compared.
    """
    least = threshold - 1e-12

    def run(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple]:
        for a, b in _block_pairs(pairs):
            if a.first > b.first:
                continue
            for part, s in _products(a, b):
                x, y = _high(s, np.full(len(s), max(least - _margin(a.dims), -2), np.float32))
                x = x + part.start
                fine = a.at[x] < b.at[y]
                x, y = x[fine], y[fine]
                value = _exact(a.x, x, b.x, y)
                na, nb = a.names[x], b.names[y]
                fine = (value >= least) & (na != nb)
                yield from zip(na[fine].tolist(), nb[fine].tolist(), value[fine].tolist())

    kind = df.schema[name].dataType.simpleString()
    blocks, _ = _blocks(_vectors(df, name, vector, narrow=True))
    found = df.sparkSession.createDataFrame(_by_all(blocks, blocks).mapPartitions(run), f"table_a {kind}, table_b {kind}, cosine_similarity double", verifySchema=False)
    return found.orderBy(F.desc("cosine_similarity"), "table_a", "table_b")


def top_neighbors(df: DataFrame, name: str = "full_table_name", vector: str = "embedding", k: int = 5, threshold: float | None = 0.0) -> DataFrame:
    """``source_table, target_table, similarity_score``: the ``k`` most similar others of each table, exactly.

    Ties, to nine digits, go to the smaller name; ``k`` is clamped to what there is, 0 gives no rows; without a threshold
    negative scores count too. A task takes a block of tables through all others and holds the best ``k`` of each:
    products in single precision tell which may be among them, and these are computed in double precision.
    """
    k = max(0, k)
    least = -np.inf if threshold is None else threshold - 1e-12

    def run(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple]:
        best: dict[int, tuple] = {}
        for a, b in _block_pairs(pairs if k else iter(())):
            if a.first not in best:
                best[a.first] = a.names, np.full((a.n, k), -np.inf), np.full((a.n, k), np.iinfo(np.int64).max), np.full((a.n, k), None, object), np.zeros((a.n, k))
            _, score, at, who, whole = best[a.first]
            margin = 2 * _margin(a.dims)
            lo = hi = np.zeros(a.n, int)
            if a.names[0] <= b.names[-1] and b.names[0] <= a.names[-1]:
                lo, hi = (np.searchsorted(b.names, a.names, side) for side in ("left", "right"))
            for part, s in _products(a, b):
                for i in np.nonzero(lo[part] < hi[part])[0]:
                    s[i, lo[part][i] : hi[part][i]] = -3  # the table itself
                floor_ = score[part, -1]
                if np.isneginf(floor_).any() and b.n >= k:
                    some = min(b.n, max(k, 1024))
                    floor_ = np.maximum(floor_, np.partition(s[:, :some], some - k, axis=1)[:, some - k])
                x, y = _high(s, np.maximum(np.maximum(floor_, least) - margin, -2).astype(np.float32))
                if not len(x):
                    continue
                x = x + part.start
                value = _exact(a.x, x, b.x, y)
                fine = value >= least
                x, y, value = x[fine], y[fine], value[fine]
                rows = np.unique(x)
                row = np.concatenate([np.repeat(rows, k), x])
                all_score, all_at, all_who, all_whole = (np.concatenate([old[rows].ravel(), new]) for old, new in ((score, np.round(value, 9)), (at, b.at[y]), (who, b.names[y]), (whole, value)))
                order = np.lexsort((all_at, -all_score, row))
                sorted_rows = row[order]
                kept = order[np.arange(len(row)) - np.searchsorted(sorted_rows, sorted_rows) < k]
                score[rows], at[rows], who[rows], whole[rows] = (new[kept].reshape(-1, k) for new in (all_score, all_at, all_who, all_whole))
        for names, score, _, who, whole in best.values():
            x, y = np.nonzero(score > -np.inf)
            yield from zip(names[x].tolist(), who[x, y].tolist(), whole[x, y].tolist())

    kind = df.schema[name].dataType.simpleString()
    blocks, _ = _blocks(_vectors(df, name, vector, narrow=True))
    found = df.sparkSession.createDataFrame(_by_all(blocks, blocks).mapPartitions(run), f"source_table {kind}, target_table {kind}, similarity_score double", verifySchema=False)
    w = Window.partitionBy("source_table").orderBy(F.round("similarity_score", 9).desc(), "target_table")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def lsh_candidates(v: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """``a, b`` (``a < b``): names of ``v`` (``name, v``) whose vectors lie on the same side of ``bits`` random planes in one of ``tables`` draws."""
    col = F.col
    kind = v.schema["name"].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, part in b.groupby(b.v.map(len)):
                keys = _keys(np.stack(part.v.to_numpy()).astype(float), tables, bits, seed) + (np.arange(tables, dtype=np.int64) << bits)
                yield pd.DataFrame({"name": part.name, "dims": int(dims), "keys": list(keys)})

    hashed = v.mapInPandas(sign, f"name {kind}, dims int, keys array<bigint>").select("name", "dims", F.explode("keys").alias("key"))
    hashed = cut(hashed)
    a, b = hashed.withColumnRenamed("name", "a"), hashed.withColumnRenamed("name", "b")
    return a.join(b, ["dims", "key"]).where(col("a") < col("b")).select("a", "b").distinct()


def lsh_pairs(
    df: DataFrame, name: str = "full_table_name", vector: str = "embedding", threshold: float = 0.8,
    tables: int = 30, bits: int = 10, seed: int = 42,
) -> DataFrame:
    """Like ``cosine_pairs`` with candidates from random-plane hashing: exact values, approximate recall.

    A pair at angle x is a candidate with probability 1 - (1 - (1 - x/pi)^bits)^tables: with the defaults 0.95 at a
    cosine of 0.8, 0.99 at 0.85 and above, 0.03 at a right angle. A task holds some buckets of one draw; a pair comes
    from the first draw in which it shares one.
    """
    least = threshold - 1e-12
    some = _vectors(df, name, vector, narrow=True).where(F.exists("v", lambda x: x != 0))  # a zero vector has no direction
    blocks, size = _blocks(some, (tables, bits, seed))
    groups = max(1, ceil(size / GROUP_BYTES))

    def bucket(x: np.ndarray, keys: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of the vectors, which share a key in draw ``t``, that reach the threshold and share none in a draw before."""
        x32, out = x.astype(np.float32), []
        step = max(1, PRODUCTS // len(x))
        for i in range(0, len(x), step):
            a, b = np.nonzero(x32[i : i + step] @ x32[i:].T >= np.float32(least - _margin(x.shape[1])))
            fine = a < b
            a, b = a[fine] + i, b[fine] + i
            first = np.ones(len(a), bool)
            for u in range(t):
                first &= keys[a, u] != keys[b, u]
            a, b = a[first], b[first]
            value = _exact(x, a, x, b)
            out.append((a[value >= least], b[value >= least], value[value >= least]))
        return tuple(np.concatenate(z) for z in zip(*out))

    def run(pairs: Iterator[tuple[tuple[int, int], Row]]) -> Iterator[tuple]:
        held: dict[tuple, list] = {}
        for (t, g), row in pairs:
            b = _Block(row)
            keys = b.keys(tables, bits)
            own = np.nonzero(keys[:, t] % groups == g)[0]
            if len(own):
                held.setdefault((t, g, b.dims), []).append((b.raw[own], keys[own], b.at[own], b.names[own]))
        for (t, *_), parts in held.items():
            at = np.concatenate([p[2] for p in parts])
            order = np.argsort(at)
            x, keys, names = (np.concatenate([p[k] for p in parts])[order] for k in (0, 1, 3))
            parts.clear()
            order = np.argsort(keys[:, t], kind="stable")
            for rows in np.split(order, np.nonzero(np.diff(keys[order, t]))[0] + 1):
                if len(rows) > 1:
                    a, b, value = bucket(_unit(x[rows]), keys[rows], t)
                    a, b = rows[a], rows[b]
                    fine = names[a] != names[b]
                    yield from zip(names[a][fine].tolist(), names[b][fine].tolist(), value[fine].tolist())

    kind = df.schema[name].dataType.simpleString()
    tasks = [(t, g) for t in range(tables) for g in range(groups)]
    found = _by_all(df.sparkSession.sparkContext.parallelize(tasks, len(tasks)), blocks).mapPartitions(run)
    scored = df.sparkSession.createDataFrame(found, f"table_a {kind}, table_b {kind}, cosine_similarity double", verifySchema=False)
    return scored.orderBy(F.desc("cosine_similarity"), "table_a", "table_b")


def clusters(df: DataFrame, name: str = "full_table_name", vector: str = "embedding", k: int | None = None, least: int = 2, seed: int = 42) -> DataFrame:
    """``full_table_name, cluster_id, cluster_size, embedding`` of k-means clusters with at least ``least`` tables.

    Without ``k`` it is the square root of half the number of tables, 2 at least.
    """
    v = cut(_vectors(df, name, vector)).withColumn("x", array_to_vector("v"))
    k = k or max(2, floor(sqrt(v.count() / 2)))
    found = KMeans(featuresCol="x", predictionCol="cluster_id", k=k, seed=seed).fit(v).transform(v)
    sized = found.withColumn("cluster_size", F.count("*").over(Window.partitionBy("cluster_id")))
    return sized.where(F.col("cluster_size") >= least).select(F.col("name").alias("full_table_name"), "cluster_id", "cluster_size", F.col("v").alias("embedding")).orderBy("cluster_id", "full_table_name")


def projection(df: DataFrame, name: str = "full_table_name", vector: str = "embedding") -> DataFrame:
    """``full_table_name, vis_x, vis_y``: the first two principal components of the unit vectors."""
    v = cut(_vectors(df, name, vector)).select("name", array_to_vector(normalize("v")).alias("x"))
    xy = vector_to_array("p")
    return PCA(k=2, inputCol="x", outputCol="p").fit(v).transform(v).select(F.col("name").alias("full_table_name"), xy[0].alias("vis_x"), xy[1].alias("vis_y"))


def overlap_columns(a: Column | str, b: Column | str) -> tuple[Column, Column, Column]:
    """Ratio |A and B| / max(|A|, |B|), common and differing lower-case names of two arrays of column names."""
    lower = lambda x: F.array_sort(F.array_distinct(F.transform(F.col(x) if isinstance(x, str) else x, F.lower)))
    x, y = lower(a), lower(b)
    common = F.array_intersect(x, y)
    different = F.array_sort(F.array_union(F.array_except(x, y), F.array_except(y, x)))
    ratio = F.coalesce(F.try_divide(F.size(common).cast("double"), F.greatest(F.size(x), F.size(y))), F.lit(0.0))
    return ratio, common, different


def column_overlap(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds ``column_overlap, common_columns, different_columns`` to pairs, from ``full_table_name, column_name`` rows."""
    lists = columns.groupBy("full_table_name").agg(F.collect_set("column_name").alias("cols"))
    a = lists.select(F.col("full_table_name").alias("table_a"), F.col("cols").alias("ca"))
    b = lists.select(F.col("full_table_name").alias("table_b"), F.col("cols").alias("cb"))
    ratio, common, different = overlap_columns("ca", "cb")
    return (
        pairs.join(a, "table_a").join(b, "table_b")
        .withColumns({"column_overlap": ratio, "common_columns": common, "different_columns": different}).drop("ca", "cb")
    )
