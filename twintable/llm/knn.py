"""The k most similar vectors of every vector, by anisotropic quantisation and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twintable.runtime import cut, parallelism, scratch

#: Vectors that the index is fitted on at most: those with the smallest hashes of their names. All are indexed.
FIT_ROWS = 20_000
#: Vectors a cell holds on average; from so many cells on they are divided further, all by the same centres of residuals.
CELL_ROWS, MOST_CELLS = 2_000, 4_096
#: Cells are searched whose score is behind the best by no more than those of all but this share of true neighbours in the sample.
MISSED, MARGIN_QUERIES = 0.005, 1_000
#: Rows of a block, on either side.
BLOCK_ROWS = 4_000


class AnisotropicIndex:
    """Cells of a spherical k-means; residuals in 4-bit codes of ``subspaces`` codebooks with 16 words each.

    The codebooks minimise a score-aware loss: the part of the error along the vector, which moves the inner
    products that matter, weighs ``eta`` times as much as the part across, eta = (d - 1) T^2 / (1 - T^2).
    """

    def __init__(self, sample: np.ndarray, cells: int, fine: int = 1, subspaces: int = 16, threshold: float = 0.2, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        while d % subspaces:
            subspaces -= 1
        self.s, self.w = subspaces, d // subspaces
        self.eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        cells = min(cells, n)
        c = sample[rng.choice(n, cells, replace=False)].copy()
        for _ in range(12):
            near = (sample @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, sample)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            empty = norm[:, 0] < 1e-9
            c = np.where(empty[:, None], sample[rng.integers(0, n, cells)], sums / np.maximum(norm, 1e-9))
        self.coarse, self.fine = c.astype(np.float32), np.zeros((1, d), np.float32)
        if fine > 1:
            rest = sample - self.coarse[(sample @ self.coarse.T).argmax(1)]
            f = rest[rng.choice(n, min(fine, n), replace=False)].copy()
            for _ in range(12):
                near = ((f**2).sum(1)[None] - 2 * rest @ f.T).argmin(1)
                sums, many = np.zeros_like(f), np.bincount(near, minlength=len(f))[:, None]
                np.add.at(sums, near, rest)
                f = np.where(many > 0, sums / np.maximum(many, 1), f)
            self.fine = f.astype(np.float32)
        residual = sample - self.centre(self.cell_of(sample))
        parts = residual.reshape(n, self.s, self.w)
        self.words = np.stack([parts[rng.choice(n, 16, replace=n < 16), s] for s in range(self.s)]).astype(np.float64)
        for _ in range(6):
            codes = self._assign(sample, residual)
            self._update(sample, residual, codes)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        cell = (x @ self.coarse.T).argmax(1)
        rest = x - self.coarse[cell]
        return cell * len(self.fine) + ((self.fine**2).sum(1)[None] - 2 * rest @ self.fine.T).argmin(1)

    def centre(self, cell: np.ndarray | int) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with the centres of all cells."""
        return ((q @ self.coarse.T)[:, :, None] + (q @ self.fine.T)[:, None]).reshape(len(q), -1)

    def margin(self, sample: np.ndarray, k: int, least: float) -> float:
        """How far the score of a true neighbour's cell is behind the best cell's, but for MISSED of them (in the sample)."""
        q = sample[:MARGIN_QUERIES]
        s = q @ sample.T
        s[np.arange(len(q)), np.arange(len(q))] = -2
        top = np.argpartition(-s, min(k, len(sample)) - 1, axis=1)[:, :k]
        score = self.scores(q)
        behind = (score.max(1)[:, None] - np.take_along_axis(score, self.cell_of(sample)[top], 1))[np.take_along_axis(s, top, 1) >= least]
        return float(np.quantile(behind, 1 - MISSED)) if len(behind) else 0.0

    def _assign(self, x: np.ndarray, residual: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on |e|^2 + (eta - 1) <e, x>^2 over the subspaces."""
        n = len(x)
        xs, rs = x.reshape(n, self.s, self.w).astype(np.float64), residual.reshape(n, self.s, self.w).astype(np.float64)
        square = (rs**2).sum(2)[:, :, None] - 2 * np.einsum("nsw,skw->nsk", rs, self.words) + (self.words**2).sum(2)[None]
        along = np.einsum("nsw,nsw->ns", rs, xs)[:, :, None] - np.einsum("nsw,skw->nsk", xs, self.words)
        codes = square.argmin(2)
        rows = np.arange(n)
        picked = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
        total = picked.sum(1)
        for _ in range(2):
            for s in range(self.s):
                rest = total - picked[:, s]
                best = (square[:, s] + (self.eta - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
                codes[:, s], picked[:, s] = best, along[rows, s, best]
                total = rest + picked[:, s]
        return codes

    def _update(self, x: np.ndarray, residual: np.ndarray, codes: np.ndarray) -> None:
        """The words that minimise the loss, one subspace after the other."""
        n = len(x)
        xs, rs = x.reshape(n, self.s, self.w).astype(np.float64), residual.reshape(n, self.s, self.w).astype(np.float64)
        error = rs - self.words[np.arange(self.s)[None], codes]
        along = (error * xs).sum(2)
        total = along.sum(1)
        for s in range(self.s):
            rest = total - along[:, s]
            for k in range(16):
                m = codes[:, s] == k
                if m.any():
                    v, r = xs[m, s], rs[m, s]
                    a = m.sum() * np.eye(self.w) + (self.eta - 1) * v.T @ v
                    b = r.sum(0) + (self.eta - 1) * v.T @ (rest[m] + (v * r).sum(1))
                    self.words[s, k] = np.linalg.solve(a, b)
            along[:, s] = ((rs[:, s] - self.words[s, codes[:, s]]) * xs[:, s]).sum(1)
            total = rest + along[:, s]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes, two 4-bit codes to a byte."""
        cell = self.cell_of(x)
        codes = self._assign(x, x - self.centre(cell))
        if self.s % 2:
            codes = np.concatenate([codes, np.zeros((len(x), 1), codes.dtype)], axis=1)
        return cell, (codes[:, ::2] * 16 + codes[:, 1::2]).astype(np.uint8)

    def errors(self, x: np.ndarray, cell: int, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors of one cell: the part of the codes' error along the vector, and the length of the part across."""
        codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(x), -1)[:, : self.s]
        x = x.astype(np.float64)
        error = x - self.centre(cell) - self.words[np.arange(self.s)[None], codes].reshape(len(x), -1)
        along = np.einsum("nd,nd->n", error, x)
        return along, np.sqrt(np.maximum((error**2).sum(1) - along**2, 0.0))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Per query, the scores of all bytes: sums of the look-up tables of two subspaces."""
        t = np.einsum("msw,skw->msk", q.reshape(len(q), self.s, self.w), self.words.astype(np.float32))
        if self.s % 2:
            t = np.concatenate([t, np.zeros((len(q), 1, 16), t.dtype)], axis=1)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256)


def usable_vectors(df: DataFrame, name: str, vector: str, dims: int) -> DataFrame:
    """``name, v``: one vector per name, of exactly ``dims`` finite numbers that are not all zero."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    ok = F.col(name).isNotNull() & x.isNotNull() & (F.size(x) == dims) & fine & F.exists(x, lambda e: e != 0)
    return df.where(ok).groupBy(F.col(name).alias("name")).agg(F.min(x).alias("v"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), -1)


def _directions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors, and their numbers rounded as a key of equal directions."""
    for b in batches:
        x = np.stack(b.v.to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rounded = np.round(x, 6) + 0.0
        yield pd.DataFrame({"name": b.name, "key": [r.astype(np.float32).tobytes() for r in rounded], "u": [r.tobytes() for r in x.astype(np.float32)]})


def nearest(
    df: DataFrame, name: str, vector: str, dims: int = 64, k: int = 5, least: float = 0.8,
    probes: int | None = 10, rerank: int = 32, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS,
) -> DataFrame:
    """``name, neighbour, cosine``: the ``k`` most similar other names of every name, as far as cosine >= ``least``.

    Ties go to the smaller name (cosines are compared to nine places). Vectors of one direction are one class:
    classes are searched, with the k + 1 smallest names of each, and results expanded to all members.

    The index is fitted on a bounded sample of ``fit_rows`` vectors; every vector is indexed and every vector
    is a query. A class is stored in the block of its cell and searched for in the blocks of the ``probes``
    nearest cells, and of all others that are behind the nearest by no more than a margin measured on the sample:
    few for most vectors, many for near-copies, which fill whole cells beside one another. ``probes=None``
    searches all cells, which is exact. The number of cells grows with that of vectors: beyond ``most_cells``
    each is divided by a second set of centres, of residuals, that all share. In a block 4-bit tables score the whole of it, the best ``rerank`` are scored exactly, and so is every
    other row that may be as good as the k + 1 best of these: a cosine of t or more gives an approximate score of
    at least t (1 - a) - sqrt(1 - t^2) b, a and b being the row's error along and across. So nothing in a block is
    lost to the codes. Cells with more than BLOCK_ROWS rows on either side are cut by salt, so no task grows
    with a popular cell.

    Defined cases: null or blank names, null, wrongly long, non-finite and all-zero vectors take no part; of
    several rows of a name the smallest vector counts; an empty table gives no rows.
    """
    with scratch(df.sparkSession):
        return cut(_nearest(df, name, vector, dims, k, least, probes, rerank, fit_rows, cell_rows, most_cells), keep=True)


def _nearest(df: DataFrame, name: str, vector: str, dims: int, k: int, least: float, probes: int | None, rerank: int, fit_rows: int, cell_rows: int, most_cells: int) -> DataFrame:
    spark, col = df.sparkSession, F.col
    unit = usable_vectors(df, name, vector, dims).mapInPandas(_directions, "name string, key binary, u binary")
    unit = cut(unit.withColumn("id", F.xxhash64("key")))
    window = Window.partitionBy("id", "key").orderBy("name")
    few = unit.withColumn("r", F.row_number().over(window)).where(col("r") <= k + 1)
    classes = cut(few.groupBy("id", "key").agg(F.min(F.struct("name", "u")).alias("m"), F.array_sort(F.collect_list("name")).alias("names")).select("id", "m.u", "names"))
    n = classes.count()
    if not n:
        return df.select(col(name).alias("name"), col(name).alias("neighbour"), F.lit(0.0).alias("cosine")).limit(0)
    sample = classes.select("u", F.xxhash64("id").alias("h")).orderBy("h").limit(fit_rows).select("u").toPandas()
    fit = _stack(sample.u).astype(np.float64)
    cells = max(1, n // cell_rows)
    index = AnisotropicIndex(fit, min(most_cells, cells), ceil(cells / most_cells))
    margin = np.inf if probes is None else index.margin(fit, k, least)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index
        for b in batches:
            x = _stack(b.u)
            near = ix.scores(x)
            p = min(probes or 1, near.shape[1])
            limit = np.minimum(-np.partition(-near, p - 1, axis=1)[:, p - 1], near.max(1) - margin)
            cell, codes = ix.encode(x)
            asks = [np.nonzero(row)[0].astype("int32") for row in near >= limit[:, None]]
            yield pd.DataFrame({"id": b.id, "u": b.u, "cell": cell.astype("int32"), "code": [c.tobytes() for c in codes], "asks": asks})

    placed = cut(classes.mapInPandas(place, "id bigint, u binary, cell int, code binary, asks array<int>"))
    held = placed.groupBy("cell").agg(F.count("*").alias("n"))
    asked = placed.select(F.explode("asks").alias("cell")).groupBy("cell").agg(F.count("*").alias("m"))
    salts = held.join(asked, "cell").select(
        "cell", "m", F.ceil(col("n") / BLOCK_ROWS).cast("int").alias("si"), F.ceil(col("m") / BLOCK_ROWS).cast("int").alias("sp")
    )
    salts = cut(salts)
    total = salts.agg(F.sum("m")).first()[0] or 0
    salts = salts.drop("m")
    spread = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), m).cast("int")
    stored = placed.join(salts, "cell").select(
        "id", "u", "code", "cell", spread(col("si"), 1).alias("i"), F.explode(F.sequence(F.lit(0), col("sp") - 1)).alias("p")
    )
    asks = placed.select("id", "u", F.lit(None).cast("binary").alias("code"), F.explode("asks").alias("cell")).join(salts, "cell").select(
        "id", "u", "code", "cell", F.explode(F.sequence(F.lit(0), col("si") - 1)).alias("i"), spread(col("sp"), 2).alias("p")
    )

    def search(block: pd.DataFrame) -> pd.DataFrame:
        ix = index
        have = block[~block.code.isna()]
        ask = block[block.code.isna()]
        out = []
        if len(have) and len(ask):
            codes = np.frombuffer(b"".join(have.code), dtype=np.uint8).reshape(len(have), -1)
            x, ids = _stack(have.u), have.id.to_numpy()
            queries, asked_by = _stack(ask.u), ask.id.to_numpy()
            r = min(rerank, len(ids))
            cell = int(have.cell.iloc[0])
            along, across = (e.astype(np.float32) for e in ix.errors(x, cell, codes))
            wide = x.astype(np.float64)
            wide /= np.linalg.norm(wide, axis=1, keepdims=True)
            for at in range(0, len(queries), 256):
                q, who = queries[at : at + 256], asked_by[at : at + 256]
                tables = ix.tables(q)
                score = np.zeros((len(q), len(ids)), np.float32)
                for s in range(codes.shape[1]):
                    score += tables[:, s].take(codes[:, s], axis=1)
                top = np.argpartition(-score, r - 1, axis=1)[:, :r]
                unit = q.astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                exact = np.einsum("md,mrd->mr", unit, wide[top])
                exact[(exact < least - 1e-6) | (ids[top] == who[:, None])] = -2
                # What a row's cosine must reach: the last place of the reranked rows, if they fill the list.
                bar = np.maximum(np.partition(exact, -k - 1, axis=1)[:, -k - 1] if r > k else np.full(len(q), -2.0), least) - 1e-6
                slack = np.sqrt(np.maximum(1 - bar**2, 0.0)).astype(np.float32)
                bound = bar.astype(np.float32)[:, None] * (1 - along) - slack[:, None] * across - 1e-5
                bound[bar < 0] = -np.inf  # below 0 the bound doesn't hold
                able = score + (q @ ix.centre(cell))[:, None] >= bound
                np.put_along_axis(able, top, False, 1)
                more = np.nonzero(able.any(1))[0]
                if len(more):
                    whole = unit[more] @ wide.T
                    whole[(whole < least - 1e-6) | (ids == who[more, None])] = -2
                    deep = np.argpartition(-whole, r - 1, axis=1)[:, :r]
                    top[more], exact[more] = deep, np.take_along_axis(whole, deep, 1)
                best = np.argsort(-exact, axis=1)[:, : k + 1]
                value = np.take_along_axis(exact, best, 1)
                rows, cols = np.nonzero(value > -2)
                out.append(pd.DataFrame({"id": who[rows], "other": ids[np.take_along_axis(top, best, 1)[rows, cols]], "cosine": value[rows, cols]}))
        return pd.concat(out) if out else pd.DataFrame({"id": np.array([], "int64"), "other": np.array([], "int64"), "cosine": np.array([], "float64")})

    parts = max(parallelism(spark), ceil(total / 20_000))
    found = stored.unionByName(asks).repartition(parts, "cell", "i", "p").groupBy("cell", "i", "p").applyInPandas(search, "id bigint, other bigint, cosine double")
    own = classes.select("id", col("id").alias("other"), F.lit(1.0).alias("cosine"))
    near = found.withColumn("cosine", F.round("cosine", 9)).where(col("cosine") >= least - 1e-9)
    listed = near.unionByName(own).join(classes.select(col("id").alias("other"), F.explode("names").alias("neighbour")), "other")
    first = Window.partitionBy("id").orderBy(col("cosine").desc(), "neighbour")
    lists = listed.withColumn("r", F.row_number().over(first)).where(col("r") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "cosine"))).alias("list"))
    members = unit.select("name", "id").join(lists, "id")
    others = F.slice(F.filter("list", lambda e: e["neighbour"] != col("name")), 1, k)
    return members.select("name", F.explode(others).alias("e")).select("name", "e.neighbour", "e.cosine")
