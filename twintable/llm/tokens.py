"""Encoding of a corpus by a byte-level BPE, each shared chunk once."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain, takewhile
from math import ceil

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.runtime import cut, parallelism

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-tokenizer of byte_bpe_50k.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of the rolling hash's window; a cut after 1 in CUT_EVERY windows; characters of a chunk at least.
ROLL, CUT_EVERY, LEAST = 16, 192, 64
#: The last place where a letter is followed by something else, or a digit.
EDGE = regex.compile(r"(?r)(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})", regex.S)


class BytePairs:
    """Vocabulary and pieces of a byte-level BPE. Encodes piece by piece, with a cache of pieces."""

    def __init__(self, ranks: bytes, name: str):
        self.ranks, self.name = ranks, name

    def ready(self) -> tuple[Callable[[str], tuple[int, ...]], regex.Pattern]:
        """The function that encodes one piece, kept in the worker from task to task."""
        kept = tiktoken.__dict__.setdefault("_kept_encodings", {})
        if self.name not in kept:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.ranks.splitlines() if line)}
            encoding = tiktoken.Encoding(self.name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
            kept[self.name] = encoding, {}
        encoding, cache = kept[self.name]

        def piece(s: str) -> tuple[int, ...]:
            ids = cache.get(s)
            if ids is None:
                ids = tuple(encoding.encode_ordinary(s))
                if len(s) <= 32:
                    if len(cache) > 200_000:
                        cache.clear()
                    cache[s] = ids
            return ids

        return piece, regex.compile(PATTERN)


def load(path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> BytePairs:
    """Read on the driver; executors get the bytes (under 1 MB) with the code."""
    with open(f"{path}/{name}.tiktoken", "rb") as f:
        return BytePairs(f.read(), name)


def chunk_ends(texts: list[str]) -> list[list[int]]:
    """Ends of the content-defined chunks of each text: where a rolling hash of the last ROLL characters is 0 mod CUT_EVERY."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(len(points), np.uint64)
    for _ in range(ROLL):
        rolled[1:] = rolled[:-1] * np.uint64(0x100000001B3)
        rolled += mixed
    rolled ^= rolled >> np.uint64(33)
    cuts = np.nonzero(rolled % np.uint64(CUT_EVERY) == 0)[0] + 1
    stops = np.cumsum(lengths)
    out = []
    for n, stop in zip(lengths, stops):
        start = stop - n
        ends, last = [], 0
        for c in cuts[np.searchsorted(cuts, start + ROLL) : np.searchsorted(cuts, stop)]:
            at = int(c - start)
            if at - last >= LEAST:
                ends.append(at)
                last = at
        if n:
            ends.append(int(n))
        out.append(ends)
    return out


def segments(text: str, ends: list[int], pattern: regex.Pattern) -> list[tuple[int, int, int, int]]:
    """What of a text comes from its chunks, ``ends`` being theirs: (chunk, a, b, c), in order and without gaps.

    The chunk's own pieces hold for [a, b); the joint [b, c) is split again as a part of the whole text.

    A piece depends on nothing before its start, so two splits that have one end in common agree from there on,
    as far as neither ends. Where a letter is followed by none, or a digit by none, a piece ends whatever
    surrounds them: b is the last such place of a chunk. From b on the whole text is split until one of its
    pieces ends where one of the next chunk's own does (a later chunk's, if that one has no such place).
    """
    starts = [0, *ends[:-1]]
    last = len(ends) - 1
    out = []
    k = a = 0
    while k < last:
        place = EDGE.search(text, a + 1, ends[k])
        b = place.start() if place else a
        j = k + 1
        own, own_end = pattern.finditer(text, starts[j], ends[j]), starts[j]
        for m in pattern.finditer(text, b):
            end = m.end()
            while own_end < end:
                if own_end == ends[j]:
                    j += 1
                    own = pattern.finditer(text, starts[j], ends[j])
                own_end = next(own).end()
            if own_end == end and (end < ends[j] or j == last):
                break
        out.append((k, a, b, end))
        k, a = j, end
        if end == ends[last]:
            return out
    return [*out, (last, a, ends[last], ends[last])]


def _split(bpe: BytePairs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per segment: its chunk, how many of the chunk's ids to skip and to drop, and the joint's ids."""
        piece, pattern = bpe.ready()

        def coded(text: str, start: int, end: int) -> list[int]:
            return [i for m in pattern.finditer(text, start, end) for i in piece(m[0])]

        for b in batches:
            out = []
            for row, key, text, ends in zip(b["row"], b["id"], b.text, chunk_ends(b.text.tolist())):
                for pos, (k, start, stop, end) in enumerate(segments(text, ends, pattern)):
                    first = ends[k - 1] if k else 0
                    # The pieces of a joint end at its end, so it can be split without what follows it, but for blanks.
                    joint = [i for m in takewhile(lambda m: m.start() < end, pattern.finditer(text, stop)) for i in piece(m[0])] if end > stop else []
                    if start == stop:
                        out.append((row, key, pos, None, 0, 0, joint))
                    else:
                        out.append((row, key, pos, text[first : ends[k]], len(coded(text, first, start)), len(coded(text, stop, ends[k])), joint))
            yield pd.DataFrame(out, columns=["row", "id", "pos", "chunk", "skip", "drop", "joint"])

    return run


def _encode(bpe: BytePairs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, pattern = bpe.ready()
        for b in batches:
            ids = [np.fromiter(chain.from_iterable(map(piece, pattern.findall(text))), np.int32) for text in b.chunk]
            yield pd.DataFrame({"chunk_key": b.chunk_key, "copies": b.copies, "ids": ids})

    return run


def _texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``row, id, text`` of the texts that have any, and the ``id`` of the others."""
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return base.where("text <> ''").withColumn("row", F.monotonically_increasing_id()), base.where("text is null or text = ''").select("id")


def _coded_segments(texts: DataFrame, bpe: BytePairs, counts: bool) -> DataFrame:
    """``row, id, pos, part``: the ids of every segment in order, or (``counts``) how many they are."""
    spark, col = texts.sparkSession, F.col
    kind = texts.schema["id"].dataType.simpleString()
    parts = texts.mapInPandas(_split(bpe), f"row bigint, id {kind}, pos int, chunk string, skip int, drop int, joint array<int>")
    parts = cut(parts.withColumn("chunk_key", F.unhex(F.md5("chunk"))))
    once = parts.where("chunk is not null").groupBy("chunk_key").agg(F.min("chunk").alias("chunk"), F.count("*").alias("copies"))
    coded = cut(once.mapInPandas(_encode(bpe), "chunk_key binary, copies bigint, ids array<int>"))
    total = coded.agg(F.sum("copies")).first()[0] or 0
    tasks = parallelism(spark)
    limit = max(1000, ceil(total / (4 * tasks)))
    hot = F.broadcast(coded.where(col("copies") > limit).select("chunk_key", F.ceil(4 * col("copies") / limit).cast("int").alias("salts")))
    left = parts.drop("chunk").join(hot, "chunk_key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), col("salts")), F.lit(0)).cast("int")).drop("salts")
    what = F.size("ids").alias("ids") if counts else col("ids")
    right = coded.select("chunk_key", what).join(hot, "chunk_key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    both = left.join(right, ["chunk_key", "salt"], "left")
    if counts:
        part = F.coalesce(col("ids") - col("skip") - col("drop"), F.lit(0)) + F.size("joint")
    else:
        own = F.coalesce(F.slice("ids", col("skip") + 1, F.size("ids") - col("skip") - col("drop")), F.array().cast("array<int>"))
        part = F.concat(own, "joint")
    return both.select("row", "id", "pos", part.alias("part"))


def encode_corpus(docs: DataFrame, key: str, text: str, bpe: BytePairs) -> DataFrame:
    """``id, ids``: the token ids of every text, exactly those of encoding it as a whole, without special tokens.

    Texts are cut into content-defined chunks, which copies and near copies share. Each distinct chunk is
    encoded once. What a cut changes is repaired where the text is still at hand: the joint between two chunks
    is encoded again, until the text's pieces agree with the chunk's own. So no text is shuffled but that of
    the distinct chunks: their ids come back to the texts by a join on the chunk's 128-bit digest. Frequent
    chunks (more than 1 / (4 x tasks) of all, so no more than 4 x tasks of them) get salted on both sides, so
    that no task of the join gets all rows of one chunk.

    Defined cases: the null and the empty text give the empty list; text is taken as it is, whole, of any
    length, and strings that look like special tokens are ordinary text; a repeated key or row gives a row each.
    """
    texts, others = _texts(docs, key, text)
    parts = _coded_segments(texts, bpe, False)
    listed = F.array_sort(F.collect_list(F.struct("pos", "part")))
    whole = parts.groupBy("row").agg(F.first("id").alias("id"), listed.alias("l")).select("id", F.flatten(F.transform("l", lambda x: x["part"])).alias("ids"))
    return whole.unionByName(others.select("id", F.array().cast("array<int>").alias("ids")))


def token_counts(docs: DataFrame, key: str, text: str, bpe: BytePairs) -> DataFrame:
    """``id, n``: how many ids ``encode_corpus`` gives each text, without bringing the ids to the texts."""
    texts, others = _texts(docs, key, text)
    counted = _coded_segments(texts, bpe, True).groupBy("row").agg(F.first("id").alias("id"), F.sum("part").cast("int").alias("n"))
    return counted.select("id", "n").unionByName(others.select("id", F.lit(0).alias("n")))
