"""Near-duplicate texts: MinHash bands for candidates, segment popcounts as a lower bound, exact verification.

A text's shingles are hashed to bits; the bits are cut into segments, and the counts per segment embed the text. The
Manhattan distance of two embeddings never exceeds the size of the symmetric difference of the shingle sets, and two
sets with a Jaccard similarity of t differ in at most (1 - t) / (1 + t) of their summed sizes: pairs beyond that are
dropped without reading their texts.

A grid over the embeddings can't give the candidates at a similarity of 0.5: pairs may differ in a third of all counts,
and so do unrelated texts once segments are few enough to enumerate cells. Candidates are pairs that share a band of
their MinHash signatures, ``BANDS`` bands of ``ROWS`` least values: a pair of similarity s shares one with probability
1 - (1 - s**ROWS)**BANDS, 0.984 at 0.5 and 0.9998 at 0.6. With ``exact`` candidates are instead pairs that share a
shingle of their prefixes (the n - ceil(t n) + 1 first of a text's n shingles in the order of their hashes), which misses
no pair and costs about twice as much. What the bound leaves is verified on the texts' whole shingle sets.

Texts with the same shingle set form a class and are joined once; pairs are written out from classes at the end.

Defined results: null keys, null texts and texts without a shingle take no part; repeated rows of a key count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

BANDS, ROWS = 64, 4
SEGMENTS = 128
_WORD = re.compile(r"[^\W_]+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(300_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _runs(codes: np.ndarray, k: int) -> np.ndarray:
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _mix(h + codes[i : i + n] * _ODD[i % 4] + np.uint64(i + 1))
    return np.unique(h)


def word_shingles(text: str, k: int) -> np.ndarray:
    """Hashes of the distinct runs of ``k`` lower-case words (runs of letters or digits), sorted."""
    return _runs(np.array([_word_hash(w) for w in _WORD.findall(text.lower())], np.uint64), k)


def character_shingles(text: str, k: int) -> np.ndarray:
    """Hashes of the distinct runs of ``k`` letters or digits, lower case, all else removed, sorted."""
    kept = "".join(ch for ch in text.lower() if ch.isalnum())
    return _runs(np.frombuffer(kept.encode("utf-32-le"), np.uint32).astype(np.uint64), k)


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rs = np.random.RandomState(11)
    draw = lambda: rs.randint(0, 2**63 - 1, BANDS * ROWS).astype(np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def prefix(shingles: np.ndarray, least: float) -> np.ndarray:
    """The shingles of which two sets of a similarity of ``least`` must share one; ``shingles`` are sorted."""
    n = len(shingles)
    return shingles[: n - math.ceil(least * n - 1e-9) + 1].view(np.int64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The keys of the bands of a set's MinHash signature."""
    a, b = _permutations()
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        h = shingles[i : i + 2048, None] * a + b
        low = np.minimum(low, (h ^ (h >> np.uint64(29))).min(axis=0))
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _ODD[0]
    for i in range(ROWS):
        key = _mix(key + rows[:, i] * _ODD[i % 4])
    return key.view(np.int64)


def popcounts(shingles: np.ndarray) -> bytes:
    """Bits set in each segment, at most 255 (a lower count keeps the distance a lower bound)."""
    return np.minimum(np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=SEGMENTS), 255).astype(np.uint8).tobytes()


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def shingle_set(text: str, kind: str, how: dict[str, tuple[str, int, int]]) -> np.ndarray:
    """The set of a text of a kind; ``how``: kind -> ('word' or 'character', run length, least words)."""
    unit, k, least = how[kind]
    if least and len(text.split(None, least - 1)) < least:
        return np.zeros(0, np.uint64)
    return word_shingles(text, k) if unit == "word" else character_shingles(text, k)


def sketch(rows: DataFrame, how: dict[str, tuple[str, int, int]], least: float = 0.5, exact: bool = False) -> DataFrame:
    """(kind, id, c1, c2, n, counts, cells) of ``rows`` (kind, id, text); texts with a cell in common are candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ids, texts = (b.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for kind, i, text in zip(kinds, ids, texts):
                s = shingle_set(text, kind, how)
                if len(s):
                    out.append((kind, i, *_set_key(s), len(s), popcounts(s), prefix(s, least) if exact else bands(s)))
            cols = list(zip(*out)) if out else [[] for _ in range(7)]
            flat = np.concatenate(cols[6]) if out else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in cols[6]])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                names=["kind", "id", "c1", "c2", "n", "counts", "cells"],
            )

    return rows.select("kind", "id", "text").mapInArrow(run, "kind string, id string, c1 bigint, c2 bigint, n int, counts binary, cells array<bigint>")


def _within_bound(na: Column, ca: Column, nb: Column, cb: Column, least: float) -> Column:
    """Whether the embeddings are near enough for the similarity."""

    @F.pandas_udf("boolean")
    def near(n1, x, n2, y):  # noqa: ANN001, ANN202
        import pandas as pd

        a = np.frombuffer(b"".join(x), np.uint8).reshape(-1, SEGMENTS).astype(np.int32)
        b = np.frombuffer(b"".join(y), np.uint8).reshape(-1, SEGMENTS).astype(np.int32)
        distance = np.abs(a - b).sum(axis=1)
        return pd.Series(distance <= (1 - least) / (1 + least) * (n1.to_numpy() + n2.to_numpy()) + 1e-9)

    return near(na, ca, nb, cb)


def similar_classes(sketches: DataFrame, rows: DataFrame, how: dict[str, tuple[str, int, int]], least: float) -> DataFrame:
    """(kind, a1, a2, b1, b2): pairs of different classes whose similarity is ``least`` or more, verified on whole texts."""
    reps = sketches.groupBy("kind", "c1", "c2").agg(F.min(F.struct("id", "n", "counts", "cells")).alias("x")).select("kind", F.col("x.id").alias("id"), "x.n", "x.counts", "x.cells")
    long = reps.select("kind", "id", "n", F.explode("cells").alias("cell"))
    a = long.select("kind", F.col("id").alias("a"), F.col("n").alias("na"), "cell")
    b = long.select("kind", F.col("id").alias("b"), F.col("n").alias("nb"), "cell")
    small = F.least("na", "nb") >= least * F.greatest("na", "nb")
    met = a.join(b, ["kind", "cell"]).where((F.col("a") < F.col("b")) & small).select("kind", "a", "b").distinct()
    one = reps.select("kind", F.col("id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    two = reps.select("kind", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    bounded = cut(met.join(one, ["kind", "a"]).join(two, ["kind", "b"]).where(_within_bound(F.col("na"), F.col("ca"), F.col("nb"), F.col("cb"), least)).select("kind", "a", "b"))
    wanted = bounded.select("kind", F.col("a").alias("id")).unionByName(bounded.select("kind", F.col("b").alias("id"))).distinct()
    texts = rows.join(wanted, ["kind", "id"], "left_semi").select("kind", "id", "text")
    both = bounded.join(texts.select("kind", F.col("id").alias("a"), F.col("text").alias("ta")), ["kind", "a"]).join(texts.select("kind", F.col("id").alias("b"), F.col("text").alias("tb")), ["kind", "b"])

    @F.pandas_udf("boolean")
    def similar(kind, x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for k, p, q in zip(kind, x, y):
            s, t = shingle_set(p, k, how), shingle_set(q, k, how)
            same = len(np.intersect1d(s, t, assume_unique=True))
            out.append(same >= least * (len(s) + len(t) - same))
        return pd.Series(out, dtype=bool)

    return both.where(similar("kind", "ta", "tb")).select("kind", "a", "b")


def near_duplicates(rows: DataFrame, how: dict[str, tuple[str, int, int]], least: float, exact: bool = False) -> DataFrame:
    """(kind, id_a, id_b): pairs of ids of one kind whose shingle sets are ``least`` similar or more, id_a < id_b.

    ``rows``: kind, id, apart, text. Pairs with an equal non-null ``apart`` don't count. ``exact`` misses no pair.
    """
    one = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()).groupBy("kind", "id").agg(F.min(F.struct("text", "apart")).alias("x")).select("kind", "id", "x.apart", "x.text")
    sketches = cut(sketch(one, how, least, exact))
    names = sketches.groupBy("kind", "c1", "c2").agg(F.min("id").alias("rep"))
    members = sketches.select("kind", "id", "c1", "c2").join(names, ["kind", "c1", "c2"]).select("kind", "id", "rep").join(one.select("kind", "id", "apart"), ["kind", "id"])
    classes = similar_classes(sketches, one, how, least)
    x = members.select("kind", F.col("rep").alias("a"), F.col("id").alias("ia"), F.col("apart").alias("pa"))
    y = members.select("kind", F.col("rep").alias("b"), F.col("id").alias("ib"), F.col("apart").alias("pb"))
    other = classes.join(x, ["kind", "a"]).join(y, ["kind", "b"]).select("kind", "ia", "ib", "pa", "pb")
    many = members.groupBy("kind", "rep").count().where("count > 1").select("kind", "rep")
    copies = members.join(many, ["kind", "rep"], "left_semi")
    p = copies.select("kind", "rep", F.col("id").alias("ia"), F.col("apart").alias("pa"))
    same = p.join(copies.select("kind", "rep", F.col("id").alias("ib"), F.col("apart").alias("pb")), ["kind", "rep"]).where("ia < ib").select("kind", "ia", "ib", "pa", "pb")
    keep = F.col("pa").isNull() | F.col("pb").isNull() | (F.col("pa") != F.col("pb"))
    return other.unionByName(same).where(keep).select("kind", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
