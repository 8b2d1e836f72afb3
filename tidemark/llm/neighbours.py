"""The most similar vectors of every vector: multi-index hashing over learned, rotated binary codes.

Rotations are learned on a bounded sample (principal axes, then iterative quantisation from different starts); the signs
of a rotated vector are its code. The code is cut into substrings, each with an index of its own. A vector probes every
index with its substring and with those that have one more bit set: of two substrings one bit apart exactly one finds the
other, so every two codes with a substring no farther apart than one bit meet, by the pigeonhole all within a Hamming
distance of 2 * parts - 1 and most beyond. Pairs whose codes are no farther apart than ``radius`` are reranked by the
exact cosine of their floats. Equal vectors are searched for once, through their class.

The width of a substring is the logarithm of the largest space's size, so that a bucket of evenly spread codes holds about
one vector at any size; the number of parts is what finds a pair at the least cosine with a probability of ``FOUND``, and
nearer ones more surely. The radius leaves out pairs five standard deviations beyond the expected distance of such a pair
(fewer than one in a million where bits are independent).

Defined results: null vectors, vectors of another length, with a null, infinite or NaN number, all zeros, or without
a space take no part. Ties go to the smaller key. Repeated rows of one key count once (the smallest vector). Spaces
are never mixed. An empty input gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Vectors that the rotation is learned from, at most (the first by hash of their key). Every vector is indexed.
SAMPLE = 8000
#: With which probability a pair at the least cosine shares a bucket.
FOUND = 0.85


@dataclass(frozen=True)
class Plan:
    """Substring width, number of substrings, and the farthest codes that are reranked."""

    width: int
    parts: int
    radius: int

    @property
    def longs(self) -> int:
        return -(-self.width * self.parts // 64)


def plan(rows: int, least: float, found: float = FOUND) -> Plan:
    """The plan for a space of ``rows`` vectors."""
    width = min(30, max(10, math.ceil(math.log2(max(rows, 2)))))
    flip = math.acos(least) / math.pi
    same = (1 - flip) ** width + width * flip * (1 - flip) ** (width - 1)
    parts = math.ceil(math.log(1 - found) / math.log(1 - same))
    bits = width * parts
    return Plan(width, parts, math.ceil(bits * flip + 5 * math.sqrt(bits * flip * (1 - flip))))


def learn_rotation(vectors: np.ndarray, bits: int, rounds: int = 40, seed: int = 0) -> np.ndarray:
    """Rotations (dimensions x bits) whose signs keep most of the sample's angles; plain ones for a small sample.

    Each rotation has as many columns as there are dimensions; as many rotations are learned as the bits need.
    """
    dims = vectors.shape[1]
    out = []
    while sum(r.shape[1] for r in out) < bits:
        turn = np.linalg.qr(np.random.RandomState(seed + len(out)).randn(dims, dims))[0]
        if len(vectors) >= dims:
            w, axes = np.linalg.eigh(vectors.T @ vectors / len(vectors))
            axes = axes[:, np.argsort(w)[::-1]]
            p = vectors @ axes
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.sign(p @ turn).T @ p)
                turn = (u @ vt).T
            turn = axes @ turn
        out.append(turn)
    return np.concatenate(out, axis=1)[:, :bits]


def _matrix(values: pd.Series, dims: int) -> np.ndarray:
    return np.concatenate(values.to_numpy()).reshape(-1, dims).astype(np.float64) if len(values) else np.zeros((0, dims))


def usable(vector: Column, dims: int) -> Column:
    d = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(d(x)) & (F.abs(d(x)) < float("inf")))
    return (F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0)


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def bucket_keys(bits: np.ndarray, spaces: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own keys, probed keys, how many probed) of codes: the buckets a vector lies in, and all that it looks into, its own first."""
    n = len(bits)
    sub = (bits.reshape(n, p.parts, p.width) * (1 << np.arange(p.width, dtype=np.int64))).sum(axis=2)
    part = np.arange(p.parts, dtype=np.uint64)[None, :] * _ODD[1] + spaces.view(np.uint64)[:, None] * _ODD[2]

    def key(x: np.ndarray) -> np.ndarray:
        h = (x.astype(np.uint64) + np.uint64(1)) * _ODD[0] ^ part.reshape(n, p.parts, *[1] * (x.ndim - 2))
        h = (h ^ (h >> np.uint64(32))) * _ODD[1]
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    own = key(sub)
    more = sub[:, :, None] | (1 << np.arange(p.width, dtype=np.int64))
    fresh = more != sub[:, :, None]
    probed = key(more)
    return own, probed[fresh], fresh.reshape(n, -1).sum(axis=1)


def similar_pairs(reps: DataFrame, least: float, dims: int, p: Plan) -> DataFrame:
    """(a, b, cosine) of distinct vectors of one space, a < b, found by the index. ``reps``: rep, space, v, own, more, c0 ...

    ``own`` and ``more`` are the keys of ``bucket_keys``, the c's the code. ``rep`` is a number.
    """
    code = [f"c{i}" for i in range(p.longs)]
    index = reps.select(F.col("rep").alias("b"), *[F.col(c).alias(f"b{c}") for c in code], F.explode("own").alias("k"))
    # a bucket's own vectors meet once, by their order; those one bit apart meet from one side only, marked by a negative number
    probe = reps.select("rep", *code, F.posexplode(F.concat("own", "more")).alias("pos", "k")).select(F.when(F.col("pos") < p.parts, F.col("rep")).otherwise(-F.col("rep") - 1).alias("a"), *code, "k")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"b{c}"))) for c in code), F.lit(0))
    met = probe.join(index, "k").where((apart <= p.radius) & F.when(F.col("a") >= 0, F.col("a") < F.col("b")).otherwise(-F.col("a") - 1 != F.col("b")))
    met = met.select(F.when(F.col("a") >= 0, F.col("a")).otherwise(-F.col("a") - 1).alias("a"), "b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    vectors = reps.select("rep", "v", "space")
    both = pairs.join(vectors.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("space").alias("sa")), "a").join(vectors.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("space").alias("sb")), "b").where("sa = sb")

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = _matrix(x, dims), _matrix(y, dims)
        return pd.Series(np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)))

    return both.select("a", "b", cosine("va", "vb").alias("cosine")).where(F.col("cosine") >= least)


def nearest(df: DataFrame, key: str, vector: str, space: Column, k: int = 5, least: float = 0.8, dims: int = 128, sample: int = SAMPLE) -> DataFrame:
    """(id, neighbour): for each usable vector the ``k`` most similar others of its space with a cosine of ``least`` or more."""
    rows = df.select(F.col(key).alias("id"), space.alias("space"), F.col(vector).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("space").isNotNull() & usable(F.col("v"), dims))
    # copies of one vector form a class; one row a class is enough to search, six ids a class to answer from
    members = rows.select("id", "space", F.xxhash64("space", "v").alias("h1"), F.hash("v", "space").alias("h2"), "v").groupBy("id").agg(F.min(F.struct("h1", "h2", "space", "v")).alias("x")).select("id", "x.*")
    by_class = Window.partitionBy("h1", "h2", "space").orderBy("id")
    few = members.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    p = plan(members.groupBy("space").count().agg(F.max("count")).first()[0] or 0, least)
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
    x = _matrix(fitted["v"], dims)
    rotation = learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x, p.width * p.parts)

    @F.pandas_udf("own array<bigint>, more array<bigint>, " + ", ".join(f"c{i} bigint" for i in range(p.longs)))
    def codes(values: pd.Series, spaces: pd.Series) -> pd.DataFrame:
        bits = _matrix(values, dims) @ rotation > 0
        own, more, count = bucket_keys(bits, spaces.to_numpy(np.int64), p)
        packed = np.packbits(np.pad(bits, ((0, 0), (0, 64 * p.longs - bits.shape[1]))), axis=1, bitorder="little").copy().view(np.int64)
        return pd.DataFrame({"own": list(own), "more": np.split(more, np.cumsum(count)[:-1]) if len(count) else [], **{f"c{i}": packed[:, i] for i in range(p.longs)}})

    # numbered and written once: the searches below read it several times
    reps = cut(few.where("r = 1").select("id", "space", "h1", "h2", "v").withColumn("c", codes("v", F.xxhash64("space"))).select(F.monotonically_increasing_id().alias("rep"), "id", "space", "h1", "h2", "v", "c.*"))
    found = similar_pairs(reps.drop("id", "h1", "h2"), least, dims, p)
    ways = found.select(F.col("a").alias("rep"), F.col("b").alias("other"), "cosine").unionByName(found.select(F.col("b").alias("rep"), F.col("a").alias("other"), "cosine"))
    named = reps.select("rep", F.col("id").alias("first"), "h1", "h2", "space")
    ranked = ways.join(named.select(F.col("rep").alias("other"), "first"), "other")
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "first"))).where(F.col("r") <= k).select("rep", "other", "cosine")
    own = few.select("id", "h1", "h2", "space").join(named.drop("first"), ["h1", "h2", "space"]).select("rep", "id")
    names = best.join(own.select(F.col("rep").alias("other"), "id"), "other").select("rep", "cosine", "id").unionByName(own.select("rep", F.lit(2.0).alias("cosine"), "id"))
    offers = names.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "id"))), 1, k + 1).alias("offers"))
    all_ = members.select("id", "h1", "h2", "space").join(named.drop("first"), ["h1", "h2", "space"]).select("id", "rep").join(offers, "rep")
    answer = all_.select("id", F.explode(F.slice(F.filter("offers", lambda o: o["id"] != F.col("id")), 1, k)).alias("o"))
    return answer.select("id", F.col("o.id").alias("neighbour"))
