"""Vector expressions and feature-hashed embeddings."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.identity import plain_text


def dot(a: Column, b: Column) -> Column:
    """Sum of products in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a missing, empty or all-zero vector or unlike lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(fits & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def decision(similarity: Column, both_preprints: Column, merge: float = 0.92, review: float = 0.84) -> Column:
    """merge, review or separate; two different preprints are never merged."""
    return F.when(both_preprints, "separate").when(similarity >= merge, "merge").when(similarity >= review, "review").otherwise("separate")


def is_valid(vector: Column, length: int) -> Column:
    """Whether a vector has ``length`` finite numbers, not all of them zero."""
    d = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(d(x)) & (F.abs(d(x)) < float("inf")))
    return F.coalesce((F.size(vector) == length) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


# What a token is, and how a token's digest of eight bytes gives its bucket (first four) and sign (fifth).
_TOKEN = re.compile(r"[a-z0-9][a-z0-9_-]{1,}|[\u4e00-\u9fff]{2,}", re.I)


def hashed_features(text: str | None, dims: int = 1024) -> list[float]:
    """Signed, log-scaled counts of tokens in hashed buckets, of length one; all zeros for a text without a token."""
    out = np.zeros(dims)
    for token, count in Counter(_TOKEN.findall(plain_text(text).casefold())).items():
        d = hashlib.blake2b(token.encode(), digest_size=8).digest()
        out[int.from_bytes(d[:4], "big") % dims] += (1 if d[4] % 2 else -1) * (1 + math.log(count))
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


def feature_hash(text: Column, dims: int = 1024) -> Column:
    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: hashed_features(t, dims))

    return run(text)
