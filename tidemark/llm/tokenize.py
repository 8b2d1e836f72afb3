"""Token ids of a whole corpus by a public byte-level BPE vocabulary, without a regex engine.

A batch of texts becomes one array of code points. A table gives each code point's class (letter, number, space, other);
token boundaries follow from the classes. The transition functions between classes are the identity within a run of one
class and resets at its ends, so their composition along a text, an associative scan in general, comes down to comparing
neighbours: every boundary is found in a few passes over whole arrays. The slices between boundaries are hashed by two
independent 64-bit hashes, merged once per distinct slice, and their ids are gathered back; the byte offsets of the slices
are kept, so that ids decode to the text. Slices that share the first hash but not the second are merged by their bytes.

Defined results: an empty text and a null text both give an empty list of ids.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Distinct slices whose merges a worker keeps.
CACHE = 150_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by Unicode category; white space is what the Unicode property says."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    cats = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    a = np.array(cats)
    out[a == "L"], out[a == "N"], out[a == "Z"] = LETTER, NUMBER, SPACE
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = SPACE
    return out


def boundaries(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True at each code point where a slice begins; ``starts`` are the positions where texts begin."""
    n = len(cps)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    cls = classes()[cps]
    change = first[:n].copy()
    change[1:] |= cls[1:] != cls[:-1]
    begin = change.copy()
    blank = cps == 0x20
    space = cls == SPACE
    # A run of spaces before something else gives up its last space: a blank joins what follows, another stands alone.
    run_end = space.copy()
    run_end[:-1] &= ~space[1:]
    run_end &= ~first[1 : n + 1]
    begin |= run_end
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (run_end & blank)[:-1]
    begin &= ~(after_blank & ~first[:n])
    # Contractions: an apostrophe that begins a slice takes one of s t m d, or re ve ll, with it.
    quote = np.flatnonzero((cps == 0x27) & begin)
    if len(quote):
        at = np.searchsorted(starts, quote, "right")
        limit = np.append(starts, n)[at]
        c1 = cps[np.minimum(quote + 1, n - 1)]
        c2 = cps[np.minimum(quote + 2, n - 1)]
        one = np.isin(c1, [0x73, 0x74, 0x6D, 0x64]) & (quote + 1 < limit)
        two = (((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C))) & (quote + 2 < limit)
        two &= ~one
        begin[quote[one | two] + 1] = False
        ends = np.concatenate([quote[one] + 2, quote[two] + 3])
        ends = ends[ends < n]
        begin[ends] = True
        # what follows a contraction begins anew, unless it is the blank-led slice handled above
    return begin


class Merger:
    """Byte-pair merging of single slices by a table of ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.keys = np.zeros(0, np.uint64)
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.checks = np.zeros(0, np.uint64)
        self.seen: dict[int, tuple[int, list[int]]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first; a heap of neighbours keeps long slices near linear."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        import heapq

        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a, j = parts[i], right[i]
            if a is None or j >= n or len(a) + len(parts[j]) != size:  # a pair that has changed since
                continue
            parts[i], parts[j] = a + parts[j], None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            h = left[i]
            if h >= 0 and (r := rank(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return [self.ranks[p] for p in parts if p is not None]

    def learn(self, hashes: np.ndarray, checks: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.seen) + len(pieces) > CACHE:
            self.seen.clear()
        for h, c, p in zip(hashes.tolist(), checks.tolist(), pieces):
            self.seen[h] = (c, self.merge(p))
        self.keys = np.fromiter(self.seen, np.uint64, len(self.seen))
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        values = list(self.seen.values())
        self.checks = np.fromiter((c for c, _ in values), np.uint64, len(values))[order]
        values = [values[i][1] for i in order.tolist()]
        self.offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
        self.ids = np.fromiter((x for v in values for x in v), np.int32, int(self.offsets[-1]))


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray, cut: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash, one of several, of each slice ``data[cut[i]:cut[i+1]]``: a sum over bytes of mixed (byte, distance from the start), then mixed with the length."""
    length = np.diff(cut)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(cut[:-1], length)
    table = _table(which)
    wide = place >= 64
    v = table[(np.minimum(place, 63) << 8) | data]
    if wide.any():
        w = np.flatnonzero(wide)
        x = ((place[w].astype(np.uint64) + np.uint64(which << 40)) * _MIX) ^ ((data[w].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        v[w] = x ^ (x >> np.uint64(32))
    h = np.add.reduceat(v, cut[:-1]) if len(data) else np.zeros(0, np.uint64)
    h ^= length.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


@lru_cache(2)
def _table(which: int) -> np.ndarray:
    return np.random.RandomState(7 + which).randint(0, 2**63 - 1, 64 * 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start of each text in ids, byte offsets of the slices, start of each text in slices)."""
    m = merger(path)
    joined = "".join(t for t in texts if t)
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(joined.encode("utf-8"), np.uint8)
    if not len(cps):
        zero = np.zeros(len(texts) + 1, np.int64)
        return np.zeros(0, np.int32), zero, np.zeros(1, np.int64), zero
    ends = np.cumsum(sizes)
    starts = np.unique((ends - sizes)[sizes > 0])
    begin = np.flatnonzero(boundaries(cps, starts))
    if len(data) == len(cps):
        cut = np.append(begin, len(data))
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cut = np.append(lead[begin], len(data))
    h, check = _hashes(data, cut), _hashes(data, cut, 1)
    at = np.searchsorted(m.keys, h)
    unknown = at >= len(m.keys)
    unknown[~unknown] = m.keys[at[~unknown]] != h[~unknown]
    if unknown.any():
        fresh, first = np.unique(h[unknown], return_index=True)
        where = np.flatnonzero(unknown)[first]
        raw = data.tobytes()
        before = len(m.seen)
        m.learn(fresh, check[where], [raw[cut[i] : cut[i + 1]] for i in where.tolist()])
        if len(m.seen) < before + len(fresh):  # the cache was emptied: what this batch needs is learnt again
            need, first = np.unique(h, return_index=True)
            m.learn(need, check[first], [raw[cut[i] : cut[i + 1]] for i in first.tolist()])
        at = np.searchsorted(m.keys, h)
    slice_of_text = np.searchsorted(begin, np.concatenate([[0], ends]))
    if (m.checks[at] != check).any():  # two slices of one hash: merged by their bytes
        raw, known = data.tobytes(), {}
        each = [known[p] if p in known else known.setdefault(p, m.merge(p)) for p in (raw[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()))]
        total = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        return np.fromiter((i for x in each for i in x), np.int32, int(total[-1])), total[slice_of_text], cut, slice_of_text
    count = m.offsets[at + 1] - m.offsets[at]
    total = np.concatenate([[0], np.cumsum(count)])
    pick = np.arange(total[-1]) + np.repeat(m.offsets[at] - total[:-1], count)
    return m.ids[pick], total[slice_of_text], cut, slice_of_text


def token_ids(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row's text; repeated rows are kept, other columns are not read."""
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                ids, at, _, _ = encode(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): as ``token_ids``, but only the number of ids leaves the worker."""
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                _, at, _, _ = encode(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64())], names=["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


def _slices(b: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (a longer text stands alone)."""
    n = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(n) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows] if b.num_rows else [0, 0]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield b.slice(i, j - i)


def decode(ids: list[int], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> str:
    """The text of ids; the exact inverse of encoding."""
    back = _bytes_of(os.path.join(folder, vocabulary))
    return b"".join(back[i] for i in ids).decode("utf-8")


@lru_cache(2)
def _bytes_of(path: str) -> dict[int, bytes]:
    return {i: b for b, i in merger(path).ranks.items()}
