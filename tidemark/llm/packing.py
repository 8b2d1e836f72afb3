"""Documents into containers of a fixed capacity: sum-of-squares online packing.

Documents come one by one; each goes to the fill level whose change makes the sum of the squared numbers of partly
filled containers, by level, the least (a new container counts as level 0, a full one as none). Levels are tracked in
an array. Blocks of documents are packed apart, none larger than ``BLOCK``. What they leave partly filled goes through
the same packing again as items of its own, for at most ``TURNS`` turns: a container that even the emptiest of the others
would overfill is final and leaves, and the turns end as soon as nothing can be combined or one block held all of it.
A turn divides what can be combined by the ratio of a block to what it leaves open, so that four turns are enough for
any number of documents that can be numbered; sizes of which no two fit together end after the first.

A document longer than the capacity is cut into full pieces and a rest; no other is split. Defined results: documents
of no tokens (null or empty text) and null keys' documents get a row without a container; repeated rows are packed as
often as they come; an empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Items that one task packs. A smaller block packs with less in view; what it leaves open is packed again.
BLOCK = 50_000
#: Turns of packing what blocks left open, at most.
TURNS = 4


class Levels:
    """Open containers by fill level."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, where in it the item begins) of an item of 1..capacity."""
        c, n = self.capacity, self.count
        # the sum of squares grows by 2 n + 1 at the level gained (a full container is no level) and falls by 2 n - 1 at the level left
        best_level, best = 0, 0 if size == c else 2 * int(n[size]) + 1
        if size < c:
            here, there = n[1 : c - size + 1], n[1 + size : c + 1]
            change = 2 * there - 2 * here + 2
            change[-1] = 1 - 2 * here[-1]
            change = np.where(here > 0, change, np.iinfo(np.int64).max)
            low = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
            if here[low] > 0 and change[low] <= best:
                best_level = low + 1
        if best_level:
            box = self.open[best_level].pop()
            n[best_level] -= 1
        else:
            box = self.made
            self.made += 1
        level = best_level + size
        if level < c:
            n[level] += 1
            self.open[level].append(box)
        return box, best_level


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(container, start) of each item, in their order."""
    levels = Levels(capacity)
    return [levels.place(s) for s in sizes]


def _packed(items: DataFrame, capacity: int, blocks: int, turn: int) -> DataFrame:
    """(key, item, piece, size, box, start, fill) of ``items`` (key, item, n), packed in ``blocks`` blocks.

    ``fill`` is what the box holds in the end. Boxes are numbered by turn (4 bits), block (24 bits) and place (35 bits).
    """
    if blocks >= 1 << 24 or turn >= 8:
        raise ValueError("too many blocks to number their containers; raise block")
    fields = ("key", "item", "piece", "size", "box", "start", "fill")

    def run(key: tuple[Any, ...], t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("item", "ascending"), ("n", "ascending")]))
        n = t.column("n").to_numpy()
        levels = Levels(capacity)
        whole, rest = n // capacity, n % capacity
        row = np.repeat(np.arange(len(n)), whole + (rest > 0))
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole + (rest > 0)) - (whole + (rest > 0)), whole + (rest > 0))
        size = np.where(piece < whole[row], capacity, rest[row])
        got = np.array([levels.place(s) for s in size.tolist()], np.int64).reshape(-1, 2)
        fill = np.bincount(got[:, 0], weights=size, minlength=1).astype(np.int64)[got[:, 0]]
        box = got[:, 0] + ((turn << 59) | (int(key[0].as_py()) << 35))
        return pa.table([t.column("key").take(pa.array(row)), t.column("item").take(pa.array(row)), pa.array(piece, pa.int64()), pa.array(size, pa.int64()), pa.array(box, pa.int64()), pa.array(got[:, 1], pa.int64()), pa.array(fill, pa.int64())], names=list(fields))

    kind = items.schema["key"].dataType.simpleString()
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    return items.select("key", "item", "n", block.alias("block")).groupBy("block").applyInArrow(run, f"key {kind}, item bigint, piece bigint, size bigint, box bigint, start bigint, fill bigint")


def _blocks(items: int, block: int) -> int:
    """So many blocks that hashing leaves none of them over ``block`` items but by odds of one in a million."""
    return max(1, math.ceil(items / max(1.0, block - 5 * math.sqrt(block)))) if items > block else 1


def pack_documents(sizes: DataFrame, key: str, size: str, capacity: int, block: int = BLOCK, turns: int = TURNS) -> DataFrame:
    """(key, piece, n_tokens, container, start): one row per piece of each document of ``sizes`` (key, size)."""
    docs = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")).withColumn("item", F.monotonically_increasing_id())
    docs = cut(docs)  # item numbers must not change when a task runs again
    filled = docs.where("n > 0")
    blocks = _blocks(filled.count(), block)
    placed = cut(_packed(filled, capacity, blocks, 1))
    left = placed.where(F.col("start") == 0).where(F.col("fill") < capacity).select(F.col("box").alias("item"), F.col("fill").alias("n"))
    moves = None
    for turn in range(2, turns + 2):
        if blocks == 1:
            break
        # a container that even the emptiest of the others would overfill is final
        low = left.agg(F.min("n").alias("low")).first()["low"]
        if low is None:
            break
        open_ = left.where(F.col("n") <= capacity - low)
        many = open_.count()
        if many < 2:
            break
        blocks = _blocks(many, block)
        moved = cut(_packed(open_.withColumn("key", F.lit(0)), capacity, blocks, turn).select("item", "box", "start", "fill"))
        step = moved.select(F.col("item").alias("box"), F.col("box").alias("to"), F.col("start").alias("by"))
        if moves is not None:  # only what moved before moves again
            again = moves.join(step.select(F.col("box").alias("to"), F.col("to").alias("next"), F.col("by").alias("more")), "to", "left")
            step = again.select("box", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
        moves = step
        left = moved.where(F.col("start") == 0).where(F.col("fill") < capacity).select(F.col("box").alias("item"), F.col("fill").alias("n"))
    slim = placed.select("key", "piece", "size", "box", "start")
    if moves is not None:
        slim = slim.join(moves, "box", "left").select("key", "piece", "size", F.coalesce("to", "box").alias("box"), (F.col("start") + F.coalesce("by", F.lit(0))).alias("start"))
    none = docs.where("n <= 0").select("key", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("box"), F.lit(None).cast("bigint").alias("start"))
    return slim.unionByName(none).select(F.col("key").alias(key), F.col("piece").cast("int").alias("piece"), F.col("size").alias("n_tokens"), F.col("box").alias("container"), "start")
