"""Filling fixed-capacity containers with items (problem 7): shortest-pack-first over the length histogram."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.distributed import blocks_for


def pack_histogram(counts: dict[int, int], capacity: int, depth: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns ``(lengths, times)`` for a histogram of lengths of 1..capacity, shortest pack first.

    Lengths are placed longest first. The next item goes into the open pack with the shortest sum, that is the most
    room, if that takes it; a pattern that occurs many times takes one item each, and of one that occurs more often than
    there are items left only as many are changed. What the roomiest pack does not take opens new packs. A pack of
    ``depth`` items is closed. Work and result depend on the number of different lengths and patterns, not of items.
    """
    room: dict[int, list[list]] = defaultdict(list)  # room left -> [[lengths, times], ...]
    heap: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], times: int, r: int) -> None:
        if not r or depth and len(lengths) >= depth:
            done.append((lengths, times))
            return
        if not room[r]:
            heappush(heap, -r)
        room[r].append([lengths, times])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            most = -heap[0] if heap else 0
            if most < length:
                each = min(capacity // length, depth or capacity)
                whole, rest = divmod(left, each)
                for n, times in ((each, whole), (rest, 1)):
                    if n and times:
                        put((length,) * n, times, capacity - n * length)
                break
            lengths, times = room[most].pop()
            if times > left:
                room[most].append([lengths, times - left])
            elif not room[most]:
                heappop(heap)
            changed = min(times, left)
            put((*lengths, length), changed, most - length)
            left -= changed
    return done + [(tuple(lengths), times) for r in sorted(room) for lengths, times in room[r]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the items of each length go: sorted (length, first rank), first container and slot of each run."""
    used: dict[int, int] = defaultdict(int)
    runs, first = [], 0
    for lengths, times in patterns:
        for slot, length in enumerate(lengths):
            runs.append((length, used[length], first, slot))
            used[length] += times
        first += times
    runs.sort()
    a = np.array(runs, dtype="int64").reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack(items: DataFrame, item_id: str, size: str, capacity: int, total: int | None = None, depth: int | None = None) -> DataFrame:
    """``item_id, part_no, part_size, container_no, slot`` for every item of ``size`` 1 or more.

    An item longer than ``capacity`` is split into parts of ``capacity`` and one with the rest (``part_no`` counts
    from 0); no other item is split. Sizes that are null, 0 or negative take no room and have no row. Items with
    the same id and size are packed once each per row given: pass distinct items. The driver sees only the
    histogram of part sizes, which has at most ``capacity`` rows. ``depth`` bounds the items of a container.

    Items are numbered within their length by blocks of ids, so that a length shared by a third of all items is
    numbered by many tasks.
    """
    whole = F.col("__size") / F.lit(capacity)
    parts = (
        items.select(F.col(item_id).alias("__id"), F.col(size).cast("long").alias("__size"))
        .where(F.col("__size") > 0)
        .withColumn("part_no", F.explode(F.sequence(F.lit(0), (F.ceil(whole) - 1).cast("int"))))
        .withColumn("part_size", F.least(F.lit(capacity), F.col("__size") - F.col("part_no") * capacity).cast("int"))
        .drop("__size")
    )
    sub = blocks_for(total) if total else 64
    parts = parts.withColumn("__sub", F.pmod(F.xxhash64("__id", "part_no"), F.lit(sub)).cast("int"))
    per_block = parts.groupBy("part_size", "__sub").agg(F.count("*").alias("__n"))
    histogram = {r["part_size"]: r["n"] for r in per_block.groupBy("part_size").agg(F.sum("__n").alias("n")).collect()}
    length, rank, container, slot = _slots(pack_histogram(histogram, capacity, depth))
    before = Window.partitionBy("part_size").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select("part_size", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("part_size", "__sub").orderBy("__id", "part_no")
    numbered = parts.join(bases, ["part_size", "__sub"]).withColumn("__rank", F.col("__base") + F.row_number().over(inside) - 1)
    span = 1 << 48

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = length * span + rank
        for b in batches:
            at = np.searchsorted(starts, b["part_size"].to_numpy("int64") * span + b["__rank"].to_numpy("int64"), side="right") - 1
            yield pd.DataFrame({item_id: b["__id"], "part_no": b["part_no"], "part_size": b["part_size"], "container_no": container[at] + b["__rank"].to_numpy("int64") - rank[at], "slot": slot[at].astype("int32")})

    kind = dict(items.dtypes)[item_id]
    return numbered.select("__id", "part_no", "part_size", "__rank").mapInPandas(place, f"`{item_id}` {kind}, part_no int, part_size int, container_no bigint, slot int")
