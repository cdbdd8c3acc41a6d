"""Filling containers of fixed capacity with items of varying length.

Everything is decided on the global histogram of lengths, which has at most as many bins
as a container has room, however many items there are. Two planners work on it:

- ``optimal_buckets`` chooses length buckets of least padding by dynamic programming, and
  ``bucket_batches`` forms token-budget batches inside each of them;
- ``plan_containers`` fills containers best-fit from the longest length down, over all
  buckets, which leaves far less room unused because short items fill the room that long
  ones leave.

The plan says for each length which ranks go to which containers; items only need their
rank among the items of equal length, which is counted without gathering any length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.runtime import cut_lineage


def optimal_buckets(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    ``counts[n]`` is the number of items of length n (n >= 1). The padding of an item is the
    bound of its bucket less its length. Exact, by dynamic programming over the lengths
    that occur.
    """
    length = np.flatnonzero(counts[1:]) + 1
    if not len(length):
        return []
    c = np.r_[0.0, np.cumsum(counts[length])]
    best = length * c[1:]  # padded size of the first i + 1 lengths in one bucket
    cuts = []
    for _ in range(min(buckets, len(length)) - 1):
        # A last bucket from j + 1 to i adds its bound times its items.
        total = best[:, None] + length[None, :] * (c[1:][None, :] - c[1:][:, None])
        total[np.tril_indices(len(length))] = np.inf
        take = total.min(0)
        cuts.append(np.where(take < best, total.argmin(0), -1))
        best = np.minimum(best, take)
    out, i = [], len(length) - 1
    for cut in reversed(cuts):
        if cut[i] >= 0:
            out.append(int(length[i]))
            i = int(cut[i])
    out.append(int(length[i]))
    return sorted(out)


def bucket_batches(counts: np.ndarray, bounds: list[int], capacity: int) -> list[dict]:
    """Token-budget batches inside each bucket: items, tokens, containers and unused room of each."""
    out, low = [], 0
    for bound in bounds:
        own = np.zeros(capacity + 1, np.int64)
        own[low + 1 : bound + 1] = counts[low + 1 : bound + 1]
        plan = plan_containers(own, capacity)
        tokens = int((own * np.arange(capacity + 1)).sum())
        out.append({"bound": bound, "items": int(own.sum()), "tokens": tokens, "containers": plan.containers, "unused": plan.containers * capacity - tokens})
        low = bound
    return out


@dataclass
class Plan:
    """Sorted by length and rank: from ``rank`` on, ``per`` items of ``length`` go to each container from ``first`` on."""

    capacity: int
    containers: int
    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    per: np.ndarray
    position: np.ndarray
    room_start: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Container, position and first unit of room of each item."""
        width = np.int64(1) << 42
        k = np.searchsorted(self.length * width + self.rank, length * width + rank, side="right") - 1
        j = rank - self.rank[k]
        slot = j % self.per[k]
        return self.first[k] + j // self.per[k], self.position[k] + slot, self.room_start[k] + slot * length


def plan_containers(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit from the longest length down, on groups of containers with equal contents.

    Each item goes where the least sufficient room is left. Containers with equal contents
    are one group, so the work depends on the number of lengths, not of items.
    """
    rooms: list[int] = []  # rooms of open groups, sorted
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first container, containers, items in each)
    segments: list[tuple[int, int, int, int, int, int]] = []
    used = 0

    def keep(room: int, first: int, n: int, items: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n, items))

    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n, items = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, items = capacity, 0
                n = -(-left // (capacity // length))
                first, used = used, used + n
            per = room // length
            full = min(n, left // per)
            rest = min(per, left - full * per) if full < n else 0
            start = capacity - room
            if full:
                segments.append((length, rank, first, per, items, start))
                keep(room - per * length, first, full, items + per)
            if rest:
                segments.append((length, rank + full * per, first + full, rest, items, start))
                keep(room - rest * length, first + full, 1, items + rest)
            keep(room, first + full + bool(rest), n - full - bool(rest), items)
            rank += full * per + rest
            left -= full * per + rest
    s = np.array(sorted(segments), np.int64).reshape(-1, 6)
    return Plan(capacity, used, *s.T)


def length_histogram(pieces: DataFrame, size: str, capacity: int) -> np.ndarray:
    """Counts by length from 0 to ``capacity``; as many rows reach the driver as there are lengths."""
    out = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy(size).count().collect():
        out[r[size]] = r["count"]
    return out


def ranked(items: DataFrame, size: str) -> DataFrame:
    """The items with ``rank``, counted from 0 within each length.

    Items are numbered inside their file splits, and the counts of the splits are summed up
    by length; no length is gathered in a task. The result is written to the shared folder,
    so that a task that runs again gives the same numbers.
    """
    schema = items.schema
    at = schema.fieldNames().index(size)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1024, np.int64)
        for b in batches:
            n = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(n):
                continue
            if n.max() >= len(seen):
                seen = np.r_[seen, np.zeros(n.max() + 1 - len(seen), np.int64)]
            order = np.argsort(n, kind="stable")
            first = np.flatnonzero(np.r_[True, n[order][1:] != n[order][:-1]])
            inside = np.arange(len(n)) - np.repeat(first, np.diff(np.r_[first, len(n)]))
            own = np.empty(len(n), np.int64)
            own[order] = inside
            own += seen[n]
            seen += np.bincount(n, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=[*b.schema.names, "__own"])

    numbered = items.mapInArrow(number, T.StructType([*schema.fields, T.StructField("__own", T.LongType())])).withColumn("__part", F.spark_partition_id())
    numbered = cut_lineage(numbered, "numbered")
    # One row per split and length; a window by length adds those of the splits before.
    counts = numbered.groupBy(size, "__part").agg((F.max("__own") + 1).alias("__count"))
    before = Window.partitionBy(size).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(size, "__part", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
    return numbered.join(offsets, [size, "__part"]).withColumn("rank", F.col("__own") + F.col("__before")).drop("__own", "__before", "__part")


def cut_pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items longer than ``capacity`` cut into full pieces and a rest; others are one piece.

    Columns ``key``, ``piece``, ``token_start``, ``piece_tokens``.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0)).cast("int")
    cut = items.select(key, n.alias("__size"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * F.lit(capacity)
    return cut.select(key, "piece", start.alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("__size") - start).alias("piece_tokens"))


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Container and place of each item or piece.

    Columns: ``key``, ``piece``, ``token_start`` (of the piece in its item), ``piece_tokens``,
    ``container_id`` (from 0, without gaps), ``position`` (from 0, without gaps in a
    container) and ``room_start`` (its first unit of room). Only items longer than
    ``capacity`` are cut.

    Defined results: items of size 0 or NULL need no room and are in no container (NULL in
    the last three columns); negative sizes count as 0; repeated keys are items of their own;
    other columns are ignored; an empty table gives no rows.
    """
    base = items.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("__n"))
    pieces = ranked(cut_pieces(base, key, "__n", capacity), "piece_tokens")
    plan = plan_containers(length_histogram(pieces, "piece_tokens", capacity), capacity)
    shared = items.sparkSession.sparkContext.broadcast(plan)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("piece_tokens", "rank"))
            empty = n == 0
            where = [np.zeros(len(n), np.int64)] * 3
            if (~empty).any():
                for k, v in enumerate(shared.value.place(n[~empty], r[~empty])):
                    where[k] = np.zeros(len(n), np.int64)
                    where[k][~empty] = v
            cols = [b.column(b.schema.get_field_index(c)) for c in (key, "piece", "token_start", "piece_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*cols, *[pa.array(w, pa.int64(), mask=empty) for w in where]], names=[key, "piece", "token_start", "piece_tokens", "container_id", "position", "room_start"]
            )

    kind = items.schema[key].dataType.simpleString()
    return pieces.mapInArrow(put, f"`{key}` {kind}, piece int, token_start bigint, piece_tokens bigint, container_id bigint, position bigint, room_start bigint")
