"""Quantiles of very large numeric columns with dyadic Count-sketches.

A value is encoded as an integer of ``bits`` bits. For each binary resolution, from two
halves down to single codes, there is one array of signed counters: exact counts while
the resolution has few nodes, a Count-sketch below. Sketches are linear, so they are
merged by adding counters, and a value is deleted by adding it with weight -1. Ranks are
inverted by descending the levels; every quantile comes from that descent, however few or
many values a group has.

On the way between tasks, a part of a sketch is sent in the shorter of two encodings: its
counters other than zero, or the combined updates (codes with weights) from which exactly
these counters follow. Which one is taken never changes a counter, a quantile or a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each integer."""
    h = (x.astype(np.uint64) + np.uint64((salt * _PRIMES[1]) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(_PRIMES[0])
    h ^= h >> np.uint64(29)
    h *= np.uint64(_PRIMES[2])
    h ^= h >> np.uint64(32)
    h *= np.uint64(_PRIMES[1])
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class SketchSpec:
    """Parameters of a family of sketches that can be merged.

    ``low`` and ``high`` bound the values (others count as the nearest bound), ``bits`` is
    the resolution: the error of a value from encoding is at most ``(high - low) / 2**bits``.
    Levels of at most ``exact`` nodes are counted exactly; each level below is a
    Count-sketch of ``depth`` rows of ``width`` counters, a power of two.
    """

    low: float = -64.0
    high: float = 64.0
    bits: int = 24
    depth: int = 5
    width: int = 1024
    exact: int = 4096

    def __post_init__(self):
        if self.width & (self.width - 1) or not 1 <= self.bits <= 31:
            raise ValueError("width is a power of two, bits are 1 to 31")

    @property
    def step(self) -> float:
        return (self.high - self.low) / (1 << self.bits)

    @property
    def exact_levels(self) -> int:
        """Levels 1..k with 2**level nodes, counted exactly; only the finest of them is stored."""
        return min(self.bits, int(self.exact).bit_length() - 1)

    @property
    def cells(self) -> int:
        return (1 << self.exact_levels) + (self.bits - self.exact_levels) * self.depth * self.width

    def encode(self, values: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((np.asarray(values, float) - self.low) / self.step), 0, (1 << self.bits) - 1).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + (np.asarray(codes) + 0.5) * self.step

    def code_column(self, value: Column) -> Column:
        c = F.floor((value - F.lit(self.low)) / F.lit(self.step))
        return F.least(F.greatest(c, F.lit(0)), F.lit((1 << self.bits) - 1)).cast("int")

    def rows_of(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counter and sign of nodes in each row of a sketched level, with the rows as first axis."""
        w = self.width.bit_length() - 1
        per = 64 // (w + 1)
        at = (1 << self.exact_levels) + (level - self.exact_levels - 1) * self.depth * self.width
        idx, sign = np.empty((self.depth, *node.shape), np.int64), np.empty((self.depth, *node.shape))
        for row in range(self.depth):
            if row % per == 0:
                h = _mix(node, level * 64 + row)
            b = (h >> np.uint64((row % per) * (w + 1))).astype(np.int64)
            idx[row] = at + row * self.width + (b & (self.width - 1))
            sign[row] = 1 - 2 * (b >> w & 1)
        return idx, sign


def combine(idx: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add the weights of equal indices; indices with weight 0 go."""
    if not len(idx):
        return idx, weight
    order = np.argsort(idx, kind="stable")
    idx, weight = idx[order], weight[order]
    first = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
    total = np.add.reduceat(weight, first)
    keep = total != 0
    return idx[first][keep], total[keep]


class Bank:
    """Sketches of several groups, one row of counters each (whole numbers, held as doubles)."""

    def __init__(self, spec: SketchSpec, groups: int = 1):
        self.spec = spec
        self.counters = np.zeros((groups, spec.cells))

    def update(self, group: np.ndarray, codes: np.ndarray, weights: np.ndarray, step: int = 1 << 18) -> Bank:
        """Add codes with weights to their groups."""
        s, e, g = self.spec, self.spec.exact_levels, len(self.counters)
        for a in range(0, len(codes), step):
            own, c, w = group[a : a + step], codes[a : a + step], weights[a : a + step].astype(float)
            self.counters[:, : 1 << e] += np.bincount(own << e | c >> (s.bits - e), weights=w, minlength=g << e).reshape(g, -1)
            for level in range(e + 1, s.bits + 1):
                idx, sign = s.rows_of(level, c >> (s.bits - level))
                size = s.depth * s.width
                low = (1 << e) + (level - e - 1) * size
                got = np.bincount((own * size + (idx - low)).ravel(), weights=(sign * w).ravel(), minlength=g * size)
                self.counters[:, low : low + size] += got.reshape(g, -1)
        return self

    def add(self, values, weights=1, group: int = 0) -> Bank:
        """Add values to one group; a weight of -1 deletes."""
        codes = self.spec.encode(np.atleast_1d(values))
        return self.update(np.full(len(codes), group), codes, np.broadcast_to(np.asarray(weights), codes.shape))

    def merge(self, other: Bank) -> Bank:
        if other.spec != self.spec:
            raise ValueError("sketches of different parameters do not merge")
        self.counters += other.counters
        return self

    @property
    def n(self) -> np.ndarray:
        return self.counters[:, : 1 << self.spec.exact_levels].sum(1)

    def _noise(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each group and sketched level: the error of a node's estimate (in all but a thousandth of cases), and the share of counters in use."""
        s, e = self.spec, self.spec.exact_levels
        rows = self.counters[:, 1 << e :].reshape(len(self.counters), s.bits - e, s.depth, s.width)
        energy = np.median(np.einsum("gldw,gldw->gld", rows, rows), axis=2)
        used = np.count_nonzero(rows, axis=(2, 3)) / (s.depth * s.width)
        return 3.3 * 1.2533 / np.sqrt(s.depth) * np.sqrt(energy / s.width), used

    def descend(self, ranks: np.ndarray, noise: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the given ranks (groups by ranks, counted from 0), and the errors of the ranks on their way down.

        A node's estimate is the median over the rows of its level. Where few counters are
        in use and the rows agree, no other node was in the way: the chance that all of five
        rows (with at most a quarter of the counters in use), or four of them (with at most
        a tenth), are wrong by the same amount is below one in ten thousand.
        """
        s, e = self.spec, self.spec.exact_levels
        g = np.arange(len(self.counters))[:, None]
        top = np.cumsum(self.counters[:, : 1 << e], axis=1)
        node = np.stack([np.searchsorted(np.maximum.accumulate(t), r, side="right") for t, r in zip(top, ranks)]) if len(top) else np.zeros(ranks.shape, np.int64)
        node = np.minimum(node, (1 << e) - 1)
        inside = self.counters[g, node]
        below, error = top[g, node] - inside, np.zeros(ranks.shape)
        for level in range(e + 1, s.bits + 1):
            idx, sign = s.rows_of(level, 2 * node)
            rows = sign * self.counters[g[None], idx]
            got = np.median(rows, axis=0)
            agree = (rows == got).sum(0)
            share = used[:, level - e - 1, None]
            sure = ((agree == s.depth) & (share <= 0.25)) | ((agree >= max(3, s.depth - 1)) & (share <= 0.1))
            error += np.where(sure, 0.0, noise[:, level - e - 1, None] ** 2)
            left = np.clip(got, 0, np.maximum(inside, 0))
            right = ranks >= below + left
            node, inside, below = 2 * node + right, np.where(right, inside - left, left), below + np.where(right, left, 0)
        return node, np.sqrt(error)

    def quantiles(self, qs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimates, lower and upper bounds, each groups by quantiles; the mean of two ranks where a quantile lies between.

        Groups without values have NaN.
        """
        s, n, qs = self.spec, self.n[:, None], np.asarray(qs, float)[None, :]
        noise, used = self._noise()
        at = qs * np.maximum(n - 1, 0)
        a, b = np.floor(at + 1e-9), np.ceil(at - 1e-9)
        k = qs.shape[1]
        code, error = self.descend(np.c_[a, b], noise, used)
        low, high = s.decode(code[:, :k]), s.decode(code[:, k:])
        value = low + (high - low) * np.maximum(0.0, at - a)
        slack = np.maximum(error[:, :k], error[:, k:])
        # The bounds' own ways down may be less certain than that of the quantile.
        for _ in range(2):
            wide = np.where(slack > 0, slack + 1, 0)
            code, error = self.descend(np.c_[np.maximum(0, a - wide), np.minimum(n - 1, b + wide)], noise, used)
            slack = np.where(slack > 0, np.maximum(slack, np.maximum(error[:, :k], error[:, k:])), 0)
        least, most = s.decode(code[:, :k]), s.decode(code[:, k:])
        out = np.stack([value, np.minimum(least, value) - s.step / 2, np.maximum(most, value) + s.step / 2])
        out[:, self.n <= 0] = np.nan
        return out[0], out[1], out[2]


# ---------------------------------------------------------------- encodings between tasks

_PACKED = [T.StructField("counted", T.BooleanType()), T.StructField("idx", T.BinaryType()), T.StructField("weight", T.BinaryType())]


def _pack(idx: np.ndarray, weight: np.ndarray) -> tuple[bytes, bytes]:
    """Indices and weights as bytes, the weights as narrow as they can be, none at all if they are all 1."""
    if (weight == 1).all():
        return idx.astype(np.int32).tobytes(), b""
    for kind in (np.int8, np.int16, np.int32):
        if np.abs(weight).max() <= np.iinfo(kind).max:
            return idx.astype(np.int32).tobytes(), weight.astype(kind).tobytes()
    return idx.astype(np.int32).tobytes(), weight.astype(np.int64).tobytes()


def _unpack(idx: bytes, weight: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(idx, np.int32).astype(np.int64)
    if not weight:
        return i, np.ones(len(i), np.int64)
    return i, np.frombuffer(weight, f"<i{len(weight) // len(i)}").astype(np.int64)


def pack_counters(counters: np.ndarray) -> tuple[bool, bytes, bytes]:
    idx = np.flatnonzero(counters)
    return (True, *_pack(idx, np.rint(counters[idx]).astype(np.int64)))


class _Parts:
    """Parts of sketches of some groups as they come in, kept within a bounded number of bytes.

    A group's updates become counters as soon as those are shorter.
    """

    def __init__(self, spec: SketchSpec, room: int = 1 << 20):
        self.spec, self.room = spec, room
        self.dense: dict[int, np.ndarray] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = self.waiting = 0

    def updates(self, group: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
        self.held.append((group << self.spec.bits | codes, weights))
        self.rows += len(codes)
        self.waiting += len(codes)
        if self.waiting > self.room:
            self.compact()
            # If little could be combined, the next round waits for as many rows again.
            self.waiting = -self.rows if self.rows > self.room // 2 else 0

    def counters(self, group: int, idx: np.ndarray, weights: np.ndarray) -> None:
        if group not in self.dense:
            self.dense[group] = np.zeros(self.spec.cells)
        self.dense[group][idx] += weights

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combine the updates; they are returned as group, code and weight, sorted by group."""
        s = self.spec
        if not self.held:
            z = np.zeros(0, np.int64)
            return z, z, z
        joint, w = combine(*(np.concatenate(x) for x in zip(*self.held)))
        g, c = joint >> s.bits, joint & ((1 << s.bits) - 1)
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(g)])
        dense = 2 * size > s.cells
        for k in np.flatnonzero(dense):
            own = slice(first[k], first[k] + size[k])
            made = Bank(s).update(np.zeros(size[k], np.int64), c[own], w[own]).counters[0]
            at = int(g[first[k]])
            self.dense[at] = self.dense[at] + made if at in self.dense else made
        keep = np.repeat(~dense, size)
        self.held, self.rows = [(joint[keep], w[keep])], int(keep.sum())
        return g[keep], c[keep], w[keep]

    def bank(self, groups: int) -> Bank:
        out = Bank(self.spec, groups).update(*self.compact())
        for k, c in self.dense.items():
            out.counters[k] += c
        return out

    def packed(self, groups: int) -> Iterator[tuple[int, bool, bytes, bytes]]:
        """Every group in the shorter encoding, the empty ones too."""
        g, c, w = self.compact()
        start = np.searchsorted(g, np.arange(groups + 1))
        for k in range(groups):
            codes, weights = c[start[k] : start[k + 1]], w[start[k] : start[k + 1]]
            if k in self.dense:
                yield (k, *pack_counters(self.dense[k] + Bank(self.spec).update(np.zeros(len(codes), np.int64), codes, weights).counters[0]))
            else:
                yield (k, False, *_pack(codes, weights))


def _batch(keys: list[tuple], schema: pa.Schema, cols: list) -> pa.RecordBatch:
    by_key = list(zip(*keys)) if keys else [[] for _ in range(len(schema) - len(cols))]
    arrays = [pa.array(v, f.type) for v, f in zip([*by_key, *cols], schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _arrow(fields: list[T.StructField]) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in fields])


def sketch_parts(df: DataFrame, keys: dict[str, Column], value: Column, spec: SketchSpec, *, weight: Column | None = None, task_rows: int = 4_000_000) -> DataFrame:
    """Parts of one sketch per group, made by each task over its own rows: the keys (as strings), ``counted``, ``idx``, ``weight``.

    Rows with a NULL value or weight, or a NaN value, are left out. Keys group as in GROUP
    BY: NULL is a key like others. A task holds at most about ``task_rows`` updates and sends
    what it has when there are more.
    """
    names = list(keys)
    w = F.lit(1) if weight is None else weight
    base = df.select(*[k.cast("string").alias(n) for n, k in keys.items()], value.cast("double").alias("__v"), w.cast("bigint").alias("__w"))
    base = base.where(F.col("__v").isNotNull() & ~F.isnan("__v") & F.col("__w").isNotNull())
    weighted = weight is not None
    base = base.select(*names, spec.code_column(F.col("__v")).alias("__v"), *(["__w"] if weighted else []))
    fields = [T.StructField(n, T.StringType()) for n in names] + _PACKED

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        parts = _Parts(spec)
        for b in batches:
            if not b.num_rows:
                continue
            joint, words = np.zeros(b.num_rows, np.int64), []
            for k in range(len(names)):
                d = b.column(k).dictionary_encode(null_encoding="encode")
                words.append(d.dictionary.to_pylist())
                joint = joint * len(words[-1]) + d.indices.to_numpy()
            uniq, back = np.unique(joint, return_inverse=True)
            digits, rest = [], uniq
            for v in reversed(words):
                digits.append(rest % len(v))
                rest = rest // len(v)
            tuples = zip(*[[v[i] for i in d] for v, d in zip(words, reversed(digits))]) if words else [()]
            local = np.array([known.setdefault(t, len(known)) for t in tuples], np.int64)
            code = b.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.ones(len(code), np.int64) if not weighted else b.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(np.int64)
            parts.updates(local[back], code, n)
            if parts.rows > task_rows:
                yield from send(known, parts)
                known, parts = {}, _Parts(spec)
        yield from send(known, parts)

    def send(known: dict[tuple, int], parts: _Parts) -> Iterator[pa.RecordBatch]:
        groups, out, size = list(known), [], 0
        for p in parts.packed(len(groups)):
            out.append(p)
            size += len(p[2]) + len(p[3])
            if size > 1 << 22 or len(out) == 8192:
                yield _batch([groups[p[0]] for p in out], _arrow(fields), list(zip(*out))[1:])
                out, size = [], 0
        if out:
            yield _batch([groups[p[0]] for p in out], _arrow(fields), list(zip(*out))[1:])

    return base.mapInArrow(scan, T.StructType(fields))


def merge_sketches(sketches: DataFrame, spec: SketchSpec, *, salts: int = 16, qs: list[float] | None = None) -> DataFrame:
    """Add up the sketches of each group; every column besides ``counted``, ``idx`` and ``weight`` is a key.

    In two rounds, first within ``salts`` parts, so that no task has to merge all of a hot
    group. The result has one sketch per group, as counters; or with ``qs`` what
    ``sketch_quantiles`` gives, without the sketches' passing through another stage.
    """
    names = [c for c in sketches.columns if c not in ("counted", "idx", "weight")]
    keys = [T.StructField(n, T.StringType()) for n in names]

    def merge(fields: list[T.StructField], final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = _arrow(fields)
            groups: list[tuple] = []
            parts, now = _Parts(spec), None

            def close() -> Iterator[pa.RecordBatch]:
                nonlocal groups, parts
                if groups and qs is not None and final:
                    yield _asked(groups, parts.bank(len(groups)), qs, schema)
                elif groups and final:
                    packed = [pack_counters(c) for c in parts.bank(len(groups)).counters]
                    yield _batch(groups, schema, list(zip(*packed)))
                elif groups:
                    yield _batch(groups, schema, list(zip(*parts.packed(len(groups))))[1:])
                groups, parts = [], _Parts(spec)

            for b in batches:
                held: list[tuple[int, np.ndarray, np.ndarray]] = []
                cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
                for *key, part, counted, idx, w in zip(*cols):
                    if (key, part) != now:
                        # Banks of at most so many groups are filled at once.
                        if len(groups) >= 64:
                            _flush(parts, held)
                            held = []
                            yield from close()
                        groups.append(tuple(key))
                        now = (key, part)
                    i, x = _unpack(idx, w)
                    if counted:
                        parts.counters(len(groups) - 1, i, x)
                    else:
                        held.append((len(groups) - 1, i, x))
                _flush(parts, held)
            yield from close()

        return run

    packed = T.StructType([*keys, *_PACKED])
    once = sketches.withColumn("__part", F.spark_partition_id() % F.lit(salts))
    for final in (False, True):
        if final:
            once = once.withColumn("__part", F.lit(0))
        placed = once.select(*names, F.col("__part").cast("int").alias("__part"), "counted", "idx", "weight")
        by = [*names, *([] if final else ["__part"])]
        placed = (placed.repartition(*by) if by else placed.repartition(1)).sortWithinPartitions(*names, "__part")
        fields = [*keys, *(_ASKED if final and qs is not None else _PACKED)]
        once = placed.mapInArrow(merge(fields, final), T.StructType(fields) if final else packed)
    return once


def _flush(parts: _Parts, held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    if held:
        group = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
        parts.updates(group, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))


def build_sketches(df: DataFrame, keys: dict[str, Column], value: Column, spec: SketchSpec, *, weight: Column | None = None, salts: int = 16) -> DataFrame:
    """One sketch per group: the keys, ``counted``, ``idx``, ``weight``.

    Each input task makes its own sketches, so what is shuffled is at most one sketch per
    group and task and never more than the task's rows.

    Defined results: rows with a NULL value or weight, or a NaN value, are left out; a NULL
    key is a group like others; infinite values count as the bound of the spec; a group
    all of whose values were deleted has an empty sketch; an empty input gives no rows.
    """
    return merge_sketches(sketch_parts(df, keys, value, spec, weight=weight), spec, salts=salts)


_ASKED = [T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("value", "lower", "upper")]]


def _asked(groups: list[tuple], bank: Bank, qs: list[float], schema: pa.Schema) -> pa.RecordBatch:
    n = np.rint(bank.n).astype(np.int64)
    value, lower, upper = bank.quantiles(qs)
    some = np.flatnonzero(n > 0)
    return _batch([groups[k] for k in some], schema, [n[some], *[[row.tolist() for row in x[some]] for x in (value, lower, upper)]])


def sketch_quantiles(sketches: DataFrame, spec: SketchSpec, qs: list[float]) -> DataFrame:
    """The keys, ``n`` and arrays ``value``, ``lower``, ``upper`` over the quantiles ``qs``.

    The true quantile lies within the bounds but for about one case in a thousand. Groups
    without values are left out.
    """
    names = [c for c in sketches.columns if c not in ("counted", "idx", "weight")]
    fields = [*[T.StructField(n, T.StringType()) for n in names], *_ASKED]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 64):
                cols = [c.to_pylist() for c in b.slice(s, 64).columns]
                parts = _Parts(spec)
                for k, (counted, idx, w) in enumerate(zip(*cols[len(names) :])):
                    i, x = _unpack(idx, w)
                    parts.counters(k, i, x) if counted else parts.updates(np.full(len(i), k), i, x)
                groups = list(zip(*cols[: len(names)])) if names else [()] * len(cols[0])
                yield _asked(groups, parts.bank(len(groups)), qs, _arrow(fields))

    return sketches.select(*names, "counted", "idx", "weight").mapInArrow(ask, T.StructType(fields))
