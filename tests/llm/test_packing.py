"""Container packing: exact round trip, and optimal buckets against brute force."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeweave.llm import packing as P


def check(n, capacity):
    counts = np.bincount(n, minlength=capacity + 1)
    plan = P.plan_containers(counts, capacity)
    order = np.argsort(n, kind="stable")
    first = np.r_[True, np.diff(n[order]) > 0]
    start = np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))
    rank = np.empty(len(n), int)
    rank[order] = np.arange(len(n)) - start
    c, p, r = plan.place(n, rank)
    used = np.bincount(c, n, plan.containers)
    assert used.max() <= capacity and used.min() > 0 and c.max() == plan.containers - 1
    by = np.lexsort((p, c))
    k = np.bincount(c)
    assert (p[by] == np.arange(len(n)) - np.repeat(np.cumsum(k) - k, k)).all()
    ends = (r + n)[by]
    same = c[by][1:] == c[by][:-1]
    assert (r[by][1:][same] == ends[:-1][same]).all() and (r[by][np.r_[True, ~same]] == 0).all()
    return plan.containers


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120), st.integers(40, 64))
def test_every_item_is_placed_once(sizes, capacity):
    n = np.array(sizes)
    containers = check(n, capacity)
    assert containers <= 1.5 * -(-n.sum() // capacity) + 1


def test_room_is_nearly_full():
    n = np.minimum(2048, np.maximum(1, np.random.default_rng(1).lognormal(5.5, 1, 200_000))).astype(int)
    assert check(n, 2048) <= 1.001 * np.ceil(n.sum() / 2048) + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_buckets_are_optimal(counts, k):
    c = np.zeros(31, int)
    for n, v in counts.items():
        c[n] = v
    cost = lambda bounds: sum(v * (min(b for b in bounds if b >= n) - n) for n, v in counts.items())
    got = P.optimal_buckets(c, k)
    top = max(counts)
    best = min(cost({*x, top}) for m in range(k) for x in itertools.combinations([n for n in counts if n != top], min(m, len(counts) - 1)))
    assert len(got) <= k and cost(got) == best


def test_no_lengths():
    assert P.optimal_buckets(np.zeros(5, int), 3) == [] and P.plan_containers(np.zeros(5, int), 4).containers == 0


def test_spark(spark):
    sizes = [0, None, -3, 10, 10, 7, 3, 25, 10, 64, 1] + [10] * 400 + [4] * 300
    df = spark.createDataFrame([(k % 500, n, "x") for k, n in enumerate(sizes)], "doc_id bigint, n_tokens int, container_id string").repartition(4)
    got = P.pack(df, "doc_id", "n_tokens", 20).toPandas()
    assert len(got) == len(sizes) + 1 + 3
    none = got[got.container_id.isna()]
    assert len(none) == 3 and none.piece_tokens.eq(0).all() and none.position.isna().all()
    full = got[got.container_id.notna()]
    total = full.groupby("container_id").piece_tokens.sum()
    assert total.max() <= 20 and set(total.index) == set(range(len(total))) and full.piece_tokens.sum() == sum(n for n in sizes if n and n > 0)
    long = got[(got.piece > 0) | (got.piece_tokens == 20)]
    assert sorted(long.token_start) == [0, 0, 20, 20, 40, 60]
    for _, g in full.groupby("container_id"):
        g = g.sort_values("position")
        assert g.position.tolist() == list(range(len(g))) and g.room_start.tolist() == (g.piece_tokens.cumsum() - g.piece_tokens).tolist()
    assert P.pack(df.limit(0), "doc_id", "n_tokens", 20).count() == 0


def test_ranks_have_no_gaps(spark):
    df = spark.range(5_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 11 END AS n").repartition(6)
    got = P.ranked(df, "n").toPandas()
    assert all(sorted(g["rank"]) == list(range(len(g))) for _, g in got.groupby("n"))


def test_bucket_batches():
    c = np.zeros(101, int)
    c[[10, 50, 60]] = [20, 4, 3]
    rows = P.bucket_batches(c, [10, 60], 100)
    assert [r["containers"] for r in rows] == [2, 5] and sum(r["tokens"] for r in rows) == 580
