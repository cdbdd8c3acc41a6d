"""Dyadic Count-sketches against exact quantiles."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quakeweave.llm import queries as Q
from quakeweave.llm import sketch as S

SMALL = S.SketchSpec(low=-8, high=8, bits=16, depth=5, width=256, exact=256)


def filled(values, spec=SMALL):
    return S.Bank(spec).add(values)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-8, 8), min_size=1, max_size=60), st.floats(0, 1))
def test_few_values(values, q):
    value, low, high = (x[0, 0] for x in filled(values).quantiles([q]))
    at = q * (len(values) - 1)
    near = np.sort(values)[[int(np.floor(at + 1e-9)), int(np.ceil(at - 1e-9))]]
    assert low <= value <= high and low - SMALL.step <= near[1] and near[0] <= high + SMALL.step
    assert near[0] - 2 * SMALL.step <= high and low <= near[1] + 2 * SMALL.step


@pytest.mark.parametrize("n", [500, 5_000, 50_000, 500_000])
@pytest.mark.parametrize("spec,share", [(SMALL, 0.2), (Q.SPEC, 0.06)])
def test_bounds_hold_from_hundreds_to_hundreds_of_thousands(n, spec, share):
    rng = np.random.default_rng(n)
    # Two humps with a gap between them, a tied value that a fifth of the rows have, and values outside.
    v = np.r_[rng.normal(-1, 0.3, n // 2), rng.normal(2, 1, n - n // 2 - n // 5), np.full(n // 5, 0.5)]
    v[:3] = [-1e9, 1e9, 7.99]
    qs = [0.01, 0.05, 0.25, 0.4, 0.5, 0.75, 0.95, 0.99]
    value, low, high = (x[0] for x in filled(v, spec).quantiles(qs))
    true = np.quantile(np.clip(v, spec.low, spec.high), qs)
    assert (low - spec.step <= true).all() and (true <= high + spec.step).all()
    held = np.sort(np.clip(v, spec.low, spec.high))
    span = np.searchsorted(held, high, side="left") - np.searchsorted(held, low, side="right")
    # A tied value may lie between the bounds as a whole.
    assert (span <= share * n + n // 5).all() and np.median(span) <= 1.5 * share * n


def test_counters_merge_and_delete():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 60_000), rng.normal(1, 2, 60_000)
    s = filled(a).merge(filled(b))
    assert s.n[0] == 120_000 and (s.counters == filled(np.r_[a, b]).counters).all()
    gone = s.add(b, -1)
    assert (gone.counters == filled(a).counters).all()
    assert abs(gone.quantiles([0.5])[0][0, 0] - np.median(a)) < 0.05
    _, idx, weight = S.pack_counters(gone.counters[0])
    i, w = S._unpack(idx, weight)
    assert (np.bincount(i, weights=w, minlength=SMALL.cells) == gone.counters[0]).all()


def test_other_parameters_do_not_merge():
    with pytest.raises(ValueError):
        filled([1]).merge(S.Bank(S.SketchSpec()))
    with pytest.raises(ValueError):
        S.SketchSpec(width=1000)


def test_groups_of_a_bank_do_not_mix():
    rng = np.random.default_rng(4)
    g, v = rng.integers(0, 70, 5_000), rng.normal(0, 2, 5_000)
    bank = S.Bank(SMALL, 70).update(g, SMALL.encode(v), np.ones(5_000, np.int64), step=700)
    for k in (0, 33, 69):
        assert (bank.counters[k] == filled(v[g == k]).counters[0]).all()


@pytest.mark.parametrize("task_rows", [4_000_000, 3_000])
def test_spark_sketches(spark, task_rows):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 30_000)] + [("b", 1.0), ("b", 3.0), (None, 1.0), ("c", None), ("d", float("nan")), ("e", float("inf")), ("tie", 2.0), ("tie", 2.0)]
    df = spark.createDataFrame(rows, "key string, weight double").repartition(5)
    parts = S.sketch_parts(df, {"key": F.col("key")}, F.col("weight"), SMALL, task_rows=task_rows)
    sk = S.merge_sketches(parts, SMALL, salts=3)
    assert all(r["counted"] for r in sk.select("counted").collect())
    got = {r["key"]: r for r in S.sketch_quantiles(sk, SMALL, [0.5, 1.0]).collect()}
    assert got.keys() == {"hot", "b", "e", "tie", None}
    hot = np.array([v for k, v in rows if k == "hot"])
    assert got["hot"]["n"] == 30_000
    assert got["hot"]["lower"][0] <= np.median(hot) <= got["hot"]["upper"][0]
    assert got["b"]["value"][0] == pytest.approx(2, abs=1e-3) and got["tie"]["value"][0] == pytest.approx(2, abs=1e-3)
    assert got["e"]["value"][0] == pytest.approx(8, abs=1e-3)
    # The same by asking in the stage that merges, and after merging merged ones.
    for other in (S.merge_sketches(parts, SMALL, qs=[0.5, 1.0]), S.merge_sketches(sk, SMALL, qs=[0.5, 1.0])):
        assert {r["key"]: r for r in other.collect()} == got
    whole = S.merge_sketches(sk.drop("key"), SMALL, qs=[0.5]).collect()
    assert len(whole) == 1 and whole[0]["n"] == 30_006
    assert S.build_sketches(df.limit(0), {"key": F.col("key")}, F.col("weight"), SMALL).count() == 0


def test_shorter_encoding_changes_nothing(spark):
    """A group whose parts come as counters has the counters of the group's rows."""
    rng = np.random.default_rng(5)
    v = rng.uniform(-8, 8, 40_000)
    df = spark.createDataFrame([("k", float(x)) for x in v], "key string, v double").repartition(3)
    parts = S.sketch_parts(df, {"key": F.col("key")}, F.col("v"), SMALL)
    assert {r["counted"] for r in parts.select("counted").collect()} == {True}
    _, _, idx, w = S.merge_sketches(parts, SMALL).first()
    i, w = S._unpack(bytes(idx), bytes(w))
    assert (np.bincount(i, weights=w, minlength=SMALL.cells) == filled(v).counters[0]).all()


def test_keys_hold_any_text(spark):
    df = spark.createDataFrame([("a|b", "c", 1.0), ("a", "b|c", 3.0), ("", None, 5.0), (None, "", 7.0)], "x string, y string, v double")
    got = S.sketch_quantiles(S.build_sketches(df, {"x": F.col("x"), "y": F.col("y")}, F.col("v"), SMALL), SMALL, [0.5]).collect()
    assert {(r["x"], r["y"]): round(r["value"][0]) for r in got} == {("a|b", "c"): 1, ("a", "b|c"): 3, ("", None): 5, (None, ""): 7}


def test_deletion_in_spark(spark):
    df = spark.createDataFrame([("k", 1.0, 1), ("k", 5.0, 1), ("k", 5.0, -1), ("gone", 1.0, 1), ("gone", 1.0, -1), ("n", 1.0, None)], "key string, v double, w int")
    got = S.sketch_quantiles(S.build_sketches(df, {"key": F.col("key")}, F.col("v"), SMALL, weight=F.col("w")), SMALL, [0.5]).collect()
    assert [(r["key"], r["n"], round(r["value"][0], 2)) for r in got] == [("k", 1, 1.0)]


def test_open_medians_are_settled_exactly(spark):
    rows = [("m", "1-2 sec", "PGA", "e", "2023-01", v) for v in (0.0, 1.0, 1.3, 9.0)]
    df = spark.createDataFrame(rows, "model string, band string, metric string, event_id string, period_month string, v double")
    month, band, event = ("metric_band", "m", "1-2 sec", "PGA", None, "2023-01"), ("model_band", "m", "1-2 sec", None, None, "2023-01"), ("event_model", "m", None, None, "e", None)
    schema = "summary_id bigint, stated double, " + ", ".join(f"{c} string" for c in Q.GROUP)
    open_ = spark.createDataFrame([(k, v, *g) for k, v, g in [(1, 1.04, month), (2, 1.06, month), (3, 1.26, month), (4, 1.15, event), (5, 0.0, band)]], schema)
    assert {r[0] for r in Q._exactly_wrong(df, open_).collect()} == {1, 3, 5}
    odd = df.where("v < 9")
    assert {r[0] for r in Q._exactly_wrong(odd, open_).collect()} == {3, 4, 5}
