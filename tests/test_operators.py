"""Metric, spatial, QC and clustering operators on small fixtures."""

import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeweave.operators import clustering as ML
from quakeweave.operators import geometry as GE
from quakeweave.operators import joins as J
from quakeweave.operators import metrics as M
from quakeweave.operators import qc as Q
from quakeweave.operators import selection as SEL
from quakeweave.operators import spatial as SP
from quakeweave.operators import workflow as W
from quakeweave.plans import analytics
from quakeweave.sources import geojson, tables, waveforms
from quakeweave.streaming import ingest


@pytest.fixture(scope="module")
def field(spark):
    rows = [(f"e{e}", f"s{i}{j}", 33 + 0.1 * i, -118 + 0.1 * j, float(e) + 0.3 * i - 0.2 * j) for e in range(4) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "event_id string, station string, lat double, lon double, field_value double").cache()


def test_centring_and_bias(spark, field):
    c = M.center_by_event(field)
    assert all(abs(r[0]) < 1e-9 for r in c.groupBy("event_id").agg(F.avg("field_centered")).select("avg(field_centered)").collect())
    assert c.groupBy().agg(F.max("event_station_count")).first()[0] == 16
    b = M.station_bias(c).toPandas()
    assert len(b) == 16 and (b.n_events == 4).all() and b.std_centered.max() < 1e-9
    single = spark.createDataFrame([("x", "a", 1.0, 1.0, 5.0)], field.schema)
    assert M.center_by_event(single).count() == 0
    kept = M.center_by_event(field, remove_mean=False).first()
    assert kept["field_z"] is None and kept["field_centered"] == kept["field_value"]


def test_summaries_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), ("a", 2.0), ("a", 4.0)], "g string, v double")
    got = {r["g"]: r for r in M.summarize(df, "v", ["g", "absent"]).collect()}
    assert got[None]["n"] == 1 and got[None]["std"] is None and got["a"]["iqr"] == 1.0
    assert M.summarize(df.limit(0), "v", ["g"]).count() == 0
    assert M.mean_over_events(df.withColumn("event_id", F.lit("e")), "v", ["g"]).count() == 2


def test_ordered_picks(spark):
    df = spark.createDataFrame([("k", None, "b", 1), ("k", "x", "a", 2), ("k", "y", None, 3)], "k string, p string, q string, o int")
    assert M.first_present(df, ["k"], ["p", "q"], "o").first()[1:] == ("x", "b")
    assert M.first_row(df, ["k"], ["o"]).first()["q"] == "b" and M.first_row(df, ["k"], ["o"], last=True).first()["p"] == "y"


def test_wide_to_long(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, 5.0, 0.0, 1.0)], "station string, PGA_obs double, PGA_syn double, PGA_score double, C2_obs double, C2_syn double")
    got = {r["metric"]: r for r in M.wide_to_long(df, ["station", "none"]).collect()}
    assert got["PGA"]["residual"] == pytest.approx(np.log10(2)) and got["PGA"]["score"] == 5 and got["C2"]["residual"] is None
    assert M.stems(df, family="legacy") == ["C2"] and M.stems(df) == ["C2", "PGA"]


def test_pairs_equal_brute_force(spark, field):
    pairs = SP.station_pairs(field, value="field_value", max_km=25.0).toPandas()
    one = field.where("event_id = 'e0'").toPandas()
    from quakeweave.operators.proximity import haversine_np

    want = sum(haversine_np(a.lat, a.lon, b.lat, b.lon) <= 25 for i, a in one.iterrows() for j, b in one.iterrows() if a.station < b.station)
    assert len(pairs) == 4 * want
    bins = SP.pair_bins(SP.station_pairs(field, value="field_value"))
    assert bins.count() == 20 and bins.agg(F.sum("pair_count")).first()[0] == 4 * 120


def test_pairs_of_lists_equal_those_of_cells(spark):
    rng = np.random.default_rng(11)
    rows = [(f"e{k % 3}" if k % 17 else None, f"s{rng.integers(30)}" if k % 19 else None, 33 + rng.random() * 3, -180 + rng.random() * 3 if k % 2 else 180 - rng.random() * 3, float(rng.normal()) if k % 13 else float("nan")) for k in range(120)]
    # One event is larger than the limit, the others are not.
    rows += [("big", f"t{k}", 33 + rng.random() * 3, -118 + rng.random() * 3, float(rng.normal())) for k in range(150)]
    df = spark.createDataFrame(rows, "event_id string, station string, lat double, lon double, field_centered double")
    lists, cells, both = (sorted(map(tuple, SP.station_pairs(df, max_km=150.0, list_rows=n).collect())) for n in (10_000, 0, 140))
    assert lists == cells == both and {"big", "e0", "e1", "e2"} == {r[0] for r in lists}


@pytest.mark.parametrize("name", ["distance_bin_semivariance", "directional_semivariance", "correlation_length"])
def test_pairs_of_events_are_not_shuffled(spark, small, name):
    # Rows for cells around a station would be repeated before a shuffle, and events be gathered more often than once.
    plan = analytics.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "own" not in plan and "explode(slice" in plan


@pytest.mark.parametrize("name", ["directional_semivariance", "correlation_length"])
def test_rows_of_pairs_are_shuffled_once_by_event(spark, small, name):
    plan = analytics.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(event_id", plan)) == 1 and not re.search(r"Exchange hashpartitioning\(event_id#\d+, station", plan)


def test_field_of_pairs_has_a_station_once(spark, small, tmp_path):
    for t in ("nation", "region", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    s = pd.read_parquet(f"{small}/supplier.parquet")
    # The same codes are listed at three positions each.
    pd.concat([s.assign(s_suppkey=s.s_suppkey + k) for k in (3007, 0, 1990)]).to_parquet(tmp_path / "supplier.parquet")
    d = str(tmp_path)
    field = analytics._pair_field(spark, d)
    assert field.count() == field.select("event_id", "station").distinct().count() > 100
    every = M.center_by_event(analytics._field(spark, d)).groupBy("event_id", "station", "lat", "lon").agg(F.avg("field_centered").alias("field_centered"))
    assert every.count() == 3 * field.count()
    ask = lambda f: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in SP.station_pairs(f, max_km=1e5).collect())
    assert ask(field) == ask(every) != []


def test_all_paths_are_made_without_a_shuffle_of_pairs(spark):
    from quakeweave.operators import joins as J

    s = spark.createDataFrame([("a", 33.0, -118.0, "x"), ("a", 33.5, -118.0, "y"), (" b", 34.0, -117.0, "z"), (None, 1.0, 1.0, "n")], "station string, lat double, lon double, event_id string")
    e = spark.createDataFrame([("e1", 33.1, -118.1, 5.0), ("e1", 33.2, -118.1, 6.0), ("e2", 34.0, -118.0, 7.0)], "event_id string, event_lat double, event_lon double, lon double")
    got = J.event_station_table(s, e)
    pairs = spark.createDataFrame([(i, k) for i in ("e1", "e2") for k in ("A", "B")], "event_id string, station string")
    want = J.event_station_table(s, e, pairs)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") == 1 and "Join LeftOuter" not in plan and "Aggregate" not in plan
    assert "RepartitionByExpression [event_id" in plan


def test_small_groups_are_listed_and_large_ones_selected(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"e{k % 97}" if k % 5 else ("big" if k % 2 else None), k % 3, float(rng.integers(9)) / 8 if k % 11 else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "e string, m int, v double")
    monkeypatch.setattr(M, "LIST_ROWS", 60)
    ask = lambda **k: sorted(map(repr, M.aggregate(df, ["e", "m"], [F.count(F.lit(1)).alias("n")], {"med": (F.col("v"), 0.5), "q3": (F.col("v"), 0.75)}, **k).collect()))
    assert ask(select_bytes=0, rows=(df, ["e"])) == ask(select_bytes=1 << 63) == ask(select_bytes=0)


def test_neighbours_widen_their_search(spark):
    rows = [(f"s{k}", 30.0 + k * k * 0.5, -118.0) for k in range(8)]
    got = SP.nearest_neighbours(spark.createDataFrame(rows, "station string, lat double, lon double"), 2, cell_km=5.0).toPandas()
    assert got.groupby("station").size().eq(2).all()
    assert set(got[got.station == "s7"].neighbour) == {"s6", "s5"}


def test_moran(spark, field):
    st = M.station_bias(M.center_by_event(field))
    r = SP.morans_i(st).first()
    assert r["n"] == 16 and 0 < r["moran_i"] <= 1.5
    t = SP.moran_test(st, permutations=19).first()
    assert t["moran_i"] == pytest.approx(r["moran_i"]) and 0 < t["p_two_sided"] <= 1
    flat = st.withColumn("mean_centered", F.lit(1.0))
    assert SP.morans_i(flat).first()["moran_i"] is None


def test_exponential_length():
    d = np.arange(5, 200, 10.0)
    fit = SP.fit_correlation_length(d, np.exp(-d / 40), np.full(len(d), 50))
    assert fit["correlation_length_km"] == pytest.approx(40, rel=1e-6)
    assert SP.fit_correlation_length(d, -np.ones(len(d)), np.full(len(d), 50))["correlation_length_km"] is None


def test_rank_tests(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 4)] + [("b", float(v)) for v in (4, 5, 6, 7, 8)] + [("c", 1.0)], "g string, v double")
    k = SP.kruskal_wallis(df, "v", "g").first()
    assert k["df"] == 1 and k["h"] == pytest.approx(5.9142857) and 0.01 < k["p_value"] < 0.02
    u = SP.mann_whitney(df, "v", "g", "a", "b").first()
    assert u["u"] == 1.0 and u["n_left"] == 5
    assert SP.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9) and SP.chi2_tail(200, 3) < 1e-40


def test_bootstrap(spark, field):
    rows = M.center_by_event(field).withColumn("zone", F.when(F.col("lat") > 33.15, F.lit("in")).otherwise(F.lit("out")))
    a, b = (SP.bootstrap_contrast(rows, "zone", ["in"], ["out"], samples=50).first() for _ in range(2))
    assert a == b and a["estimate"] == pytest.approx(0.6) and a["ci_low"] <= 0.6 + 1e-9 <= a["ci_high"] + 1e-6
    assert SP.bootstrap_contrast(rows, "zone", ["in"], ["nowhere"], samples=5).count() == 0


def test_holdout(spark, field):
    got = SP.block_holdout(field, size_km=25.0, k=3).toPandas()
    assert len(got) >= 2 and (got.rmse >= 0).all() and got.skill.notna().all()


def _held_out(pdf, size_km, k, least, least_events):
    """One fold after another, as the reference does."""
    pdf = pdf.dropna(subset=["event_id", "station", "field_value"])
    at = pdf.groupby("station")[["lat", "lon"]].mean().dropna()
    x, y = (6371.0088 * np.radians(v) for v in (at.lon * np.cos(np.radians(at.lat).mean()), at.lat))
    block = [f"bx{int(i):03d}_by{int(j):03d}" for i, j in zip((x - x.min()) // size_km, (y - y.min()) // size_km)]
    out = {}
    for f in sorted(set(block)):
        held = set(at.index[[b == f for b in block]])
        rest = pdf[~pdf.station.isin(held)].groupby("event_id").agg(m=("field_value", "mean"), n=("station", "nunique"))
        c = pdf.join(rest[rest.n >= least], on="event_id", how="inner")
        c["c"] = c.field_value - c.m
        bias = c.groupby("station").agg(v=("c", "mean"), e=("event_id", "nunique"))
        bias = bias[(bias.e >= least_events) & bias.index.isin(at.index)].v
        train = bias[~bias.index.isin(held)]
        errors = []
        for s in sorted(held & set(bias.index)):
            d = np.hypot(x[train.index] - x[s], y[train.index] - y[s]).nsmallest(k)
            w = 1 / np.maximum(d, 1e-6) ** 2
            errors.append(((w * train[d.index]).sum() / w.sum() - bias[s], train.mean() - bias[s]))
        if errors:
            out[f] = (len(errors), *np.sqrt((np.array(errors) ** 2).mean(axis=0)))
    return out


@pytest.mark.parametrize(("events", "most", "pairs"), [(60, 20, 1_000_000), (400, 5, 40)])
def test_holdout_equals_fold_by_fold_without_all_pairs(spark, monkeypatch, events, most, pairs):
    rng = np.random.default_rng(events)
    at = [(33 + rng.random(), -118 + rng.random()) for _ in range(60)]
    at[7] = (None, None)
    rows = []
    for e in range(events):
        for i in rng.choice(60, rng.integers(1, most), replace=False):
            rows += [(f"e{e}" if rng.random() > 0.02 else None, f"s{i}" if rng.random() > 0.02 else None, *at[i], float(rng.normal()) if rng.random() > 0.05 else None)] * rng.integers(1, 3)
    df = spark.createDataFrame(rows, "event_id string, station string, lat double, lon double, field_value double")
    written = []
    cut = SP.cut_lineage
    monkeypatch.setattr(SP, "cut_lineage", lambda f, *a: (lambda g: written.append(g.count()) or g)(cut(f, *a)))
    if hasattr(SP, "HOLDOUT_PAIRS"):
        monkeypatch.setitem(SP.block_holdout.__kwdefaults__, "most_pairs", pairs)
    got = {r["fold"]: (r["n_stations"], r["rmse"], r["baseline_rmse"]) for r in SP.block_holdout(df, size_km=15.0, k=3, least_stations=1).collect()}
    want = _held_out(pd.DataFrame(rows, columns=df.columns), 15.0, 3, 3, 3)
    assert len(got) > 20 and got.keys() == want.keys()
    assert all(got[f] == pytest.approx(want[f], rel=1e-9) for f in got)
    # A mean of each station in each fold is not made.
    assert most == 5 or max(written) < 60 * len(got) / 2


def test_curve_fits():
    x = np.linspace(1, 10, 50)
    assert SP.fit_curve(x, 2 + 3 / x, "inverse")["r2"] == pytest.approx(1)
    assert SP.fit_curve(x, 2 * x + 1, "best")["r2"] == pytest.approx(1)
    assert SP.fit_curve(x, np.exp(-x), "exponential")["r2"] > 0.999 and SP.fit_curve(x, np.sin(x), "lowess", frac=0.2)["r2"] > 0.9
    with pytest.raises(ValueError):
        SP.fit_curve(x, x, "none")


def test_clusters_and_modes(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"station": [f"s{k}" for k in range(40)], "lat": [0.0] * 20 + [1.0] * 20, "lon": range(40), "a": np.r_[rng.normal(0, 0.1, 20), rng.normal(5, 0.1, 20)], "b": np.r_[rng.normal(0, 0.1, 20), rng.normal(5, 0.1, 20)], "c": 1.0})
    df = spark.createDataFrame(pdf)
    got, summary = ML.kmeans_clusters(df, "station", ["a", "b", "c"], k_range=(2, 3))
    labels = {r["station"]: r["cluster"] for r in got.collect()}
    assert {labels[f"s{k}"] for k in range(20)} == {0} and {labels[f"s{k}"] for k in range(20, 40)} == {1}
    assert summary[0]["n_clusters"] == 2 and summary[0]["silhouette"] > 0.9 and summary[0]["n_features"] == 2
    scores, loadings = ML.principal_modes(df, "station", ["a", "b", "c"])
    top = loadings.where("mode = 'PC1'").toPandas()
    assert top.loading.abs().to_numpy() == pytest.approx([0.7071, 0.7071], abs=1e-3) and top.variance_ratio.iloc[0] > 0.99
    x = np.stack([pdf.a, pdf.b], 1)
    want = ML._silhouette_np((x - x.mean(0)) / x.std(0), np.r_[np.zeros(20), np.ones(20)])
    points, _ = ML.prepare_features(df, "station", ["a", "b", "c"])
    assert ML.silhouette(points.join(got, "station"), tile=7) == pytest.approx(want, rel=1e-9)


def test_kmeans_keeps_the_best_of_its_starts(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [0, 4], [4, 0], [4, 4], [20, 20]])
    xy = np.concatenate([rng.normal(c, 0.2, (12, 2)) for c in centres])
    df = spark.createDataFrame([(f"s{i}", float(i), 0.0, float(a), float(b)) for i, (a, b) in enumerate(xy)], "station string, lat double, lon double, a double, b double")
    got, summary = ML.kmeans_clusters(df, "station", ["a", "b"], k_range=(5, 5))
    z = (xy - xy.mean(0)) / xy.std(0)
    want = sum(((g - g.mean(0)) ** 2).sum() for g in z.reshape(5, 12, 2))
    assert summary[0]["inertia"] == pytest.approx(want, rel=1e-9)
    assert {r["station"]: r["cluster"] for r in got.collect()} == {f"s{i}": i // 12 for i in range(60)}
    xy = rng.random((60, 2))
    df = spark.createDataFrame([(f"s{i}", float(a), float(b)) for i, (a, b) in enumerate(xy)], "station string, a double, b double")
    once, all_ = (ML.kmeans_clusters(df, "station", ["a", "b"], k_range=(6, 6), position=None, starts=n)[1][0]["inertia"] for n in (1, 20))
    costs = [c for c, _ in ML.lloyd(ML.prepare_features(df, "station", ["a", "b"])[0], {(6, i): ML.seed_centres((xy - xy.mean(0)) / xy.std(0), 6, i) for i in range(20)}).values()]
    assert all_ <= once and all_ < np.median(costs) < max(costs)


def test_kmeans_query_tries_all_k_and_metrics(spark, small, monkeypatch):
    seen = {}
    kmeans = ML.kmeans_clusters
    monkeypatch.setattr(ML, "kmeans_clusters", lambda *a, **k: seen.setdefault("out", kmeans(*a, **k)))
    analytics.QUERIES["station_kmeans"](spark, small)
    assert [s["n_clusters"] for s in seen["out"][1]] == [2, 3, 4, 5, 6] and seen["out"][1][0]["n_features"] == 7
    assert analytics.QUERIES["pca_spatial_modes"](spark, small).select("feature").distinct().count() == 7


def test_redcap(spark):
    rows = [(f"s{k}", 33.0, -118 + 0.1 * k, 1.0 if k >= 5 else -1.0) for k in range(10)]
    got = ML.redcap(spark.createDataFrame(rows, "station string, lat double, lon double, v double"), "v", k_range=(2, 4)).toPandas().sort_values("lon")
    assert got.region.tolist() == [0] * 5 + [1] * 5 and got.n_regions.eq(2).all()
    assert ML.components({0: {1}, 1: {0}, 2: set()}) == [{0, 1}, {2}]


def _dense_graph(xy, k):
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    graph = {i: set() for i in range(len(xy))}
    for i in range(len(xy)):
        for j in np.argsort(d[i], kind="stable")[:k]:
            graph[i].add(int(j))
            graph[int(j)].add(i)
    while len(parts := ML.components(graph)) > 1:
        a = sorted(parts[0])
        b = sorted(set(range(len(xy))) - parts[0])
        i, j = np.unravel_index(d[np.ix_(a, b)].argmin(), (len(a), len(b)))
        graph[a[i]].add(b[j])
        graph[b[j]].add(a[i])
    return graph


def test_neighbour_graph_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in (0, 5, 20)])
    want = _dense_graph(xy, 2)
    blocks = ML._blocks
    monkeypatch.setattr(ML, "_blocks", lambda n: blocks(n, 7 * n))
    assert ML.neighbour_graph(xy, 2) == want and len(ML.components(want)) == 1
    grid = np.stack(np.meshgrid(np.arange(5.0), np.arange(4.0)), -1).reshape(-1, 2)
    assert ML.neighbour_graph(grid, 2) == _dense_graph(grid, 2)


def test_redcap_query_spans_networks(spark, small):
    got = analytics.QUERIES["redcap_regions"](spark, small).toPandas()
    assert got.station.is_unique and got.network.nunique() > 1
    assert got.n_regions.nunique() == 1 and got.region.nunique() == got.n_regions.iloc[0] >= 2
    assert got.groupby("region").network.nunique().max() > 1


def test_joins(spark):
    left = spark.createDataFrame([("a", None, 1.0), ("b", 5.0, None)], "k string, x double, y double")
    dim = spark.createDataFrame([("a", 9.0, "n"), ("a", 9.0, "n"), ("b", 7.0, "m")], "k string, x double, name string")
    got = {r["k"]: r for r in J.fill_from(left, dim, "k").collect()}
    assert got["a"]["x"] == 9 and got["b"]["x"] == 5 and got["a"]["name"] == "n"
    with pytest.raises(ValueError):
        J.assert_unique(dim, ["k"])
    assert "x_dim" in J.attach(left, dim, "k", "_dim").columns


def test_qc_rules(spark):
    df = spark.createDataFrame([(70.0, 80.0, True, True, 5.0), (50.0, None, False, True, None), (70.0, 80.0, True, True, 1.0)], "l double, e double, n boolean, s boolean, snr double")
    got = [r[0] for r in df.select(Q.passband_reasons(Q.global_reasons("l", "e"), noise_ok="n", signal_ok="s", snr="snr")).collect()]
    assert got == [[], ["record_too_short", "end_before_origin_plus_60s", "insufficient_noise_window"], ["low_snr"]]
    pairs = spark.createDataFrame([("observed", "e", "s", "Z", "b", "g", "m", None, "pass", ""), ("synthetic", "e", "s", "Z", "b", "g", "m", None, "fail", "x")], "source string, event_id string, station string, component string, passband string, metric_group string, metric string, period_s double, qc_status string, qc_reason string")
    assert Q.comparison_pairs(pairs).first()["retained"] is False
    assert [r[0] for r in spark.createDataFrame([(0.5,), (0.4,), (None,)], "p double").select(Q.period_supported("p", F.lit(2.0))).collect()] == [True, False, True]


def test_qc_ladder(spark):
    table = spark.createDataFrame([("observed", "e", "s", "Z", "m", "g", "x", 1.0, "fail", "a", 1), ("observed", "e", "s", "Z", "m", None, None, None, "fail", "trace", 2)], "source string, event_id string, station string, component string, model string, metric_group string, metric string, period_s double, qc_status string, qc_reason string, seq int")
    rows = spark.createDataFrame([("observed", "e", "s", "Z", "m", "g", "x", 1.0), ("observed", "e", "s", "Z", "m", "g", "y", None), ("observed", "e", "other", "Z", "m", "g", "x", 1.0)], "source string, event_id string, station string, component string, model string, metric_group string, metric string, period_s double")
    got = [(r["qc_reason"], r["qc_pass"]) for r in J.metric_qc(rows, table, order="seq").orderBy("station", "metric").collect()]
    assert got == [(None, True), ("a", False), ("trace", False)]


def test_workflow(spark):
    t = np.arange(0, 5, 0.01)
    x = np.sin(2 * np.pi * t).tolist()
    df = spark.createDataFrame([("p", (2 * np.array(x)).tolist(), x, 0.01), ("q", None, x, 0.01), ("r", [1.0, 2.0], [1.0, 2.0], 1.0)], "k string, obs_samples array<double>, syn_samples array<double>, dt double").withColumns({"period_min_s": F.lit(0.5), "period_max_s": F.lit(2.0)})
    got = W.calculate(df, ["k"], metrics=["PGA", "PSA", "original_cc"], periods=[0.5, 1.0, 9.0]).toPandas()
    p = got[got.k == "p"]
    assert p[p.metric == "PGA"].log2_residual.iloc[0] == pytest.approx(1) and p[p.metric == "original_cc"].value.iloc[0] == pytest.approx(1)
    assert p[p.metric == "PSA"].status.tolist() == ["pass", "pass", "insufficient_cycles"]
    assert set(got[got.k == "q"].status) == {"missing_waveform"} and "cutoffs" in got[got.k == "r"].status.iloc[0]
    assert W.calculate(df.limit(0), ["k"], metrics=["PGA"]).count() == 0


def test_polygons(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n, "region_type": "box"}, "geometry": {"type": "Polygon", "coordinates": [[[w, 0], [w + 1, 0], [w + 1, 1], [w, 1], [w, 0]]]}} for n, w in (("A", 0), ("B", 1))]}
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps(doc))
    polys = geojson.read_geojson(spark, str(path))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 1.0), (3, 0.5, 5.0), (4, None, 1.0)], "id int, lat double, lon double")
    got = {r["id"]: r["region_labels"] for r in GE.annotate_points(pts, polys, "lat", "lon", per_polygon=True).collect()}
    assert got == {1: "A", 2: "A;B", 3: "", 4: ""}
    paths = spark.createDataFrame([(1, 0.5, -1.0, 0.5, 0.5), (2, 0.5, 0.2, 0.5, 0.8), (3, 0.5, 0.5, 0.5, 3.0)], "id int, event_lat double, event_lon double, sta_lat double, sta_lon double")
    flag = lambda **k: {r["id"]: r["path_labels"] for r in GE.classify_paths(paths, polys, **k).collect()}
    assert flag() == {1: "A", 2: "", 3: "A;B"} and flag(direction="inward") == {1: "A", 2: "", 3: ""} and flag(relation="station_inside") == {1: "A", 2: "A", 3: ""}
    share = GE.inside_share(np.concatenate([s.edges for s in GE.shapes(polys)[:1]]), *(np.array([v]) for v in (0.5, -1.0, 0.5, 1.0)))
    assert share[0] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        geojson.select_polygons(polys, "C")
    assert geojson.select_polygons(polys, {"region_type": "box"}).count() == 2
    zones = {r["id"]: r["target_region_zone"] for r in GE.edge_zones(pts, polys, "A", "lat", "lon", edge_km=10.0).collect()}
    assert zones == {1: "target_region_interior", 2: "target_region_edge_inside", 3: "outside_target_region", 4: None}
    c = GE.boundary_corridors(spark.createDataFrame([("s", 0.5, 0.05)], "station string, lat double, lon double"), polys, "station", "lat", "lon", inside_km=20.0, outside_km=20.0)
    hit = GE.classify_by_corridors(paths, c).toPandas()
    assert 1 in set(hit.id) and hit.path_km.max() > 10


def test_selection(spark):
    df = spark.createDataFrame([("m", "PGA", "1-2s", 10.0, "x"), ("m", "pga", "2-3 sec", None, "y")], "model string, metric string, band string, distance_km double, station string")
    assert SEL.filter_metrics(df, metric="PGA", bands=["1-2 sec"]).count() == 1 and SEL.filter_metrics(df, distance_km=(0, 50)).count() == 1
    with pytest.raises(ValueError):
        SEL.spatial_subset(df.withColumn("station_regions", F.lit("A;B")), station_regions=["c"])
    tr = spark.createDataFrame([("s", "HNZ"), ("s", "BHZ"), ("s", "EHZ")], "station string, channel string")
    assert SEL.select_traces(tr, ["station"]).first()["channel"] == "BHZ"


def test_tables_and_waveforms(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for kind in ("parquet", "csv", "json"):
        assert tables.read_table(spark, tables.write_table(df, f"{tmp_path}/t.{kind}")).count() == 2
    with pytest.raises(ValueError):
        tables.write_table(df, f"{tmp_path}/t.xls")
    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b.csv").write_text("v,w\ny,2\n")
    assert set(tables.read_bundle(spark, f"{tmp_path}/[ab].csv").columns) == {"k", "v", "w", "source_path"}
    np.savez(tmp_path / "w.npz", data=np.zeros((5, 2)), channels=["HNZ", "HNE"], station="ABC", sampling_rate=20.0)
    got = waveforms.read_waveforms(spark, str(tmp_path)).toPandas()
    assert got.component.tolist() == ["Z", "E"] and got.npts.eq(5).all() and got.dt.eq(0.05).all()
    inv = tables.file_inventory(spark, str(tmp_path), dataset="d", suffixes=(".npz",)).first()
    assert len(inv["sha256"]) == 64
    reg = tables.ArtifactRegistry(f"{tmp_path}/reg.jsonl")
    reg.record(f"{tmp_path}/w.npz", kind="npz", name="w")
    reg.record(f"{tmp_path}/gone", kind="x", name="g")
    assert reg.frame(spark).count() == 2 and len(reg.missing()) == 1
    m = spark.createDataFrame([("a b", "1-2", None, 1.0)], "model string, band string, metric string, v double")
    assert tables.read_dashboard_dataset(spark, tables.write_dashboard_dataset(m, f"{tmp_path}/dash")).where("model_key = 'a_b' and metric_key = 'unknown'").count() == 1


def test_stream_is_incremental(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    df.write.mode("append").parquet(src)
    work = ingest.new_rows_only(out, ["k"])
    for _ in range(2):
        ingest.run_available(ingest.file_stream(spark, src, df.schema), work, f"{tmp_path}/ck").awaitTermination()
        df.union(spark.createDataFrame([(3, "c")], df.schema)).write.mode("append").parquet(src)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_as_of_equals_pandas(spark):
    rng = np.random.default_rng(4)
    t0 = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"k": rng.integers(0, 3, 300).astype(str), "at": t0 + pd.to_timedelta(rng.integers(0, 20 * 86400, 300), "s"), "i": range(300)})
    right = pd.DataFrame({"k": rng.integers(0, 2, 25).astype(str), "since": t0 + pd.to_timedelta(rng.choice(20 * 86400, 25, replace=False), "s"), "v": rng.random(25)})
    got = J.as_of(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "at", "since", ["v"]).toPandas().sort_values("i")
    want = pd.merge_asof(left.sort_values("at"), right.sort_values("since"), left_on="at", right_on="since", by="k").sort_values("i")
    assert len(got) == 300 and got.v.isna().any() and got.v.notna().any()
    pd.testing.assert_series_equal(got.v.reset_index(drop=True), want.v.reset_index(drop=True))
    none = spark.createDataFrame([(None, None, 1)], "k string, at timestamp, i int")
    assert J.as_of(none, spark.createDataFrame(right), ["k"], "at", "since", ["v"]).collect()[0]["v"] is None


def test_running_total(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.permutation(2000).astype(float), "n": rng.integers(1, 9, 2000)})
    got = SP.running_total(spark.createDataFrame(pdf), "x", "n", "before").toPandas().sort_values("x")
    want = pdf.sort_values("x").n.cumsum() - pdf.sort_values("x").n
    assert (got.before.to_numpy() == want.to_numpy()).all()


def test_permutations_are_bijections(spark):
    from quakeweave.operators import spatial as SP

    for n in (1, 2, 7, 40):
        rows = spark.range(n).selectExpr("id AS seat", f"{n} AS n").crossJoin(spark.range(30).selectExpr("id AS run"))
        got = {}
        for r in rows.select("seat", "run", SP.permuted("seat", "n", "run", 5).alias("to")).collect():
            got.setdefault(r["run"], {})[r["seat"]] = r["to"]
        assert all(sorted(m.values()) == list(range(n)) for m in got.values()) and got[0] == {k: k for k in range(n)}
        if n == 40:
            assert len({tuple(m[k] for k in range(n)) for m in got.values()}) == 30
            # Each seat goes to any other about equally often.
            assert sum(m[0] == 0 for m in got.values()) <= 5


def test_moran_permutation_p_value(spark):
    from quakeweave.operators import spatial as SP

    rows = [(g, f"s{k:03d}", 33 + 0.05 * (k // 8), -118 + 0.05 * (k % 8), float(k // 8) if g == "smooth" else float((k * 7919) % 13)) for g in ("smooth", "noise") for k in range(64)]
    df = spark.createDataFrame(rows, "g string, station string, lat double, lon double, v double")
    got = {r["g"]: r for r in SP.moran_by(df, ["g"], "v", k=4, permutations=99).collect()}
    assert got["smooth"]["moran_i"] > 0.6 and got["smooth"]["p_two_sided"] == 0.01 and got["noise"]["p_two_sided"] > 0.05 and got["noise"]["n"] == 64
    one = SP.moran_test(df.where("g = 'smooth'"), "v", k=4).first()
    assert one["moran_i"] == pytest.approx(got["smooth"]["moran_i"]) and one["moran_i"] == pytest.approx(SP.morans_i(df.where("g = 'smooth'"), "v", k=4).first()["moran_i"])
    flat = SP.moran_test(df.withColumn("v", F.lit(1.0)), "v", k=4).first()
    assert flat["moran_i"] is None and flat["p_two_sided"] is None


def test_bootstrap_equals_plain_resampling(spark):
    from quakeweave.operators import spatial as SP

    rng = np.random.default_rng(3)
    rows = [(f"e{e}", f"s{s}", "A" if s < 6 else "B", float(rng.normal(0.4 * (s < 6), 0.3))) for e in range(15) for s in range(12) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "event_id string, station string, zone string, field_centered double").repartition(3)
    got = SP.bootstrap_contrast(df, "zone", ["A"], ["B"], samples=200, seed=7).first()
    keys = {r[0]: r[1] for r in df.select("event_id", F.xxhash64("event_id")).distinct().collect()}
    names = sorted(keys)
    w = SP.poisson_weights(np.array([keys[e] for e in names]), 200, 7)
    assert w[:, 0].tolist() == [1] * 15 and abs(w[:, 1:].mean() - 1) < 0.1 and abs(w[:, 1:].var() - 1) < 0.2
    d = []
    for run in range(201):
        weight = dict(zip(names, w[:, run]))
        sides = {"A": [], "B": []}
        for s in sorted({r[1] for r in rows}):
            own = [(weight[r[0]], r[3], r[2]) for r in rows if r[1] == s and weight[r[0]] > 0]
            if own:
                sides[own[0][2]].append(sum(a * b for a, b, _ in own) / sum(a for a, *_ in own))
        d.append(np.mean(sides["A"]) - np.mean(sides["B"]))
    assert got["estimate"] == pytest.approx(d[0]) and got["ci_low"] == pytest.approx(np.quantile(d[1:], 0.025)) and got["ci_high"] == pytest.approx(np.quantile(d[1:], 0.975))
    assert (got["n_left"], got["n_right"], got["n_events"]) == (6, 6, 15) and got["p_value"] < 0.05
    middle = SP.bootstrap_contrast(df, "zone", ["A"], ["B"], samples=20, seed=7, statistic="median").first()
    assert abs(middle["estimate"] - d[0]) < 0.2
    both = SP.bootstrap_contrast(df.withColumn("m", F.lit("x")).unionByName(df.withColumn("m", F.lit("y"))), "zone", ["A"], ["B"], by=["m"], samples=200, seed=7).collect()
    assert {r["m"] for r in both} == {"x", "y"} and all(r["ci_low"] == pytest.approx(got["ci_low"]) for r in both)
    assert SP.bootstrap_contrast(df, "zone", ["A"], ["none"]).count() == 0


def test_two_sample_bootstrap(spark):
    from quakeweave.operators import spatial as SP

    df = spark.createDataFrame([(k, "a" if k % 2 else "b", float(k % 2) + 0.1 * (k % 7)) for k in range(400)], "row_id bigint, g string, v double")
    r = SP.bootstrap_difference(df, "v", "g", "a", "b", samples=300).first()
    assert r["estimate"] == pytest.approx(1.0, abs=0.02) and 0.9 < r["ci_low"] < r["estimate"] < r["ci_high"] < 1.1 and r["p_value"] == 0 and r["n_left"] == r["n_right"] == 200
    assert SP.bootstrap_difference(df, "v", "g", "a", "none").count() == 0


def test_pairs_and_neighbours_everywhere_on_the_globe(spark):
    from quakeweave.operators import spatial as SP
    from quakeweave.operators.proximity import haversine_np

    rng = np.random.default_rng(2)
    pos = [(f"s{k:03d}", float(rng.uniform(-10, 10)), float((180 + rng.uniform(-2, 2) + 180) % 360 - 180)) for k in range(40)] + [(f"p{k:03d}", float(rng.uniform(86, 90)), float(rng.uniform(-180, 180))) for k in range(30)]
    df = spark.createDataFrame([("e", *p, 1.0) for p in pos], "event_id string, station string, lat double, lon double, field_centered double")
    far = lambda a, b: float(haversine_np(a[1], a[2], b[1], b[2]))
    got = {(r["station"], r["station_b"]) for r in SP.station_pairs(df, max_km=300).collect()}
    assert got == {tuple(sorted((a[0], b[0]))) for i, a in enumerate(pos) for b in pos[:i] if far(a, b) <= 300}
    near = {}
    for r in SP.nearest_neighbours(df, 3).collect():
        near.setdefault(r["station"], []).append((r["rank"], r["neighbour"]))
    for a in pos:
        want = [n for _, n in sorted((round(far(a, b), 6), b[0]) for b in pos if b is not a)[:3]]
        assert [n for _, n in sorted(near[a[0]])] == want


def test_names_are_preferred_in_order(spark):
    from quakeweave.operators import normalize as N

    both = spark.createDataFrame([("A", "B", "E1", "E2", "S1", "S2", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, "N1", "N2")], "model string, simulation_model string, event_title string, event_id string, station_name string, station string, station_latitude double, lat double, longitude double, lon double, source_latitude double, log2_residual double, network_code string, station_network string")
    r = N.metric_field(both).first()
    assert (r["model"], r["event_id"], r["station"], r["lat"], r["lon"], r["event_lat"]) == ("B", "E1", "S1", 1.0, 3.0, 5.0)
    s = N.stations(both).first()
    assert (s["network"], s["station"], s["lat"], s["lon"]) == ("N2", "S2", 2.0, 4.0)
    r = N.metric_field(both.withColumn("metric", F.lit("PGA"))).first()
    assert (r["model"], r["event_id"], r["station"], r["lat"], r["lon"]) == ("A", "E2", "S2", 2.0, 4.0)
    old = spark.createDataFrame([("E", "S", 1.0, 2.0, 3.0, 4.0, 0.5)], "Event string, Station string, sta_lat double, sta_lon double, hypocenter_latitude double, hypocenter_longitude double, log2_residual double")
    r = N.metric_field(old).first()
    assert (r["event_id"], r["event_name"], r["station"], r["event_lat"], r["event_lon"]) == ("E", "E", "S", 3.0, 4.0)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000, 60_000])
def test_selected_quantiles_equal_percentile(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k % 3 if k % 5 else None, float(v), float(round(v, 1)), None if k % 4 else float(v)) for k, v in enumerate(rng.normal(0, 1, n))]
    df = spark.createDataFrame(rows, "g int, v double, ties double, some double").repartition(4)
    wanted = {f"{c}{q}": (F.col(c), q) for c in ("v", "ties", "some") for q in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)}
    for by in (["g"], []):
        one, two = (sorted(tuple(r) for r in M.aggregate(df, by, [F.count(F.lit(1)).alias("n")], wanted, select_bytes=b).fillna(-1, subset=by).collect()) for b in (10**19, 0)) if by else (sorted(tuple(r) for r in M.aggregate(df, by, [F.count(F.lit(1)).alias("n")], wanted, select_bytes=b).collect()) for b in (10**19, 0))
        assert len(one) == len(two)
        for a, b in zip(one, two):
            assert a == pytest.approx(b, nan_ok=True)


def test_a_tied_value_is_counted_where_it_is_read(spark):
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, id, 7) * 1D AS v", "'x' AS g")
    got = M.aggregate(df, ["g"], [], {"m": (F.col("v"), 0.5), "q": (F.col("v"), 0.9)}, select_bytes=0).first()
    v = [k if k % 3 == 0 else 7 for k in range(30_000)]
    assert (got["m"], got["q"]) == (np.quantile(v, 0.5), np.quantile(v, 0.9))


def test_size_of_what_a_plan_reads(spark, small):
    one = spark.read.parquet(f"{small}/lineitem.parquet")
    assert 10_000 < M.input_bytes(one.groupBy("l_suppkey").count()) < M.SELECT_BYTES
    assert M.input_bytes(one.join(one.withColumnRenamed("l_suppkey", "k"), F.col("k") == F.col("l_suppkey"))) < M.SELECT_BYTES
