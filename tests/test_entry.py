"""The registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry


def _rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda v: repr(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(map(tuple, df.to_numpy().tolist()))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name: entry.queries()[name](spark, small).toPandas()


def test_modes_and_regions(run):
    pca = run("pca_spatial_modes")
    by = pca.groupby("mode")
    assert np.allclose(by.loading.apply(lambda v: (v**2).sum()), 1, atol=1e-4)
    share = by.variance_ratio.first()
    assert (np.diff(share) <= 1e-9).all() and np.allclose(share.cumsum(), by.cumulative_ratio.first(), atol=1e-5) and 0 < share.sum() <= 1 + 1e-6
    regions = run("redcap_regions")
    n = regions.n_regions.iloc[0]
    assert (regions.n_regions == n).all() and set(regions.region) == set(range(n)) and regions.station.is_unique
    k = run("station_kmeans")
    assert k.station.is_unique and k.cluster.nunique() >= 2


def test_correlation_and_zone_tests(run):
    fit = run("correlation_length").iloc[0]
    assert fit.method in ("none", "log_linear", "exponential")
    assert fit.method == "none" or fit.effective_range_km == pytest.approx(-math.log(0.05) * fit.correlation_length_km, rel=1e-4)
    tests = run("zone_tests_by_metric")
    assert tests.p_value.dropna().between(0, 1).all() and {"moran_i"} <= set(tests.test) and (tests[tests.test == "moran_i"].groupby("metric").size() == 1).all()
    boot = run("two_sample_bootstrap")
    assert len(boot) == 7 and (boot.ci_low <= boot.estimate).all() and (boot.estimate <= boot.ci_high).all()
    effects = run("contrast_effects")
    assert np.allclose(effects.percent_effect, (2**effects.estimate - 1) * 100, atol=1e-3) and (effects.ci_excludes_zero == ((effects.ci_low > 0) | (effects.ci_high < 0))).all()


def test_trace_tables(run, spark, small):
    traces = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 2 = 0").toPandas()
    own = {k: np.array(v, float) for k, v in zip(traces.vec_id, traces.embedding)}
    m = run("trace_metrics").set_index("pair_id")
    assert 0 < len(m) <= len(own)
    for k, r in m.iterrows():
        x = own[k]
        edge = int(0.01 * len(x))
        assert r.PGA == pytest.approx(np.abs(x[edge : len(x) - edge]).max(), abs=1e-5)
        assert 0 < r.arias_duration < len(x) * 0.05 and 0 < r.energy_duration < len(x) * 0.05 and r.CAV <= np.abs(x).max() * len(x) * 0.05
    rows = run("metric_rows_from_waveforms")
    # Two durations, three amplitudes, three intensities, three comparisons, two spectra at three periods.
    assert (rows.groupby("pair_id").size() == 2 + 3 + 3 + 3 + 2 * 3).all() and rows.pair_id.nunique() == len(m)
    # Registered queries round to six digits, which is too coarse for ratios of the smallest values.
    good = rows[(rows.status == "pass") & (rows.value_obs > 0.05) & (rows.value_syn > 0.05)]
    assert len(good) and np.allclose(good.log2_residual, np.log2(good.value_obs / good.value_syn), atol=1e-3)
    q = run("trace_quality")
    assert np.allclose(q.record_length_s, [len(own[k]) * 0.05 for k in q.pair_id]) and set(q.qc_status) <= {"pass", "fail"} and ((q.qc_reason == "") == (q.qc_status == "pass")).all()
    f = run("filtered_traces").set_index("pair_id")
    # A filter adds no energy, and half the rate leaves half the samples.
    level = pd.Series({k: np.sqrt((own[k] ** 2).mean()) for k in f.index})
    assert (f.lowpassed_rms <= level * 1.2).all() and (f.n_resampled * 2 - f.n).abs().max() <= 1 and (f.n_bandpassed == f.n).all()
    s = run("spectral_quality")
    assert (s[s.period_s > f.n.max() * 0.05 / 3].qc_status == "fail").all() and (s.psa.dropna() > 0).all()
    p = run("trace_pairs")
    assert p.original_cc.between(-1, 1).all() and (p.delay_corrected_cc.dropna() <= 1 + 1e-9).all()
    g = run("trace_spectrogram")
    assert (g.n == len(m)).all() and (g.mean_power >= 0).all() and g.period_s.max() == pytest.approx(32 * 0.05)


def test_wide_table_holds_all_rows(run, spark, small):
    wide = run("p3_wide")
    cells = run("p3_cells")
    assert wide.n_rows.sum() == cells.drop_duplicates(["event_id", "station", "component", "model", "band"]).n_rows.sum()
    assert (wide.conflicts.map(len) <= wide.n_attributes).all() and not wide.duplicated(["event_id", "station", "component", "model", "band"]).any()


def test_corridors_hold_their_events(run):
    c = run("corridor_events")
    assert c.corridor_id.is_unique and (c.n_events > 0).all()
    paths = run("boundary_corridor_paths")
    assert paths.corridor_id.is_unique and (paths.mean_path_km >= 1).all()
