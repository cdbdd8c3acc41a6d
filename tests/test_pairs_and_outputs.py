"""Numbered pair metrics, geology tables, output sets, command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeweave.__main__ import main
from quakeweave.operators import geology as GL
from quakeweave.operators import pairs as P
from quakeweave.plans import outputs as O


def sine(n=1000, dt=0.01):
    return np.sin(2 * np.pi * np.arange(n) * dt)


def test_equal_traces_score_ten():
    got = P.pair_metrics(sine(), sine(), 0.01)
    assert set(got) >= {f"C{k}" for k in range(1, 14)} | {"PSA_T1.0", "PSA_T10.0"}
    assert all(s == pytest.approx(10) for _, _, s in got.values())
    half = P.pair_metrics(2 * sine(), sine(), 0.01)
    assert half["C5"][2] == pytest.approx(5, rel=1e-3) and half["C3"][0] == pytest.approx(4 * half["C3"][1]) and half["C10"][2] == pytest.approx(10)
    assert P.score_np(1, 0) == 0 and np.isnan(P.score_np(np.nan, 1)) and P.score_np(2, 1, "anderson") == pytest.approx(10 * np.exp(-1))


def test_phase_lag():
    x = np.exp(-((np.arange(1000) * 0.01 - 5) ** 2) * 20)
    y = np.exp(-((np.arange(1000) * 0.01 - 5.3) ** 2) * 20)
    got = P.phase_lag(x, y, 0.01, 5.0, 5.3)
    assert got["lag_s"] == pytest.approx(0.3) and got["correlation"] > 0.999 and got["status"] == "pass"
    assert P.phase_lag(x, y, 0.01, np.nan, 5)["reason"] == "missing_pick"
    assert P.phase_lag(x, y, 0.01, 0.2, 5)["reason"] == "window_outside_trace"
    assert P.phase_lag(x, y, 0.01, 5, 8, max_lag_s=1)["reason"] == "lag_exceeds_limit"


def test_pair_rows(spark):
    df = spark.createDataFrame([("a", sine(300).tolist(), sine(300).tolist(), 0.01), ("b", None, [1.0], 0.01)], "k string, obs_samples array<double>, syn_samples array<double>, dt double")
    got = P.pair_metric_rows(df, ["k"]).toPandas()
    assert set(got.k) == {"a"} and got[got.code == "C5"].metric.iloc[0] == "PGA" and got[got.code == "C5"].score.iloc[0] == pytest.approx(10)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"e{e}", f"s{i}{j}", "m", "PGA", "1-2 sec", "Z", 2.0 ** (0.1 * i) * (1 + e), 1.0 + e, 33 + 0.1 * i, -118 + 0.1 * j, 33.5, -117.0 - 0.1 * e, "Basin" if i < 2 else "Mountains") for e in range(3) for i in range(4) for j in range(4)]
    return spark.createDataFrame(data, "event_id string, station string, model string, metric string, band string, component string, value_obs double, value_syn double, sta_lat double, sta_lon double, event_lat double, event_lon double, mapped_region_type string")


def test_geology(spark, rows):
    r = GL.residual_events(rows.union(rows), ["metric"], distinct=True)
    assert r.count() == 48 and abs(r.agg(F.sum("value")).first()[0]) < 1e-9
    both = GL.scaled_events(rows.withColumn("distance_km", F.lit(10.0)), ["metric"], datasets=("observed", "synthetic"), pooled=True)
    assert both.count() == 96 and abs(both.agg(F.sum("value")).first()[0]) < 1e-9
    zoned = r.join(rows.select("station", "mapped_region_type").distinct(), "station").withColumnRenamed("value", "field_centered")
    c = GL.contrast_table(zoned, GL.CONTRASTS, samples=40).collect()
    assert [x["contrast"] for x in c] == ["Basin_minus_Mountains"] and c[0]["estimate"] == pytest.approx(-0.2) and c[0]["percent_effect"] == pytest.approx((2**-0.2 - 1) * 100)
    st = zoned.groupBy("station", "mapped_region_type").agg(F.avg("field_centered").alias("v")).join(rows.select("station", F.col("sta_lat").alias("lat"), F.col("sta_lon").alias("lon")).distinct(), "station")
    t = GL.spatial_tests(st, "v", "mapped_region_type", k=3).first()
    assert t["n"] == 16 and t["p_value"] < 0.01 and t["moran_i"] > 0
    f = GL.fingerprint(rows, "event_id", "value_obs", least=3, prefix="event::")
    assert f.count() == 16 and "event::e0" in f.columns
    assert GL.select_anchors(rows, "max", column="value_obs", key="station").count() == 1 and GL.select_anchors(rows, "where", where="event_id = 'e1'").count() == 16


def test_outputs(spark, rows, tmp_path):
    t = O.metric_outputs(rows.withColumn("log2_residual", F.log2(F.col("value_obs") / F.col("value_syn"))))
    assert set(t) == {"metrics_long", "path_table", "path_summary", "model_metric_band", "station_rollup", "event_rollup", "path_hex"}
    paths = O.write_all(t, str(tmp_path))
    assert spark.read.parquet(paths["model_metric_band"]).count() == 1 and spark.read.parquet(paths["metrics_long"]).where("distance_km > 0").count() == 48
    tr = spark.createDataFrame([("f", "HNZ", sine(400).tolist(), 0.01, 100.0, 400), ("g", "HNZ", sine(400).tolist(), 0.01, 100.0, 400)], "source string, channel string, samples array<double>, dt double, sampling_rate double, npts int")
    done = spark.createDataFrame([("g", "HNZ")], "source string, channel string")
    got = O.preprocess_traces(tr, lowpass_hz=20.0, resample_hz=50.0, done=done).collect()
    assert len(got) == 1 and got[0]["npts"] == 200 and got[0]["dt"] == 0.02


def test_command_line(spark, small, capsys, tmp_path):
    assert main(["list"]) == 0 and "event_demeaned_station_bias" in capsys.readouterr().out
    assert main(["write", "station_means", small, f"{tmp_path}/o"]) == 0 and spark.read.parquet(f"{tmp_path}/o").count() > 0
    assert main(["show", "station_means", small, "--rows", "2"]) == 0 and main(["explain", "station_means", small]) == 0
