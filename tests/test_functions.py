"""Scalar functions and signal kernels against closed forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quakeweave import runtime
from quakeweave.functions import geodesy as G
from quakeweave.functions import kernels as K
from quakeweave.functions import labels as L
from quakeweave.functions import residuals as R
from quakeweave.functions import text as X
from quakeweave.functions import traces as T


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_labels(spark):
    assert column(spark, ["1-2s", "1_2s", " 0.5 - 1 SEC", "10-20 sec", "NaN", "", None, "Broad"], "string", L.band_key) == ["1-2 sec", "1-2 sec", "0.5-1 sec", "10-20 sec", None, None, None, "broad"]
    assert column(spark, ["psa@5.0", "PSA(T=2.0)", "PSA 2.50s", "Arias Duration", "null", "pga "], "string", L.metric_key) == ["PSA", "PSA", "PSA", "ARIAS_DURATION", None, "PGA"]
    assert column(spark, ["A:b c", "a_B-C", " none ", "--"], "string", L.label_core) == ["abc", "abc", None, None]
    assert column(spark, [1.0, float("nan"), float("inf"), None], "double", L.finite) == [1.0, None, None, None]


def test_text(spark):
    assert column(spark, ["", "reject_x", "OK", "False", "maybe", None], "string", X.qc_status) == ["pass", "fail", "pass", "fail", "maybe", "pass"]
    assert column(spark, ["CI.PASC", "12345", "A1", "1234A", "", "X12"], "string", lambda c: X.station_family(F.lit("CI"), c)) == ["broadband", "strong_motion", "broadband", "strong_motion", "unknown", "strong_motion"]
    assert column(spark, ["1.5-3 sec", "3-1", "x"], "string", X.band_column_key) == ["1p5_3s", None, None]
    assert column(spark, ["1p5_3s", "bad"], "string", X.band_from_column_key) == ["1.5-3s", None]
    assert column(spark, ["1_2", "all", None, "1-2s"], "string", X.band_display) == ["1-2 sec", "All periods", "All periods", "1-2 sec"]
    assert column(spark, ["C5", "PGV", "c13"], "string", X.public_metric_name) == ["PGA", "PGV", "CAV"]
    assert column(spark, ["a;B| c", "", None], "string", lambda c: X.has_member(c, ["b"])) == [True, False, False]


def test_transforms(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 0.0), (-1.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "value_obs double, value_syn double")
    got = R.add_transforms(df).collect()
    assert got[0]["residual"] == 1 and got[0]["log2_residual"] == 1 and got[0]["ln_residual"] == pytest.approx(math.log(2))
    assert got[0]["anderson_2004_gof"] == pytest.approx(10 * math.exp(-1)) and got[0]["olsen_mayhew_gof"] == pytest.approx(100 * math.erfc(2 / 3), rel=1e-12)
    assert got[1]["residual"] == 1 and got[1]["log2_residual"] is None and got[2]["anderson_2004_gof"] is None
    assert all(got[k][t] is None for k in (3, 4) for t in R.TRANSFORMS)
    assert R.add_transforms(df, transforms="olsen_2011").first()["residual"] is None
    with pytest.raises(ValueError):
        R.transform_names(["nothing"])
    two = df.select(R.decay_score("value_obs", "value_syn"), R.wide_residual("value_obs", "value_syn")).collect()
    assert two[0][0] == pytest.approx(5) and two[0][1] == pytest.approx(math.log10(0.5)) and two[1][0] == 0


def test_geodesy(spark):
    df = spark.createDataFrame([(34.0, -118.0, 34.1, -117.8), (0.0, 0.0, 0.0, 1.0)], "event_lat double, event_lon double, sta_lat double, sta_lon double")
    a, b = G.add_path_geometry(df).collect()
    assert a["distance_km"] == pytest.approx(21.53, abs=0.1) and b["azimuth_deg"] == pytest.approx(90) and b["backazimuth_deg"] == pytest.approx(270)
    assert G.add_path_geometry(df.drop("sta_lat")).columns == ["event_lat", "event_lon", "sta_lon"]
    with pytest.raises(ValueError):
        G.add_path_geometry(df.drop("sta_lat"), required=True)
    assert G.sector_centers(45) == [0, 45, 90, 135] and G.sector_label(45, 45) == "NE-SW"


@settings(max_examples=30, deadline=None)
@given(st.integers(20, 400), st.floats(0.005, 0.1))
def test_parseval_and_simpson(n, dt):
    x = np.sin(np.arange(n) * 0.3) + 0.1
    f, a = K.fourier_spectrum(x, dt, hann=False)
    power = np.abs(np.fft.rfft(x - x.mean())) * dt
    assert a[1:-1] == pytest.approx(2 * power[1:-1]) and f[-1] <= 0.5 / dt + 1e-9
    t = np.arange(n) * dt
    assert K.simpson(t**2, dt) == pytest.approx(t[-1] ** 3 / 3, rel=1e-6)


def test_filter_response():
    for order in (3, 4):
        for kind, cutoff in (("low", 2.0), ("high", 2.0), ("band", (1.0, 3.0))):
            sos = K.butterworth(order, cutoff, 0.02, kind)
            at = np.abs(K.frequency_response(sos, np.atleast_1d(cutoff), 0.02))
            assert at == pytest.approx(math.sqrt(0.5), rel=1e-9)
    with pytest.raises(ValueError):
        K.butterworth(4, 30.0, 0.02, "low")
    t = np.arange(0, 40, 0.01)
    y, ok = K.bandpass(np.sin(2 * np.pi * t), 0.01, 0.5, 2.0)
    assert np.abs(y - np.sin(2 * np.pi * t))[1500:-1500].max() < 1e-2 and not ok[:100].any()


def test_stacks_equal_single_traces():
    x = np.random.default_rng(0).standard_normal((3, 300))
    assert K.bandpass(x, 0.05, 0.5, 2)[0][1] == pytest.approx(K.bandpass(x[1], 0.05, 0.5, 2)[0])
    assert K.response_spectrum(x, 0.05, [0.5, 1])[2] == pytest.approx(K.response_spectrum(x[2], 0.05, [0.5, 1]))


def test_response_spectrum_step():
    dt, period = 0.005, 1.0
    w, z = 2 * np.pi / period, 0.05
    t = np.arange(0, 5, dt)
    wd = w * math.sqrt(1 - z * z)
    u = -(1 - np.exp(-z * w * t) * (np.cos(wd * t) + z * w / wd * np.sin(wd * t))) / w**2
    assert K.response_spectrum(np.ones(len(t)), dt, [period])[0] == pytest.approx(w * w * np.abs(u).max(), rel=5e-3)
    assert np.isnan(K.response_spectrum(np.ones(9), dt, [0.0, -1.0])).all()


def test_sine_metrics():
    t = np.arange(0, 20, 0.01)
    x = np.sin(2 * np.pi * t)
    assert K.pga(x) == pytest.approx(1, abs=1e-3) and K.cav(x, 0.01) == pytest.approx(20 * 2 / np.pi, rel=1e-3)
    assert K.arias_intensity(x, 0.01) == pytest.approx(np.pi / (2 * 981) * 10, rel=1e-3)
    assert K.arias_duration(x, 0.01) == pytest.approx(18, abs=0.1) and np.isnan(K.arias_duration(0 * x, 0.01))
    p = np.sin(2 * np.pi * t) * np.exp(-((t - 8) ** 2))
    late = np.interp(t - 0.2, t, p)
    assert K.traveltime_delay(p, late, 0.01) == pytest.approx(-0.2) and K.delay_corrected_cc(p, late, 0.01) > 0.999
    assert np.isnan(K.cav(x, 0.01, (5, 50))) and K.cav(np.ones(101), 0.01, (0.105, 0.505)) == pytest.approx(0.4)


def test_array_reductions(spark):
    df = spark.createDataFrame([([3.0, -4.0], [1.0, 0.0], 90.0), ([0.0], [0.0], 0.0), ([], [], 0.0)], "n array<double>, e array<double>, b double")
    r, t = T.rotate_ne_to_rt("n", "e", "b")
    got = df.select(T.peak_abs("n").alias("p"), T.rms("n").alias("r"), T.correlation("n", "e").alias("c"), r.alias("rad"), t.alias("tra")).collect()
    assert got[0]["p"] == 4 and got[0]["r"] == pytest.approx(math.sqrt(12.5)) and got[0]["c"] == pytest.approx(0.6)
    assert got[0]["rad"] == pytest.approx([-1, 0]) and got[0]["tra"] == pytest.approx([3, -4])
    assert got[1]["c"] is None and got[2]["p"] is None
    back = df.withColumns({"x": r, "y": t}).select(*T.rotate_rt_to_ne("x", "y", "b")).first()
    assert back[0] == pytest.approx([3, -4]) and back[1] == pytest.approx([1, 0])


class _Cluster:
    """A session as on a cluster, without a shared folder."""

    class sparkContext:
        master, applicationId = "spark://host:7077", "app-1"

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_no_machine_local_folder_on_a_cluster(spark):
    with pytest.raises(RuntimeError):
        runtime.shared_folder(_Cluster, "step")
    assert runtime.is_local(spark)


def test_small_files_and_folders(spark):
    folder = runtime.shared_folder(spark, "files")
    assert runtime.list_folder(spark, folder) == []
    runtime.write_text(spark, f"{folder}/a", "first")
    runtime.write_text(spark, f"{folder}/a", "zweite ü")
    assert runtime.read_text(spark, f"{folder}/a") == "zweite ü"
    assert [n for n in runtime.list_folder(spark, folder) if not n.endswith(".crc")] == ["a"]
    runtime.remove_folder(spark, folder)
    assert runtime.list_folder(spark, folder) == []
    df = runtime.cut_lineage(spark.range(5), "few")
    path = df.inputFiles()[0].rsplit("/", 2)
    assert df.count() == 5 and path[1] in runtime.list_folder(spark, path[0])
    assert runtime.remove_intermediates(spark) >= 1 and path[1] not in runtime.list_folder(spark, path[0])
