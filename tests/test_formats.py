"""Format detection, requests, component remapping; functions that no query calls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeweave.functions import kernels as K
from quakeweave.functions import text as X
from quakeweave.operators import figures as V
from quakeweave.operators import geometry as GE
from quakeweave.operators import proximity as P
from quakeweave.operators import qc as Q
from quakeweave.sources import formats as FM
from quakeweave.streaming import ingest


def test_sniffing():
    h5 = FM.HDF5_SIGNATURE
    assert FM.sniff([("a/x.mseed", b"")]) == "mseed" and FM.sniff([("a/x", b"000001D CIABC")]) == "mseed"
    assert FM.sniff([("x.asdf", h5)]) == "asdf" and FM.sniff([("x.h5", h5 + b"..Waveforms..")]) == "asdf"
    assert FM.sniff([("x.h5", h5)]) == "hdf5" and FM.sniff([("run/receivers.h5", h5)]) == "salvus" and FM.sniff([("meta.json", b"{}"), ("out.h5", h5)]) == "salvus"
    assert FM.sniff([("x.npz", b"PK")]) == "numpy" and FM.sniff([("x.csv", b"a,b")]) == "csv" and FM.sniff([]) == "unknown"


def test_detect_and_read(spark, tmp_path):
    np.savez(tmp_path / "one.npz", data=np.arange(6.0).reshape(3, 2), channels=["BHX", "BHY"], station="aa", sampling_rate=10.0)
    np.savez(tmp_path / "two.npz", data=np.arange(3.0), channels=["BHZ"], station="BB", sampling_rate=10.0)
    root = f"file://{tmp_path}"
    assert FM.detect_format(spark, root) == FM.Detected(root, "numpy", True, False)
    got = FM.read_synthetics(spark, root, FM.Request(stations=("AA",)))
    assert {r["channel"] for r in got.collect()} == {"BHX", "BHY"}
    assert FM.read_synthetics(spark, root, FM.Request(components=("z", "x"))).count() == 2
    with pytest.raises(ValueError):
        FM.reader_for("salvus")(spark, root)
    with pytest.raises(FileNotFoundError):
        FM.detect_format(spark, root + "/none")


def test_remap_and_rotate(spark):
    rows = [("s", "BHX", "x", 30.0, [1.0, 2.0]), ("s", "BHY", "Y", 30.0, [3.0, 4.0]), ("s", "BHZ", "Z", 30.0, [5.0, 6.0]), ("s", "BHQ", "Q", 30.0, [0.0, 0.0]), ("t", "BHX", "X", None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "station string, channel string, component string, backazimuth double, samples array<double>")
    got = FM.remap_components(df)
    assert {(r["station"], r["channel"], r["component"]): r["samples"][0] for r in got.collect()} == {("s", "BHE", "E"): 100, ("s", "BHN", "N"): 300, ("s", "BHZ", "Z"): 500, ("t", "BHE", "E"): 100}
    with pytest.raises(ValueError):
        FM.remap_components(df, scale=0)
    turned = {(r["station"], r["component"]): r["samples"] for r in FM.with_rotated(got, ["station"], "backazimuth").collect()}
    assert set(turned) == {("s", c) for c in "ENZRT"} | {("t", "E")}
    s, c = math.sin(math.radians(30)), math.cos(math.radians(30))
    assert turned["s", "R"][0] == pytest.approx(-c * 300 - s * 100) and turned["s", "T"][0] == pytest.approx(s * 300 - c * 100)


def test_convert_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert FM.convert_once(spark, f"file://{tmp_path}/out", make).count() == 3
    assert made == [1]


def test_width_to_the_opposite_edge():
    edges = P.ring_edges([-118.0, -117.5, -117.5, -118.0, -118.0], [33.0, 33.0, 34.0, 34.0, 33.0])
    width = P.haversine_np(33.5, -118.0, 33.5, -117.5)
    assert GE.opposite_width_km(edges, 33.5, -118.0, 90.0) == pytest.approx(width, rel=1e-3)
    assert GE.opposite_width_km(edges, 34.0, -117.75, 180.0) == pytest.approx(P.haversine_np(34.0, -117.75, 33.0, -117.75), rel=1e-3)
    assert math.isnan(GE.opposite_width_km(edges, 33.5, -118.0, 270.0))


def test_spectra_of_a_sine():
    dt, n = 0.01, 1_000
    x = np.sin(2 * np.pi * 5 * np.arange(n) * dt)
    p, a = K.period_spectrum(x, dt)
    assert (np.diff(p) > 0).all() and p[np.argmax(a)] == pytest.approx(0.2) and a.max() == pytest.approx(n / 2)
    assert K.at_periods(p, a, [0.2, 1e9])[0] == pytest.approx(n / 2) and np.isnan(K.at_periods(p, a, [1e9])[0])
    f, amplitude = K.plain_spectrum(x, dt)
    assert amplitude.max() == pytest.approx(0.5) and f[np.argmax(amplitude)] == pytest.approx(5)
    f, t, power = K.spectrogram(x, dt)
    assert f[np.argmax(power.mean(1))] == pytest.approx(5, abs=0.4) and power.shape == (len(f), len(t)) and t[1] - t[0] == pytest.approx(0.64)
    # A whole number of periods per segment: the power is that of the sine.
    assert (power.mean(1) * (f[1] - f[0])).sum() == pytest.approx(0.5, rel=0.02)
    name, share = K.dominant_band(f, power.mean(1), [("low", 0.1, 4.0), ("mid", 4.0, 6.0), ("high", 6.0, 50.0)])
    assert name == "mid" and share["mid"] > 0.9 and sum(share.values()) == pytest.approx(1)
    assert K.dominant_band([1.0], [0.0], [("a", 0, 2)])[0] is None
    assert K.relative_amplitude_mask([0.5, 1, 2, 4], [1.0, 10.0, 3.0, np.nan]).tolist() == [False, True, True, False]
    assert K.relative_amplitude_mask([0.5, 1, 2], [9.0, 10.0, 3.0], low=1.5).tolist() == [False, False, True]
    assert K.support_bounds(1_000, 0.01, 4, fmax=10) == (0.1, 2.5)
    assert K.log_mean([1.0, 100.0, -1.0, np.nan]) == pytest.approx(10)


def test_window_levels():
    t = np.arange(-100, 100) * 0.1
    x = np.where(t < 0, 0.1, 1.0)
    assert K.window_rms(x, t, -5, -1) == pytest.approx(0.1) and K.window_rms(x, t, 1, 5) == pytest.approx(1) and np.isnan(K.window_rms(x, t, 50, 60))
    assert K.onset_threshold(x, t) == pytest.approx(0.1) and K.onset_threshold(np.where(t < 0, 0.01, 1.0), t) == pytest.approx(0.05)


def test_figure_tables(spark):
    df = spark.createDataFrame([("b", "e", 2.0, [1.0, -4.0]), ("a", "e", 1.0, [2.0, 1.0]), ("c", "e", None, [0.0, 0.0])], "station string, event_id string, distance_km double, trace array<double>")
    got = V.record_section(df).collect()
    assert [r["station"] for r in got] == ["a", "b", "c"] and got[0]["trace"] == [1.0, 0.5] and got[1]["trace"] == [0.25, -1.0] and got[2]["trace"] is None
    pairs = spark.createDataFrame([("s", "e", True, False), ("s", "f", True, True), ("t", "e", False, False)], "station string, event_id string, observed_available boolean, synthetic_available boolean")
    m = {r["station"]: (r["e"], r["f"]) for r in V.availability_matrix(pairs).collect()}
    assert m == {"s": (1, 3), "t": (0, None)}
    spans = spark.createDataFrame([("e", "s", "observed", 0, 50), ("e", "s", "synthetic", 10, 70), ("e", "t", "observed", 0, 9)], "event_id string, station string, source string, a int, b int")
    spans = spans.select("event_id", "station", "source", F.timestamp_seconds(F.lit(1000)).alias("origin_time"), F.timestamp_seconds(F.col("a") + 1005).alias("starttime"), F.timestamp_seconds(F.col("b") + 1005).alias("endtime"))
    r = V.record_spans(spans).collect()
    assert len(r) == 1 and (r[0]["observed_start_s"], r[0]["synthetic_end_s"], r[0]["overlap_s"]) == (5, 75, 40)
    with pytest.raises(ValueError):
        V.record_spans(spans, on_missing="raise")
    with pytest.raises(ValueError):
        V.require(df, ["none"], "the table")
    lim = V.value_limits(df, "distance_km", diverging=False).first()
    assert (lim["low"], lim["high"]) == (1, 2)
    assert V.with_distance(spark.createDataFrame([(33.0, -118.0, 33.0, -118.0)], "a double, b double, c double, d double"), ("a", "b"), ("c", "d")).first()["distance_km"] == 0


def test_scope_words_and_members(spark):
    df = spark.createDataFrame([("cvms5_LABonly_SI_run",), ("plain",), (None,)], "f string")
    assert [r[0] for r in df.select(X.model_basin_scope("f")).collect()] == ["LABonly+SI", "", ""]
    t = spark.createDataFrame([("2020-01-02T03:04:05Z", "x"), ("bad", "2021-01-01"), ("", None)], "a string, b string")
    assert [str(r[0]) for r in t.select(X.origin_time("a", "b").cast("date")).collect()] == ["2020-01-02", "2021-01-01", "None"]


def test_resume_and_spectral_status(spark):
    work = spark.createDataFrame([(k, "a") for k in range(5)], "k int, x string")
    assert {r["k"] for r in Q.resume(work, work.where("k < 2").unionByName(work.where("k = 1")), ["k"]).collect()} == {2, 3, 4}
    df = spark.createDataFrame([([1.0, 9.0, 2.0, None],)], "a array<double>")
    r = df.select(Q.spectral_qc([0.01, 0.5, 1.0, 2.0], F.col("a"), F.lit(1_000), F.lit(0.01))).first()[0]
    assert [x["qc_status"] for x in r] == ["fail", "pass", "fail", "fail"]


def test_orphans_over_a_stream(spark, tmp_path):
    """Restarted with the folder of the state, a stream goes on where it was."""
    from quakeweave.operators import orphans as O

    folder, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    rows = lambda ks: spark.createDataFrame([(k, "e", f"k{k}", None) for k in ks], O.REFERENCE)
    parents = lambda s, b: s.createDataFrame([("e", f"k{b}", None, None)], O.PARENT).withColumn("since", F.timestamp_seconds(F.lit(0)))
    for b, ks in enumerate(([0, 1], [2, 3])):
        rows(ks).coalesce(1).write.mode("append").parquet(folder)
        tracker = O.OrphanTracker(spark, state)
        assert tracker.batch == b
        q = ingest.track_stream(ingest.file_stream(spark, folder, O.REFERENCE), parents, tracker, f"{tmp_path}/checkpoint")
        q.awaitTermination(120)
        assert q.exception() is None
    assert {r["row_id"] for r in O.OrphanTracker(spark, state).snapshot().collect()} == {2, 3}


def test_motion_of_a_wave_packet():
    dt = 0.01
    t = np.arange(0, 40, dt)
    w = 2 * np.pi * 2
    packet = np.exp(-(((t - 20) / 4) ** 2))
    x = packet * np.sin(w * t)
    # Slowly varying, so that integrals divide by the frequency.
    assert K.peak(x) == pytest.approx(1, abs=0.01) and K.pgv(x, dt) == pytest.approx(1 / w, rel=0.02) and K.pgd(x, dt) == pytest.approx(1 / w**2, rel=0.02)
    assert K.energy_intensity(x, dt) == pytest.approx(K.trapezoid(packet**2, dt) / 2 / w**2, rel=0.02)
    # 5 to 95 % of a Gaussian of deviation 4 / 2.
    assert K.energy_duration(x, dt) == pytest.approx(2 * 1.645 * 2, rel=0.05) and K.significant_duration(x**2, dt, 0.16, 0.84) == pytest.approx(4, rel=0.05)
    assert K.peak(np.r_[9.0, np.zeros(198), 9.0]) == 0 and K.peak([]) == 0 and np.isnan(K.significant_duration(np.zeros(5), dt))


def test_small_choices(spark, tmp_path):
    from quakeweave.operators import metrics as M
    from quakeweave.plans import config as C
    from quakeweave.sources import tables as TB
    from quakeweave.sources import waveforms as WF

    df = spark.createDataFrame([("N", "B", None, 1.0), ("N", "A", 2.0, 1.0), ("N", "A", 2.0, 1.0)], "network string, station string, x double, y double")
    assert [tuple(r) for r in WF.stations_of(df).collect()] == [("N", "A"), ("N", "B")]
    # A choice for the whole table, not for each row.
    assert [r[0] for r in df.select(M.first_existing(df, ["none", "x", "y"])).collect()] == [None, 2.0, 2.0]
    assert [r[0] for r in df.select(M.first_existing(df, ["none"], 7)).collect()] == [7, 7, 7]
    assert C.resolve_path("{root}/a", base="b", root=tmp_path) == tmp_path / "a" and C.resolve_path("a", base=tmp_path) == tmp_path / "a"
    with pytest.raises(FileNotFoundError):
        C.resolve_path("a", base=tmp_path, must_exist=True)
    registry = TB.ArtifactRegistry(tmp_path / "registry.jsonl")
    assert registry.frame(spark).count() == 0 and registry.missing() == []
    registry.record(str(tmp_path / "gone.csv"), kind="table", name="gone")
    assert registry.frame(spark).first()["name"] == "gone" and len(registry.missing()) == 1
