"""Normalisation, settings and figure tables."""

import json

import pytest
from pyspark.sql import functions as F

from quakeweave.operators import figures as V
from quakeweave.operators import normalize as N
from quakeweave.plans import config as C


def test_stations_and_events(spark):
    df = spark.createDataFrame([("CI.pas ", "34.1", "-118", None, 2), ("pas", "0", "0", "ci", 1), ("nan", "1", "2", "x", 3), ("b", "bad", "2", "x", 4)], "Station string, Latitude string, Longitude string, Net string, seq int")
    got = {r["station"]: r for r in N.stations(df, order="seq").collect()}
    assert set(got) == {"PAS"} and got["PAS"]["network"] == "CI" and got["PAS"]["lat"] == 0
    assert N.stations(df).count() == 4
    with pytest.raises(ValueError):
        N.stations(df.drop("Latitude"))
    e = N.events(spark.createDataFrame([("e1", "2023-01-01T00:00:00Z", "x"), (None, "no time", "3")], "event_id string, start_utc string, mag string")).collect()
    assert e[0]["origin_time"] is not None and e[1]["origin_time"] is None and e[1]["magnitude"] == 3


def test_inventory_and_qc(spark):
    inv = spark.createDataFrame([(None, "e", "s", "z", "0.5"), ("synthetic", "e", "s", "n", None)], "role string, event string, station string, component string, delta string")
    got = {r["component"]: r for r in N.waveform_inventory(inv, fmax=1.0).collect()}
    assert got["Z"]["source"] == "observed" and got["Z"]["synthetic_max_frequency_hz"] is None and got["N"]["synthetic_max_frequency_hz"] == 1 and got["Z"]["dt"] == 0.5
    qc = N.qc_table(spark.createDataFrame([("e", "s", "true"), ("e", "s", "no")], "event_id string, station string, reject string")).collect()
    assert [r["qc_status"] for r in qc] == ["fail", "pass"] and qc[0]["metric"] == ""


def test_metric_tables(spark):
    wide = spark.createDataFrame([("e", "s", 1.0, 2.0, 8.0, 2.0), ("e", "s", None, 2.0, 8.0, 2.0)], "event_title string, station_name string, sta_lat double, sta_lon double, PGA_obs double, PGA_syn double")
    f = N.metric_field(wide, metric="PGA").collect()
    assert len(f) == 1 and f[0]["field_value"] == 2 and f[0]["field_source"] == "log2_ratio" and f[0]["model"] == "unknown"
    long = spark.createDataFrame([("m", "1-2s", None, 1.5), (None, None, None, 2.5)], "model string, passband string, residual double, log2_residual double")
    got = N.standard_metrics(long).collect()
    assert [r["residual"] for r in got] == [1.5, 2.5] and got[0]["band"] == "1-2 sec" and got[1]["band"] == "all" and got[1]["score"] is None
    p = N.picks(spark.createDataFrame([("e", "s", "p", "0.9")], "event_id string, station string, phase_type string, prob string")).first()
    assert p["phase"] == "P" and p["probability"] == 0.9 and p["component"] == "ALL"
    d = N.decisions(spark.createDataFrame([("e", "s", "Reject")], "event_id string, station string, decision string")).first()
    assert d["scope_kind"] == "full" and d["decision"] == "reject"


def test_config(tmp_path, monkeypatch):
    cfg = {"defaults": {"common": {"a": 1}, "groups": {"metrics": {"a": 2, "b": {"x": 1}}}, "commands": {"metrics.calculate": {"b": {"y": 2}}}}, "metrics": {"groups": ["amplitude"], "passbands": ["1-2", "2:4"]}, "scenarios": {"one": {"metrics": {"names": ["C5", "PSA"]}}}}
    path = tmp_path / "quakeweave.json"
    path.write_text(json.dumps(cfg))
    (tmp_path / "deep").mkdir()
    assert C.find_config(start=str(tmp_path / "deep")) == path and C.load_config(path) == cfg
    assert C.run_defaults(cfg, "metrics.calculate") == {"a": 2, "b": {"x": 1, "y": 2}} and C.dotted(cfg, "metrics.none", 5) == 5
    plan = C.MetricPlan.from_config(cfg)
    assert plan.metrics == ["PGA", "PGV", "PGD"] and plan.passbands == [(1, 2), (2, 4)] and len(plan.periods_s) == 19
    assert C.MetricPlan.from_config(C.with_scenario(cfg, "one")).metrics == ["PGA", "PSA"]
    for bad in ({"output_mode": "x"}, {"names": ["PGA"]}, {"groups": ["none"]}, {"passbands": ["2-1"]}):
        with pytest.raises(ValueError):
            C.MetricPlan.from_config(cfg, overrides=bad)
    assert C.bounds_of("Here", {"here": (0, 1, 0, 1)}) == (0, 1, 0, 1)
    assert str(C.output_path("k", {"k": "x.csv"}, root="/r")) == "/r/x.csv"


def test_figures(spark):
    df = spark.createDataFrame([("a", "g", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", "g", None)], "x string, g string, v double")
    b = V.box_statistics(df, "v", ["g"]).first()
    assert b["median"] == 3 and b["outliers"] == 1 and b["whisker_high"] == 4
    s = V.scatter(df, "x", ["v"]).collect()
    assert len(s) == 5 and {r["x_position"] for r in s} == {0}
    c = V.fitted_curves(spark.createDataFrame([("g", float(k), 2.0 * k) for k in range(5)], "g string, x double, y double"), "x", "y", ["g"]).toPandas()
    assert len(c) == 100 and c.r2.iloc[0] == pytest.approx(1)
    assert V.value_limits(df, "v", diverging=True).first()[0] == -100
    assert {r["x"]: r["n"] for r in V.counts_by(df.withColumn("x", F.when(F.col("x") == "a", F.col("x"))), "x").collect()} == {"a": 5, "unknown": 1}
    n = V.batches(spark.range(1000), 300, "id").groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("m")).orderBy("batch").collect()
    assert [(r["n"], r["m"]) for r in n] == [(300, 0), (300, 300), (300, 600), (100, 900)]
    with pytest.raises(ValueError):
        V.require(df, ["nothing"], "the table")
    m = V.availability_matrix(spark.createDataFrame([("s", "e", True, True), ("t", "e", False, True)], "station string, event_id string, observed_available boolean, synthetic_available boolean"))
    assert {r["station"]: r["e"] for r in m.collect()} == {"s": 3, "t": 2}
