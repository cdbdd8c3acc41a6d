"""Attribute-value rows to wide tables."""

import pandas as pd
import pytest

from quakeweave.operators import eav

SCHEMA = "e string, a string, v string, t int, v__0 string, conflicts string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_types_duplicates_nulls_and_clashing_columns(spark):
    rows = [("1", "n", "5", 1), ("1", "n", "7", 2), ("1", "x", "1.5", 1), ("1", "x", "2", 1), ("2", "s", "abc", 1), ("2", None, "9", 1), (None, "n", "3", 1), ("2", "n", None, 5), ("2", "a b", "1", 1), ("2", "A-B", "2", 1)]
    wide = eav.widen(table(spark, rows), ["e"], "a", ["v"], ["t"])
    kinds = dict(wide.dtypes)
    assert kinds["n"] == "bigint" and kinds["x"] == "double" and kinds["s"] == "string"
    assert {"a_b", "a_b_2"} <= set(kinds)
    got = {r["e"]: r.asDict() for r in wide.collect()}
    assert got["1"]["n"] == 7 and got["1"]["x"] == 2.0  # latest, then the greater value
    assert got[None]["n"] == 3 and got["2"]["n"] is None
    assert got["1"]["conflicts"] == ["n", "x"] and got["2"]["conflicts"] == []
    assert got["1"]["n_rows"] == 4 and got["1"]["n_attributes"] == 2


def test_empty_table(spark):
    wide = eav.widen(table(spark, []), ["e"], "a", ["v"], ["t"])
    assert wide.columns == ["e", "n_attributes", "n_rows", "conflicts"] and wide.count() == 0


def test_resolutions_and_tolerance(spark):
    df = spark.createDataFrame([("1", "n", 10.0, 1), ("1", "n", 10.04, 2), ("1", "m", 1.0, 1), ("1", "m", -5.0, 2), ("1", "m", float("nan"), 3), ("1", "k", 1.0, 1), ("1", "k", 1.1, 2)], "e string, a string, v double, t int")
    for how, want in (("max", 10.04), ("min", 10.0), ("earliest", 10.0), ("mean", 10.02)):
        assert eav.widen(df, ["e"], "a", ["v"], ["t"], resolution=how).first()["n"] == pytest.approx(want)
    assert eav.widen(df, ["e"], "a", ["v"], ["t"], tolerance=1.005).first()["conflicts"] == ["k"]
    with pytest.raises(ValueError):
        eav.widen(df, ["e"], "a", ["v"], ["t"], resolution="any")


def test_hot_entity_equals_pandas(spark):
    n = 20_000
    pdf = pd.DataFrame({"e": ["hot" if k % 3 == 0 else str(k % 97) for k in range(n)], "a": [f"m{k % 7}" for k in range(n)], "v": [float(k % 1013) for k in range(n)], "t": range(n)})
    got = eav.widen(spark.createDataFrame(pdf), ["e"], "a", ["v"], ["t"]).toPandas().set_index("e")
    want = pdf.sort_values("t").groupby(["e", "a"])["v"].last().unstack()
    for a in want.columns:
        pd.testing.assert_series_equal(got[a].sort_index(), want[a].sort_index(), check_names=False)


def test_attributes_named_like_other_columns(spark):
    df = spark.createDataFrame([("1", "E", 1.0, 1), ("1", "conflicts", 2.0, 1), ("1", "e 2", 3.0, 1), ("1", "", 4.0, 1)], "e string, a string, v double, t int")
    wide = eav.widen(df, ["e"], "a", ["v"], ["t"])
    assert len({c.lower() for c in wide.columns}) == len(wide.columns) == 8
    r = wide.first()
    assert r["e"] == "1" and r["e_2"] == 1.0 and r["e_2_2"] == 3.0 and r["conflicts_2"] == 2.0 and r["unnamed"] == 4.0


def test_blocks_of_columns_equal_one_table(spark, monkeypatch):
    rows = [(str(k % 5) if k % 7 else None, f"m{(k * k) % 23:02d}", str(k % 11), k % 13) for k in range(600)]
    df = table(spark, rows)
    one = eav.widen(df, ["e"], "a", ["v", "t"], ["t"])
    monkeypatch.setattr(eav, "BLOCK_COLUMNS", 6)
    two = eav.widen(df, ["e"], "a", ["v", "t"], ["t"])
    assert one.columns == two.columns and one.dtypes == two.dtypes
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_thousands_of_attributes(spark):
    df = spark.range(6_000).selectExpr("CAST(id % 2 AS STRING) AS e", "concat('m', id DIV 2) AS a", "id * 1D AS v", "1 AS t")
    wide = eav.widen(df, ["e"], "a", ["v"], ["t"])
    assert len(wide.columns) == 3_004
    got = {r["e"]: r for r in wide.collect()}
    assert got["1"]["m2999"] == 5_999 and got["0"]["m7"] == 14 and got["0"]["n_attributes"] == 3_000 and got["1"]["conflicts"] == []
