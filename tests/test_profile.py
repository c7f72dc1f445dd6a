import numpy as np
import pandas as pd
import pytest

from tablewise.operators import profile as P


@pytest.fixture()
def mixed(spark):
    rows = [(i, float(i % 7), "abc"[i % 3], "yes" if i % 2 else "no", f"id{i}") for i in range(120)]
    return spark.createDataFrame(rows, "k long, x double, cat string, flag string, name string")


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.lognormal(size=300), "b": rng.integers(0, 9, 300).astype(float)})
    pdf.loc[::13, "a"] = np.nan
    got = P.describe(spark.createDataFrame(pdf)).toPandas().set_index("column")
    exp = pdf.describe().round(4).T
    for c in ("a", "b"):
        assert got.loc[c, "count"] == exp.loc[c, "count"]
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert got.loc[c, ours] == pytest.approx(exp.loc[c, theirs], abs=1e-4)


def test_skew_kurtosis_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.exponential(size=500), "c": np.full(500, 2.0)})
    got = P.skew_kurtosis(spark.createDataFrame(pdf)).toPandas().set_index("column")
    assert got.loc["a", "skewness"] == pytest.approx(round(pdf.a.skew(), 4), abs=1e-4)
    assert got.loc["a", "kurtosis"] == pytest.approx(round(pdf.a.kurtosis(), 4), abs=1e-4)
    assert got.loc["c", "skewness"] == 0.0 and got.loc["c", "kurtosis"] == 0.0


def test_column_types_precedence(spark, mixed):
    types = {r.column: r.type for r in P.column_types(mixed).collect()}
    assert types == {"k": "numerical", "x": "numerical", "cat": "categorical", "flag": "boolean", "name": "high_cardinality"}


def test_two_valued_numeric_is_boolean_and_all_null_text_categorical(spark):
    df = spark.createDataFrame([(0, None), (1, None), (0, None)], "q int, t string")
    types = {r.column: r.type for r in P.column_types(df).collect()}
    assert types == {"q": "boolean", "t": "categorical"}


def test_categorical_profile_and_top_values(spark, mixed):
    prof = {r.column: r for r in P.categorical_profile(mixed).collect()}
    assert prof["cat"].unique == 3 and prof["cat"].top_value == "a" and prof["cat"].top_count == 40
    top = P.top_values(mixed, ["cat"], k=2).orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in top] == [("a", 40), ("b", 40)]


def test_missing_and_catalog(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (3, "a")], "x long, t string")
    assert P.missing_total(df).first().missing == 2
    miss = {r.column: r.missing for r in P.missing_per_column(df).collect()}
    assert miss == {"x": 1, "t": 1}
    cat = {r.column: r for r in P.column_catalog(df).collect()}
    assert cat["t"].unique == 1 and cat["t"].nulls == 1 and cat["x"].dtype == "bigint"


def test_cleaning_report(spark):
    before = spark.createDataFrame([(1, None), (1, None), (2, "a")], "x long, t string")
    from tablewise.operators.clean import clean

    rep = {r.metric: (r.before, r.after) for r in P.cleaning_report(before, clean(before)).collect()}
    assert rep["rows"] == (3, 2) and rep["missing"] == (2, 0) and rep["duplicates"] == (1, 0)


def test_column_types_approx_agrees_on_small_counts(spark, mixed):
    exact = {r.column: r.type for r in P.column_types(mixed).collect()}
    approx = {r.column: r.type for r in P.column_types(mixed, approx=True).collect()}
    assert exact == approx
