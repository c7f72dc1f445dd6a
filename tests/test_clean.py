import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import clean as C


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (1,), (3,), (2,), (None,)], "x long")
    out = C.impute(df, "mode")
    assert sorted(r.x for r in out.collect()) == [1, 1, 1, 2, 3, 3]


def test_mean_median_and_text_mode(spark):
    rows = [(1, 29.0, "Sales", "2021-05-10"), (2, None, "Ops", "2020-08-21"), (3, 35.0, "HR", "2019-11-15"),
            (4, 28.0, "Sales", None), (5, 40.0, "Ops", "2018-03-03"), (6, 30.0, None, "2022-01-01")]
    df = spark.createDataFrame(rows, "id long, age double, dept string, joined string")
    mean = {r.id: r for r in C.impute(df, "mean").collect()}
    assert mean[2].age == pytest.approx(32.4)
    assert mean[6].dept == "Ops"  # tie Ops/Sales -> smallest text
    assert mean[4].joined == "2018-03-03"  # all distinct -> smallest
    med = {r.id: r for r in C.impute(df, "median").collect()}
    assert med[2].age == 30.0


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "id long, t string, x double")
    out = C.impute(df, "mean").collect()
    assert all(r.t == "Unknown" for r in out)
    assert all(r.x is None for r in out)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    vals = sorted(r.x for r in C.impute(df, "mean").collect())
    assert vals == [1.0, 2.0, 2.0, 3.0]


def test_drop_strategy_and_unknown_strategy(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id long, t string")
    assert C.impute(df, "drop").count() == 1
    with pytest.raises(ValueError):
        C.impute(df, "average")


def test_integral_mean_becomes_double(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x long")
    out = C.impute(df, "mean")
    assert dict(out.dtypes)["x"] == "double"
    assert sorted(r.x for r in out.collect()) == [1.0, 1.5, 2.0]


@pytest.mark.parametrize("bad", ["1d", "0x1F", "1,000", "$75", "True"])
def test_retype_one_bad_value_keeps_text(spark, bad):
    df = spark.createDataFrame([("1",), ("2",), (bad,)], "v string")
    assert dict(C.retype_numeric(df).dtypes)["v"] == "string"


def test_retype_strict_numbers(spark):
    df = spark.createDataFrame([(" 1 ", "1.5", "1e3"), ("2", "inf", "-2"), ("3", "", "3")], "a string, b string, c string")
    out = C.retype_numeric(df)
    types = dict(out.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "double"}
    b = [r.b for r in out.collect()]
    assert b[0] == 1.5 and math.isinf(b[1]) and b[2] is None


def test_dedupe_nulls_equal_and_dup_stats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "k long, t string")
    assert C.dedupe(df).count() == 2
    r = C.duplicate_stats(df).first()
    assert (r.rows, r.distinct_rows, r.duplicates) == (5, 2, 3)


def test_minmax_constant_is_null_and_range(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, b double")
    out = C.minmax_scale(df).collect()
    assert sorted(r.a for r in out) == [0.0, 0.5, 1.0]
    assert all(r.b is None for r in out)


def test_clean_order_fill_then_dedupe_then_retype(spark):
    # the number-like text column is mode-filled first, then retyped; rows that
    # became equal through filling are de-duplicated
    df = spark.createDataFrame([("1", "x"), (None, "x"), ("1", "x"), ("2", "y")], "n string, t string")
    out = C.clean(df)
    assert dict(out.dtypes)["n"] == "bigint"
    assert sorted((r.n, r.t) for r in out.collect()) == [(1, "x"), (2, "y")]


def test_parse_dates_one_format_only(spark):
    df = spark.createDataFrame([("09/15/2024", "2024-09-15"), ("09/16/2024", "09/16/2024")], "us string, mixed string")
    out = C.parse_dates(df)
    t = dict(out.dtypes)
    assert t["us"] == "timestamp" and t["mixed"] == "string"


def test_impute_matches_pandas_random(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.integers(0, 5, 200).astype(float)})
    pdf.loc[rng.choice(200, 30, replace=False), "a"] = np.nan
    pdf.loc[rng.choice(200, 30, replace=False), "b"] = np.nan
    df = spark.createDataFrame(pdf)
    for strategy in ("mean", "median"):
        got = C.impute(df, strategy).toPandas()
        exp = pdf.fillna(pdf.mean() if strategy == "mean" else pdf.median())
        np.testing.assert_allclose(np.sort(got.a), np.sort(exp.a), rtol=1e-12)
        np.testing.assert_allclose(np.sort(got.b), np.sort(exp.b), rtol=1e-12)
    got = C.impute(df, "mode").toPandas()
    exp = pdf.fillna({c: pdf[c].mode().iloc[0] for c in pdf})
    np.testing.assert_allclose(np.sort(got.b), np.sort(exp.b))


def test_idempotent_on_text_free_table(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 3), (1.0, 2)], "a double, b long")
    once = C.clean(df)
    twice = C.clean(once)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.filter(F.col("a").isNull()).count() == 0
