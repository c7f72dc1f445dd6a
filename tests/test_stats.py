import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import stats as S


def test_correlation_constant_and_bands(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(scale=0.1, size=400), "z": -x + rng.normal(scale=1.2, size=400), "c": 1.0})
    df = spark.createDataFrame(pdf)
    pairs = {(r.col1, r.col2): r.r for r in S.correlation_pairs(df).collect()}
    assert pairs[("x", "y")] == pytest.approx(pdf.x.corr(pdf.y))
    assert pairs[("x", "c")] is None  # constant: undefined, no ANSI error
    strong = S.strong_correlations(df).collect()
    assert strong[0].col1 == "x" and strong[0].col2 == "y" and strong[0].strength == "strong positive"
    assert all(abs(r.correlation) >= 0.3 for r in strong)
    assert all(abs(r.r) <= 1 + 1e-12 for r in S.correlation_pairs(df).collect() if r.r is not None)


def test_outlier_report_rules(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, 5.0, 1.0) for v in vals] + [(None, 5.0, 2.0)], "a double, const double, few double")
    rep = S.outlier_report(df).collect()
    assert [r.column for r in rep] == ["a"]  # const: IQR 0; few: two values only (still >= 4 rows but IQR>0?)
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert rep[0].lower_bound == round(q1 - 1.5 * (q3 - q1), 4)
    assert rep[0].outlier_count == 1 and rep[0].outlier_pct == 20.0


def test_outlier_needs_four_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (50.0,)], "a double")
    assert S.outlier_report(df).count() == 0


def test_histogram_last_bin_closed_and_empty_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 9, 10]], "x double")
    h = S.histogram(df, "x", bins=10).collect()
    assert len(h) == 10
    assert sum(r["count"] for r in h) == 5
    assert h[-1]["count"] == 2  # 9 and the max 10
    assert h[5]["count"] == 0


def test_histogram_constant_and_density(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    h = S.histogram(df, "x", bins=60, density=True).collect()
    assert h[0].lo == 2.5 and h[-1].hi == 3.5
    width = 1.0 / 60
    assert sum(r.density * width for r in h) == pytest.approx(1.0)


def test_box_stats_whiskers(spark):
    rows = [("g", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]]
    b = S.box_stats(spark.createDataFrame(rows, "g string, v double"), "v", by="g").first()
    s = pd.Series([r[1] for r in rows])
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert b.q1 == q1 and b.q3 == q3 and b.median == 5.0
    assert b.upper_whisker == 8.0 and b.lower_whisker == 1.0


def test_trend_cv_shares_monthly(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "x double, y double")
    t = S.trend_line(df, "x", "y").first()
    assert t.slope == pytest.approx(2.0) and t.intercept == pytest.approx(1.0) and t.r2 == pytest.approx(1.0)
    cv = {r.column: r for r in S.variability(df).collect()}
    assert cv["x"].cv == pytest.approx(np.std(range(10), ddof=1) / 4.5)
    cats = spark.createDataFrame([(c,) for c in "aaabbc"], "c string")
    sh = {r.value: r.share for r in S.category_shares(cats, "c").collect()}
    assert sh["a"] == 0.5
    many = spark.createDataFrame([(str(i),) for i in range(9)], "c string")
    assert S.category_shares(many, "c").count() == 0
    ts = spark.createDataFrame([("2024-01-05", 1.0), ("2023-01-07", 2.0), ("2024-02-01", 5.0)], "d string, v double")
    ts = ts.withColumn("d", F.to_timestamp("d"))
    m = {r.month: r.total for r in S.monthly_totals(ts, "d", "v").collect()}
    assert m == {1: 3.0, 2: 5.0}


def test_contingency_wide_zero_fill(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    w = {r.p: (r.x, r.y) for r in S.contingency_wide(df, "p", "q").collect()}
    assert w == {"a": (1, 1), "b": (1, 0)}
