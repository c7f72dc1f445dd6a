"""Property tests (random small frames with nulls)."""

import math

import pytest

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablewise.operators import clean as C
from tablewise.operators import stats as S

_SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

cell = st.one_of(st.none(), st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False))
frames = st.lists(st.tuples(cell, cell, st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))), min_size=1, max_size=40)


def _df(spark, rows):
    return spark.createDataFrame(rows, "x double, y double, t string")


@_SETTINGS
@given(rows=frames)
def test_clean_fills_every_column_that_had_a_value(spark, rows):
    df = _df(spark, rows)
    out = C.clean(df, "mean", checkpoint=False).toPandas()
    src = pd.DataFrame(rows, columns=["x", "y", "t"])
    for c in ("x", "y", "t"):
        if src[c].notna().any():
            assert out[c].notna().all()


@_SETTINGS
@given(rows=frames)
def test_clean_idempotent_without_text(spark, rows):
    df = _df(spark, rows).drop("t")
    once = C.clean(df, "median", checkpoint=False)
    twice = C.clean(once, "median", checkpoint=False)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(once.collect(), key=key) == sorted(twice.collect(), key=key)


@_SETTINGS
@given(rows=frames)
def test_scaled_values_in_unit_interval(spark, rows):
    out = C.minmax_scale(_df(spark, rows)).toPandas()
    for c in ("x", "y"):
        v = out[c].dropna()
        assert ((v >= 0) & (v <= 1)).all()


@_SETTINGS
@given(rows=frames)
def test_histogram_counts_sum_and_corr_bounded(spark, rows):
    df = _df(spark, rows)
    n = sum(1 for r in rows if r[0] is not None)
    if n:
        assert sum(r["count"] for r in S.histogram(df, "x").collect()) == n
    for r in S.correlation_pairs(df).collect():
        if r.r is not None:
            assert abs(r.r) <= 1 + 1e-9 and not math.isnan(r.r)


text_cell = st.one_of(st.none(), st.sampled_from(["1", "2", "-3", " 4 ", "", "  ", "1.5", "2e3", "x", "$75", "inf"]))
text_frames = st.lists(st.tuples(text_cell, text_cell), min_size=1, max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=text_frames, strategy=st.sampled_from(["mean", "median", "mode", "drop"]))
def test_clean_retype_decided_before_dedupe_equals_after(spark, rows, strategy):
    df = spark.createDataFrame(rows, "a string, b string")
    got = C.clean(df, strategy)
    filled = C.impute(df, strategy)
    ref = C.apply_numeric_plan(C.dedupe(filled), C.numeric_text_plan(filled))
    assert got.dtypes == ref.dtypes
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got.collect(), key=key) == sorted(ref.collect(), key=key)


qvals = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e3, 1e3, allow_nan=False)), min_size=1, max_size=60)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(vals=qvals, probs=st.lists(st.floats(0, 1), min_size=1, max_size=4, unique=True),
       bound=st.sampled_from([3, 8, 1_000_000]), groups=st.integers(1, 3))
def test_quantiles_match_pandas_any_path(spark, vals, probs, bound, groups):
    from tablewise.operators.quantiles import quantiles

    rows = [(i % groups, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r.g, r.p): r.value for r in quantiles(df, ["x"], probs, by=["g"], max_candidates=bound).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g, part in pdf.groupby("g"):
        s = part["x"].dropna()
        for p in probs:
            if len(s) == 0:
                assert (g, float(p)) not in got
            else:
                assert got[(g, float(p))] == pytest.approx(s.quantile(p), rel=1e-9, abs=1e-9)
