"""Empty and one-row tables go through every main operator."""

import pytest

from tablewise.operators import clean as C
from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tablewise.plans import charts as V
from tablewise.plans import insights as I

SCHEMA = "k long, x double, t string"


@pytest.mark.parametrize("rows", [[], [(1, 2.5, "a")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert C.clean(df).count() == len(rows)
    d = {r.column: r for r in P.describe(df).collect()}
    assert set(d) == {"k", "x"}
    if rows:
        assert d["x"].q50 == 2.5 and d["x"].std is None
    assert P.column_types(df).count() == 3
    assert S.outlier_report(df).count() == 0
    assert S.strong_correlations(df).count() == 0
    assert S.histogram(df, "x").count() == (10 if rows else 0)
    assert V.rule_plan(df).count() >= 0
    res = I.analyze(df)
    assert res["insights"].first().text.startswith(f"The dataset contains {len(rows)} rows")


def test_mode_fill_for_bool_timestamp_date(spark):
    import datetime as dt

    rows = [
        (True, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2)),
        (True, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2)),
        (False, dt.datetime(2023, 5, 6, 0, 0, 0), dt.date(2023, 5, 6)),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "b boolean, ts timestamp, d date")
    out = C.impute(df, "mean").collect()
    assert out[3].b is True and out[3].ts == dt.datetime(2024, 1, 2, 3, 4, 5) and out[3].d == dt.date(2024, 1, 2)
    assert dict(C.impute(df, "mean").dtypes) == {"b": "boolean", "ts": "timestamp", "d": "date"}
