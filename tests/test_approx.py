"""The approx=True switches run and land close to the exact results."""

import pytest

from tablewise.operators import clean as C
from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tests.conftest import SF01


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF01}/events.parquet")


def test_approx_describe_and_outliers(spark, events):
    exact = {r.column: r for r in P.describe(events).collect()}
    approx = {r.column: r for r in P.describe(events, approx=True).collect()}
    for c in exact:
        assert approx[c].q50 == pytest.approx(exact[c].q50, rel=0.02, abs=0.5)
    rep = S.outlier_report(events, approx=True).collect()
    assert [r.column for r in rep] == ["value"]
    box = S.box_stats(events, "value", by="event_type", approx=True).count()
    assert box == 5


def test_approx_median_clean_and_distinct(spark, events):
    out = C.clean(events.select("event_id", "value"), "median", approx=True)
    assert out.count() == 10000
    d = {r.column: r.unique for r in P.distinct_counts(events, approx=True).collect()}
    assert d["event_type"] == 5
