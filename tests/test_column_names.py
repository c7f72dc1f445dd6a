"""Column names with spaces and dots go through every main operator."""

import pytest
from pyspark.sql import functions as F

from tablewise.operators import clean as C
from tablewise.operators import enrich as E
from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tablewise.plans import charts as V
from tablewise.plans import insights as I


@pytest.fixture()
def odd(spark):
    rows = [(f"2024-0{1 + i % 9}-1{i % 9}", float(i % 17) if i % 5 else None, ["Red", "Blue", "Green"][i % 3] if i % 7 else None, i % 4, float(i))
            for i in range(60)]
    return spark.createDataFrame(rows, "`Order Date` string, `unit.price` double, `Team Name` string, qty long, `x y` double")


def test_operators_accept_odd_names(spark, odd):
    cleaned = C.clean(odd, "median", normalize=True)
    assert set(cleaned.columns) == set(odd.columns)
    assert cleaned.filter(F.col("`unit.price`").isNull()).count() == 0
    types = {r.column: r.type for r in P.column_types(odd).collect()}
    assert types["Order Date"] == "datetime" and types["Team Name"] == "categorical"
    assert P.describe(odd).count() == 3
    assert P.top_values(odd, ["Team Name"], k=2).count() == 2
    assert S.strong_correlations(odd).count() >= 0
    assert S.outlier_report(odd).count() >= 0
    assert S.box_stats(odd, "unit.price", by="Team Name").count() == 3
    assert S.histogram(odd, "unit.price").count() >= 10
    assert S.contingency(odd, "Team Name", "qty").count() > 0
    assert S.sorted_by(odd, "unit.price").count() == 60
    assert E.impute_by_group(odd, "unit.price", "Team Name").filter(F.col("`unit.price`").isNull()).count() == 0
    assert E.anomaly_flags(odd, ["unit.price"]).count() == 60
    assert C.parse_dates(odd).dtypes[0][1] == "timestamp"
    assert V.rule_plan(odd).count() > 0
    assert I.analyze(odd)["insights"].count() >= 1
