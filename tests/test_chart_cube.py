"""Charts of a plan from shared scans: equal to the single-chart functions, scans counted."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import cube as Q
from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tablewise.plans import charts as V


def _rows(frame):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)


def _table(spark, n=120):
    rows = []
    for i in range(n):
        rows.append(
            (
                None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i % 7) - 3.0,
                None if i % 5 == 0 else i * i,
                [None, "a", "b.c", "", "é"][i % 5],
                None if i % 9 == 0 else bool(i % 2),
                None if i % 8 == 0 else dt.datetime(2023, 1 + i % 12, 1 + i % 28, i % 24, 30, 1, i),
                -0.0 if i % 2 else 0.0,
            )
        )
    return spark.createDataFrame(rows, "`x.1` double, n long, g string, flag boolean, day timestamp, zero double")


TMAP = {"x.1": "numerical", "n": "numerical", "g": "categorical", "flag": "boolean", "day": "datetime", "zero": "numerical"}


def test_rule_plan_data_equals_single_charts(spark):
    df = _table(spark)
    items = [r.asDict() for r in spark.createDataFrame(V.rule_plan_rows(TMAP, ["x.1", "n", "zero"]), V.PLAN_SCHEMA).orderBy("ord").collect()]
    drawn = V.plan_data(df, items, TMAP, rules=True)
    kinds = set()
    for it, data in zip(items, drawn):
        kinds.add(it["chart_type"])
        if it["kind"] == "univariate":
            want = V.univariate(df, it["x"], TMAP)
        elif it["kind"] == "bivariate":
            want = V.bivariate_data(df, it["x"], it["y"], TMAP)[1]
        else:
            want = {"heatmap": V.heatmap(df)}
        assert set(data) == set(want), it
        for name in want:
            assert set(data[name].columns) == set(want[name].columns)
            assert _rows(data[name].select(*[F.col(f"`{c}`") for c in want[name].columns])) == _rows(want[name]), (it, name)
    assert kinds == {"histogram", "bar", "line", "scatter", "box", "heatmap"}


def test_external_items_equal_single_functions(spark):
    df = _table(spark)
    it = lambda t, x, y=None, color=None: {"chart_type": t, "x": x, "y": y, "color": color}
    plan = {
        "totals": (it("bar", "g", "n", "flag"), S.bar_totals(df, "g", "n", "flag")),
        "by time": (it("bar", "day", "n"), S.bar_totals(df, "day", "n")),
        "zeros": (it("bar", "zero"), P.value_counts(df, "zero")),
        "nan": (it("bar", "x.1"), P.value_counts(df, "x.1")),
        "line of text": (it("line", "g", "n"), S.bar_totals(df, "g", "n")),
        "line": (it("line", "day", "x.1", "g"), V.period_totals(df, "day", "x.1", TMAP, "g")),
        "scatter": (it("scatter", "n", "day", "x.1"), V.binned_pairs(df, "n", "day", TMAP, color="x.1")),
        "strip": (it("scatter", "g", "n"), V.binned_pairs(df, "g", "n", TMAP)),
        "box": (it("box", "n"), S.box_stats(df, "n")),
        "box by two": (it("box", "g", "n", "flag"), V._box(df, "n", ["g", "flag"])),
        "box by time": (it("box", "day", "n"), S.box_stats(df, "n", by="day")),
        "not a number": (it("box", "g", "flag"), None),
        "no y": (it("scatter", "g"), None),
        "no x": (it("bar", None, "n"), None),
    }
    got = V.plan_data(df, [item for item, _ in plan.values()], TMAP)
    for (name, (item, want)), data in zip(plan.items(), got):
        if want is None:
            assert data is None, name
        else:
            frame = data[item["chart_type"]]
            assert _rows(frame.select(*[F.col(f"`{c}`") for c in want.columns])) == _rows(want), name
    zeros = dict(V.plan_data(df, [it("bar", "zero")], TMAP)[0]["bar"].collect())
    assert zeros == {0.0: 120}


def test_nested_and_binary_axes(spark):
    df = spark.createDataFrame([([1, 2], bytearray(b"\xff\x00"), 1.0), ([1, 2], bytearray(b"a"), 3.0), (None, None, 5.0)], "a array<int>, b binary, v double")
    tmap = {"a": "high_cardinality", "b": "high_cardinality", "v": "numerical"}
    items = [{"chart_type": t, "x": x, "y": y} for t, x, y in (("bar", "b", None), ("bar", "a", "v"), ("box", "a", "v"), ("box", "b", "v"), ("bar", "a", None))]
    bars, totals, nested, binary, counts = (d[i["chart_type"]] for d, i in zip(V.plan_data(df, items, tmap), items))
    assert {bytes(r.value): r["count"] for r in bars.collect()} == {b"\xff\x00": 1, b"a": 1}
    assert {tuple(r.a or ()): r.total for r in totals.collect()} == {(1, 2): 4.0, (): 5.0}
    assert [(r.a, r["median"], r.n) for r in nested.collect()] == [([1, 2], 2.0, 2)]
    assert {bytes(r.b): r["median"] for r in binary.collect()} == {b"\xff\x00": 1.0, b"a": 3.0}
    assert [(r.value, r["count"]) for r in counts.collect()] == [([1, 2], 2)]


def test_empty_table(spark):
    df = _table(spark).limit(0)
    items = [r.asDict() for r in spark.createDataFrame(V.rule_plan_rows(TMAP, ["x.1", "n"]), V.PLAN_SCHEMA).collect()]
    for it, data in zip(items, V.plan_data(df, items, TMAP, rules=True)):
        for name, frame in data.items():
            if name == "trend_line":
                assert [tuple(r) for r in frame.collect()] == [(None, None, None, 0)]
            elif name != "heatmap":
                assert frame.count() == 0, (it, name)
    assert V.plan_data(df, [], TMAP) == []


@pytest.mark.parametrize("n_columns", [3, 9])
def test_scans_do_not_grow_with_charts(spark, n_columns):
    rows = 60
    pdf = pd.DataFrame({f"c{k}": [float((i * (k + 3)) % 17) for i in range(rows)] for k in range(n_columns)})
    pdf["g"], pdf["h"], pdf["d"] = [["p", "q", "r"][i % 3] for i in range(rows)], [["s", "t"][i % 2] for i in range(rows)], [dt.date(2020, 1 + i % 12, 1) for i in range(rows)]
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    base = spark.createDataFrame(pdf)
    df = base.mapInPandas(watched, base.schema)
    tmap = {c: "numerical" for c in pdf.columns if c.startswith("c")} | {"g": "categorical", "h": "categorical", "d": "datetime"}
    plan = [dict(zip(("ord", "kind", "chart_type", "x", "y"), r)) for r in V.rule_plan_rows(tmap, [], pair_numerics=n_columns)]
    drawn = V.plan_data(df, plan, tmap, rules=True)
    for data in drawn:
        for frame in data.values():
            frame.collect()
    charts = sum(len(d) for d in drawn)
    assert charts > (100 if n_columns == 9 else 15)
    # ranges, cells, trend lines, and three of the boxes: sketch, selection, whiskers
    assert seen.value == 6 * rows, (charts, seen.value / rows)


def test_one_cell_of_most_rows_is_combined_in_the_task(spark):
    df = spark.range(4000, numPartitions=4).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    (bars,) = Q.chart_cells(df, [V._counted(df, "g")])
    assert bars.first()["count"] == 3600 and bars.count() == 401
