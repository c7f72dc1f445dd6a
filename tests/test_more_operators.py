import os

from pyspark.sql import functions as F

from tablewise.operators import enrich as E
from tablewise.operators import profile as P
from tablewise.plans import charts as V
from tablewise.plans import insights as I
from tablewise.sources import readers as SR
from tablewise.sources import sinks as SK


def test_object_reply_and_json_dispatch(spark, tmp_dir):
    df = spark.createDataFrame([(1, 'x {"a": 5, "b": "q"} y')], "id long, r string")
    out = E.parse_reply(df, "r", "a bigint, b string", kind="object", keep=["id"]).first()
    assert (out.id, out.a, out.b) == (1, 5, "q")
    p = os.path.join(tmp_dir, "recs.json")
    with open(p, "w") as f:
        f.write('[{"k": 1}, {"k": 2}]')
    assert SR.read_table(spark, p).count() == 2


def test_time_series_per_day_and_distribution_grid(spark):
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", 1.0), ("2024-01-01 12:00:00", 2.0), ("2024-01-02 00:00:00", 5.0)], "d string, v double"
    ).withColumn("d", F.to_timestamp("d"))
    days = {r.period: r.total for r in V.time_series(df, "d", "v", period="day").collect()}
    assert days == {"2024-01-01": 3.0, "2024-01-02": 5.0}
    grid = V.distribution_grid(df)
    assert [(c, k) for c, k, _ in grid] == [("d", "bar"), ("v", "box")]


def test_report_and_text_export(spark, tmp_dir):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "a double, b double")
    res = I.analyze(df)
    lines = [r.text for r in I.report_lines(res).orderBy("section_ord", "ord").collect()]
    assert lines[0] == "EXECUTIVE SUMMARY" and lines[1].startswith("This dataset (50 rows")
    assert "KEY INSIGHTS" in lines and "PATTERNS" in lines and "RECOMMENDATIONS" in lines
    assert lines[-1][0].isdigit() and ". " in lines[-1]
    out = os.path.join(tmp_dir, "report")
    SK.write_text_report(I.report_lines(res), out)
    assert spark.read.text(out).count() == len(lines)
    paths = SK.write_tables({"a": df, "b": df.limit(3)}, os.path.join(tmp_dir, "tables"))
    assert spark.read.parquet(paths["b"]).count() == 3


def test_planning_metadata_excludes_high_cardinality(spark):
    rows = [(i, f"name{i}", ["x", "y", "z"][i % 3]) for i in range(80)]
    m = {r.column: r for r in P.planning_metadata(spark.createDataFrame(rows, "k long, name string, g string")).collect()}
    assert "name" not in m and m["g"].sample_values == ["x", "y"] and m["k"].max == 79.0
