import os

from pyspark.sql import functions as F

from tablewise.plans import charts as V
from tablewise.plans import insights as I
from tablewise.streaming.intake import read_stream, row_local_clean, start_clean_stream


def test_row_local_clean_batch(spark):
    df = spark.createDataFrame([("  a   b ", float("nan")), ("N/A", 1.0), ("x", float("inf"))], "t string, v double")
    rows = row_local_clean(df, text_case="upper").collect()
    assert [r.t for r in rows] == ["A B", None, "X"]
    assert [r.v for r in rows] == [None, 1.0, None]


def test_stream_end_to_end(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("id,name,score\n1, Ann  Lee ,1.5\n2,NULL,NaN\n")
    out = os.path.join(tmp_dir, "out")
    stream = read_stream(spark, src, "id long, name string, score double")
    q = start_clean_stream(stream, out, checkpoint=os.path.join(tmp_dir, "ck"))
    q.processAllAvailable()
    q.stop()
    rows = sorted(spark.read.parquet(out).collect())
    assert [(r.id, r.name, r.score) for r in rows] == [(1, "Ann Lee", 1.5), (2, None, None)]


def _frame(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), "abc"[i % 3], f"2024-0{1 + i % 3}-1{i % 9}") for i in range(90)]
    df = spark.createDataFrame(rows, "k long, x double, y double, cat string, d string")
    return df.withColumn("d", F.to_timestamp("d"))


def test_rule_plan_and_dispatch(spark):
    df = _frame(spark)
    plan = V.rule_plan(df).orderBy("ord").collect()
    kinds = [(r.kind, r.chart_type) for r in plan]
    assert ("univariate", "histogram") in kinds and ("correlation", "heatmap") == kinds[-1]
    titles = [r.title for r in plan]
    assert "'x' vs 'y'" in titles and "'x' by 'cat'" in titles and "'k' over time" in titles
    tmap = {r.column: r.type for r in __import__("tablewise.operators.profile", fromlist=["x"]).column_types(df).collect()}
    assert V.bivariate(df, "x", "y", tmap)[0] == "scatter"
    assert V.bivariate(df, "cat", "x", tmap)[0] == "box"
    assert V.bivariate(df, "d", "x", tmap)[0] == "line"
    assert set(V.univariate(df, "x", tmap)) == {"histogram", "density"}
    assert V.heatmap(df).count() == 9


def test_external_plan_validation(spark):
    df = _frame(spark)
    reply = spark.createDataFrame(
        [('```json\n[{"title": "x vs y", "chart_type": "scatter", "x": "x", "y": "y", "color": "nope"},'
          ' {"title": "bad", "chart_type": "pie", "x": "x"}, {"title": "zz", "chart_type": "bar", "x": "missing"}]\n```',)],
        "r string",
    )
    items = V.execute_plan(df, V.parse_plan(reply, "r"))
    assert len(items) == 1 and items[0][0]["color"] is None and items[0][0]["kind"] == "bivariate"
    assert items[0][1].count() == 90


def test_high_cardinality_text_is_counted_by_whole_values(spark):
    df = spark.createDataFrame([(f"Customer#{i % 80:03d}", f"Part {i % 60}", "ab"[i % 2], float(i % 7)) for i in range(240)], "name string, part string, flag string, v double")
    tmap = V._types_map(df)
    assert tmap["name"] == tmap["part"] == "high_cardinality"
    kind, data = V.bivariate_data(df, "name", "flag", tmap)
    assert kind == "strip"
    assert sorted(map(tuple, data["strip"].collect())) == [(f"Customer#{i:03d}", "ab"[i % 2], 3) for i in range(80)]
    assert V.bivariate_data(df, "name", "part", tmap)[1]["strip"].count() == 240
    by_part = V.binned_pairs(df, "flag", "v", tmap, color="part")
    assert by_part.select("color").distinct().count() == 60 and by_part.agg({"count": "sum"}).first()[0] == 240


def test_insight_sentences(spark):
    df = spark.createDataFrame([(float(i), float(i) * 2 + (i % 3), 1.0 if i < 95 else 500.0) for i in range(100)], "a double, b double, c double")
    res = I.analyze(df)
    ins = [r.text for r in res["insights"].orderBy("ord").collect()]
    assert ins[0] == "The dataset contains 100 rows and 3 columns."
    assert ins[1].startswith("Strongest correlation: 'a' and 'b' (+1.00, strong positive)")
    assert any("right-skewed" in r.text for r in res["trends"].collect())
    recs = I.top_up_recommendations(res["recommendations"]).count()
    assert recs == 3
    summary = res["executive_summary"].first().text
    assert summary.startswith("This dataset (100 rows × 3 cols)")


def test_visualize_end_to_end(spark):
    df = _frame(spark)
    out = V.visualize(df)
    plan = out["plan"].orderBy("ord").collect()
    assert len(out["charts"]) == len(plan)
    for item, data in out["charts"]:
        assert isinstance(data, dict) and data
        for frame in data.values():
            assert frame.count() >= 0
    assert set(out["statistical_summary"]) >= {"numerical", "missing_values", "shape"}
