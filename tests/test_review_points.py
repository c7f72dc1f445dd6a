"""Edge cases of readers, replies, charts and statistics that a review has asked for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import clean as C
from tablewise.operators import enrich as E
from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tablewise.operators.quantiles import quantiles
from tablewise.plans import charts as V
from tablewise.plans import insights as I
from tablewise.plans.prepare import prepare
from tablewise.sources import readers as R
from tablewise.sources import sinks as K


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide")) + "/t"
    x = np.random.default_rng(1).normal(size=(500, 40))
    x[::9, 3] = np.nan
    x[:, 7] = 2.5
    x[:, 8] = 1e9 + x[:, 9] * 3
    spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(40)])).write.parquet(path)
    return spark.read.parquet(path)


def test_scans_do_not_grow_with_columns(wide):
    assert scans(P.numeric_summary(wide, with_quartiles=False)) == 1
    assert scans(P.distinct_counts(wide)) == 1
    assert scans(S.correlation_pairs(wide)) == 1 and scans(S.correlation_pairs(wide, full=True)) <= 2


def test_one_scan_statistics_match_pandas(wide):
    pdf = wide.toPandas()
    near = pdf.assign(c8=pdf.c8 - 1e9)  # exact, and free of the rounding that a mean of 1e9 brings
    for r in S.correlation_pairs(wide, full=True).collect():
        if r.col1 == "c7" or r.col2 == "c7":
            assert r.r is None
        else:
            both = near[[r.col1, r.col2]].dropna().to_numpy()
            assert r.r == pytest.approx(np.corrcoef(both[:, 0], both[:, -1])[0, 1], abs=1e-9)
    assert dict(P.distinct_counts(wide).select("column", "unique").collect()) == {c: pdf[c].nunique() for c in pdf}
    got = P.numeric_summary(wide, with_quartiles=False).toPandas().set_index("column")
    assert np.allclose(got["std"].loc[list(pdf)], pdf.std()) and np.allclose(got["skewness"].drop("c7").loc["c0":], pdf.skew().drop("c7").loc[got.index.drop("c7")])


def test_quantile_loop_terminates_on_two_heavy_values(spark):
    vals = [1.0] * 5000 + [2.0] * 5000
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    got = {r.p: r.value for r in quantiles(df, ["x"], [0.0, 0.49, 0.5, 0.51, 1.0], max_candidates=10).collect()}
    assert got == {p: pd.Series(vals).quantile(p) for p in got}
    assert quantiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_replies_keep_rows_with_null_or_wrong_fields(spark):
    def rows(text):
        return [tuple(r) for r in E.parse_reply(spark.createDataFrame([(text,)], "r string"), "r", "a int, b int").collect()]

    assert rows('[{"a":null,"b":2},{"a":1,"b":3}]') == [(None, 2), (1, 3)]
    assert rows('[{"a":"x","b":2}]') == [(None, 2)]
    assert rows('See note [1].\n```json\n[{"a":1,"b":2}]\n```') == [(1, 2)]
    assert rows("no array [here") == rows("[]") == rows("[{]") == []


def test_plan_items_without_title_stay(spark):
    p = V.parse_plan(spark.createDataFrame([('[{"title":null,"chart_type":"bar","x":"g"},{"chart_type":"heatmap"}]',)], "r string"), "r")
    assert [(r.ord, r.title, r.chart_type) for r in p.orderBy("ord").collect()] == [(0, "", "bar"), (1, "", "heatmap")]


def test_csv_keeps_quoted_line_breaks(spark, tmp_dir):
    K.write_csv(spark.createDataFrame([(1, 'a\nb "q"'), (2, "c")], "k int, t string"), tmp_dir + "/c")
    out = R.read_csv(spark, tmp_dir + "/c")
    assert dict(out.dtypes)["k"] == "bigint" and sorted(map(tuple, out.collect())) == [(1, 'a\nb "q"'), (2, "c")]


def test_csv_encoding_is_decided_per_file(spark, tmp_dir):
    import os

    os.mkdir(tmp_dir + "/e")
    for name, text, enc in (("a", "café", "utf-8"), ("b", "naïve", "latin-1"), ("c", "� ok", "utf-8")):
        with open(f"{tmp_dir}/e/{name}.csv", "w", encoding=enc) as f:
            f.write(f"w\n{text}\n")
    assert sorted(r[0] for r in R.read_csv(spark, tmp_dir + "/e").collect()) == sorted(["café", "naïve", "� ok"])


def test_read_sql_leaves_the_callers_views(spark):
    spark.range(3).createOrReplaceTempView("orders_view")
    out = R.read_sql(spark, "SELECT count(*) AS n FROM orders_view JOIN other USING (id)", {"orders_view": spark.range(7), "other": spark.range(5)})
    assert out.first().n == 5 and spark.table("orders_view").count() == 3 and not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("orders_view")


def test_text_dates_in_charts(spark):
    df = spark.createDataFrame([(f"{1 + i % 12:02d}/15/{2023 + i // 12}", float(i), "ab"[i % 2]) for i in range(24)], "day string, v double, g string")
    out = V.visualize(df)
    charts = {it["title"]: data for it, data in out["charts"]}
    assert out["route"] == "rules"
    assert [r.count for r in charts["Time Series – 'day'"]["by_period"].collect()] or charts["Time Series – 'day'"]["by_period"].count() == 24
    line = charts["'v' over time"]["line"].collect()
    assert [r.total for r in line] == [float(i) for i in range(24)] and [r.period for r in line] == sorted(r.period for r in line)
    assert [r.v for r in V.bivariate(df, "day", "v")[1].collect()] == [float(i) for i in range(24)]
    assert V.distribution(df, "day")[1].count() == 24


def test_external_plan_drops_only_the_bad_items(spark):
    df = spark.createDataFrame([(i % 3, float(i), "ab"[i % 2], "xyz"[i % 3]) for i in range(60)], "k int, v double, g string, h string")
    reply = spark.createDataFrame(
        [('[{"chart_type":"bar","x":null,"y":"v"},{"chart_type":"bar","x":"g","y":"h"},{"chart_type":"box","x":"g","y":"v","color":"h"},{"chart_type":"scatter","x":"k","y":"v"}]',)], "r string"
    )
    out = V.visualize(df, plan=V.parse_plan(reply, "r"))
    assert out["route"] == "external" and [it["chart_type"] for it, _ in out["charts"]] == ["box", "scatter"]
    assert out["charts"][0][1]["box"].count() == 6
    assert out["charts"][1][1]["scatter"].agg(F.sum("count")).first()[0] == 60
    assert V.visualize(df, plan=V.parse_plan(reply.filter("false"), "r"))["route"] == "rules"


def test_analyze_reply_routes(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "a double, b double")
    good = spark.createDataFrame([('text {x}\n```json\n{"insights":["one"],"executive_summary":"sum"}\n```',)], "reply string")
    out = I.analyze(df, reply=good)
    assert out["route"].first()[0] == "reply" and [r.text for r in out["insights"].collect()] == ["one"]
    assert out["patterns"].count() == I.analyze(df)["patterns"].count()  # a missing section comes from the rules
    assert I.analyze(df, reply=good.select(F.lit("{").alias("reply")))["route"].first()[0] == "rules"


def test_prepare_falls_back_as_a_whole(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (2, 3.0)], "k int, v double")
    good = prepare(df, fn=lambda p: p.assign(v=p["v"] * 2))
    assert good["enhanced"] and sorted(map(tuple, good["data"].collect())) == [(1, 6.0), (2, 6.0)]

    def broken(p):
        raise RuntimeError("ERROR: no")

    bad = prepare(df, fn=broken)
    assert not bad["enhanced"] and sorted(map(tuple, bad["data"].collect())) == [(1, 3.0), (2, 3.0)]
    assert {r.metric: r.after for r in bad["report"].collect()}["rows"] == 2


def test_modes_of_signed_zero_and_instants(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, -0.0, 0.0, -0.0, 1.0, 1.0, 1.0, None]], "x double")
    assert C.impute(df, "mode").filter("x = 0").count() == 5
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        us = [1730611800 - 3600, 1730611800, 1730611800, None]  # 05:30Z once and 06:30Z twice: both read 01:30
        ts = spark.createDataFrame([(u,) for u in us], "u long").select(F.timestamp_seconds("u").alias("t"))
        assert C.impute(ts, "mode").filter(F.unix_seconds("t") == us[1]).count() == 3
        assert P.distinct_counts(ts).first().unique == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_map_columns_in_duplicates(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 1, 'b', 2)), (1, map('b', 2, 'a', 1)), (1, map('a', 1)) t(k, m)")
    assert C.duplicate_stats(df).first().duplicates == 1
    out = C.dedupe(df)
    assert out.count() == 2 and dict(out.dtypes)["m"] == "map<string,int>" and C.clean(df).count() == 2


def test_zero_rows_keep_their_types(spark):
    df = spark.createDataFrame([("a", None)], "t string, u string").limit(0)
    assert C.retype_numeric(df).dtypes == df.dtypes and C.clean(df, "drop").dtypes == df.dtypes


def test_group_imputation_fills_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", None), (None, float("nan"))], "g string, v double")
    assert sorted(r.v for r in E.impute_by_group(df, "v", "g").collect()) == [2.0] * 4
    assert sorted(r.v for r in E.impute_by_group(df, "v", "g", stat="mode").collect()) == [2.0] * 4


def test_samples_are_cut_after_the_choice(spark):
    df = spark.createDataFrame([("prefix" * 5 + c,) for c in "ab"] + [("z",)], "t string")
    assert [r.value for r in P.sample_values(df, ["t"]).orderBy("rank").collect()] == [("prefix" * 5)[:20]] * 2


def test_wide_contingency_has_no_default_limit(spark):
    df = spark.range(1200).select((F.col("id") % 2).alias("a"), F.col("id").alias("b"))
    assert len(S.contingency_wide(df, "a", "b").columns) == 1201
    with pytest.raises(ValueError):
        S.contingency_wide(df, "a", "b", max_levels=1000)


def test_stream_restarts_where_it_stopped(spark, tmp_dir):
    """The default checkpoint folder depends on the sink's name only, so a restarted stream resumes."""
    from tablewise.streaming.intake import read_stream, start_clean_stream

    spark.range(5).selectExpr("id", "'x' AS t").write.parquet(tmp_dir + "/in")
    for _ in range(2):
        q = start_clean_stream(read_stream(spark, tmp_dir + "/in", "id long, t string", fmt="parquet"), tmp_dir + "/out")
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(tmp_dir + "/out").count() == 5
    import hashlib
    import os

    base = spark.sparkContext.getCheckpointDir().replace("file:", "")
    assert os.path.isdir(f"{base}/streams/{hashlib.sha256((tmp_dir + '/out').encode()).hexdigest()}")


def test_materialize_of_types_parquet_cannot_hold(spark):
    from tablewise.session import materialize

    out = materialize(spark.sql("SELECT 1 AS k, make_interval(1) AS i, NULL AS n"))
    assert out.count() == 1
