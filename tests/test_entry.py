from tests.conftest import SF001


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) >= {"column", "mean", "q50"}
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 90
    # a cheap smoke over a few registered queries at the smallest scale
    for name in ("p01_shape", "a03_value_counts", "c09_duplicate_count"):
        assert q[name](spark, SF001).count() >= 1
    import importlib.util

    here = importlib.util.find_spec("tablewise.llm") is not None
    assert any(name.startswith("op8_") for name in q) == here


def test_package_exports_and_release(spark):
    import os

    import tablewise as tw

    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "x long, t string")
    out = tw.materialize(tw.clean(df))
    assert out.count() == 2
    path = out.inputFiles()[0]
    assert tw.release_materialized(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))


def test_release_unpersists_quantile_helpers(spark):
    import tablewise as tw
    from tablewise import session as S

    df = spark.range(200).selectExpr("cast(id as double) as x")
    tw.quantiles(df, ["x"], [0.5]).collect()
    app = spark.sparkContext.applicationId
    held = list(S._CACHED.get(app, []))
    assert held and all(d.is_cached for d in held)
    tw.release_materialized(spark)
    assert not any(d.is_cached for d in held)
