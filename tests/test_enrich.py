import pandas as pd
from pyspark.sql import functions as F

from tablewise.operators import enrich as E


def test_batches_of_thirty(spark):
    df = spark.range(95).repartition(2).selectExpr("id", "cast(id as string) as t")

    def fn(pdf):
        return pd.DataFrame({"id": pdf["id"], "n": len(pdf)})

    out = E.enrich_batches(df, fn, "id bigint, n long", batch_size=30)
    rows = out.collect()
    assert len(rows) == 95 and all(r._ok for r in rows)
    assert max(r.n for r in rows) == 30


def test_fallback_whole_table(spark):
    df = spark.range(40).selectExpr("id")

    def fn(pdf):
        if (pdf["id"] == 7).any():
            raise RuntimeError("ERROR: quota")
        return pdf

    out, enhanced, _ = E.enrich_or_fallback(df, fn, max_rows=None)
    assert not enhanced and out.count() == 40
    out2, enhanced2, _ = E.enrich_or_fallback(df, lambda p: p, max_rows=None)
    assert enhanced2 and out2.count() == 40
    _, gated, msg = E.enrich_or_fallback(spark.range(600).selectExpr("id"), lambda p: p, max_rows=E.ROW_GATE)
    assert not gated and "500" in msg
    out3, enhanced3, _ = E.enrich_or_fallback(spark.range(600).selectExpr("id"), lambda p: p)  # no gate unless asked for
    assert enhanced3 and out3.count() == 600


def test_parse_reply_fenced_and_broken(spark):
    df = spark.createDataFrame([(1, 'ok\n```json\n[{"a": 1}, {"a": 2}]\n```'), (2, "ERROR: nope"), (3, "[{broken")], "id long, r string")
    out = E.parse_reply(df, "r", "a bigint", keep=["id"])
    assert sorted((r.id, r.a) for r in out.collect()) == [(1, 1), (1, 2)]
    ok = {r.id: r.parse_ok for r in E.reply_ok(df, "r", "a bigint").collect()}
    assert ok == {1: True, 2: False, 3: False}


def test_text_group_impute_flags(spark):
    df = spark.createDataFrame([("  Hello   World ", "“q”—€™")], "a string, b string")
    r = E.latin1_columns(E.standardize_columns(df, ["a"], case="lower")).first()
    assert r.a == "hello world" and r.b == '"q"-EURTM'
    g = spark.createDataFrame([("x", 1.0), ("x", None), ("y", 5.0), (None, None)], "g string, v double")
    out = sorted((r.g, r.v) for r in E.impute_by_group(g, "v", "g").collect() if r.g is not None)
    assert out == [("x", 1.0), ("x", 1.0), ("y", 5.0)]
    glob = [r.v for r in E.impute_by_group(g, "v", "g").filter(F.col("g").isNull()).collect()]
    assert glob == [3.0]
    flags = E.anomaly_flags(spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")).collect()
    assert [r.v_outlier for r in flags] == [False, False, False, False, True]


def test_ledger_repeats_only_what_is_missing(spark, tmp_dir):
    import os

    calls, ledger = tmp_dir + "/calls", tmp_dir + "/ledger"
    os.makedirs(calls)
    df = spark.range(0, 100, 1, 2).selectExpr("id", "cast(id % 7 as string) as t", "if(id = 3, null, id * 1.5D) as v")

    def flaky(pdf):
        first = int(pdf["id"].min())
        n = sum(f.startswith(f"{first}_") for f in os.listdir(calls))
        open(f"{calls}/{first}_{n}", "w").close()
        if n == 0 or (first == 50 and n < 4):
            raise ValueError(f"busy {first}")
        return pdf.assign(n=len(pdf))

    schema = "id long, t string, v double, n long"
    # chunks begin at 0, 30, 50, 80; each fails once, that of 50 more often than it is tried
    out, enhanced, why = E.enrich_or_fallback(df, flaky, schema, ledger=ledger, attempts=2)
    assert not enhanced and "ValueError: busy 50" in why and out.count() == 100 and len(os.listdir(calls)) == 8
    rows = E.enrich_recorded(df, flaky, schema, ledger, attempts=1)  # another failure of that chunk, no call for the others
    assert rows.where("not _ok").count() == 1 and rows.where("_ok").count() == 70 and len(os.listdir(calls)) == 9
    out, enhanced, _ = E.enrich_or_fallback(df, flaky, schema, ledger=ledger, attempts=2)
    got = sorted(map(tuple, out.collect()))
    assert enhanced and got == [(i, str(i % 7), None if i == 3 else i * 1.5, 30 if i % 50 < 30 else 20) for i in range(100)]
    made = len(os.listdir(calls))
    assert E.enrich_or_fallback(df, flaky, schema, ledger=ledger)[1] and len(os.listdir(calls)) == made


def test_ledger_equal_chunks_empty_replies_and_no_rows(spark, tmp_dir):
    same = spark.range(0, 120, 1, 4).selectExpr("cast(null as string) as a", "1 as b")
    out = E.enrich_recorded(same, lambda p: p, "a string, b int", tmp_dir + "/l1", batch_size=10, wave=1)
    assert out.where("_ok and a is null and b = 1").count() == 120  # one call, a row for every row
    none = E.enrich_recorded(same, lambda p: p.iloc[:0], "a string, b int", tmp_dir + "/l2")
    assert none.count() == 0
    assert E.enrich_recorded(same.limit(0), lambda p: p, "a string, b int", tmp_dir + "/l3").count() == 0
    bad = E.enrich_recorded(same, lambda p: "ERROR: quota", "a string, b int", tmp_dir + "/l4", attempts=2)
    assert {r._error for r in bad.collect()} == {"ERROR: quota"} and bad.where("_ok").count() == 0
