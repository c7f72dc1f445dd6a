import os

import pytest

from tablewise.sources import readers as SR
from tablewise.sources import sinks as SK

CSV_ORDERS = """OrderID,Customer,Product,Qty,Price,Order_Date,Address,Email
2001,C01,Desk Lamp,1,40.00,2024-03-01,"1 Elm St, Springfield",a@x.org
2002,C02,Chair,2,$80,03/02/2024,"2 Oak St, Springfield",b@x.org
2003,C03,Pen,5,2,2024-03-03,3 Pine Rd,C@X.ORG
2004,C04,Desk Lamp,1,NaN,2024/03/04,4 Birch Ave,N/A
2005,C05,Desk,1,210.5,Missing,5 Cedar Ct,not-an-email
-1,C06,UNKNOWN,0,1.00,2024-03-06,6 Error Way,e@x.org
"""

CSV_PEOPLE = """ID,Name,Age,Team,Pay,Start
1,Ann,31.0,Red,50000.0,2020-01-10
2,Ben,,Blue,61000.0,2019-05-01
3,Cal,44.0,Red,,2021-07-15
4,Dee,27.0,Blue,45000.0,
"""


def _write(tmp_dir, name, text, encoding="utf-8"):
    p = os.path.join(tmp_dir, name)
    with open(p, "w", encoding=encoding) as f:
        f.write(text)
    return p


def test_csv_tokens_and_whole_column_types(spark, tmp_dir):
    df = SR.read_csv(spark, _write(tmp_dir, "orders.csv", CSV_ORDERS))
    t = dict(df.dtypes)
    assert t["OrderID"] == "bigint" and t["Qty"] == "bigint"
    assert t["Price"] == "string"  # '$80' keeps the whole column text
    rows = {r.OrderID: r for r in df.collect()}
    assert rows[2004].Price is None and rows[2004].Email is None  # NaN and N/A are null
    assert rows[2005].Order_Date == "Missing"  # not a null token
    assert rows[2001].Address == "1 Elm St, Springfield"


def test_csv_then_clean_mean(spark, tmp_dir):
    from tablewise.operators.clean import clean

    df = SR.read_csv(spark, _write(tmp_dir, "people.csv", CSV_PEOPLE))
    out = {r.ID: r for r in clean(df, "mean").collect()}
    assert out[2].Age == pytest.approx((31 + 44 + 27) / 3)
    assert out[3].Pay == pytest.approx((50000 + 61000 + 45000) / 3)
    assert out[4].Start == "2019-05-01"
    assert len(out) == 4


def test_latin1_fallback(spark, tmp_dir):
    df = SR.read_csv(spark, _write(tmp_dir, "l1.csv", "name,city\nRené,Orléans\n", encoding="latin-1"))
    r = df.first()
    assert r.name == "René" and r.city == "Orléans"


def test_read_table_dispatch_and_reject(spark, tmp_dir):
    p = _write(tmp_dir, "t.csv", "a,b\n1,x\n")
    assert SR.read_table(spark, p).count() == 1
    with pytest.raises(ValueError):
        SR.read_table(spark, os.path.join(tmp_dir, "t.xlsx"))


def test_jdbc_options():
    o = SR.jdbc_options("jdbc:postgresql://h/db", table="t", user="u", password="p", partition_column="id",
                        lower_bound=0, upper_bound=100, num_partitions=4)
    assert o["dbtable"] == "t" and o["numPartitions"] == "4" and o["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        SR.jdbc_options("jdbc:x", query="select 1", partition_column="id")


def test_json_records_and_sinks(spark, tmp_dir):
    p = _write(tmp_dir, "r.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    df = SR.read_json_records(spark, p)
    assert sorted(r.a for r in df.collect()) == [1, 2]
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    out = os.path.join(tmp_dir, "out_json")
    SK.write_json(nan, out)
    back = spark.read.json(out, schema="v double").collect()
    assert sorted((r.v is None) for r in back) == [False, True, True]
    csv_out = os.path.join(tmp_dir, "out_csv")
    SK.write_csv(df, csv_out)
    assert SR.read_csv(spark, csv_out).count() == 2


def test_records_from_column(spark):
    df = spark.createDataFrame([(1, '[{"k": 1}, {"k": 2}]'), (2, '{"k": 3}')], "id long, payload string")
    out = SR.records_from_column(df, "payload", "k bigint", keep=["id"])
    assert sorted((r.id, r.k) for r in out.collect()) == [(1, 1), (1, 2), (2, 3)]


def test_from_records_and_cut_text(spark):
    df = SR.from_records(spark, [{"a": 1.0, "t": "abcdef"}, {"a": float("nan"), "t": None}], "a double, t string")
    rows = df.collect()
    assert rows[1].a is None  # NaN is missing
    cut = SR.cut_text(df, "t", width=3).collect()
    assert cut[0].t == "abc" and cut[1].t is None


def test_csv_orders_clean_mean_has_no_nulls_and_price_stays_text(spark, tmp_dir):
    from pyspark.sql import functions as F

    from tablewise.operators.clean import clean

    df = SR.read_csv(spark, _write(tmp_dir, "orders2.csv", CSV_ORDERS))
    out = clean(df, "mean")
    assert out.count() == 6
    assert dict(out.dtypes)["Price"] == "string"
    nulls = out.select([F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first()
    assert all(v == 0 for v in nulls)


def test_csv_sink_writes_nested_columns_as_json(spark, tmp_dir):
    from tests.conftest import SF001

    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    out = os.path.join(tmp_dir, "emb_csv")
    SK.write_csv(emb, out)
    back = SR.read_csv(spark, out)
    assert back.count() == emb.count()
    assert back.first().embedding.startswith("[")
