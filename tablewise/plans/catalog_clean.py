"""Registered queries: cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.operators import clean as C
from tablewise.plans import fixtures as fx
from tablewise.plans.registry import _CLEANED_LINEITEM_SQL, _with, query

_D = fx.DIRTY_LINEITEM_SQL

_ROWCOLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "part_txt", "supp_txt"]


def _rowview(df: DataFrame) -> DataFrame:
    return df.select(
        "l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("l_quantity"),
        F.round("l_extendedprice", 4).alias("l_extendedprice"), "l_returnflag", "part_txt", "supp_txt",
    )


_ROWSQL = (
    "SELECT l_orderkey, l_linenumber, ROUND(l_quantity, 4) AS l_quantity, "
    "ROUND(l_extendedprice, 4) AS l_extendedprice, l_returnflag, part_txt, supp_txt FROM {src}"
)

_NAN_EVENTS_SQL = """
nan_ev AS (
  SELECT event_id,
         CASE WHEN event_id % 10 = 1 THEN CAST('NaN' AS DOUBLE)
              WHEN event_id % 10 = 2 THEN CAST('Infinity' AS DOUBLE)
              ELSE value END AS value
  FROM events)
"""


def nan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.when(F.col("event_id") % 10 == 1, F.lit(float("nan")))
        .when(F.col("event_id") % 10 == 2, F.lit(float("inf")))
        .otherwise(F.col("value"))
        .alias("value"),
    )


@query(
    "c01_nan_to_null",
    _with(_NAN_EVENTS_SQL)
    + "SELECT event_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM nan_ev",
)
def q_c01(spark, sf):
    return C.nan_to_null_all(nan_events(spark, sf))


@query(
    "c02_impute_mean",
    _with(_D, "st AS (SELECT avg(l_quantity) AS mq, avg(l_extendedprice) AS mp FROM dirty)",
          """mrf AS (SELECT l_returnflag AS m FROM dirty WHERE l_returnflag IS NOT NULL
                     GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
          """f AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT mq FROM st)) AS l_quantity,
                  coalesce(l_extendedprice, (SELECT mp FROM st)) AS l_extendedprice,
                  coalesce(l_returnflag, (SELECT m FROM mrf)) AS l_returnflag, part_txt, supp_txt FROM dirty)""")
    + _ROWSQL.format(src="f"),
)
def q_c02(spark, sf):
    return _rowview(C.impute(fx.dirty_lineitem(spark, sf), "mean"))


@query(
    "c03_impute_median",
    _with(_D, "st AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_extendedprice, 0.5) AS mp FROM dirty)",
          """mrf AS (SELECT l_returnflag AS m FROM dirty WHERE l_returnflag IS NOT NULL
                     GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
          """f AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT mq FROM st)) AS l_quantity,
                  coalesce(l_extendedprice, (SELECT mp FROM st)) AS l_extendedprice,
                  coalesce(l_returnflag, (SELECT m FROM mrf)) AS l_returnflag, part_txt, supp_txt FROM dirty)""")
    + _ROWSQL.format(src="f"),
)
def q_c03(spark, sf):
    return _rowview(C.impute(fx.dirty_lineitem(spark, sf), "median"))


@query(
    "c04_impute_mode",
    _with(_D,
          """mq AS (SELECT l_quantity AS m FROM dirty WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
          """mp AS (SELECT l_extendedprice AS m FROM dirty WHERE l_extendedprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
          """mrf AS (SELECT l_returnflag AS m FROM dirty WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
          """f AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT m FROM mq)) AS l_quantity,
                  coalesce(l_extendedprice, (SELECT m FROM mp)) AS l_extendedprice,
                  coalesce(l_returnflag, (SELECT m FROM mrf)) AS l_returnflag, part_txt, supp_txt FROM dirty)""")
    + _ROWSQL.format(src="f"),
)
def q_c04(spark, sf):
    return _rowview(C.impute(fx.dirty_lineitem(spark, sf), "mode"))


@query(
    "c05_impute_text_mode_unknown",
    _with(_D,
          """mrf AS (SELECT l_returnflag AS m FROM dirty WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
          """mst AS (SELECT supp_txt AS m FROM dirty WHERE supp_txt IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
    + """SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, (SELECT m FROM mrf)) AS l_returnflag,
                supp_txt, 'Unknown' AS empty_txt FROM dirty""",
)
def q_c05(spark, sf):
    d = fx.dirty_lineitem(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "supp_txt", F.lit(None).cast("string").alias("empty_txt")
    )
    return C.impute(d, "mean")


@query(
    "c06_drop_null_rows",
    _with(_D) + _ROWSQL.format(src="dirty")
    + " WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL",
)
def q_c06(spark, sf):
    return _rowview(C.impute(fx.dirty_lineitem(spark, sf), "drop"))


@query("c08_dedupe", _with(_D) + _ROWSQL.format(src="(SELECT DISTINCT * FROM dirty)"))
def q_c08(spark, sf):
    return _rowview(C.dedupe(fx.dirty_lineitem(spark, sf)))


@query(
    "c09_duplicate_count",
    _with(_D)
    + """SELECT CAST(count(*) AS BIGINT) AS rows,
                CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS BIGINT) AS distinct_rows,
                CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS BIGINT) AS duplicates
         FROM dirty""",
)
def q_c09(spark, sf):
    return C.duplicate_stats(fx.dirty_lineitem(spark, sf))


@query(
    "c10_retype_numeric_text",
    _with(_D) + "SELECT l_orderkey, l_linenumber, CAST(part_txt AS BIGINT) AS part_txt, supp_txt, "
    "CAST(l_discount AS VARCHAR) AS disc_txt FROM dirty",
)
def q_c10(spark, sf):
    d = fx.dirty_lineitem(spark, sf).select(
        "l_orderkey", "l_linenumber", "part_txt", "supp_txt", F.col("l_discount").cast("string").alias("disc_txt")
    )
    out = C.retype_numeric(d)
    # disc_txt is all numbers, so it comes back as double; shown as text again
    # so both engines print it the same way
    return out.select("l_orderkey", "l_linenumber", "part_txt", "supp_txt", F.col("disc_txt").cast("string").alias("disc_txt"))


_MM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "c11_minmax_scale",
    _with("mm AS (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _MM_COLS) + " FROM lineitem)")
    + "SELECT l_orderkey, "
    + ", ".join(
        f"ROUND(CASE WHEN mx_{c} = mn_{c} THEN NULL ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END, 6) AS {c}" for c in _MM_COLS
    )
    + " FROM lineitem, mm",
)
def q_c11(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", *_MM_COLS)
    out = C.minmax_scale(li, _MM_COLS)
    return out.select("l_orderkey", *[F.round(c, 6).alias(c) for c in _MM_COLS])


@query(
    "c12_clean_rows",
    _with(_D, _CLEANED_LINEITEM_SQL)
    + "SELECT l_orderkey, l_linenumber, ROUND(l_quantity, 4) AS l_quantity, ROUND(l_extendedprice, 4) AS l_extendedprice, "
    "l_returnflag, part_txt, supp_txt FROM cleaned",
)
def q_c12_rows(spark, sf):
    return _rowview(C.clean(fx.dirty_lineitem(spark, sf), strategy="mean"))  # read once: no copy is written


_DATES_SQL = """
dt AS (
  SELECT o_orderkey,
         strftime(o_orderdate, '%m/%d/%Y') AS us_date,
         CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              ELSE strftime(o_orderdate, '%d-%m-%Y') END AS mixed_date
  FROM orders)
"""


@query(
    "c13_parse_text_dates",
    _with(_DATES_SQL)
    + "SELECT o_orderkey, CAST(strptime(us_date, '%m/%d/%Y') AS VARCHAR) AS us_date, mixed_date FROM dt",
)
def q_c13(spark, sf):
    o = fx.table(spark, sf, "orders")
    d = o.select(
        "o_orderkey",
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_date"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
        .alias("mixed_date"),
    )
    out = C.parse_dates(d)
    return out.select("o_orderkey", F.col("us_date").cast("string").alias("us_date"), "mixed_date")
