"""Dirty views over the driver tables (the tables themselves hold no nulls or
duplicates).  Each view is defined twice - DataFrame API for Spark and plain
SQL text for the DuckDB oracle - with identical meaning.  Every view covers
the whole table; the modulo tests only choose which cells are made dirty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    null = F.lit(None)
    base = li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_orderkey") % 7 == 0, null.cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 11 == 0, null.cast("double")).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount",
        F.when(F.col("l_suppkey") % 13 == 0, null.cast("string")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        "l_shipdate",
        F.col("l_partkey").cast("string").alias("part_txt"),
        F.when(F.col("l_orderkey") % 997 == 0, F.lit("$75")).otherwise(F.col("l_suppkey").cast("string")).alias("supp_txt"),
    )
    return base.unionByName(base.filter(F.col("l_orderkey") % 50 == 0))


DIRTY_LINEITEM_SQL = """
base AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_orderkey % 7  = 0 THEN NULL ELSE l_quantity      END AS l_quantity,
         CASE WHEN l_partkey  % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
         l_discount,
         CASE WHEN l_suppkey  % 13 = 0 THEN NULL ELSE l_returnflag    END AS l_returnflag,
         l_linestatus, l_shipdate,
         CAST(l_partkey AS VARCHAR) AS part_txt,
         CASE WHEN l_orderkey % 997 = 0 THEN '$75'
              ELSE CAST(l_suppkey AS VARCHAR) END AS supp_txt
  FROM lineitem),
dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 50 = 0)
"""


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with missing values in value and event_type."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("event_id") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
    )


DIRTY_EVENTS_SQL = """
dirty_ev AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS value
  FROM events)
"""


def corr_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem numbers plus derived columns whose correlations fall in each band."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        (F.col("l_quantity") * F.col("l_discount")).alias("qty_disc"),
        (-F.col("l_quantity") * F.col("l_tax")).alias("neg_qty_tax"),
    )


CORR_FRAME_SQL = """
cf AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax,
         l_extendedprice * (1 - l_discount) AS net_price,
         l_quantity * l_discount AS qty_disc,
         -l_quantity * l_tax AS neg_qty_tax
  FROM lineitem)
"""
