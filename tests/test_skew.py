"""Hot keys: one value holding a third of the rows must not fill one task."""

from pyspark.sql import functions as F

from tablewise.operators import profile as P
from tablewise.operators.stats import box_stats, sorted_by


def _hot(spark, n=60000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        (F.col("id") % 997).cast("double").alias("v"),
    )


def test_range_sort_spreads_a_hot_key(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        d = sorted_by(_hot(spark), "k")
        sizes = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 60000 / 3 * 0.6
        ks = [r.k for r in d.select("k").collect()]
        assert ks == sorted(ks)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_group_statistics_are_whole(spark):
    df = _hot(spark)
    b = {r.g: r for r in box_stats(df, "v", by="g").collect()}
    assert b["hot"].n == 20000
    top = P.top_values(df, ["g"], k=1).first()
    assert top.value == "hot" and top["count"] == 20000
