"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.session import ensure_checkpoint_dir, ship_package

#: One Arrow batch handed to Python holds about so many bytes, however long the texts are.
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the executors, bounded Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back:
    cuts the lineage, and a lost executor costs a re-read of these files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tablewise_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``store`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tablewise_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Connected components of an edge list by large-star / small-star rounds.

    Returns (node, component) for every node of an edge; component is the
    smallest node reachable.  Each round is two min-aggregates (combined map
    side) and two joins; the edge list of a round is a stored table, so nothing
    passes through the driver but one count and checksum per round.  Nulls and
    self links are ignored; repeated links count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    cur, last = store(e.distinct()), None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        new = store(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(cur)
        cur = new
        if tuple(now) == last:
            break
        last = tuple(now)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v"), F.col("v")).distinct())
