"""Session construction and lineage helpers.

On a cluster the session is created by the platform; ``get_spark`` only
fills in settings that are still unset, so cluster-wide values
(``spark.sql.shuffle.partitions``, ``spark.checkpoint.dir`` ...) win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "tablewise") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, laptops) gets a private folder when the
    setting is unset; on a cluster a machine-local folder would be lost with
    the executor, so an unset value is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) before running multi-pass operators"
            )
        configured = tempfile.mkdtemp(prefix="tablewise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the frame as a Parquet table in the shared
    checkpoint folder and reading it back.

    Used between passes of multi-pass operators: a lost executor then costs
    a re-read of those files, not a replay of earlier shuffles, and later
    passes get column pruning and filter pushdown (an RDD checkpoint would
    be re-read as whole rows).  Types Parquet cannot hold fall back to a
    reliable ``checkpoint()`` in the same folder.
    """
    import uuid

    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    if not _parquet_holds(df.schema):
        return df.checkpoint(eager=True)
    df.write.mode("error").parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    out = df.sparkSession.read.parquet(path)
    out._tablewise_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialize`` returned, once its results are held elsewhere."""
    path = getattr(df, "_tablewise_path", None)
    written = _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [])
    if path in written:
        written.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def _parquet_holds(t: T.DataType) -> bool:
    """Can a Parquet table hold this type (intervals and untyped nulls cannot)?"""
    if isinstance(t, T.StructType):
        return all(_parquet_holds(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _parquet_holds(t.elementType)
    if isinstance(t, T.MapType):
        return _parquet_holds(t.keyType) and _parquet_holds(t.valueType)
    return not isinstance(t, (T.NullType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType))


_WRITTEN: dict[str, list[str]] = {}
_CACHED: dict[str, list[DataFrame]] = {}


def cache_tracked(df: DataFrame) -> DataFrame:
    """Cache a helper table reused by several jobs of one operator (e.g. one
    row per quantile target) and remember it, so ``release_materialized`` can
    unpersist it.  Cached blocks lost with an executor are recomputed."""
    out = df.cache()
    _CACHED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(out)
    return out


def release_materialized(spark: SparkSession) -> int:
    """Delete the tables ``materialize`` wrote and unpersist the helper tables
    ``cache_tracked`` cached for this application (call when the frames derived
    from them are no longer needed).  Returns the number of written tables."""
    for cached in _CACHED.pop(spark.sparkContext.applicationId, []):
        cached.unpersist()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablewise`` importable in Python workers (once per application).

    Operators that run Python in tasks (``mapInPandas``) pickle functions by
    module reference, so executors need the package.  This zips the package
    sources and registers them with ``addPyFile`` - Spark copies the file to
    every executor (the same as ``spark-submit --py-files``).
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import tablewise

    root = os.path.dirname(os.path.abspath(tablewise.__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="tablewise-pkg-"), "tablewise.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
