"""Streaming intake: the row-local cleaning steps on a stream.

The reference is batch-only.  The operators that look at one row at a time -
null tokens (S1), NaN -> NULL (C1), consistent text (E4), Latin-1-safe text
(E7) and JSON-safe numbers (K6) - need no statistics over the table, so they
apply unchanged to a Structured Streaming DataFrame.  Table-wide steps (mean,
mode, de-duplication, retyping) need the whole table and stay batch-only; the
``foreachBatch`` sink below runs them per micro-batch when a caller asks for
it, which is per-batch, not table-wide, semantics.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewise.functions.exprs import json_safe, latin1_safe, nan_to_null, nullify_tokens, standardize_text
from tablewise.operators.clean import _c
from tablewise.session import ensure_checkpoint_dir


def row_local_clean(
    df: DataFrame,
    text_case: str | None = None,
    latin1: bool = False,
    tokens: Sequence[str] | None = None,
) -> DataFrame:
    """Null tokens -> NULL and text standardised (text columns), NaN/Inf ->
    NULL (float columns).  Works on batch and streaming frames alike."""
    out = []
    for f in df.schema.fields:
        c = _c(f.name)
        if isinstance(f.dataType, T.StringType):
            c = standardize_text(nullify_tokens(c, list(tokens) if tokens is not None else None), text_case)
            c = nullify_tokens(c, [""])
            if latin1:
                c = latin1_safe(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = json_safe(nan_to_null(c, f.dataType), f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "csv",
    max_files: int | None = None,
    base_path: str | None = None,
) -> DataFrame:
    """A file stream (csv with header / json / parquet) with a fixed schema.

    ``path`` may be a folder or a glob; ``base_path`` names the folder when
    ``path`` points at files inside it."""
    reader = spark.readStream.schema(schema)
    if base_path:
        reader = reader.option("basePath", base_path)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def start_clean_stream(
    df: DataFrame,
    sink_path: str,
    checkpoint: str | None = None,
    fmt: str = "parquet",
    per_batch: Callable[[DataFrame], DataFrame] | None = None,
    **clean_kwargs,
) -> StreamingQuery:
    """Run ``row_local_clean`` on a stream and append the result to files.

    The checkpoint location defaults to a folder under the shared
    ``spark.checkpoint.dir`` so a restarted query resumes exactly once.
    ``per_batch`` (optional) is applied to each micro-batch before writing; its
    results go to ``batch=<n>`` folders below the sink (read as a column ``batch``).
    """
    cleaned = row_local_clean(df, **clean_kwargs)
    ckpt = checkpoint or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{hashlib.sha256(sink_path.encode()).hexdigest()}"
    if per_batch is None:
        return cleaned.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", ckpt).outputMode("append").start()

    def write(batch: DataFrame, epoch: int) -> None:
        # one folder per micro-batch, overwritten: a batch replayed after a restart is not appended twice
        per_batch(batch).write.mode("overwrite").format(fmt).save(f"{sink_path.rstrip('/')}/batch={epoch}")

    return cleaned.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).start()
