"""Registered queries: the row-local cleaning steps run as a Structured
Streaming query (file stream over a driver table -> file sink)."""

from __future__ import annotations

from tablewise.plans.catalog_io import scratch_path
from tablewise.plans.registry import query
from tablewise.streaming.intake import read_stream, start_clean_stream

_TXT = "upper(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


@query(
    "st01_stream_row_local_clean",
    f"SELECT event_id, user_id, {_TXT.format(c='event_type')} AS event_type, value, {_TXT.format(c='props')} AS props FROM events",
)
def q_st01(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a glob that matches the table's file, so the folder is the stream's base
    stream = read_stream(spark, f"{sf}/events.parque[t]", schema, fmt="parquet", base_path=sf)
    sink = scratch_path(spark, "st01")
    q = start_clean_stream(stream, sink, checkpoint=sink + "-checkpoint", text_case="upper")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type", "value", "props")
