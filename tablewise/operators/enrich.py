"""Enrichment operators E1-E7.

The reference sends rows in batches of 30 to a hosted model.  Here the model
call is the caller's function, run per partition with ``mapInPandas`` (Arrow
batches, no per-row Python), and the deterministic parts of what the prompt
asks for (consistent text, contextual imputation, anomaly flags) are plain
Spark expressions and aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import is_numeric_type, latin1_safe, nan_to_null, standardize_text
from tablewise.operators.clean import _c, _types
from tablewise.operators.quantiles import broadcastable
from tablewise.operators.stats import iqr_bounds, _num
from tablewise.session import materialize, release, ship_package

BATCH_SIZE = 30
ROW_GATE = 500
ERROR_PREFIX = "ERROR:"
OK_COL = "_ok"
ERROR_COL = "_error"
CHUNK_COL, PLACE_COL = "_chunk", "_place"


# ---------------------------------------------------------------------------
# E1 / E3 / R9
# ---------------------------------------------------------------------------


def _as_struct(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, str):
        return T.StructType.fromDDL(schema)
    return schema


def enrich_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    batch_size: int = BATCH_SIZE,
    error_col: str | None = None,
) -> DataFrame:
    """Run ``fn`` on chunks of ``batch_size`` rows inside each partition.

    ``fn`` gets a pandas DataFrame and returns one with the columns of
    ``schema``.  A chunk whose call raises, or whose reply is a text starting
    with ``ERROR:``, yields one marker row with ``_ok = false``; every other
    output row has ``_ok = true``.  Chunks run in parallel across partitions.
    ``error_col`` names a column for the error of a failed chunk.
    """
    ship_package(df.sparkSession)
    out_schema = _as_struct(schema)
    call = _call(fn, out_schema.fieldNames())

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        out = call(chunk)
        return out.rename(columns={ERROR_COL: error_col}) if error_col else out.drop(columns=ERROR_COL)

    full = _reply_fields(out_schema)
    if error_col:
        full = full.add(error_col, T.StringType(), True)

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            buf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            whole = len(buf) - len(buf) % batch_size
            for s in range(0, whole, batch_size):
                yield run(buf.iloc[s : s + batch_size])
            rest = buf.iloc[whole:] if whole < len(buf) else None
        if rest is not None:
            yield run(rest)

    return df.mapInPandas(per_partition, full)


def _reply_fields(schema: T.StructType) -> T.StructType:
    """The output fields and ``_ok``; marker rows of failed chunks hold NULLs, so every output field is nullable."""
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    return T.StructType([*fields, T.StructField(OK_COL, T.BooleanType(), False)])


def _call(fn: Callable[[pd.DataFrame], pd.DataFrame], names: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``fn`` on one chunk: the columns ``names``, ``_ok`` and ``_error``; one marker row if the call failed."""

    def failed(why: str) -> pd.DataFrame:
        return pd.DataFrame({**{n: [None] for n in names}, OK_COL: [False], ERROR_COL: [why]})

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        try:
            res = fn(chunk.reset_index(drop=True))
        except Exception as e:  # noqa: BLE001 - any failure means fall back
            return failed(f"{type(e).__name__}: {e}")
        if isinstance(res, str):  # a raw reply text, e.g. "ERROR: ..."
            return failed(res)
        if not isinstance(res, pd.DataFrame):
            return failed("reply is not a table")
        missing = [n for n in names if n not in res.columns]
        if missing:
            return failed(f"reply lacks {', '.join(missing)}")
        return res[list(names)].assign(**{OK_COL: True, ERROR_COL: None})

    return run


def enrich_recorded(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    ledger: str,
    batch_size: int = BATCH_SIZE,
    attempts: int = 3,
    wave: int = 100_000,
) -> DataFrame:
    """E1 with a call ledger: the rows of ``enrich_batches`` and ``_error``, replies kept in the folder ``ledger``.

    The table is cut into chunks once; a chunk's name is a digest of its rows.  Chunks
    without a reply in the ledger are called, about ``wave`` of them per job, and each job's replies
    are added to the ledger when it ends: a failed job or a later run repeats only what is
    missing.  A chunk that failed is called again, ``attempts`` times in all.  Equal
    chunks are called once.  ``ledger`` is a folder all executors share; use another one for
    another function.  An empty table gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    out_schema = _as_struct(schema)
    names, columns = out_schema.fieldNames(), df.columns
    call = _call(fn, names)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def named(chunk: pd.DataFrame) -> pd.DataFrame:
            name = hashlib.sha256("\n".join(chunk[CHUNK_COL]).encode()).hexdigest()
            return chunk.assign(**{CHUNK_COL: name, PLACE_COL: range(len(chunk))})

        rest: pd.DataFrame | None = None
        for pdf in batches:
            buf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            whole = len(buf) - len(buf) % batch_size
            for at in range(0, whole, batch_size):
                yield named(buf.iloc[at : at + batch_size])
            rest = buf.iloc[whole:] if whole < len(buf) else None
        if rest is not None:
            yield named(rest)

    row_digest = F.sha2(F.to_json(F.struct(*[_c(n) for n in columns]), {"ignoreNullFields": "false"}), 256)
    rows = df.select("*", row_digest.alias(CHUNK_COL))
    chunked = materialize(rows.mapInPandas(cut, T.StructType([*rows.schema.fields, T.StructField(PLACE_COL, T.IntegerType())])))

    kept = _reply_fields(out_schema).add(ERROR_COL, T.StringType()).add(CHUNK_COL, T.StringType()).add(PLACE_COL, T.IntegerType())

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        res = call(pdf.sort_values(PLACE_COL)[columns])
        res = res.assign(**{PLACE_COL: range(len(res))})
        mark = pd.DataFrame({**{n: [None] for n in names}, OK_COL: [bool(res[OK_COL].all())], ERROR_COL: res[ERROR_COL].iloc[:1].tolist() or [None], PLACE_COL: [-1]})
        # a failed chunk is its mark alone, a good one its mark and its rows
        out = pd.concat([mark, res] if mark[OK_COL].iloc[0] else [mark])
        return out.assign(**{CHUNK_COL: key[0]})[kept.names]

    def replies() -> DataFrame:
        return spark.read.schema(kept).parquet(ledger)

    spark.createDataFrame([], kept).write.mode("append").parquet(ledger)  # the folder exists from here on
    chunks = chunked.where(F.col(PLACE_COL) == 0).select(CHUNK_COL)
    done = replies().where((F.col(PLACE_COL) == -1) & F.col(OK_COL)).select(CHUNK_COL)
    for _ in range(attempts):
        open_ = materialize(chunks.distinct().join(done.distinct(), CHUNK_COL, "left_anti"))
        waves = -(-open_.count() // wave)
        for w in range(waves):
            part = open_.where(F.pmod(F.xxhash64(CHUNK_COL), F.lit(waves)) == w)
            todo = chunked.join(part, CHUNK_COL, "left_semi").dropDuplicates([CHUNK_COL, PLACE_COL])
            todo.groupBy(CHUNK_COL).applyInPandas(answer, kept).write.mode("append").parquet(ledger)
        release(open_)
        done = replies().where((F.col(PLACE_COL) == -1) & F.col(OK_COL)).select(CHUNK_COL)
        if not waves:
            break
    good = replies().where(F.col(OK_COL) & (F.col(PLACE_COL) >= 0)).dropDuplicates([CHUNK_COL, PLACE_COL])
    bad = replies().where(~F.col(OK_COL)).join(done.distinct(), CHUNK_COL, "left_anti").dropDuplicates([CHUNK_COL])
    return chunks.join(good.unionByName(bad), CHUNK_COL).select(*[_c(n) for n in names], OK_COL, ERROR_COL)


def row_gate(df: DataFrame, limit: int = ROW_GATE) -> bool:
    """True when the table has at most ``limit`` rows (never a full count)."""
    return df.limit(limit + 1).count() <= limit


def enrich_or_fallback(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str | None = None,
    batch_size: int = BATCH_SIZE,
    max_rows: int | None = None,
    ledger: str | None = None,
    attempts: int = 3,
) -> tuple[DataFrame, bool, str]:
    """Enrich, or return ``df`` unchanged if ANY batch failed.

    Returns ``(frame, enhanced, message)``.  The enriched result is
    checkpointed before the all-ok check so ``fn`` runs once per chunk.
    Tables of any size are enriched; a caller with a row budget passes
    ``max_rows`` (R9 gate, e.g. ``ROW_GATE``).  With ``ledger`` (a shared folder) replies are
    kept and failed chunks called ``attempts`` times (``enrich_recorded``).  The message of a
    failure holds one error text.
    """
    if max_rows is not None and not row_gate(df, max_rows):
        return df, False, f"more than {max_rows} rows: rule-based result"
    sch = _as_struct(schema) if schema is not None else df.schema
    calls = enrich_recorded(df, fn, sch, ledger, batch_size, attempts) if ledger else enrich_batches(df, fn, sch, batch_size, ERROR_COL)
    enriched = materialize(calls)
    state = enriched.agg(F.coalesce(F.bool_and(OK_COL), F.lit(True)).alias("ok"), F.min(ERROR_COL).alias("why")).first()
    if not state["ok"]:
        return df, False, f"enrichment failed for at least one batch ({state['why']}): rule-based result"
    return enriched.filter(F.col(OK_COL)).drop(OK_COL, ERROR_COL), True, "enriched"


# ---------------------------------------------------------------------------
# E2  reply parsing
# ---------------------------------------------------------------------------

FENCE = r"```[A-Za-z0-9_-]*\s*([\s\S]*?)```"
BRACKETS = {"array": ("[", "]"), "object": ("{", "}")}


def _outermost(text: Column, kind: str) -> Column:
    """From the first opening bracket to the last closing one (NULL if there is no such pair)."""
    left, right = BRACKETS[kind]
    start = F.locate(left, text)
    stop = F.length(text) - F.locate(right, F.reverse(text)) + 1
    return F.when((start > 0) & (F.locate(right, text) > 0) & (stop >= start), F.substring(text, start, stop - start + 1))


def reply_body(reply: Column, kind: str = "array") -> Column:
    """The JSON text of a reply (NULL if there is none): the body of a code fence if it holds
    valid JSON of the wanted kind, else the outermost brackets of the fence, else those of the
    whole reply - so brackets in the prose around a fence do no harm."""
    fenced = F.regexp_extract(reply, FENCE, 1)

    def valid(text: Column) -> Column:
        t = F.trim(text)
        return F.when(t.startswith(BRACKETS[kind][0]) & F.get_json_object(t, "$").isNotNull(), t)

    return F.coalesce(valid(fenced), valid(_outermost(fenced, kind)), valid(_outermost(reply, kind)))


def parse_reply(df: DataFrame, col: str, schema: T.StructType | str, kind: str = "array", keep: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """Text reply -> rows, parsed with ``schema`` (the element struct), next to
    the ``keep`` columns: one row per element of an array reply, one row per
    object reply.

    A reply without valid JSON gives no row (``reply_ok`` tells which).  A field that
    is missing, null or of another type is NULL in its row; the row stays.
    ``position`` names a column for the element's place in its array.
    """
    elem = _as_struct(schema)
    body = reply_body(_c(col), kind)
    rows = df.select(*[_c(k) for k in keep], body.alias("__body")).filter(F.col("__body").isNotNull())
    if kind == "array":
        parsed = F.from_json("__body", T.ArrayType(elem))
        rows = rows.select(*[_c(k) for k in keep], F.posexplode(parsed).alias("__pos", "__o"))
    else:
        rows = rows.select(*[_c(k) for k in keep], F.lit(0).alias("__pos"), F.from_json("__body", elem).alias("__o"))
    fields = [F.col("__o")[f.name].alias(f.name) for f in elem.fields]
    return rows.select(*[_c(k) for k in keep], *([F.col("__pos").alias(position)] if position else []), *fields)


def reply_ok(df: DataFrame, col: str, schema: T.StructType | str, kind: str = "array") -> DataFrame:
    """Per-row flag: does the reply parse (feeds the E3 decision)."""
    elem = _as_struct(schema)
    target = T.ArrayType(elem) if kind == "array" else elem
    ok = ~F.trim(_c(col)).startswith(ERROR_PREFIX) & F.from_json(reply_body(_c(col), kind), target).isNotNull()
    return df.withColumn("parse_ok", F.coalesce(ok, F.lit(False)))


# ---------------------------------------------------------------------------
# E4 / E7 text
# ---------------------------------------------------------------------------


def standardize_columns(df: DataFrame, cols: Sequence[str] | None = None, case: str | None = None) -> DataFrame:
    """Trim + collapse whitespace (+ case) for text columns."""
    types = _types(df)
    cols = [n for n in (cols or types) if isinstance(types[n], T.StringType)]
    return df.select(*[standardize_text(_c(n), case).alias(n) if n in cols else _c(n) for n in types])


def latin1_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Smart punctuation to Latin-1, other non-Latin-1 characters to '?'."""
    types = _types(df)
    cols = [n for n in (cols or types) if isinstance(types[n], T.StringType)]
    return df.select(*[latin1_safe(_c(n)).alias(n) if n in cols else _c(n) for n in types])


# ---------------------------------------------------------------------------
# E5  contextual imputation
# ---------------------------------------------------------------------------


def impute_by_group(df: DataFrame, col: str, by: str | Sequence[str], stat: str = "mean") -> DataFrame:
    """E5: fill ``col`` from the row's group (mean for numbers, mode otherwise),
    else from the whole column.  Rows whose group key is NULL use the global
    value.  The per-group table is one aggregate (partial-combined, so a hot
    group costs one row per partition) and is broadcast only when its measured
    size is within a fixed bound; otherwise it is a shuffle join (AQE splits
    skewed partitions)."""
    orig_keys = [by] if isinstance(by, str) else list(by)
    keys = [f"__k{i}" for i in range(len(orig_keys))]
    original = df
    dt = _types(df)[col]
    # NaN is missing here as everywhere
    df = df.select(*[nan_to_null(_c(n), t).alias(n) if n == col else _c(n) for n, t in _types(df).items()])
    df = df.select("*", *[_c(k).alias(s) for k, s in zip(orig_keys, keys)])
    numeric = is_numeric_type(dt)
    if stat not in ("mean", "mode"):
        raise ValueError("stat must be 'mean' or 'mode'")
    if numeric and stat == "mean":
        x = _num(df, col)
        grp = df.groupBy(*keys).agg(F.avg(x).alias("__g"))
        glob = df.agg(F.avg(x).alias("v")).first()["v"]
        fill_type = "double"
    else:
        vc = df.filter(_c(col).isNotNull()).groupBy(*keys, _c(col).alias("__x")).agg(F.count("*").alias("__n"))
        vc = materialize(vc)  # per (group, value) counts, which grow with the table: both modes come from it
        grp = vc.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__x").alias("v"))).alias("__m")).select(
            *keys, F.col("__m.v").alias("__g")
        )
        # the global mode from the same counts (ties -> smallest value)
        glob_row = (
            vc.groupBy("__x").agg(F.sum("__n").alias("__n"))
            .agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__x").alias("v"))).alias("__m"))
            .first()
        )
        glob = glob_row["__m"]["v"] if glob_row["__m"] is not None else None
        fill_type = dt
    for k in keys:
        grp = grp.filter(F.col(k).isNotNull())
    small = F.broadcast(grp) if broadcastable(grp, [*keys, "__g"]) else grp
    j = df.join(small, keys, "left")
    base = _c(col).cast("double") if (numeric and stat == "mean") else _c(col)
    filled = F.coalesce(base, F.col("__g").cast(fill_type), F.lit(glob).cast(fill_type))
    return j.select(*[filled.alias(n) if n == col else _c(n) for n in original.columns])


# ---------------------------------------------------------------------------
# E6  anomaly flags
# ---------------------------------------------------------------------------


def anomaly_flags(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Add ``<col>_outlier`` booleans using the IQR fences of A9.

    Columns without fences (< 4 values or IQR 0) get all-false flags."""
    types = _types(df)
    num = [n for n in (cols or types) if is_numeric_type(types[n])]
    bounds = {b["column"]: b for b in iqr_bounds(df, num, approx=approx)}
    flags = []
    for n in num:
        if n in bounds:
            x = _num(df, n)
            f = F.coalesce((x < F.lit(bounds[n]["lower"])) | (x > F.lit(bounds[n]["upper"])), F.lit(False))
        else:
            f = F.lit(False)
        flags.append(f.alias(f"{n}_outlier"))
    return df.select("*", *flags)
