"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into ``blocks`` blocks.  Two fingerprints that differ in at
most ``max_bits`` bits agree in at least ``blocks - max_bits`` whole blocks, so
they share one of the C(blocks, blocks - max_bits) keys made of that many blocks.
The join runs over distinct fingerprints (copies meet in one aggregate before) and
inside sorted runs of equal keys; each run returns a spanning forest of its links
instead of all its pairs.  With 6 blocks and 4 bits a key has about 21 bits.

A key shared by more than ``max_run`` fingerprints is split again by the same
argument on its remaining bits (one of ``max_bits + 1`` pieces must be equal), and
what is still too large is cut into tiles of which every two meet once.  Nothing
is dropped on either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm.common import components, discard, prepare, read_table, store

SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of one text; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) > shingle:
        pairs = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    else:
        pairs = [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _with_fingerprint(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``docs`` with a further column __fp."""
    i = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(i).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], names=[*b.schema.names, "__fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))


def forest(fps: np.ndarray, max_bits: int, step: int = 256) -> np.ndarray:
    """For each fingerprint of a run the position of its component's first member."""
    n = len(fps)
    label = np.arange(n)
    for lo in range(0, n, step):
        near = np.bitwise_count(fps[lo : lo + step, None] ^ fps[None, lo:]) <= max_bits
        for i in range(near.shape[0]):
            mine = label[lo:][near[i]]
            low = mine.min()
            if (mine != low).any():
                label[np.isin(label, mine)] = low
    return label


def _runs(max_bits: int):
    """Links inside runs of equal keys of a partition sorted by (k, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(k, key, fp, rep):
            new = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(k)]))
            out_a, out_b = [], []
            two = ends - starts == 2
            a, b = starts[two], starts[two] + 1
            near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
            out_a.append(rep[a[near]])
            out_b.append(rep[b[near]])
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                label = forest(fp[s:e], max_bits)
                own = np.flatnonzero(label != np.arange(e - s))
                out_a.append(rep[s:e][own])
                out_b.append(rep[s:e][label[own]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["src", "dst"])

        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            rows[2] = rows[2].astype(np.int64).view(np.uint64)
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            k, key = rows[0], rows[1]
            if len(k) == 0:
                continue
            last = (k == k[-1]) & (key == key[-1])
            cut = len(k) - int(last[::-1].argmin() if not last.all() else len(k))  # the last run may go on in the next batch
            held = [x[cut:] for x in rows]
            if cut:
                yield links(*[x[:cut] for x in rows])
        if held and len(held[0]):
            yield links(*held)

    return run


def _bounds(parts: int, width: int = 64) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


def links(reps: DataFrame, max_bits: int = 4, blocks: int = 6, max_run: int = 4096) -> DataFrame:
    """(src, dst) links that connect all of ``reps`` (fp, rep; fp distinct) at ``max_bits``
    or fewer differing bits.  The links form a spanning forest of each key's run."""
    at = _bounds(blocks)
    chosen = list(combinations(range(blocks), blocks - max_bits))
    masks = [sum(((1 << (at[i + 1] - at[i])) - 1) << at[i] for i in c) for c in chosen]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = reps.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(j).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for j, m in enumerate(signed)])).alias("p")
    ).select("p.k", "p.key", "fp", "rep")
    hot = store(keys.groupBy("k", "key").count().where(F.col("count") > max_run))
    spark = reps.sparkSession

    def run(rows: DataFrame) -> DataFrame:
        return rows.repartition("k", "key").sortWithinPartitions("k", "key", "fp").mapInArrow(_runs(max_bits), "src long, dst long")

    if hot.isEmpty():
        return run(keys.select("k", "key", "fp", "rep"))
    plain = keys.join(hot, ["k", "key"], "left_anti").select("k", "key", "fp", "rep")
    # second split: the bits outside the key, cut into max_bits + 1 pieces; pieces[j] are the masks for key j
    pieces = []
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        cut = _bounds(max_bits + 1, len(free))
        pieces.append([sum(1 << b for b in free[cut[i] : cut[i + 1]]) for i in range(max_bits + 1)])
    table = spark.createDataFrame([(j, [x - (1 << 64) if x >> 63 else x for x in p]) for j, p in enumerate(pieces)], "k int, pieces array<long>")  # one row per key kind
    fine = store(
        keys.join(hot.select("k", "key"), ["k", "key"])
        .join(F.broadcast(table), "k")
        .select("k", "key", "fp", "rep", F.posexplode("pieces").alias("piece", "mask"))
        .select("k", F.xxhash64("key", "piece", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "rep")
    )
    large = fine.groupBy("k", "key").count().where(F.col("count") > max_run).withColumn("tiles", F.ceil(F.col("count") / (max_run // 2)).cast("int"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = (
        fine.join(large, ["k", "key"])
        .withColumn("t", tile)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("k", F.xxhash64("key", F.least("t", "o"), F.greatest("t", "o")).alias("key"), "fp", "rep")
    )
    rest = fine.join(large, ["k", "key"], "left_anti").select("k", "key", "fp", "rep")
    return run(plain).union(run(rest)).union(run(tiled))


def _grouped(fp: DataFrame, max_bits: int = 4, blocks: int = 6, max_run: int = 4096) -> DataFrame:
    """(doc_id, fp) plus ``grp``, the smallest fingerprint of the component (null where no document has an id),
    and ``component_id``.  Fingerprints are linked, not ids: different texts under one id are not linked by it."""
    if not 0 <= max_bits < blocks:
        raise ValueError("blocks must be more than max_bits")
    reps = store(fp.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = reps.where("rep is not null").select("fp", F.col("fp").alias("rep"))
    found = store(components(links(named, max_bits, blocks, max_run)))
    at = reps.join(found, reps.fp == found.node, "left").select("fp", "rep", F.when(F.col("rep").isNotNull(), F.coalesce("component", "fp")).alias("grp"))
    low = at.groupBy("grp").agg(F.min("rep").alias("component_id"))
    return fp.join(at.join(low, "grp", "left").select("fp", "grp", "component_id"), "fp").select("doc_id", "fp", "grp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, blocks: int = 6, max_run: int = 4096) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest id reachable over links of
    ``max_bits`` or fewer differing bits; the own id if there is none).

    A null, empty or wordless text has fingerprint 0 and is linked like any other;
    texts of fewer words than a shingle have their whole sequence as only
    shingle; equal texts share a fingerprint; repeated rows stay as rows; rows
    with a null id keep a row and name no component (null if nothing else is
    linked); an empty table gives an empty result; further columns are ignored.
    """
    return _grouped(store(fingerprints(docs, id_col, text_col, shingle)), max_bits, blocks, max_run).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: 4-word shingles, 4 bits, all documents."""
    prepare(spark)
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that of the smallest (id, fingerprint), also
    where ids repeat (of equal rows one); documents without an id stay."""
    prepare(spark)
    fp = store(fingerprints(docs, "doc_id", "text", 4))
    ids = fp.where("doc_id is not null")
    keep = store(_grouped(fp).where("doc_id is not null").groupBy("grp").agg(F.min(F.struct("doc_id", "fp")).alias("m")).select("m.doc_id", "m.fp"))
    # ids of texts with different fingerprints: there the id alone does not say which row stays
    several = store(ids.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id"))
    named = docs.where("doc_id is not null")
    one = named.join(keep.join(several, "doc_id", "left_anti"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    if not several.isEmpty():
        rows = _with_fingerprint(named.join(several, "doc_id", "left_semi").select(*docs.columns), "text", 4)
        kept = rows.join(keep.select("doc_id", F.col("fp").alias("__fp")), ["doc_id", "__fp"], "left_semi").dropDuplicates(["doc_id", "__fp"])
        one = one.unionByName(kept.drop("__fp"))
    return one.unionByName(docs.where("doc_id is null")).select(*docs.columns)
