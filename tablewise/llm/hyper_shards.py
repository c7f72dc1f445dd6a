"""Uniform sharding through a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes, in four steps:

1. every row belongs to one of P parts by a hash of its key columns;
2. the driver draws the P x S matrix "how many rows of part p go to shard s"
   from the multivariate hypergeometric law, which is exactly the law these
   counts have under a uniform permutation of all rows.  It needs the P part
   sizes only (P is bounded by ``max_parts``, whatever the input size);
3. rows are permuted within their part by a second hash, and the matrix row
   cuts that order into the shards: shard sizes are exact;
4. after the exchange, rows are permuted again within their shard: a third
   hash orders them; its leading bits give buckets whose counts are summed
   up to offsets, so no task ever sorts a whole shard.

Same key columns, seed and shard count give the same result on every run and
for every file layout (rows equal in all key columns are interchangeable).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.common import discard, prepare, read_table, store

#: numpy's sampler takes totals below this; larger ones are drawn by inversion.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good items among n drawn without replacement."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))

    def lchoose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    peak = math.exp(lchoose(good, mode) + lchoose(bad, n - mode) - lchoose(good + bad, n))
    left, up, down = rng.random() - peak, mode, mode
    p_up = p_down = peak
    while left > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) / (up + 1) * (n - up) / (bad - n + up + 1)
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > lo:
            p_down *= down / (good - down + 1) * (bad - n + down) / (n - down + 1)
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of part p for shard s: row sums are ``sizes``, column sums at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    for p, n in enumerate(sizes):
        left, rest = n, sum(room)
        for s in range(shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, left)
            out[p, s] = k
            left -= k
        for s in range(shards):
            room[s] -= int(out[p, s])
    return out


def shuffle_shards(df: DataFrame, keys: list[str], shards: int = 8, seed: int = 7, rows_per_part: int = 20_000, max_parts: int = 65_536) -> DataFrame:
    """All rows of ``df`` plus ``shard`` (int, 0 to shards-1) and ``slot`` (long,
    gapless from 0 in each shard).

    Shard sizes differ by one row at most.  Nulls in key columns are values
    like any other; repeated rows are spread as separate rows; an empty table
    gives an empty result; input columns named ``shard`` or ``slot`` are
    replaced, any other name is kept (helper columns start with ``__tw_``).
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = df.sparkSession
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    base = store(df.select(*cols))
    parts = min(max_parts, max(1, -(-base.count() // rows_per_part)))
    tie = [F.col(c) for c in keys]

    def hashed(salt: int):
        return F.xxhash64(F.lit(seed * 3 + salt), *tie)

    dealt = base.withColumn("__tw_part", F.pmod(hashed(0), F.lit(parts)).cast("int"))
    sizes = {r[0]: r[1] for r in dealt.groupBy("__tw_part").count().collect()}  # at most max_parts rows
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], shards, seed)
    cuts = np.cumsum(matrix, axis=1)[:, :-1]
    plan = spark.createDataFrame([(p, [int(x) for x in cuts[p]]) for p in range(parts)], "__tw_part int, __tw_cuts array<long>")

    local = Window.partitionBy("__tw_part").orderBy(hashed(1), *tie)
    sent = (
        dealt.withColumn("__tw_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(plan), "__tw_part")  # max_parts rows of shards-1 numbers at most
        .withColumn("shard", F.size(F.filter("__tw_cuts", lambda c: c <= F.col("__tw_rank"))).cast("int"))
        .withColumn("__tw_bucket", F.pmod(F.shiftrightunsigned(hashed(2), 16), F.lit(parts)).cast("int"))
    )
    sent = store(sent.select(*cols, "shard", "__tw_bucket"))
    discard(base)
    before = Window.partitionBy("shard").orderBy("__tw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "__tw_bucket").count().select("shard", "__tw_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__tw_off"))
    again = Window.partitionBy("shard", "__tw_bucket").orderBy(hashed(2), *tie)
    return (
        sent.withColumn("__tw_rank", F.row_number().over(again) - 1)
        .join(offsets, ["shard", "__tw_bucket"])
        .select(*cols, "shard", (F.col("__tw_off") + F.col("__tw_rank")).cast("long").alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write the result of ``shuffle_shards`` as ``path/shard=k/``, in slot order
    within each file; file j of a shard holds the slots that leave j modulo
    ``files_per_shard``, so no file has to hold a whole shard."""
    file = F.pmod(F.col("slot"), F.lit(files_per_shard))
    sharded.repartition("shard", file).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents into 8 shards of equal row counts.  A null text has
    size 1 and the checksum of an empty text."""
    prepare(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    return shuffle_shards(slim, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
