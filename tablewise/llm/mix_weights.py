"""Mixing sources to target weights by hash-threshold histograms.

DataFrame functions only.  Every document has a 64-bit hash of its id.  For a
source that needs a part of its words, the documents whose hash lies below a
threshold are taken; the threshold is found without sorting:

1. sum words by (source, leading 12 hash bits) and cumulate: the bucket in
   which the budget is reached is the boundary bucket;
2. sum only the boundary bucket's documents by the next 12 bits: the
   boundary is now 1 part in 2^24 of the source;
3. sum what is left in that bucket by whole hash and put the threshold before the
   document that would pass the budget.

What that document leaves open is a budget of its own: the same three steps run again over
the documents not taken whose size fits into it.  The boundary document itself is taken
where that comes nearer.  The buckets are nested, so a larger budget takes a superset in the first
round.  Every step
is an aggregate that combines map side, so a source holding a third of all rows
costs no more than the others; the filter itself is one comparison per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.common import discard, prepare, read_table, store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Per-source tables up to this many rows and name bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 16 << 20


def _targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """(skey, source, source_size, weight, target): the sources in code point order, null
    last, have ``weights`` repeating and share all words; targets stop at
    ``max_repeat`` times the source and the excess is shared again by weight
    until none is above."""
    # ranks without one global window: ordered ranges, each numbered by itself, plus the rows of the ranges before
    ranged = store(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("rng", F.spark_partition_id()))
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("rng").count().select("rng", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("rng").orderBy(F.col("source").asc_nulls_last())
    rank = F.col("start") + F.row_number().over(within) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = store(ranged.join(F.broadcast(starts), "rng").select("skey", "source", "source_size", weight.alias("weight")))  # one row per range
    discard(ranged)
    cap = (F.col("source_size") * max_repeat).cast("double")
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    share = None  # words per unit of weight
    while True:
        held = F.lit(False) if share is None else (F.col("weight") * share >= cap)
        a = weighed.agg(F.sum(F.when(held, cap)), F.sum(F.when(~held, F.col("weight")))).first()
        new = (total - (a[0] or 0.0)) / a[1] if a[1] else share
        if new == share or new is None:
            break
        share = new
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(share or 0.0), cap))


def _columns(id_col: str, source_col: str, seed: int) -> dict:
    src = F.col(source_col).cast("string")
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    return {
        "skey": F.when(src.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), src)),
        "b1": F.shiftrightunsigned(h, 52).cast("int"),
        "b2": F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(4095)).cast("int"),
        "b3": h.bitwiseAND(F.lit((1 << 40) - 1)),
    }


BAR = "struct<b1:int,b2:int,b3:bigint>"
BARS = f"array<struct<bar:{BAR},cap:bigint>>"


def _below(bars: str = "bars") -> F.Column:
    """Does one of the source's bars take the document: hash below the bar, size within its cap?"""
    return F.exists(F.col(bars), lambda b: (F.struct("b1", "b2", "b3") < b["bar"]) & (F.col("size") <= b["cap"]))


def _thresholds(slim: DataFrame, weights: tuple[float, ...], max_repeat: int, rounds: int):
    """Per source: skey, source_size, target, whole (times every document is taken)
    and bars (which documents are taken once more); and a hint for joining them."""
    sources = slim.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = store(
        _targets(sources, weights, max_repeat)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    n, name_bytes = goal.agg(F.count("*"), F.coalesce(F.sum(F.length("skey")), F.lit(0))).first()

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_SOURCES and 4 * name_bytes <= BROADCAST_BYTES else df

    def boundary(rows: DataFrame, at: list[str], bucket: str) -> DataFrame:
        """Per source the bucket in which the budget ``rest`` is reached, its words and the words before it."""
        sums = rows.groupBy("skey", *at, "rest", bucket).agg(F.sum("size").alias("words"))
        before = Window.partitionBy("skey").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("used", F.coalesce(F.sum("words").over(before), F.lit(0))).where("used <= rest and rest < used + words")

    left = (F.col("rest") - F.col("used")).alias("rest")
    # stops: what to do when the document on the boundary is taken as well, by how far that misses
    state = store(
        goal.where("rest > 0").select("skey", "rest", F.expr(f"cast(array() as {BARS})").alias("bars"), F.expr(f"cast(array() as array<struct<miss:double,bars:{BARS}>>)").alias("stops"))
    )
    for k in range(rounds):
        cap = F.lit((1 << 63) - 1) if k == 0 else F.floor("rest").cast("bigint")
        open_ = slim.join(small(state), "skey").where((F.col("size") > 0) & (F.col("size") <= cap) & ~_below()).select("skey", "rest", "size", "b1", "b2", "b3")
        sums = store(open_.groupBy("skey", "rest", "b1").agg(F.sum("size").alias("size")))  # 4096 rows a source
        first = store(boundary(sums, [], "b1").select("skey", "b1", left))
        second = store(boundary(open_.drop("rest").join(small(first), ["skey", "b1"]), ["b1"], "b2").select("skey", "b1", "b2", left))
        cut = boundary(open_.drop("rest").join(small(second), ["skey", "b1", "b2"]), ["b1", "b2"], "b3").select(
            "skey", F.struct("b1", "b2", "b3").alias("at"), F.struct("b1", "b2", (F.col("b3") + 1).alias("b3")).alias("past"),
            (F.col("rest") - F.col("used")).alias("under"), (F.col("used") + F.col("words") - F.col("rest")).alias("over"),
        )
        total = sums.groupBy("skey").agg(F.sum("size").alias("total"))
        every = F.expr(f"cast(struct(4096, 0, 0) as {BAR})")  # no boundary: all that is open fits

        def bar(c: F.Column, cap: F.Column = cap) -> F.Column:
            return F.concat("bars", F.array(F.struct(c.cast(BAR).alias("bar"), cap.alias("cap"))))

        stop = F.array(F.struct(F.col("over").alias("miss"), bar(F.col("past")).alias("bars")))
        new = store(
            state.join(total, "skey", "left").join(cut, "skey", "left").select(
                "skey",
                F.when(F.col("at").isNotNull(), F.col("under")).when(F.col("total").isNotNull(), F.col("rest") - F.col("total")).otherwise(F.col("rest")).alias("rest"),
                F.when(F.col("at").isNotNull(), bar(F.col("at"))).when(F.col("total").isNotNull(), bar(every)).otherwise(F.col("bars")).alias("bars"),
                F.when(F.col("at").isNotNull(), F.concat("stops", stop)).otherwise(F.col("stops")).alias("stops"),
            )
        )
        for t in (state, sums, first, second):
            discard(t)
        state = new
    best = F.array_min("stops")
    chosen = state.select("skey", F.when(best["miss"] < F.col("rest"), best["bars"]).otherwise(F.col("bars")).alias("bars"))
    bars = store(goal.join(chosen, "skey", "left").select("skey", "source_size", "target", "whole", F.coalesce("bars", F.expr(f"cast(array() as {BARS})")).alias("bars")))
    discard(goal)
    discard(state)
    return bars, small


def _copies() -> F.Column:
    return (F.col("whole") + F.when(_below(), 1).otherwise(0)).cast("int")


def _words(text_col: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    size = _words(text_col)
    named = [c.alias(k) for k, c in _columns(id_col, source_col, seed).items()]
    return store(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *named))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3, seed: int = 11, rounds: int = 3) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``copies`` (0 to ``max_repeat``) is how often the mix holds the document,
    ``taken`` = size * copies.  A null text has size 0; null is a source of its
    own; rows with the same id (null included) are taken or left together; documents
    of size 0 follow the threshold like any other; an empty table gives an
    empty result; further columns are ignored.  What the document on the boundary
    leaves of a budget is filled, in ``rounds`` rounds in all, by documents that fit
    into it; a source misses its target by at most half the words of the
    document(s) on its first boundary, and mostly by much less.
    """
    slim = _sizes(docs, id_col, text_col, source_col, seed)
    bars, small = _thresholds(slim, weights, max_repeat, rounds)
    return slim.join(small(bars), "skey").select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", _copies().alias("copies"), (F.col("size") * _copies()).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3, seed: int = 11, rounds: int = 3) -> DataFrame:
    """The documents themselves, each as often as ``mix`` takes it, with the columns of ``docs``."""
    slim = _sizes(docs, id_col, text_col, source_col, seed)
    bars, small = _thresholds(slim, weights, max_repeat, rounds)
    discard(slim)
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), _words(text_col).alias("size"), *[c.alias(k) for k, c in _columns(id_col, source_col, seed).items()])
    return row.join(small(bars), "skey").select("row", F.explode(F.array_repeat(F.lit(0), _copies()))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents, sources weighing 5, 2, 1 in turn."""
    prepare(spark)
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    prepare(spark)
    return mixed_documents(docs)
