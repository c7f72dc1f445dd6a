"""Exact (linear-interpolated) and approximate quantiles, distributed.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group in
one hash map, so a 100 TB column with billions of distinct values would land
in one task.  ``quantiles(approx=False)`` never needs that map.  One loop serves
every size:

1. Long form ``(by..., column, v)`` of the numeric columns; one scan gives each
   group's row count and a ``percentile_approx`` grid (a bounded-memory
   sketch, combined partially per partition).
2. Each target rank (floor/ceil of h = (n-1)*p) gets a bracket from its
   grid, widened by twice the sketch's rank error; edge buckets stay open.
3. A target whose bracket is expected to hold more than ``max_candidates`` rows
   goes through one more scan, which at once counts the rows below and inside
   the bracket (the check) and sketches the rows inside (the next grid).  A
   bracket that fails its check is widened and goes round again; one that holds
   is narrowed further.  A bracket that cannot shrink consists of heavy values.
4. Selection: rows below the bracket collapse into ONE NULL-keyed count per
   target and rows inside it into (value, multiplicity), both combined map side;
   a running count in value order gives the exact order statistics,
   interpolated linearly (pandas / DuckDB ``quantile_cont`` semantics).  A bracket
   that missed a rank shows as a missing pick; its target is widened and goes
   round again.

A selection window holds the distinct values of one target's bracket: at most
about ``max_candidates`` rows, and for brackets of heavy values the few
values that remain after combining.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.exprs import nan_to_null
from tablewise.session import cache_tracked, materialize

SKETCH_ACCURACY = 10000  # of approximate quantiles
# brackets: a coarse sketch is cheap, its brackets hold about 1.5% of the rows
BRACKET_BUCKETS = 200
BRACKET_ACCURACY = 2000
# a helper table is broadcast up to this many bytes (rows and key text measured)
BROADCAST_BYTES = 64 << 20


def long_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), translate: bool = True) -> DataFrame:
    """Unpivot numeric columns to ``(by..., column, __v double)`` without NULL/NaN.

    ``by`` columns keep their names; callers pass internal (safe) names."""
    from tablewise.operators.clean import _c, long_form

    types = {f.name: f.dataType for f in df.schema.fields}
    named = [(c, nan_to_null(_c(c).cast("double"), types[c])) for c in cols]
    return long_form(df, named, ids=[_c(b) for b in by], val="__v", translate=translate).filter(F.col("__v").isNotNull())


def broadcastable(df: DataFrame, text: Sequence[str] = ()) -> bool:
    """Is this helper table small enough to broadcast?  Rows count 64 bytes each
    plus the text of the ``text`` columns (four bytes a character)."""
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in text), F.lit(0))
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("chars")).first()
    return 64 * r["n"] + 4 * r["chars"] <= BROADCAST_BYTES


def _join_small(big: DataFrame, small: DataFrame, on: list[str], fits: bool, how: str = "inner") -> DataFrame:
    """Join a large frame to a small one; broadcast only under a measured bound.  A NULL group meets itself."""
    own = {k: f"__at{i}" for i, k in enumerate(on)}
    small = small.select(*[F.col(k).alias(a) for k, a in own.items()], *[c for c in small.columns if c not in own])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(a)) if k.startswith("__by") else F.col(k) == F.col(a) for k, a in own.items()])
    return big.join(F.broadcast(small) if fits else small, same, how).drop(*own.values())


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = SKETCH_ACCURACY,
    max_candidates: int = 1_000_000,
) -> DataFrame:
    """Quantiles of each numeric column (per ``by`` group).

    Returns ``(by..., column, p, value, n)``: one row per group, column and
    probability that has at least one non-null value.
    """
    cols = list(cols)
    if not cols:
        raise ValueError("no columns")
    orig_by = list(by)
    if orig_by:
        from tablewise.operators.clean import _c

        safe_by = [f"__by{i}" for i in range(len(orig_by))]
        df = df.select(*[_c(b).alias(s) for b, s in zip(orig_by, safe_by)], *[_c(c) for c in cols])
        res = _quantiles(df, cols, probs, safe_by, approx, accuracy, max_candidates)
        return res.select(*[F.col(s).alias(b) for b, s in zip(orig_by, safe_by)], "column", "p", "value", "n")
    return _quantiles(df, cols, probs, [], approx, accuracy, max_candidates)


def _quantiles(df, cols, probs, by, approx, accuracy, max_candidates) -> DataFrame:
    from tablewise.operators.clean import name_of

    # internal column aliases throughout; names are restored on the result
    to_name = name_of([(c, None) for c in cols])
    res = _quantiles_internal(df, cols, probs, by, approx, accuracy, max_candidates)
    return res.withColumn("column", to_name(F.col("column")))


def _quantiles_internal(df, cols, probs, by, approx, accuracy, max_candidates) -> DataFrame:
    keys = [*by, "column"]
    long = long_numeric(df, cols, by, translate=False)
    probs_col = F.array(*[F.lit(float(p)) for p in probs])

    if approx:
        agg = long.groupBy(*keys).agg(
            F.percentile_approx("__v", probs_col, accuracy).alias("qs"), F.count("*").alias("n")
        )
        return agg.select(
            *keys, "n", F.explode(F.arrays_zip(probs_col.alias("p"), F.col("qs").alias("q"))).alias("__z")
        ).select(*keys, F.col("__z.p").alias("p"), F.col("__z.q").cast("double").alias("value"), "n")

    return _exact(long, keys, probs, max_candidates)


def _bracketed(tgt: DataFrame) -> DataFrame:
    """Add ``__blo``/``__bhi`` (NULL = open), the rows expected inside and whether
    the bracket is narrower than the range ``[__lo, __hi]`` its grid describes."""
    nb = BRACKET_BUCKETS
    m, lo, hi = F.col("__m"), F.col("__lo"), F.col("__hi")
    slack = (F.ceil(m / F.lit(BRACKET_ACCURACY)) * 2 + 2) * F.col("__wide")
    i_lo = F.greatest(F.lit(0), F.floor((F.col("__klo") - F.col("__base") - slack) / m * nb)).cast("int")
    i_hi = F.least(F.lit(nb), F.ceil((F.col("__khi") - F.col("__base") + 1 + slack) / m * nb)).cast("int")
    blo = F.when(i_lo > 0, F.element_at("__grid", i_lo + 1)).otherwise(lo)
    bhi = F.when(i_hi < nb, F.element_at("__grid", i_hi + 1)).otherwise(hi)
    return tgt.withColumns(
        {
            "__blo": blo,
            "__bhi": bhi,
            "__est": (i_hi - i_lo) / F.lit(nb) * m + slack * 2,
            "__shrinks": ~(blo.eqNullSafe(lo) & bhi.eqNullSafe(hi)),
        }
    )


def _in(v, lo: str, hi: str):
    return (F.col(lo).isNull() | (v >= F.col(lo))) & (F.col(hi).isNull() | (v <= F.col(hi)))


def _exact(long: DataFrame, keys: list[str], probs, max_candidates: int) -> DataFrame:
    grid = F.array(*[F.lit(i / BRACKET_BUCKETS) for i in range(BRACKET_BUCKETS + 1)])
    v = F.col("__v")
    sk = long.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", grid, BRACKET_ACCURACY).alias("__grid"))
    pos = (F.col("n") - 1).cast("double") * F.col("p")
    tgt = (
        sk.select(*keys, "n", "__grid", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
        .withColumns({"__pos": pos, "__klo": F.floor(pos).cast("long"), "__khi": F.ceil(pos).cast("long"), "__m": F.col("n")})
        .withColumns({"__base": F.lit(0).cast("long"), "__wide": F.lit(1).cast("long"), "__lo": F.lit(None).cast("double"), "__hi": F.lit(None).cast("double")})
    )
    tkeys = [*keys, "p"]
    state = [*tkeys, "n", "__pos", "__klo", "__khi", "__m", "__base", "__wide", "__lo", "__hi"]
    done: list[DataFrame] = []
    level = 0
    while True:
        tgt = _bracketed(tgt)
        # written, not cached: a grouped join renames its keys, and the planner then no longer finds cached rows.
        # Later rounds keep the grid as well; the common single round stores narrow rows
        held = materialize(tgt.drop("__grid")) if level == 0 else tgt
        big = (F.col("__est") > max_candidates) & F.col("__shrinks")
        size = sum((F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0))
        s = held.agg(F.count("*").alias("t"), F.count_if(big).alias("big"), F.coalesce(F.sum(size), F.lit(0)).alias("chars")).first()
        fits = 64 * s["t"] + 4 * s["chars"] <= BROADCAST_BYTES
        ready = held.filter(~big)
        if s["big"]:
            if level == 0:
                tgt = materialize(tgt)
                ready = tgt.filter(~big)
            rough = tgt.filter(big)
            scan = (
                _join_small(long, rough.select(*tkeys, "__lo", "__hi", "__blo", "__bhi"), keys, fits)
                .filter(_in(v, "__lo", "__hi"))
                .groupBy(*tkeys)
                .agg(
                    F.count_if(v < F.col("__blo")).alias("__below"),
                    F.count_if(_in(v, "__blo", "__bhi")).alias("__inside"),
                    F.percentile_approx(F.when(_in(v, "__blo", "__bhi"), v), grid, BRACKET_ACCURACY).alias("__next"),
                )
            )
            at = F.col("__base") + F.col("__below")
            holds = (at <= F.col("__klo")) & (F.col("__khi") < at + F.col("__inside"))
            new = {
                "__lo": F.when(holds, F.col("__blo")).otherwise(F.col("__lo")),
                "__hi": F.when(holds, F.col("__bhi")).otherwise(F.col("__hi")),
                "__base": F.when(holds, at).otherwise(F.col("__base")),
                "__m": F.when(holds, F.col("__inside")).otherwise(F.col("__m")),
                "__grid": F.when(holds, F.col("__next")).otherwise(F.col("__grid")),
                "__wide": F.when(holds, F.lit(1)).otherwise(F.col("__wide") * 4).cast("long"),
            }
            narrowed = _join_small(rough, scan, tkeys, fits).select(*[new.get(c, F.col(c)).alias(c) for c in [*state, "__grid"]])
            after = materialize(narrowed)
        else:
            after = None
        if not s["t"] and not done:  # no group has a value
            return held.select(*tkeys, F.col("__pos").alias("value"), "n")
        if s["t"] > s["big"]:
            res, missed = _select(long, ready, keys, fits)
            done.append(res)
            if missed is not None:  # widen these and go round again
                grids, on = (sk.select(*keys, "__grid"), keys) if level == 0 and not s["big"] else (tgt.select(*tkeys, "__grid"), tkeys)
                again = _join_small(missed, grids, on, fits)
                again = materialize(again.withColumn("__wide", F.col("__wide") * 4).select(*state, "__grid"))
                after = again if after is None else after.unionByName(again)
        if after is None:
            break
        tgt, level = after, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _select(long: DataFrame, tgt: DataFrame, keys: list[str], fits: bool) -> tuple[DataFrame, DataFrame | None]:
    """Exact order statistics inside each target's bracket: the result rows and
    the targets whose bracket missed a rank (None if there are none)."""
    tkeys = [*keys, "p"]
    v = F.col("__v")
    j = _join_small(long, tgt.select(*tkeys, "__blo", "__bhi"), keys, fits)
    inside = _in(v, "__blo", "__bhi")
    cand = j.filter(inside | (v < F.col("__blo"))).groupBy(*tkeys, F.when(inside, v).alias("__cv")).agg(F.count("*").alias("__c"))
    # NULL (= below the bracket) sorts first, so its count is the rank offset
    w = Window.partitionBy(*tkeys).orderBy(F.col("__cv").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("__start", F.sum("__c").over(w) - F.col("__c")).filter(F.col("__cv").isNotNull())

    def at(k: str):
        hit = (F.col("__start") <= F.col(k)) & (F.col(k) < F.col("__start") + F.col("__c"))
        return F.max(F.when(hit, F.col("__cv")))

    picked = _join_small(cand, tgt.select(*tkeys, "__klo", "__khi"), tkeys, fits).groupBy(*tkeys).agg(at("__klo").alias("__vlo"), at("__khi").alias("__vhi"))
    # one row per target; stored, so the selection pass runs once, and held in memory for the reads to come
    picked = cache_tracked(materialize(picked))
    out = _join_small(tgt, picked, tkeys, fits, "left")
    value = F.col("__vlo") + (F.col("__pos") - F.col("__klo")) * (F.col("__vhi") - F.col("__vlo"))
    missing = F.col("__vlo").isNull() | F.col("__vhi").isNull()
    res = out.filter(~missing).select(*keys, "p", value.alias("value"), "n")
    missed = out.filter(missing).select(*[c for c in tgt.columns if c not in ("__blo", "__bhi", "__est", "__shrinks", "__grid")])
    return res, None if missed.isEmpty() else missed


def quantiles_wide(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """Pivot ``quantiles`` to one row per (by..., column) with one column per prob."""
    from tablewise.operators.clean import _c

    q = quantiles(df, cols, probs, by=by, approx=approx)
    aggs = [
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(name)
        for p, name in zip(probs, names)
    ]
    return q.groupBy(*[_c(b) for b in by], "column").agg(*aggs)
