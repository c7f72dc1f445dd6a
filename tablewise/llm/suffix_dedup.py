"""Repeated byte strings removed by minimizer anchors, fingerprint grouping and a byte comparison.

This is not a suffix sort: no order of suffixes is made or merged, only equality is used.  It takes
from the difference-cover method which positions are sampled.  Anchors are byte positions whose 8-byte hash
is the smallest of a run of 48 positions.  Whether a position is an anchor depends on nearby bytes only, so
equal strings have equal anchors inside, with letters between them (at most 48 bytes, about 25 on average):

1. anchors whose number leaves 1 or 2 modulo 3 get the fingerprint of their next three letters
   as a name; names are grouped by hash and those that occur once are discarded;
2. for longer windows the same with names of 9, 27, ... letters, as often as every window is sure to
   hold so many (not at 400 bytes, once from 678, twice from 1542);
3. of any two equal anchors, after 0, 1 or 2 steps both are sampled (the difference cover), so a
   name found twice reaches the anchors up to two before it;
4. anchors that are reached are grouped by the bytes shared by all windows that start before
   the anchor (``core``); members of a group are compared by the bytes to the
   left and right of it, which decides for each start whether its whole window occurs
   again.  This step is exact on bytes (cores by 128-bit fingerprint).

Every text is its own string, so matches never cross documents.  Texts go by a 64-bit id that is checked
beforehand against a second digest and the length; if two texts share one, all ids are drawn anew.  Copies of a text are collapsed
per task, and so are members with equal bytes: the second one a task meets is a repeat for certain, so only
the first travels and a passage in a third of all texts sends one row per task.  A run of more than
``max_run`` members is spread by start instead.
No step moves whole texts but the two joins that bring the marks to the texts.
"""

from __future__ import annotations

import gc
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.common import discard, prepare, read_table, store

#: Positions of a run of which one is an anchor; bytes hashed at a position.
RUN, GRAM = 48, 8
#: Members a task remembers before it starts afresh (about 150 MB).
FORMS = 1_000_000
_PIECE = 1 << 20


def levels(window: int) -> int:
    """How many times triples are named: 3**levels letters and two steps lie in every window."""
    sure, n = (window - 3 * RUN - GRAM + 2) // RUN, 0
    while 3 ** (n + 1) + 2 <= sure:
        n += 1
    if n == 0:
        raise ValueError("the window is too short for the anchors")
    return n


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every n consecutive values."""
    have = 1
    while 2 * have <= n:
        x = pick(x[:-have], x[have:])
        have *= 2
    return x if have == n else pick(x[: len(x) - (n - have)], x[n - have :])


def anchors(raw: bytes) -> np.ndarray:
    """Anchor positions of a text, ascending.  Long texts go piece by piece with overlap."""
    out, margin = [], RUN + GRAM
    for at in range(0, max(1, len(raw)), _PIECE):
        lo, hi = max(0, at - margin), min(len(raw), at + _PIECE + margin)
        if hi - lo < RUN + GRAM - 1:
            continue
        h = np.ndarray((hi - lo - GRAM + 1,), "<u8", raw, offset=lo, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(32)).astype(np.uint32)
        low = _slide(h, RUN, np.minimum)
        # a position is an anchor if the largest minimum of the runs around it is its own value
        edge = np.zeros(RUN - 1, np.uint32)
        best = _slide(np.concatenate((edge, low, edge)), RUN, np.maximum)
        # (every position lies in a real run, so the zeros at the edges never decide, not even for a hash of 0)
        found = np.flatnonzero(best == h) + lo
        out.append(found[(found >= at) & (found < at + _PIECE)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _text_id(salt: int) -> Column:
    """64-bit id of a text; another salt gives other ids."""
    return F.xxhash64("raw") if salt == 0 else F.xxhash64(F.lit(salt), F.md5("raw"), F.octet_length("raw"))


def _texts(docs: DataFrame, id_col: str, text_col: str, salt: int = 0) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("raw")).withColumn("sid", _text_id(salt))


def _copies(long: DataFrame) -> tuple[DataFrame, bool]:
    """(sid) of the texts that occur more than once, and whether the ids tell all texts apart:
    none may stand for texts of different length or second digest (128 bits with the id)."""
    check = long.select("sid", F.xxhash64(F.md5("raw")).alias("h"), F.octet_length("raw").alias("n"))
    many = check.groupBy("sid").agg(F.count("*").alias("k"), F.expr("min(h) <> max(h) or min(n) <> max(n)").alias("clash")).where("k > 1")
    many = store(many.select("sid", "clash"))
    return many, many.where("clash").isEmpty()


def _names(depth: int):
    """(k1 .. k_depth, sid, a, sure): names of 3, 9, ... letters of every sampled anchor.

    A name met twice in one Arrow batch is a repeat for certain: all its places are ``sure`` rows, which
    pass by the grouping under names of their own, and one of them travels under the real name for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            keys: list[list[np.ndarray]] = [[] for _ in range(depth)]
            sids, at = [], []
            for sid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if sid in seen:  # copies of a text within a task
                    continue
                seen.add(sid)
                p = anchors(raw)
                n = 3**depth
                idx = np.arange(len(p) - n)
                idx = idx[idx % 3 != 0]
                if not len(idx):
                    continue
                starts = p[idx].tolist()
                for d in range(depth):
                    ends = p[idx + 3 ** (d + 1)].tolist()
                    keys[d].append(np.array([digest(raw[s:e]) for s, e in zip(starts, ends, strict=True)], dtype=np.uint64).view(np.int64))
                sids.append(np.full(len(idx), sid, np.int64))
                at.append(np.array(starts, np.int64))
            if sids:
                names, sid, a = [np.concatenate(k) for k in keys], np.concatenate(sids), np.concatenate(at)
                order = np.argsort(names[-1], kind="stable")  # the longest names: equal ones have equal shorter ones
                same = names[-1][order][1:] == names[-1][order][:-1]
                later, twice = np.zeros(len(a), bool), np.zeros(len(a), bool)
                later[order[1:][same]] = True
                twice[order[:-1][same]] = True
                twice |= later
                own = (sid[twice] ^ (a[twice] * np.int64(0x9E3779B97F4A7C1))).astype(np.int64)
                cols = [*(np.concatenate((k[~later], own)) for k in names), np.concatenate((sid[~later], sid[twice])), np.concatenate((a[~later], a[twice]))]
                sure = np.concatenate((np.zeros(int((~later).sum()), bool), np.ones(int(twice.sum()), bool)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(sure)], names=[*(f"k{d + 1}" for d in range(depth)), "sid", "a", "sure"])

    return run


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose name stands at two places at least, and the sure ones."""
    same = Window.partitionBy(key)
    two = rows.withColumns({"__s": F.min("sid").over(same), "__t": F.max("sid").over(same), "__a": F.min("a").over(same), "__b": F.max("a").over(same)})
    return two.where("sure or __s <> __t or __a <> __b").drop("__s", "__t", "__a", "__b", key)


def _members(window: int):
    """(core, left, right, sid, p, mask) of every anchor that a repeated name reaches.

    mask is set, and the bytes are left out, where the task itself holds another member with equal bytes;
    such a row's core is unique, so it spreads evenly."""
    back = RUN - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        forms: dict[bytes, tuple[int, int] | None] = {}
        digest = xxhash.xxh3_128_digest
        for b in batches:
            core, left, right, sids, at, masks = [], [], [], [], [], []

            def sure(sid: int, q: int, mask: int) -> None:
                core.append(digest(b"%d %d" % (sid, q)))  # noqa: B023 - used within this batch only
                left.append(None)  # noqa: B023
                right.append(None)  # noqa: B023
                sids.append(sid)  # noqa: B023
                at.append(q)  # noqa: B023
                masks.append(mask)  # noqa: B023

            if len(forms) > FORMS:
                forms.clear()
            for sid, raw, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if sid in seen:
                    continue
                seen.add(sid)
                p = anchors(raw)
                t = np.searchsorted(p, hits.values.to_numpy(zero_copy_only=False))
                t = np.unique(np.concatenate((t, t - 1, t - 2)))
                t = t[t >= 0]
                prev = np.where(t > 0, p[t - 1], -1)
                first = np.where(t > 0, np.maximum(0, prev - back + 1), 0)
                for q, lo in zip(p[t].tolist(), first.tolist(), strict=True):
                    stop = q - 2 * RUN + 1 + window  # end of the core
                    if q < back or stop >= len(raw) + 1 or q - back < lo:
                        continue
                    r = raw[stop : stop + RUN]
                    if len(r) + (q - back - lo) < RUN:  # no window fits before the end of the text
                        continue
                    whole = digest(b"%d " % (q - back - lo) + raw[lo : stop + RUN])
                    if whole in forms:
                        full = _valid(raw[lo : q - back], r)
                        if forms[whole] is not None:
                            sure(*forms[whole], full)
                            forms[whole] = None
                        sure(sid, q, full)
                        continue
                    forms[whole] = (sid, q)
                    core.append(digest(raw[q - back : stop]))
                    left.append(raw[lo : q - back])
                    right.append(r)
                    at.append(q)
                    sids.append(sid)
                    masks.append(None)
            if core:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.binary()) for c in (core, left, right)), *(pa.array(c, pa.int64()) for c in (sids, at, masks))],
                    names=["core", "left", "right", "sid", "p", "mask"],
                )

    return run


def _valid(left: bytes, right: bytes) -> int:
    """Bit d: the window that starts d bytes before the core lies in the text and belongs to this anchor."""
    return (1 << (len(left) + 1)) - (1 << max(0, RUN - len(right)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of each member of a run whose window another member has too (input sorted by core)."""
    held: list[tuple] = []

    def close(run: list[tuple], out: list[tuple]) -> None:
        forms = Counter((x[1], x[2]) for x in run)
        mask = dict.fromkeys(forms, 0)
        for d in range(RUN):
            groups: dict[tuple[bytes, bytes], list] = {}
            for f in forms:
                if _valid(*f) >> d & 1:
                    groups.setdefault((f[0][len(f[0]) - d :], f[1][: RUN - d]), []).append(f)
            for same in groups.values():
                if len(same) > 1 or forms[same[0]] > 1:
                    for f in same:
                        mask[f] |= 1 << d
        out += [(x[3], x[4], mask[x[1], x[2]]) for x in run if mask[x[1], x[2]]]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["sid", "p", "mask"])

    for b in batches:
        out: list[tuple] = []
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[0][0] != row[0]:
                close(held, out)
                held = []
            held.append(row)
        yield batch(out)
    if held:
        out = []
        close(held, out)
        yield batch(out)


def _spread(rows: DataFrame) -> DataFrame:
    """The same comparison for very large runs: one row per start, grouped by its whole window."""
    low, high = F.greatest(F.lit(0), RUN - F.length("right")), F.least(F.length("left"), F.lit(RUN - 1))
    starts = rows.select("core", "left", "right", "sid", "p", F.explode(F.sequence(low, high)).alias("d"))
    tail = F.expr("substring(left, length(left) - d + 1, d)")
    head = F.expr(f"substring(right, 1, {RUN} - d)")
    starts = starts.select("sid", "p", "d", F.xxhash64("core", "d", tail, head).alias("h1"), F.md5(F.concat("core", F.encode(F.hex(tail), "utf-8"), F.lit(b"|"), head)).alias("h2"))
    again = starts.groupBy("h1", "h2", "d").count().where("count > 1").drop("count")
    return starts.join(again, ["h1", "h2", "d"]).groupBy("sid", "p").agg(F.bit_or(F.expr("shiftleft(1L, d)")).alias("mask"))


def covered(n: int, marks: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes in the marked windows; marks are (anchor, bit mask of starts)."""
    starts = [p - (RUN - 1) - d for p, mask in marks for d in range(RUN) if mask >> d & 1]
    if not starts:
        return []
    s = np.unique(np.array(starts, np.int64))
    new = np.flatnonzero(np.concatenate(([True], s[1:] > s[:-1] + window)))
    return list(zip(s[new].tolist(), (s[np.append(new[1:] - 1, len(s) - 1)] + window).tolist(), strict=True))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, raw, copied, p, mask in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                spans = [(0, len(raw))] if copied else covered(len(raw), list(zip(p or [], mask or [], strict=True)), window)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((doc, len(raw), len(raw) - len(rest), [{"start": s, "end": e} for s, e in spans], rest))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def _drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", max_run: int = 20_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (array of start, end), kept (binary).

    Every byte is removed that lies in a string of ``window`` bytes which also starts anywhere
    else in the table, the same document included; overlapping windows count, and windows are judged
    on the input.  A null text is empty; texts shorter than the window lose nothing; repeated rows are
    copies of each other and lose all they have in windows; null ids are kept; an
    empty table gives an empty result; further columns are ignored.
    """
    spark, depth = docs.sparkSession, levels(window)
    salt = 0
    while True:
        texts = _texts(docs, id_col, text_col, salt)
        long = texts.where(F.octet_length("raw") >= window)
        twice, apart = _copies(long)
        if apart:
            break
        discard(twice)
        salt += 1
    _drop_shuffles(spark)
    names = ", ".join(f"k{d + 1} long" for d in range(depth))
    rows = long.select("sid", "raw").mapInArrow(_names(depth), f"{names}, sid long, a long, sure boolean")
    for d in range(depth):
        rows = _repeated(rows, f"k{d + 1}")
    hits = store(rows.groupBy("sid").agg(F.collect_set("a").alias("hits")))
    _drop_shuffles(spark)

    found = long.select("sid", "raw").join(hits, "sid").select("sid", "raw", "hits").mapInArrow(_members(window), "core binary, left binary, right binary, sid long, p long, mask long")
    run = Window.partitionBy("core")
    found = found.withColumns({"n": F.count("*").over(run), "lo": F.min(F.struct("left", "right")).over(run), "hi": F.max(F.struct("left", "right")).over(run)}).where("n > 1 or mask is not null")
    alike = F.col("lo") == F.col("hi")
    valid = F.expr(f"shiftleft(1L, length(left) + 1) - shiftleft(1L, greatest(0, {RUN} - length(right)))")
    found = store(
        found.select(
            "sid", "p", "n", F.coalesce("mask", F.when(alike, valid)).alias("mask"), *[F.when(~alike, F.col(c)).alias(c) for c in ("core", "left", "right")]
        )
    )
    discard(hits)
    _drop_shuffles(spark)
    cols = ["core", "left", "right", "sid", "p"]
    open_ = found.where("mask is null")
    some = open_.where(F.col("n") <= max_run).select(*cols).repartition("core").sortWithinPartitions("core").mapInArrow(_compare, "sid long, p long, mask long")
    many = _spread(open_.where(F.col("n") > max_run).select(*cols))
    marks = found.where("mask is not null").select("sid", "p", "mask").union(some).union(many)
    marks = marks.groupBy("sid").agg(F.collect_set(F.struct("p", "mask")).alias("m"))
    copied = twice.select("sid", F.lit(True).alias("copied"))
    # a text with copies is removed whole, its marks are not needed
    marks = store(copied.select("sid", "copied", F.lit(None).cast("array<struct<p:long,mask:long>>").alias("m")).union(marks.join(copied, "sid", "left_anti").select("sid", F.lit(False), "m")))
    discard(found)
    discard(twice)
    _drop_shuffles(spark)
    joined = texts.join(marks, "sid", "left").select("doc_id", "raw", F.coalesce("copied", F.lit(False)).alias("copied"), F.col("m.p").alias("p"), F.col("m.mask").alias("mask"))
    return joined.mapInArrow(_cut(window), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: strings of 400 bytes over all documents."""
    prepare(spark)
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("has_repeats"),
    )
