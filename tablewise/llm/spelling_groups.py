"""Spelling variants of a vocabulary: words one edit apart, found by dynamic programming over sorted lists.

Two words at most one edit apart agree before the edit or behind it. With l the length of the shorter one and
k = l // 2 they share their first k code points or their last k; so each word stands in the lists of
(side, l, shared part) for l its own length and one less. A list of reversed words serves the last k.

Within a list the words are sorted and scanned once for a block of query words at a time. The edit matrix is
banded (one edit leaves three cells a row), its rows are kept by depth, and a word starts from the
rows of the prefix it shares with its predecessor (the adjacent LCP). Query words whose row exceeds one edit
leave at that depth; where none is left, all following words that share the prefix are skipped.

A list of more than ``max_list`` words is scanned in blocks of queries by blocks of targets, each a group of
its own. Pairs never leave their group: it returns the number of near words and the best one per word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import discard, prepare, read_table, store

#: Distinct words a task counts before it passes them on.
HELD_WORDS = 200_000
#: Largest list that is scanned in one piece.
MAX_LIST = 4096
#: In Latin-1, letters of the contract's class with A-Z lowered; anything else parts runs (what Latin-1 lacks is no letter either).
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z lowered, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_RUNS).split() if text else []


def _count(every: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        crc = zlib.crc32
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = crc(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for w, n in Counter(runs_of(text)).items():
                    h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= least:
                        total[w] += n
            if len(total) > HELD_WORDS:
                yield out()
                total.clear()
        yield out()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points that occur ``min_count`` times.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), only A-Z lowered; a run whose crc32 of
    ``<id>:<run>`` is divisible by ``every`` loses the code point at crc32 % length. A null text has no words, a
    null id reads as the empty text; repeated rows count again; further columns are ignored; an empty table gives an empty result."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_count(every, min_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, one row a word, -1 beyond its end."""
    out = np.full((len(words), width), -1, np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def near_pairs(queries: list[str], targets: list[str], shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, target) positions of all pairs one edit apart. Queries have one length, targets that or one more, are sorted,
    and all of them start with the same ``shared`` code points."""
    length = len(queries[0])
    q = np.full((len(queries), length + 4), -2, np.int32)
    q[:, 1 : length + 1] = _codes(queries, length)  # column j holds code point j - 1; others equal nothing
    t = _codes(targets, length + 1)
    differs = t[1:] != t[:-1]
    lcp = np.concatenate(([0], np.argmax(np.column_stack((differs, np.ones(len(differs), bool))), axis=1))).tolist()
    sizes = [len(w) for w in targets]
    codes = t.tolist()
    everyone = np.arange(len(queries))
    # the row at the shared depth: all equal so far, one edit to either side
    low, mid, high = np.full(len(queries), min(shared, 1), np.int8), np.zeros(len(queries), np.int8), np.ones(len(queries), np.int8)
    if shared == 0:
        low[:] = 2
    rows = [(everyone, low, mid, high)]  # rows[i] is the row at depth shared + i
    dead, qs, ts = None, [], []
    for j, word in enumerate(codes):
        start = max(lcp[j], shared)
        if dead is not None and lcp[j] >= dead:
            continue  # shares a prefix that is more than one edit away from every query
        dead = None
        del rows[start - shared + 1 :]
        ids, low, mid, high = rows[-1]
        for d in range(shared + len(rows), sizes[j] + 1):
            c = word[d - 1]
            mine = q[ids]
            new_low = np.minimum(low + (mine[:, d - 1] != c), mid + 1)
            new_mid = np.minimum(np.minimum(mid + (mine[:, d] != c), high + 1), new_low + 1)
            new_high = np.minimum(high + (mine[:, min(d + 1, length + 3)] != c), new_mid + 1)
            if d + 1 > length:
                new_high[:] = 2
            if d > length:
                new_mid[:] = 2
            alive = (new_low <= 1) | (new_mid <= 1) | (new_high <= 1)
            if not alive.all():
                ids, new_low, new_mid, new_high = ids[alive], new_low[alive], new_mid[alive], new_high[alive]
            low, mid, high = new_low, new_mid, new_high
            rows.append((ids, low, mid, high))
            if not len(ids):
                dead = d
                break
        else:
            hit = ids[(mid if sizes[j] == length else low) == 1]
            if len(hit):
                qs.append(hit)
                ts.append(np.full(len(hit), j))
    if not qs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(qs), np.concatenate(ts)


class _Best:
    """Number of near words and the best one (largest n, then smallest word) per word."""

    def __init__(self):
        self.rows: dict[str, list] = {}

    def add(self, word: str, other: str, n: int) -> None:
        r = self.rows.get(word)
        if r is None:
            self.rows[word] = [1, n, other]
            return
        r[0] += 1
        if n > r[1] or n == r[1] and other < r[2]:
            r[1], r[2] = n, other

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*((w, *r) for w, r in self.rows.items()), strict=True)) or [()] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["word", "n_near", "best_n", "best"])


def _scan_list(back: bool, length: int, rows: list[tuple[str, int, bool, bool]], best: _Best) -> None:
    """Near pairs of one list; rows are (word, n, asks, answers)."""
    k = length // 2
    turned = (lambda w: w[::-1]) if back else (lambda w: w)
    asks = sorted((turned(w), n) for w, n, a, _ in rows if a)
    answers = sorted((turned(w), n) for w, n, _, a in rows if a)
    if not asks or not answers:
        return
    for i, j in zip(*(x.tolist() for x in near_pairs([w for w, _ in asks], [w for w, _ in answers], k)), strict=True):
        (w, n), (v, m) = asks[i], answers[j]
        w, v = turned(w), turned(v)
        if back and w[:k] == v[:k]:
            continue  # the list of the first half has this pair
        best.add(w, v, m)
        if len(v) > length:
            best.add(v, w, n)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (back, length, part, asker, answerer, word, n, asks, answers) sorted by list and block."""
    held: list[tuple] = []
    key, best = None, _Best()
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key is not None and r[:5] != key:
                _scan_list(key[0], key[1], held, best)
                held = []
                if len(best.rows) > 20_000:
                    yield best.batch()
                    best = _Best()
            key = r[:5]
            held.append(r[5:])
    if held:
        _scan_list(key[0], key[1], held, best)
    yield best.batch()


def near_words(words: DataFrame, min_length: int = 6, max_list: int = MAX_LIST) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``words`` (word, n; one row a word) that have a near word."""
    size = F.char_length("word")
    entry = []
    for back in (False, True):
        for longer in (0, 1):
            length = size - longer
            part = F.expr(f"{'right' if back else 'left'}(word, cast(floor((char_length(word) - {longer}) / 2) as int))")
            entry.append(F.when(length >= min_length, F.struct(F.lit(back).alias("back"), length.alias("length"), part.alias("part"), F.lit(longer == 0).alias("asks"))))
    lists = words.select("word", "n", F.explode(F.array_compact(F.array(*entry))).alias("e")).select("word", "n", "e.*")
    key = ["back", "length", "part"]
    large = lists.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > max_list).withColumn("blocks", F.ceil(F.col("rows") / max_list).cast("int")).drop("rows")
    lists = lists.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    place = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    both = F.when((F.col("blocks") == 1), F.array(F.struct(F.lit(0).alias("asker"), F.lit(0).alias("answerer"), F.col("asks").alias("asks"), F.lit(True).alias("answers"))))
    spread = F.concat(
        F.transform(all_blocks, lambda a: F.struct(a.alias("asker"), place.alias("answerer"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))),
        F.when(F.col("asks"), F.transform(all_blocks, lambda a: F.struct(place.alias("asker"), a.alias("answerer"), F.lit(True).alias("asks"), F.lit(False).alias("answers")))).otherwise(
            F.expr("array()").cast("array<struct<asker:int,answerer:int,asks:boolean,answers:boolean>>")
        ),
    )
    group = [*key, "asker", "answerer"]
    rows = lists.select(*key, "word", "n", F.explode(F.coalesce(both, spread)).alias("x")).select(*key, "x.asker", "x.answerer", "word", "n", "x.asks", "x.answers")
    found = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")
    )


def group_spellings(words: DataFrame, min_length: int = 6, ratio: int = 5, max_list: int = MAX_LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n; one row a word).

    Near words differ by exactly one inserted, deleted or replaced code point. The form of a word is its near word of largest
    n (ties: the smallest in code-point order) if that n is at least ``ratio`` times its own (``ratio`` above 1, so
    forms never lead in a circle); root follows the forms to the last. An empty table gives an empty result."""
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = store(words.select("word", "n"))
    near = store(near_words(words, min_length, max_list))
    out = store(
        words.join(near, "word", "left")
        .withColumn("leads", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
        .select("word", F.when(F.col("leads"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("leads"), F.col("best_n")).alias("form_n"))
    )
    discard(near)
    discard(words)
    root = store(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps taken; a chain has at most log(n) / log(ratio) of them
        step = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = store(root.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        discard(root)
        root = new
        if not moved:
            break
    return out.join(root.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: words of at least 6 code points and 5 occurrences in all documents."""
    prepare(spark)
    return group_spellings(vocabulary(read_table(spark, sf_dir, "documents")))


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, r, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  GROUP BY doc_id, r),
hashed AS (
  SELECT r, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(0, octet_length(b)), lambda i:
      [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, c:
      CASE WHEN c >= 0 THEN xor(a, c) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS h
  FROM (SELECT r, k, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r) AS b, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r) AS x FROM runs)),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN (SELECT min(encode(other)) FROM near WHERE near.word = w.word AND near.n = top) END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk(word, seat, form) AS (
  SELECT word, word, decode(form) FROM forms
  UNION ALL SELECT walk.word, walk.form, decode(f.form) FROM walk JOIN forms f ON f.word = walk.form WHERE walk.form IS NOT NULL)
SELECT f.word, decode(f.form) AS form, walk.seat AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word AND walk.form IS NULL
"""
