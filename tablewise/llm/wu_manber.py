"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``window`` words of a benchmark item is a pattern (an item with fewer words is one
pattern).  Patterns of one length share three tables, which each Python worker builds once:

* shift: for a block of two words, how far the search may move on; a block that no pattern
  holds lets it skip all but one word of a window;
* buckets: a block that ends a pattern leads to the patterns it ends, told apart by
  the hash of their first block;
* the patterns themselves: an occurrence counts only after a direct comparison.

Items are cut into pieces of bounded size (they overlap by a window less one word, so no window is lost) and
dealt into blocks of at most ``block_bytes``.  A block is broadcast and all documents are searched for it; with more
blocks the documents are read once per block and the hits of a text meet by its digest.
No document is compared with an item that the tables do not lead to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import prepare, read_table, store

WINDOW = 10
#: Words of an item that stand in one piece, and bytes of pieces that stand in one broadcast block.
PIECE_WORDS, BLOCK_BYTES = 2000, 2 << 20
#: Word bytes are 0-9, a-z (A-Z are lowered) and all of a character outside ASCII; any other byte parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class Patterns:
    """Patterns of ``m`` words each and where they may end."""

    def __init__(self, m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[int, list[int]]] = {}
        self.numbers: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.owners: list[list[int]] = []

    def add(self, words: list[bytes], item: int) -> None:
        """The pattern ``words`` of an item."""
        text = b" ".join(words)
        number = self.numbers.setdefault(text, len(self.texts))
        if number < len(self.texts):
            if self.owners[number][-1] != item:
                self.owners[number].append(item)
            return
        self.texts.append(text)
        self.owners.append([item])
        b = self.block
        for end in range(b, self.m + 1):
            block = b" ".join(words[end - b : end])
            self.shift[block] = min(self.shift.get(block, self.m), self.m - end)
        self.buckets.setdefault(block, {}).setdefault(hash(b" ".join(words[:b])), []).append(number)

    def search(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence."""
        m, b, shift, found = self.m, self.block, self.shift, []
        free, at, n = m - b + 1, m, len(words)
        while at <= n:
            block = words[at - 1] if b == 1 else words[at - 2] + b" " + words[at - 1]
            skip = shift.get(block, free)
            if skip:
                at += skip
                continue
            start = at - m
            for number in self.buckets[block].get(hash(b" ".join(words[start : start + b])), ()):
                if self.texts[number] == b" ".join(words[start:at]):
                    found.append((start, number))
            at += 1
        return found


class Matcher:
    """All patterns of a block of pieces, by length."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int):
        self.names = sorted({name for name, _ in pieces})
        number = {name: k for k, name in enumerate(self.names)}
        self.sets: dict[int, Patterns] = {}
        for name, text in pieces:
            words = text.split(b" ")
            m = min(window, len(words))
            patterns = self.sets.setdefault(m, Patterns(m))
            for s in range(len(words) - m + 1):
                patterns.add(words[s : s + m], number[name])

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Maximal runs of hit words (start, end) and the names of the items that hit."""
        runs, items = [], set()
        for patterns in self.sets.values():
            for start, number in patterns.search(words):
                runs.append((start, start + patterns.m))
                items.update(patterns.owners[number])
        return merged(runs), [self.names[k] for k in sorted(items)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pieces(window: int, piece_words: int):
    """(item, seq, words) of every item: words joined by a space, at most ``piece_words`` windows a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for seq, s in enumerate(range(0, max(min(1, len(words)), len(words) - window + 1), piece_words)):
                    rows.append((item, seq, b" ".join(words[s : s + piece_words + window - 1])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["item", "seq", "words"])

    return run


_SPANS = "array<struct<start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(runs: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], _SPAN_TYPE)


_BUILT: dict[str, Matcher] = {}


def _search(pieces, key: str, window: int, only_hits: bool):
    """(doc_id, digest, n_words, spans, items) of every document, or of those with a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()  # one block at a time
            _BUILT[key] = Matcher(pieces.value, window)
        matcher = _BUILT[key]
        for b in batches:
            docs, digests, counts, spans, items = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                runs, names = matcher.match(words)
                if only_hits and not runs:
                    continue
                docs.append(doc)
                digests.append(hashlib.blake2b((text or "").encode(), digest_size=16).digest())
                counts.append(len(words))
                spans.append(runs)
                items.append(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "digest", "n_words", "spans", "items"],
            )

    return run


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of all blocks of a document, brought together."""
    for b in batches:
        spans, items = [], []
        for own, own_items, more in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), b.column("more").to_pylist(), strict=True):
            more = more or []
            spans.append(merged([(r["start"], r["end"]) for part in [own, *(m["spans"] for m in more)] for r in part]))
            items.append(sorted({i for part in [own_items, *(m["items"] for m in more)] for i in part}))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), _spans(spans), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (array of start, end: maximal runs of hit words), items (sorted array of item ids as text).

    A window is ``window`` consecutive words of an item, or the whole of a shorter one; all words of a
    document inside an occurrence of a window are hit.  Null and empty texts have no words; an item without words has no
    window; rows of one item id are one item, a null item id counts as the empty text; repeated documents give repeated
    rows; null document ids are kept; further columns are ignored; an empty table of items hits
    nothing and an empty table of documents gives an empty result.
    """
    spark = docs.sparkSession
    given = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    pieces = store(given.mapInArrow(_pieces(window, piece_words), "item string, seq int, words binary").select("item", "words").distinct())
    size = F.octet_length("words") + F.octet_length("item")
    blocks = max(1, -(-(pieces.agg(F.sum(size)).first()[0] or 0) // block_bytes))
    largest = pieces.agg(F.max(size)).first()[0] or 0
    while True:
        block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
        if (pieces.groupBy(block.alias("b")).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0) <= max(2 * block_bytes, largest):
            break
        blocks *= 2
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id long, digest binary, n_words long, spans {_SPANS}, items array<string>"
    found = []
    for k in range(blocks):  # a block holds at most 2 * block_bytes, or one piece
        held = spark.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in pieces.where(block == k).select("item", "words").collect()])
        found.append(texts.mapInArrow(_search(held, f"{pieces._tablewise_path} {k}", window, only_hits=k > 0), schema))
        if k:
            found[-1] = store(found[-1].dropDuplicates(["digest", "n_words"]).select("digest", "n_words", F.struct("spans", "items").alias("part")))
            held.destroy()
    if blocks == 1:
        return found[0].drop("digest")
    more = found[1]
    for f in found[2:]:
        more = more.union(f)
    more = more.groupBy("digest", "n_words").agg(F.collect_list("part").alias("more"))  # one part a block
    joined = found[0].join(more, ["digest", "n_words"], "left").select("doc_id", "n_words", "spans", "items", "more")
    return joined.mapInArrow(_join_blocks, f"doc_id long, n_words long, spans {_SPANS}, items array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: windows of 10 words of all benchmark items in all documents."""
    prepare(spark)
    found = find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
patterns AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
starts AS (SELECT row_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS p
  FROM (SELECT row_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m)),
hits AS (SELECT row_id, s, m, item_id FROM starts JOIN patterns USING (m, p)),
words AS (SELECT row_id, count(DISTINCT x) AS n FROM (SELECT row_id, unnest(range(s, s + m)) AS x FROM hits) GROUP BY row_id),
found AS (SELECT row_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS names FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN found USING (row_id)
"""
