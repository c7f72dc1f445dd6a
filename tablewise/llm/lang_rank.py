"""Language identification by rank-order profiles.

A language's profile is its ``profile_size`` most frequent character n-grams (1 to 3
letters, words padded with one blank) in rank order, learned from labelled documents.
A document's own n-grams are ranked the same way over its whole text; its distance to a
language is the sum of how far each of its leading n-grams is out of place, an n-gram
missing from the profile counting ``profile_size``.  The nearest language wins.

Counting is vectorised per document: code points to letters and blanks, n-grams
packed into integers, one sort.  Very long texts are counted in pieces that overlap by
the n-gram length, so memory is bounded and no n-gram is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.common import prepare, read_table, store

#: Documents per language that the profiles are learned from (those of smallest id hash).
TRAIN_DOCS = 2000
PROFILE_SIZE, DOC_GRAMS = 400, 300
#: Profiles of so many languages are handed to the tasks; more raise.
MAX_LANGS = 5000
#: Documents whose score is lower are rejected by the pipeline stage.
MIN_SCORE = 0.2
UNKNOWN = "und"
_BLANK = 1
_PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a text, ascending, and how often each occurs.

    A code packs up to three code points of 21 bits; the blank is code point 1.
    """
    letters = _letters()
    codes, counts = [], []
    carry = np.array([_BLANK], dtype=np.int64)
    low = text.lower()
    for at in range(0, len(low) + 1, _PIECE):
        piece = low[at : at + _PIECE]
        s = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        s = np.where(letters[s], s, _BLANK)
        if at + _PIECE > len(low):
            s = np.append(s, _BLANK)
        s = s[(s != _BLANK) | np.concatenate(([carry[-1] != _BLANK], s[:-1] != _BLANK))]
        k, s = len(carry), np.concatenate((carry, s))
        one = s[k:][s[k:] != _BLANK]
        two = (s[k - 1 : -1] << 21) | s[k:]
        three = ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[s[1:-1] != _BLANK]
        grams = np.sort(np.concatenate((one, two, three)))
        if len(grams):
            new = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            codes.append(grams[new])
            counts.append(np.diff(np.append(new, len(grams))))
        carry = s[-2:]
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, back = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def leading(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes in rank order; ties go to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:n]]


def learn(train: DataFrame, profile_size: int) -> list[tuple[str, list[int]]]:
    """(language, codes in rank order), languages ascending.  ``train`` is (lang, text), without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # added up per task for at most so many n-grams at a time
        held: dict[str, list] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            lang, code, n = [], [], []
            for k, parts in held.items():
                every, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                lang += [k] * len(every)
                code.append(every)
                n.append(np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(code), pa.int64()), pa.array(np.concatenate(n), pa.int64())], names=["lang", "code", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c, n = gram_counts(text)
                if len(c):
                    held.setdefault(lang, []).append((c, n))
                    size += len(c)
            if size > 4_000_000:
                yield rows()
                held, size = {}, 0
        if held:
            yield rows()

    total = train.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    best = total.withColumn("r", rank).where(F.col("r") <= profile_size)
    if best.select("lang").distinct().count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    found: dict[str, list] = {}
    for lang, code, r in best.select("lang", "code", "r").collect():  # languages x profile_size rows
        found.setdefault(lang, []).append((r, code))
    return [(k, [c for _, c in sorted(v)]) for k, v in sorted(found.items())]


def training_rows(docs: DataFrame, usable, per_lang: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the ``per_lang`` usable documents of smallest id hash per language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), usable.alias("ok"))
    rows = rows.where("ok and lang is not null and text is not null")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    bars = store(rows.select("lang", "h").withColumn("r", first).where(F.col("r") <= per_lang).groupBy("lang").agg(F.max("h").alias("bar")))
    if bars.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    # at most MAX_LANGS rows: the texts stay where they are
    return rows.join(F.broadcast(bars), "lang").where("h <= bar").select("lang", "text")


def identify(docs: DataFrame, profiles: list[tuple[str, list[int]]], text_col: str = "text", doc_grams: int = DOC_GRAMS, profile_size: int = PROFILE_SIZE) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (columns of these names are replaced).

    score is 1 - distance / largest possible distance.  A text that is null or has
    no letter, and every text when no language was learned, gets ``und`` and score 0.
    Ties go to the language that sorts first; rows are judged one by one, so repeated rows
    and further columns change nothing.
    """
    langs = [k for k, _ in profiles]
    known = np.unique(np.concatenate([np.array(c, np.int64) for _, c in profiles])) if profiles else np.zeros(0, np.int64)
    place = np.full((len(known) + 1, len(langs)), -1, dtype=np.int64)
    for j, (_, c) in enumerate(profiles):
        place[np.searchsorted(known, np.array(c, np.int64)), j] = np.arange(len(c))

    def judge(text: str | None) -> tuple[str, float]:
        if text is None or not langs:
            return UNKNOWN, 0.0
        top = leading(*gram_counts(text), doc_grams)
        if not len(top):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(known, top), max(len(known) - 1, 0))
        rows = place[np.where(known[at] == top, at, len(known))]
        out = np.where(rows < 0, profile_size, np.minimum(np.abs(rows - np.arange(len(top))[:, None]), profile_size)).sum(axis=0)
        j = int(np.argmin(out))
        return langs[j], float(1 - out[j] / (profile_size * len(top)))

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t) for t in b.column(len(keep)).to_pylist()]
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__tw_text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the third of the documents that is never learned from; a null id counts as learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, profile_size: int = PROFILE_SIZE) -> DataFrame:
    """Learn profiles from the documents that are not held out, predict all."""
    profiles = learn(training_rows(docs, ~held_out(id_col), train_docs, id_col, text_col, lang_col), profile_size)
    return identify(docs, profiles, text_col, profile_size=profile_size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: whole texts of all documents."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn(training_rows(docs, ~held_out(), TRAIN_DOCS, "doc_id", "text", "lang"), PROFILE_SIZE)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(slim, profiles).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in none of the languages go (no text, no letter, or a score below ``MIN_SCORE``)."""
    prepare(spark)
    judged = language_id(docs.withColumnsRenamed({"score": "__tw_score", "lang_pred": "__tw_pred"}))
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__tw_score": "score", "__tw_pred": "lang_pred"}).select(*docs.columns)
