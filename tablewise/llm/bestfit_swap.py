"""Best-fit packing of token sequences, improved by swap-based local search.

Tokenizing runs once and keeps one small row per piece (id, place, length,
checksum).  The pieces are dealt by a hash of their row number into groups of a
bounded size, and each group is packed by itself:

1. best fit, longest first;
2. local search between underfull bins: move one piece, exchange one for one, or two
   for one, whenever that increases the sum of squared fills.  The least filled
   bin gives, until it is empty or nothing improves; a group that has reached
   its lower bound (tokens / capacity) stops at once.

Bins left below ``refill`` of the capacity are opened again and packed with those
of other groups, until one group is left or a round saves no bin: the loss does not grow with the
number of groups.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import discard, prepare, read_table, store

CAPACITY, END_ID = 4096, 1
#: Words (and pieces of words) a worker remembers: this many recent ones and as many before them.
CACHE_WORDS = 150_000
#: Texts without these can be cut at white space and lower-cased beforehand: each is its own
#: normal form, holds no special token, and Arrow and the tokenizer agree on its case and white space.
_UNSAFE = r"[^\t\n\r -~\x{A1}-\x{FF}]|<\|"
#: Fixed value: the vocabulary's own pattern for pieces of words.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Recent(dict):
    """Entries used lately: when ``room`` new ones have come in, those not used since the last time are forgotten."""

    def __init__(self, room: int):
        super().__init__()
        self.room, self.older = room, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys that are not held; the others are held at least until the next call."""
        if len(self) > self.room:
            self.older = dict(self)
            self.clear()
        older, out = self.older, []
        for k in keys:
            if k not in self:
                if k in older:
                    self[k] = older[k]
                else:
                    out.append(k)
        return out


class WordIds:
    """Token ids of whole columns of texts.

    The words of a batch are numbered by Arrow, each distinct word is encoded once, and the ids of all texts are
    put together by position. Same ids as encoding the whole text: the vocabulary never merges over white space."""

    def __init__(self, path: str, room: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = Recent(room), Recent(room)
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        # U+0080..U+00FF in UTF-8 use the bytes 0x80..0xFF only; their stand-ins come from the tokenizer itself
        self.stand_in = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x100)}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct lower-case words as little-endian bytes."""
        cut = {}
        for w in self.words.missing(words):
            if w.isalpha():
                cut[w] = (w,)
            elif w[:-1].isalpha() and w[-1] in ".,;:!?":
                cut[w] = (w[:-1], w[-1])
            else:
                cut[w] = _SPLIT.findall(w)
        tokens, pieces = self.tokenizer.model.tokenize, self.pieces
        for piece in pieces.missing(dict.fromkeys(x for xs in cut.values() for x in xs)):
            shown = piece if piece.isascii() else piece.translate(self.stand_in)
            pieces[piece] = array("I", [t.id for t in tokens(shown)]).tobytes()
        for w, xs in cut.items():
            self.words[w] = pieces[xs[0]] if len(xs) == 1 else b"".join([pieces[x] for x in xs])
        return [self.words[w] for w in words]

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, END_ID last; a null text is empty."""
        texts = texts.fill_null("")
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(unsafe, "", texts)))
        numbered = split.values.dictionary_encode()
        found = self.word_ids(numbered.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        at = numbered.indices.to_numpy(zero_copy_only=False)
        long = size[at]
        end = np.cumsum(long)
        flat = ids[np.repeat(first[at] - (end - long), long) + np.arange(int(long.sum()))]
        bounds = np.concatenate(([0], end))[split.offsets.to_numpy()]
        flat = np.insert(flat, bounds[1:], END_ID)
        bounds += np.arange(len(bounds))
        out = [flat[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.append(self.encode(texts[k].as_py()), np.uint32(END_ID)).astype("<u4")
        return out


@contextmanager
def _no_collection() -> Iterator[None]:
    """Strings and tuples only are made here: walking the word tables for cycles again and again costs a third of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_LOADED: dict[str, WordIds] = {}


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        for b in batches:
            rows = []
            with _no_collection():
                found = _LOADED[path].column(b.column(1))
            for doc, ids in zip(b.column(0).to_pylist(), found, strict=True):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first.  Open bins are kept by their room; a bit per room that
    occurs makes "smallest room that is enough" one operation on an integer."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= n
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves and exchanges that increase the sum of squared fills.

    Every piece and every pair of the giving bin is tried against every piece of the others: of the
    sorted lengths and pair sums, the largest that still fits gains most.
    """
    least = -(-int(lengths.sum()) // capacity)
    bins = [list(b) for b in bins]
    owner = np.empty(len(lengths), dtype=np.int64)
    for b, items in enumerate(bins):
        owner[items] = b
    fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    alive = np.ones(len(bins), dtype=bool)
    stuck = np.zeros(len(bins), dtype=bool)
    while int(alive.sum()) > least:
        givers = np.flatnonzero(alive & ~stuck & (fill < capacity))
        if len(givers) == 0 or (alive & (fill < capacity)).sum() < 2:
            break
        d = int(givers[np.argmin(fill[givers])])
        emptied = False
        while True:
            room = np.where(alive & (fill < capacity), capacity - fill, -1)
            room[d] = -1
            mine = np.array(sorted(bins[d], key=lambda i: -lengths[i]), dtype=np.int64)
            if len(mine) == 0:
                alive[d], emptied = False, True
                break
            others = np.flatnonzero(room[owner] > 0)
            best = (0, None, None, None)  # gain, pieces that go, piece that comes, bin
            for i in mine:  # move: the tightest room that holds the piece
                n = int(lengths[i])
                ok = np.flatnonzero(room >= n)
                if len(ok):
                    r = int(ok[np.argmin(room[ok])])
                    gain = 2 * n * (int(fill[r]) - int(fill[d]) + n)
                    if gain > best[0]:
                        best = (gain, [int(i)], None, r)
            if best[1] is None and len(others):
                kinds, many = np.unique(lengths[mine], return_counts=True)
                x, y = np.triu_indices(len(kinds))
                x, y = x[(x != y) | (many[x] > 1)], y[(x != y) | (many[x] > 1)]
                sums, first = np.unique(np.concatenate((kinds, kinds[x] + kinds[y])), return_index=True)  # one piece before two
                theirs, at = lengths[others], owner[others]
                pick = np.searchsorted(sums, theirs + room[at], side="right") - 1
                delta = sums[pick] - theirs
                gain = np.where((pick >= 0) & (delta > 0), 2 * delta * (fill[at] - fill[d] + delta), 0)
                j = int(np.argmax(gain))
                if gain[j] > 0:
                    f = int(first[pick[j]])
                    need = [int(kinds[f])] if f < len(kinds) else [int(kinds[x[f - len(kinds)]]), int(kinds[y[f - len(kinds)]])]
                    go: list[int] = []
                    for n in need:
                        go.append(next(int(i) for i in mine if lengths[i] == n and int(i) not in go))
                    best = (int(gain[j]), go, int(others[j]), int(at[j]))
            if best[1] is None:
                break
            _, go, back, r = best
            for i in go:
                bins[d].remove(i)
                bins[r].append(i)
                owner[i] = r
            moved = int(lengths[go].sum()) - (int(lengths[back]) if back is not None else 0)
            if back is not None:
                bins[r].remove(back)
                bins[d].append(back)
                owner[back] = d
            fill[r] += moved
            fill[d] -= moved
        if emptied:
            stuck[:] = False
        else:
            stuck[d] = True
    return [b for b, a in zip(bins, alive, strict=True) if a]


def _pack_group(round_no: int, capacity: int, refill: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        seq, off, done = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64), np.empty(len(pdf), bool)
        base = (round_no << 48) + (int(key[0]) << 20)
        for b, items in enumerate(local_search(lengths, best_fit(lengths, capacity), capacity)):
            seq[items] = base + b
            off[items] = np.concatenate(([0], np.cumsum(lengths[items])[:-1]))
            done[items] = lengths[items].sum() >= refill * capacity
        return pdf.drop(columns=["grp"]).assign(sequence_id=seq, offset=off, done=done)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 20_000, refill: float = 0.95) -> DataFrame:
    """``pieces`` (any columns, with ``length`` of 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    Columns of these names, and ``rid``, ``grp``, ``done``, are replaced.  Every
    sequence is gapless from 0 and holds at most ``capacity``; repeated rows are
    packed as separate pieces; an empty table gives an empty result.
    """
    cols = [c for c in pieces.columns if c not in ("rid", "grp", "done", "sequence_id", "offset")]
    todo = store(pieces.select(*cols).withColumn("rid", F.monotonically_increasing_id()))
    n, rounds, packed, before, bins = todo.count(), 0, [], None, 0
    while True:
        groups = max(1, -(-n // group_rows))
        out = store(
            todo.withColumn("grp", F.pmod(F.xxhash64("rid", F.lit(rounds)), F.lit(groups)))
            .groupBy("grp")
            .applyInPandas(_pack_group(rounds, capacity, refill), todo.schema.add("sequence_id", "long").add("offset", "long").add("done", "boolean"))
        )
        discard(todo)
        if before is not None and out.where("offset = 0").count() >= bins:  # no bin fewer in other company
            discard(out)
            packed.append(before)
            break
        before, bins = out.where("not done"), out.where("not done and offset = 0").count()
        if groups == 1 or bins == 0:
            packed.append(out)
            break
        packed.append(out.where("done"))
        todo, rounds = store(before.select(*cols, "rid")), rounds + 1
        n = todo.count()
    result = packed[0]
    for p in packed[1:]:
        result = result.union(p)
    return result.select(*cols, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece holding the end id only; a text longer than
    ``capacity`` is cut, every other stays whole; null ids and repeated rows are
    kept; further columns are ignored; an empty table gives an empty result.
    """
    return pack(tokenize(docs, path, id_col, text_col, capacity), capacity)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in sequences of 4096 tokens."""
    prepare(spark)
    return pack_documents(read_table(spark, sf_dir, "documents"), default_vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack_documents(docs, default_vocabulary())
