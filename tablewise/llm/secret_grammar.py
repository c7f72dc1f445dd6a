"""Secret scans by grammar inference.

Labelled credentials are what the base patterns find.  The distinct values of a kind are
divided by the character classes they use; the prefix tree of each family is merged, state by state,
into a probabilistic automaton.  Nodes that few values reach are no evidence on their own and are
pooled by depth; two states merge when the frequencies of their symbols, character classes and
ends agree within the Hoeffding bound, all the way down.  So a format's symbols, fixed parts
and length are learned together.

Every run of 8 or more key characters outside the base spans (``=``, ``.`` and ``/`` as part of it, and as
breaks) is a candidate.  It is a span of kind ``format`` if some automaton finds it 1 / ``PRIOR`` times
likelier than the symbol pairs of the corpus' plain words and numbers do, its mean log-likelihood per symbol
is at most ``SLACK`` under that of nearly all labelled values, and it is at least ``CUT_OFF`` times as long
as they are (a value cut off on its way is found, a short piece is not).
A bound on the likelihood passes over the text first, so few candidates are spelled out.

One pass collects labelled values and symbol pairs, one scans; only the automata and 69 x 69 pair
counts pass through the driver, and their size is bounded by the training sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.common import discard, prepare, read_table, store

#: The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Shortest candidate (the base rule's shortest value).
MIN_CANDIDATE = MIN_ASSIGN
#: Distinct values per kind that automata are learned from (those of smallest hash), and the longest of them.
TRAIN_VALUES, TRAIN_LENGTH = 1000, 4096
#: Visits that make a state evidence, and values that make a family; states deeper than DEPTH are one.
FEW, DEPTH = 30, 256
#: Share of the labelled values that may score below the cut-off, and how far a candidate may be below it; probability of an unseen symbol;
#: merge confidence; share of the candidates that are taken to be secrets; part of a value that is still found.
MISSED, SLACK, UNSEEN, ALPHA, PRIOR, CUT_OFF = 0.01, 0.5, 1e-4, 0.05, 1e-6, 0.5
MASK = "[SECRET]"
_WORDS = ("passw", "secret", "token", "api")
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-"
_CODE = np.zeros(256, dtype=np.uint8)  # 0: no key character
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(1, len(SYMBOLS) + 1)
_KEY_BYTE = _CODE > 0
_DIGIT, _LETTER = (_CODE > 0) & (_CODE <= 10), (_CODE > 10) & (_CODE <= 62)
_NARROW = _KEY_BYTE.copy()
_NARROW[[ord(c) for c in ".=/"]] = False
WIDTH = len(SYMBOLS) + 1

def _runs(text: str) -> list[tuple[int, str]]:
    """Runs of 16 or more key characters: code point position and run."""
    raw = text.encode("utf-8", "surrogatepass")
    stops = np.flatnonzero(~_KEY_BYTE[np.frombuffer(raw, dtype=np.uint8)])
    edges = np.concatenate(([-1], stops, [len(raw)]))
    long = np.flatnonzero(np.diff(edges) > 16)
    plain = len(raw) == len(text)
    out, seen_b, seen_c = [], 0, 0
    for i in long.tolist():
        s, e = int(edges[i]) + 1, int(edges[i + 1])
        if not plain:
            seen_c += len(raw[seen_b:s].decode("utf-8", "surrogatepass"))
            seen_b = s
        out.append((s if plain else seen_c, raw[s:e].decode()))
    return out


def base_spans(text: str, runs: list[tuple[int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, kind number, end, value) of the base matches, in the order of the result."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    for at, run in runs:  # access keys and hex digests consist of key characters only
        if "AKIA" in run:
            out += [(at + m.start(), 1, at + m.end(), m[0]) for m in ACCESS.finditer(run) if len(m[0]) >= MIN_ACCESS]
        if len(run) >= MIN_HEX:
            out += [(at + m.start(), 2, at + m.end(), m[0]) for m in HEX.finditer(run) if len(m[0]) >= MIN_HEX]
    return sorted(out)


class Automaton:
    """Probabilistic automaton: per state the log probability and target of each symbol, of ending, and the usual target."""

    def __init__(self, moves: list[dict[str, tuple[float, int]]], ends: list[float], usual: list[int], cut: float, shortest: int):
        self.moves, self.ends, self.usual, self.cut, self.shortest = moves, ends, usual, cut, shortest

    def loglik(self, value: str) -> float:
        """Log-likelihood of a value and its end; a foreign symbol costs ``UNSEEN`` and goes the usual way."""
        state, total, unseen = 0, 0.0, math.log(UNSEEN)
        for ch in value:
            step = self.moves[state].get(ch)
            if step is None:
                total += unseen
                state = self.usual[state]
            else:
                total += step[0]
                state = step[1]
        return total + self.ends[state]

    def score(self, value: str) -> float:
        """Mean log-likelihood per symbol, the end among them."""
        return self.loglik(value) / (len(value) + 1)

    def best(self) -> np.ndarray:
        """Per symbol code the greatest log probability in any state; at 0 that of ending."""
        out = np.full(WIDTH, math.log(UNSEEN))
        out[0] = max(self.ends)
        for step in self.moves:
            for ch, (lp, _) in step.items():
                out[_CODE[ord(ch)]] = max(out[_CODE[ord(ch)]], lp)
        return out


def symbol_class(ch: str) -> int:
    """0 digits, 1 a-f, 2 g-z, 3 A-F, 4 G-Z, 5 others."""
    return 0 if ch.isdigit() else (1 if ch <= "f" else 2) if ch.islower() else (3 if ch <= "F" else 4) if ch.isupper() else 5


def families(values: list[str], few: int = FEW) -> list[list[str]]:
    """Values divided by the classes of their symbols.  A set of classes that fewer than ``few`` values
    have joins the smallest larger one that enough have; what is left is a family of its own."""
    kept: dict[int, list[str]] = {}
    for v in values:
        kept.setdefault(sum(1 << c for c in {symbol_class(ch) for ch in v}), []).append(v)
    large = sorted((m for m in kept if len(kept[m]) >= few), key=lambda m: (m.bit_count(), m))
    out: dict[int, list[str]] = {m: list(kept[m]) for m in large}
    for m in sorted(kept.keys() - set(large)):
        home = next((g for g in large if g & m == m), -1)
        out.setdefault(home, []).extend(kept[m])
    return [sorted(out[m]) for m in sorted(out)]


def infer(values: list[str], alpha: float = ALPHA, missed: float = MISSED, few: int = FEW, depth: int = DEPTH) -> Automaton:
    """Merge the prefix tree of ``values`` into an automaton (red-blue order, Hoeffding test).

    Prefixes that fewer than ``few`` values share are one state per depth, those deeper than ``depth`` one state.
    """
    kids: list[dict[str, int]] = []
    hits: list[int] = []
    ends: list[int] = []
    arcs: list[Counter] = []
    pools: dict[int, int] = {}

    def state() -> int:
        kids.append({})
        hits.append(0)
        ends.append(0)
        arcs.append(Counter())
        return len(kids) - 1

    def pool(d: int) -> int:
        d = min(d, depth)
        if d not in pools:
            pools[d] = state()
        return pools[d]

    todo = [(state(), 0, values)]
    while todo:  # nodes that enough values share
        node, d, here = todo.pop()
        hits[node] += len(here)
        by: dict[str, list[str]] = {}
        for v in here:
            if len(v) == d:
                ends[node] += 1
            else:
                by.setdefault(v[d], []).append(v)
        for ch, some in sorted(by.items()):
            arcs[node][ch] += len(some)
            if len(some) >= few and d + 1 < depth:
                kids[node][ch] = state()
                todo.append((kids[node][ch], d + 1, some))
                continue
            kids[node][ch] = pool(d + 1)
            for v in some:  # the rest of a value few share
                for at in range(d + 1, len(v) + 1):
                    s = pool(at)
                    hits[s] += 1
                    if at == len(v):
                        ends[s] += 1
                    else:
                        arcs[s][v[at]] += 1
                        kids[s][v[at]] = pool(at + 1)

    width = math.sqrt(0.5 * math.log(2 / alpha))
    boss = list(range(len(kids)))

    def of(x: int) -> int:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    def classes(x: int) -> list[int]:
        out = [0] * 6
        for ch, n in arcs[x].items():
            out[symbol_class(ch)] += n
        return out

    def differ(x: int, y: int) -> bool:
        n1, n2 = hits[x], hits[y]
        far = width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        pairs = [(ends[x], ends[y]), *zip(classes(x), classes(y), strict=True), *((arcs[x][c], arcs[y][c]) for c in arcs[x].keys() | arcs[y].keys())]
        return any(abs(f1 / n1 - f2 / n2) > far for f1, f2 in pairs)

    unlike: set[tuple[int, int]] = set()  # pairs known to differ somewhere below

    def compatible(a: int, b: int) -> bool:
        todo, came = [(a, b)], {(a, b): None}
        while todo:
            pair = todo.pop()
            x, y = pair
            if x == y or min(hits[x], hits[y]) < few:  # too few visits tell nothing
                continue
            if pair in unlike or differ(x, y):
                up = pair
                while up is not None:
                    unlike.add(up)
                    up = came[up]
                return False
            for c in sorted(kids[x].keys() & kids[y].keys()):
                nxt = of(kids[x][c]), of(kids[y][c])
                if nxt not in came:
                    came[nxt] = pair
                    todo.append(nxt)
        return True

    def fold(a: int, b: int) -> None:
        """One state of a and b, and of what the same symbols lead to from them."""
        todo = [(a, b)]
        while todo:
            x, y = (of(s) for s in todo.pop())
            if x == y:
                continue
            if y in is_red and x not in is_red:
                x, y = y, x
            boss[y] = x
            hits[x] += hits[y]
            ends[x] += ends[y]
            arcs[x] += arcs[y]
            for c, k in kids[y].items():
                if c in kids[x]:
                    todo.append((kids[x][c], k))
                else:
                    kids[x][c] = k

    red, is_red = [0], {0}
    while True:
        red = [r for r in red if of(r) == r]
        blue = {of(k) for r in red for k in kids[r].values()} - is_red
        if not blue:
            break
        node = min(blue, key=lambda b: (-hits[b], b))
        like = next((r for r in red if hits[node] >= few and hits[r] >= few and compatible(r, node)), None)
        if like is None:
            red.append(node)
            is_red.add(node)
        else:
            fold(like, node)
            unlike.clear()
    number = {r: i for i, r in enumerate(red)}
    shares = Counter(ch for v in values for ch in v)
    total, wide = sum(shares.values()), len(shares)
    moves, stops, usual = [], [], []
    for r in red:
        # half an end in one visit more; a symbol of each kind more, shared as the family's symbols are
        stop, n = (ends[r] + 0.5) / (hits[r] + 1), sum(arcs[r].values()) + wide
        ways = Counter()
        for c, k in kids[r].items():
            ways[number[of(k)]] += arcs[r][c]
        most = min(ways, key=lambda s: (-ways[s], s)) if ways else number[r]
        moves.append({ch: (math.log((1 - stop) * (arcs[r][ch] + wide * q / total) / n), number[of(kids[r][ch])] if ch in kids[r] else most) for ch, q in sorted(shares.items())})
        stops.append(math.log(stop))
        usual.append(most)
    few_below = int(missed * len(values))
    model = Automaton(moves, stops, usual, 0.0, sorted(map(len, values))[few_below] if values else 0)
    model.cut = sorted(map(model.score, values))[few_below] - SLACK if values else 0.0
    return model


class Plain:
    """What is no secret: symbol pairs of the corpus' words and numbers."""

    def __init__(self, pairs: np.ndarray):
        self.logp = np.log((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * WIDTH))

    def loglik(self, value: str) -> float:
        code = np.concatenate(([0], _CODE[np.frombuffer(value.encode(), dtype=np.uint8)], [0]))
        return float(self.logp[code[:-1], code[1:]].sum())


class Grammars(dict):
    """The automata of each kind; ``plain`` is what they are weighed against."""

    def __init__(self, automata: dict[str, list[Automaton]] | None = None, pairs: np.ndarray | None = None):
        super().__init__(automata or {})
        self.plain = Plain(np.zeros((WIDTH, WIDTH)) if pairs is None else pairs)
        self.all = [a for kind in sorted(self) for a in self[kind]]
        self.tops = [a.best() for a in self.all]

    def accepts(self, value: str) -> bool:
        """Does the value have the format of a secret?"""
        least = self.plain.loglik(value) - math.log(PRIOR)
        return any(len(value) >= CUT_OFF * a.shortest and (ll := a.loglik(value)) >= least and ll / (len(value) + 1) >= a.cut for a in self.all)


def pair_counts(text: str, base: list[tuple[int, int, str, str]]) -> np.ndarray:
    """WIDTH x WIDTH counts of neighbouring symbols (0: none) in runs outside ``base`` that do not mix letters and digits."""
    raw, open_ = _bytes(text, base)
    code = np.where(open_, _CODE[raw], 0)
    stops = np.concatenate(([-1], np.flatnonzero(code == 0), [len(code)]))
    size = np.diff(stops)
    mixed = np.ones(len(size), dtype=bool)
    for some in (_DIGIT, _LETTER):
        n = np.concatenate(([0], np.cumsum(some[raw] & open_)))
        mixed &= n[stops[1:]] > n[stops[:-1] + 1]
    inside = np.repeat(mixed, size)[: len(code)] if len(code) else np.zeros(0, dtype=bool)
    code = np.concatenate(([0], np.where(inside, 0, code), [0])).astype(np.int64)
    pair = code[:-1] * WIDTH + code[1:]
    return np.bincount(pair[pair > 0], minlength=WIDTH * WIDTH)


def _bytes(text: str, base: list[tuple[int, int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes, and which of them no base span covers."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    open_ = np.ones(len(raw), dtype=bool)
    if base:
        first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each code point
        for s, _, e, _ in base:
            open_[first[s] : first[e]] = False
    return raw, open_


def candidates(text: str, base: list[tuple[int, int, str, str]], models: Grammars) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) in bytes of runs of 8 or more key characters outside ``base`` that may be secrets:
    whole runs without dots at their end, then their parts between ``.``, ``=`` and ``/``."""
    raw, open_ = _bytes(text, base)
    code = _CODE[raw]
    last = np.maximum.accumulate(np.where(raw != 46, np.arange(len(raw)), -1))
    ahead = np.concatenate(([0], code[:-1]))
    plain = None
    for keys in (_KEY_BYTE, _NARROW):
        inside = keys[raw] & open_
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        s, e = edges[::2], edges[1::2]
        far = e - s >= MIN_CANDIDATE
        s, e = s[far], e[far]
        e = np.minimum(e, last[e - 1] + 1)
        far = e - s >= MIN_CANDIDATE
        s, e = s[far], e[far]
        if not len(s):
            continue
        if plain is None:
            plain = np.concatenate(([0.0], np.cumsum(models.plain.logp[ahead, code])))
            tops = [np.concatenate(([0.0], np.cumsum(t[code]))) for t in models.tops]
        # a run begins after and ends before no symbol; its first pair is corrected for that
        lp = models.plain.logp
        words = plain[e] - plain[s + 1] + lp[0, code[s]] + lp[code[e - 1], 0]
        may = np.zeros(len(s), dtype=bool)
        for t, top, a in zip(tops, models.tops, models.all, strict=True):  # the likeliest way, whatever the states
            most = t[e] - t[s] + top[0]
            may |= (e - s >= CUT_OFF * a.shortest) & (most >= words - math.log(PRIOR) - 1e-6) & (most >= a.cut * (e - s + 1) - 1e-6)
        for x, y in zip(s[may].tolist(), e[may].tolist(), strict=True):
            yield x, y, raw[x:y].tobytes().decode()


def labelled_values(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, value, pair, n): every base match of every document, and per batch the counts of symbol pairs (kind null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            pairs = np.zeros(WIDTH * WIDTH, dtype=np.int64)
            for t in b.column(0).to_pylist():
                if t:
                    base = base_spans(t, _runs(t))
                    for _, k, _, v in base:
                        found[KINDS[k], v] = found.get((KINDS[k], v), 0) + 1
                    pairs += pair_counts(t, base)
            some = np.flatnonzero(pairs)
            kinds, values = [k for k, _ in found] + [None] * len(some), [v for _, v in found] + [None] * len(some)
            at = [None] * len(found) + some.tolist()
            n = [*found.values(), *pairs[some].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["kind", "value", "pair", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, value string, pair int, n long")


def training_sample(values: DataFrame, train_values: int = TRAIN_VALUES) -> DataFrame:
    """The ``train_values`` rows of smallest hash of each kind, of a stored table of distinct (kind, value).

    Hashes are spread evenly, so a bar on the hash leaves about four times as many rows
    before they are ranked, however many tasks and values there are."""
    n = {r["kind"]: r["n"] for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # one row per kind
    bar = F.lit(None).cast("long")
    for kind, count in n.items():
        share = min(1.0, 4 * train_values / count)
        bar = F.when(F.col("kind") == kind, F.lit(int(-(2**63) + share * (2**64 - 1025)))).otherwise(bar)
    low = values.withColumn("h", F.xxhash64("value")).where(F.col("h") <= bar)
    first = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    return low.withColumn("r", first).where(F.col("r") <= train_values).select("kind", "value")


def learn(docs: DataFrame, text_col: str = "text", train_values: int = TRAIN_VALUES, train_length: int = TRAIN_LENGTH) -> Grammars:
    """The automata of each kind that has labelled values, those of a kind inferred in one task.

    At most ``train_values`` distinct values of a kind and of at most ``train_length`` characters are learned
    from; symbol pairs are counted over all documents."""
    seen = store(labelled_values(docs, text_col))
    values = store(seen.where(F.col("kind").isNotNull() & (F.length("value") <= train_length)).select("kind", "value").distinct())

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for f, some in enumerate(families(sorted(pdf["value"].tolist()))):
            m = infer(some)
            rows += [(key[0], f, s, ch, lp, to, m.cut, m.shortest) for s, d in enumerate(m.moves) for ch, (lp, to) in sorted(d.items())]
            rows += [(key[0], f, s, "", lp, to, m.cut, m.shortest) for s, (lp, to) in enumerate(zip(m.ends, m.usual, strict=True))]
        return pd.DataFrame(rows, columns=["kind", "family", "state", "symbol", "logp", "target", "cut", "shortest"])

    arcs = training_sample(values, train_values).groupBy("kind").applyInPandas(fit, "kind string, family int, state int, symbol string, logp double, target int, cut double, shortest int")
    out: dict[str, list[Automaton]] = {}
    for (kind, _), pdf in arcs.toPandas().groupby(["kind", "family"]):  # at most 68 symbols of each state of the sample's trees
        n = int(pdf["state"].max()) + 1
        m = Automaton([{} for _ in range(n)], [0.0] * n, [0] * n, float(pdf["cut"].iloc[0]), int(pdf["shortest"].iloc[0]))
        for s, ch, lp, to in zip(pdf["state"], pdf["symbol"], pdf["logp"], pdf["target"], strict=True):
            if ch:
                m.moves[s][ch] = (lp, int(to))
            else:
                m.ends[s], m.usual[s] = lp, int(to)
        out.setdefault(str(kind), []).append(m)
    pairs = np.zeros(WIDTH * WIDTH)
    for r in seen.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 69 x 69 rows
        pairs[r["pair"]] = r["n"]
    discard(seen)
    discard(values)
    return Grammars(out, pairs.reshape(WIDTH, WIDTH))


def find(text: str | None, models: Grammars) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans of a text, ordered by start, then kind as listed."""
    if not text:
        return []
    base = base_spans(text, _runs(text))
    out = [(s, k, e) for s, k, e, _ in base]
    if models:
        taken: list[tuple[int, int]] = []
        for s, e, v in candidates(text, base, models):
            if models.accepts(v) and not any(b < e and s < t for b, t in taken):
                taken.append((s, e))
        if taken:
            raw = text.encode("utf-8", "surrogatepass")
            points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
            out += [(int(points[s]), 3, int(points[e])) for s, e in taken]
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, models: Grammars, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_format, base_spans, spans.

    Positions are code points, ends exclusive.  A null or empty text has no spans; repeated
    rows and null ids are kept; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t, models) for t in b.column(1).to_pylist()]
            count = [[sum(k == i for _, k, _ in f) for f in found] for i in range(4)]
            text = [_joined([x for x in f if x[1] < 3]) for f in found], [_joined(f) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in count), *(pa.array(t, pa.string()) for t in text)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_spans", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_spans string, spans string")


def mask(docs: DataFrame, models: Grammars, text_col: str = "text", mark: str = MASK) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark`` (overlapping spans by one)."""
    names = docs.columns

    def cover(text: str | None) -> str | None:
        spans = find(text, models)
        if not spans:
            return text
        out, at = [], 0
        for s, _, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(len(names))]
            i = names.index(text_col)
            cols[i] = pa.array([cover(t) for t in cols[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: whole texts of all documents."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, learn(docs)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_format")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets are masked; n_chars follows the text."""
    prepare(spark)
    out = mask(docs, learn(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out
