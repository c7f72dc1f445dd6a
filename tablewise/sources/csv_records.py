"""CSV records cut in parallel: quoted line breaks without reading whole files in one task.

Whether a line starts inside a quoted cell depends on all lines before it. Each split of a file is therefore run once
for both start states (``flow``), the ends are composed split by split in file order, and a second pass, which now
knows its start state, joins lines to records. A record that crosses splits leaves a fragment in
each; fragments are brought together by the split in which their record began.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.session import materialize, ship_package


def open_after(line: bytes, inside: bool) -> bool:
    """Does a quoted cell stay open at the end of the line? ``inside``: the line starts in one.

    A quote opens a cell only as its first character; two quotes in a quoted cell are one character; what follows
    the closing quote runs to the next comma."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(b",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == b'"':
            at, inside = at + 2, True
            continue
        at = line.find(b",", at) + 1
        if not at:
            return False
        inside = False


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, line) in file order within a split; ``start`` names the split, lines are bytes."""
    text = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, closed, open, ends): the state after a split that starts outside or inside a quoted cell, and whether
    the record it starts inside of ends in it."""
    key, state, ends, out = None, (False, True), False, []
    for b in batches:
        for file, start, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, start) != key:
                if key is not None:
                    out.append((*key, *state, ends))
                key, state, ends = (file, start), (False, True), False
            if b'"' in line:
                one = open_after(line, state[0])
                state = (one, one if state[0] == state[1] else open_after(line, state[1]))
                ends = ends or not state[1]
    if key is not None:
        out.append((*key, *state, ends))
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "start", "closed", "open", "ends"])


def _records(began: dict[tuple[str, int], int | None], fragments: bool):
    """Whole records (file, began, start, header, record) of each split, or the fragments at its ends. ``began`` names the split in
    which the record began that a split starts inside of (null: none). The first record of a file is its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, head, state, header = None, [], False, False, False
        out: list[tuple] = []

        def emit(whole: bool) -> None:
            nonlocal header, held
            record, held = b"\n".join(held), []
            if whole and record == b"":
                return
            first = header and not head
            header = header and head
            if whole == fragments or whole and first:
                return
            out.append((key[0], began[key] if head else key[1], key[1], first, record))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            out.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "began", "start", "header", "record"])

        for b in batches:
            for file, start, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, start) != key:
                    if held:
                        emit(False)
                    key = (file, start)
                    if key not in began:
                        raise RuntimeError("the splits of a CSV file changed between two passes; set spark.sql.files.minPartitionNum")
                    head = state = began[key] is not None
                    header = start == 0
                held.append(line.removesuffix(b"\r"))
                state = open_after(line, state)
                if not state:
                    emit(not head)
                    head = False
            yield batch()
        if held:
            emit(False)
        yield batch()

    return run


def quoted_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, record): the bytes of each CSV record below the header, quoted line breaks kept as a line feed.

    Three passes over the lines, all split like any text file. The driver holds one small row per split (128 MB by
    default). Blank records are left out; a quote left open at the end of a file leaves the rest of it in one record
    (less the file's last line break)."""
    ship_package(spark)
    lines = _lines(spark, path)
    flows = lines.mapInArrow(_flows, "file string, start long, closed boolean, open boolean, ends boolean").collect()
    began: dict[tuple[str, int], int | None] = {}
    file, source, left_open = None, None, False
    for r in sorted(flows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            left_open = left_open or source is not None
            file, source = r["file"], None
        began[file, r["start"]] = source
        if source is None or r["ends"]:
            source = r["start"] if (r["closed"] if source is None else r["open"]) else None
    schema = "file string, began long, start long, header boolean, record binary"
    whole = lines.mapInArrow(_records(began, False), schema).select("file", "record")
    if source is None and not left_open and all(x is None for x in began.values()):
        return whole
    parts = materialize(lines.mapInArrow(_records(began, True), schema))
    # at most two fragments a split; a split's head comes before its open end by where their records began
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("start", "record"))), lambda x: F.hex(x["record"]))
    texts = F.unhex(F.array_join(pieces, "0A"))
    joined = parts.groupBy("file", "began").agg(texts.alias("record"), F.max("header").alias("header")).where("not header")
    return whole.union(joined.select("file", "record"))
