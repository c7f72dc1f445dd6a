"""Quoted line breaks read by many tasks: the same rows as reading whole files."""

import csv
import io
import os
import random
from collections import Counter

import pytest

from tablewise.sources import csv_records
from tablewise.sources.readers import read_csv


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_automaton():
    assert csv_records.open_after(b'a,"b', False) and not csv_records.open_after(b'a,"b"', False)
    assert not csv_records.open_after(b'5" pipe,x"y', False)  # a quote inside an unquoted cell is a character
    assert not csv_records.open_after(b'end",x', True) and csv_records.open_after(b'end","again', True)
    assert csv_records.open_after(b'say ""hi""', True) and not csv_records.open_after(b'say ""hi"""', True)
    assert csv_records.open_after(b"", True) and not csv_records.open_after(b"", False) and not csv_records.open_after(b'""', False) and csv_records.open_after(b'"""', False)


@pytest.mark.parametrize("seed,ending", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_same_rows_as_whole_files(spark, tmp_dir, small_splits, seed, ending):
    rng = random.Random(seed)
    bits = ["plain", 'with "quotes"', "line\nbreak", "two\n\nbreaks", "a,b", "", "é" if seed == 3 else "e", "long " * 40, '"\n"', "\n" * 150, "NA"]
    for k in range(3):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=ending)
        w.writerow(["id", "first\nname" if seed == 2 else "name", "note"])
        w.writerows([k * 1000 + i, rng.choice(bits), rng.choice(bits) + rng.choice(bits)] for i in range(60))
        with open(os.path.join(tmp_dir, f"f{k}.csv"), "wb") as f:
            f.write(out.getvalue().encode("latin-1" if k == 1 else "utf-8"))
    got = read_csv(spark, tmp_dir)
    plain = Counter()
    for k in range(3):
        with open(os.path.join(tmp_dir, f"f{k}.csv"), newline="", encoding="latin-1" if k == 1 else "utf-8") as f:
            rows = list(csv.reader(f))
        assert got.columns == rows[0]
        plain.update((int(i), *(None if v in ("", "NA") else v for v in cells)) for i, *cells in rows[1:])
    assert rows_of(got) == plain and got.count() == 180
    if ending == "\n":
        want = read_csv(spark, tmp_dir, multiline=True)
        assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)
    records = csv_records.quoted_records(spark, tmp_dir)
    assert records.rdd.getNumPartitions() > 20


def test_open_quote_at_the_end_and_lone_carriage_returns(spark, tmp_dir, small_splits):
    for name, text in (("a.csv", 'x,y\n1,"one\ntwo"\n2,"never closed\n' + "more,\n" * 50 + "end"), ("b.csv", 'x,y\n1,"one\rtwo"\n2,"b\nc"\n')):
        path = os.path.join(tmp_dir, name)
        with open(path, "w", newline="") as f:
            f.write(text)
        assert rows_of(read_csv(spark, path, infer=False)) == rows_of(read_csv(spark, path, infer=False, multiline=True))
