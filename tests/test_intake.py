"""Delimited intake: quoted line breaks, doubled quotes and ragged rows at exact numbers, over many splits and files."""

import csv
import io
import random

import duckdb
import pytest

from datassay.sources import delimited


@pytest.fixture
def tiny_splits(spark):
    """Splits of some 64 bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "64")
    spark.conf.set(keys[1], "1")
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def quoted_file(path, rows, d=",", end="\n", blank=()):
    """A file with every third cell quoted, and blank lines after some rows; what a plain parser reads from it."""
    out = []
    for i, row in enumerate(rows):
        out.append(d.join('"' + c.replace('"', '""') + '"' if any(x in c for x in (d, '"', "\n", "\r")) or (i + j) % 3 == 0 else c for j, c in enumerate(row)))
        out += [""] * (i in blank)
    path.write_bytes(end.join(out).encode() + end.encode())


def messy(n, seed=4):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(["a", "b ", '"', "\n", ",", "é", "12", "\n\n", '""', ";"]) for _ in range(r.randint(0, 9)))
    return [["id", "note", "x"]] + [[str(i), text(), str(r.random())] for i in range(n)]


@pytest.mark.parametrize(("d", "end"), [(",", "\n"), ("\t", "\r\n"), (";", "\n"), ("|", "\n")])
def test_quoted_breaks_over_splits(spark, tmp_path, tiny_splits, d, end):
    rows = messy(150)
    quoted_file(tmp_path / "a.csv", rows, d, end, blank={0, 3, 77})
    df, seen = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.rdd.getNumPartitions() > 10 and df.columns == ["id", "note", "x"]
    assert sorted(map(tuple, df.collect()), key=lambda r: int(r[0])) == [tuple(r) for r in rows[1:]]
    assert (seen.delimiter, seen.ragged, seen.rows, seen.encoding) == (d, 0, 150, "UTF-8")
    if end == "\n":
        other = duckdb.sql(f"select * from read_csv('{tmp_path / 'a.csv'}', header=true, all_varchar=true, delim='{d}', quote='\"', escape='\"', parallel=false)").fetchall()
        assert sorted((i, n or "", x) for i, n, x in other) == sorted(map(tuple, df.collect()))


def test_ragged_rows_at_exact_numbers(spark, tmp_path, tiny_splits):
    text = 'id,note,x\n1,"two\nlines",3\n\n4,5\n6,"say ""so"", twice",8\n9,10,11,12\n13,5" pipe,15\n"16","17\n\n17","18"\n19\n20,,\n21'
    (tmp_path / "r.csv").write_text(text)
    df, seen = delimited.read_delimited(spark, str(tmp_path / "r.csv"))
    got = sorted(map(tuple, df.collect()), key=lambda r: int(r[0]))
    assert got == [("1", "two\nlines", "3"), ("4", "5", None), ("6", 'say "so", twice', "8"), ("9", "10", "11"), ("13", '5" pipe', "15"), ("16", "17\n\n17", "18"), ("19", None, None), ("20", "", ""), ("21", None, None)]
    # Lines of the file, and rows as the header and non-empty records count.
    assert (seen.rows, seen.ragged, seen.ragged_lines, seen.ragged_rows) == (9, 4, [5, 7, 12], [3, 5, 8])


def test_quote_never_closed(spark, tmp_path, tiny_splits):
    (tmp_path / "q.csv").write_text("a,b\n1,2\n" + "3,4\n" * 40 + '5,"6\n' + "7,8\n" * 40)
    df, seen = delimited.read_delimited(spark, str(tmp_path / "q.csv"))
    rows = df.collect()
    assert len(rows) == 42 and seen.rows == 42 and max(len(r["b"]) for r in rows) > 150


def test_many_files(spark, tmp_path, tiny_splits):
    """One scan over files of unlike encoding, delimiter, header and width."""
    quoted_file(tmp_path / "1.csv", messy(30))
    (tmp_path / "2.tsv").write_bytes("﻿name\tgrad\nzürich\t1\n".encode())
    (tmp_path / "3.txt").write_bytes("stadt;t(°)\ngenève;21\nbern\n".encode("cp1252"))
    (tmp_path / "4.csv").write_text("0.5,-2,7\n1.5,-3,8\n")
    (tmp_path / "5.csv").write_text("")
    (tmp_path / "6.csv").write_text("only,a,header\n")
    scan, verdicts = delimited.read_many(spark, str(tmp_path))
    got = {r["file"].rsplit("/", 1)[1]: r for r in verdicts.collect()}
    assert sorted(got) == ["1.csv", "2.tsv", "3.txt", "4.csv", "6.csv"]  # an empty file has no line
    assert (got["1.csv"]["rows"], got["1.csv"]["ragged"]) == (30, 0)
    assert (got["2.tsv"]["columns"], got["2.tsv"]["delimiter"], got["2.tsv"]["encoding"]) == (["name", "grad"], "\t", "UTF-8")
    assert (got["3.txt"]["columns"], got["3.txt"]["encoding"], got["3.txt"]["ragged_rows"]) == (["stadt", "t(°)"], "windows-1252", [3])
    assert (got["4.csv"]["headerless"], got["4.csv"]["columns"], got["4.csv"]["rows"]) == (True, ["column_1", "column_2", "column_3"], 2)
    assert got["6.csv"]["unusable"] and not got["4.csv"]["unusable"]
    by = {n.rsplit("/", 1)[1]: n for n in scan.files}
    assert [tuple(r) for r in scan.table(by["2.tsv"]).collect()] == [("zürich", "1")]
    assert sorted(tuple(r) for r in scan.table(by["4.csv"]).collect()) == [("0.5", "-2", "7"), ("1.5", "-3", "8")]
    assert scan.rows().count() == 30 + 1 + 2 + 2


def test_lines_end_open():
    q = delimited.opening(",")
    assert [delimited.ends_open(x, False, q) for x in (b'a,"b', b'a,"b"', b'a,"b""', b'a b"c', b'"a"b"', b'"",",', b'"x,"",')] == [True, False, True, False, False, True, True]
    assert [delimited.ends_open(x, True, q) for x in (b"", b'b",c', b'b"",c', b'",""', b'","')] == [True, False, True, False, True]
    r = random.Random(1)
    for _ in range(300):
        rows = [["".join(r.choice('a",\n;') for _ in range(r.randint(0, 5))) for _ in range(3)] for _ in range(4)]
        s = io.StringIO()
        csv.writer(s, lineterminator="\n").writerows(rows)
        open_, out = False, []
        for line in s.getvalue().encode().split(b"\n")[:-1]:
            out = [*out[:-1], out[-1] + b"\n" + line] if open_ else [*out, line]
            open_ = delimited.ends_open(line, open_, q)
        assert not open_ and [delimited.cells_of(x.decode(), ",") for x in out] == rows
