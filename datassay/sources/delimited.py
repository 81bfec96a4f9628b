"""Delimited text: decoding, delimiter, headers, records with quoted line breaks, ragged rows; one file or many."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DELIMITERS = (",", "\t", ";", "|")
ACCEPTED = (".csv", ".tsv", ".txt")
FRACTION_OR_NEGATIVE = re.compile(r"^\s*(-\d+(\.\d+)?|\d*\.\d+)\s*$")


@dataclass
class Intake:
    """A file's verdict: how it was read, and what was odd about it."""

    path: str
    encoding: str
    delimiter: str
    headerless: bool
    columns: list[str]
    ragged: int = 0
    ragged_lines: list[int] = field(default_factory=list)
    rows: int = 0
    ragged_rows: list[int] = field(default_factory=list)


def accepted(path: str) -> bool:
    return path.lower().endswith(ACCEPTED)


def split_line(line: str, delimiter: str) -> list[str]:
    """One line's cells, with double quotes and doubled quotes inside them."""
    out, cell, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"' and line[i + 1 : i + 2] == '"':
            cell.append('"')
            i += 1
        elif c == '"' and (quoted or not cell):
            quoted = not quoted
        elif c == delimiter and not quoted:
            out.append("".join(cell))
            cell = []
        else:
            cell.append(c)
        i += 1
    return [*out, "".join(cell)]


def guess_delimiter(lines: list[str], records=None) -> str:
    """The delimiter that cuts most of the first records into the same number of cells, two or more; of those the one with most cells."""
    def rating(d: str) -> tuple[bool, float, int]:
        widths = [len(cells_of(x, d)) for x in (records(d) if records else lines) if x.strip()]
        usual = max(set(widths), key=lambda w: (widths.count(w), w), default=1)
        return usual > 1, widths.count(usual) / max(1, len(widths)), usual

    return max(DELIMITERS, key=rating)


def header_names(cells: list[str]) -> list[str]:
    """Names without a byte order mark; a blank one is column_<place>, a repeated one gets a number."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name = base = c.lstrip("﻿").strip() or f"column_{i + 1}"
        n = 1
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def is_headerless(cells: list[str]) -> bool:
    """At least half of the first line's cells are negative or fractional numbers: those are values, not names."""
    return bool(cells) and sum(bool(FRACTION_OR_NEGATIVE.match(c)) for c in cells) * 2 >= len(cells)


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, headerless: bool | None = None, sample: int = 20) -> tuple[DataFrame, Intake]:
    """(df, intake) of one file: every cell a string, cells that a row lacks null; ragged rows are counted, the first three by number."""
    scan = Scan(spark, path, delimiter, headerless, sample)
    if not scan.files:
        return spark.createDataFrame([], "column_1 string"), Intake(path, "UTF-8", delimiter or ",", False, [])
    if len(scan.files) > 1:
        raise ValueError(f"{path} has {len(scan.files)} files: read them with read_many()")
    (name,) = scan.files
    verdict = {r["file"]: r for r in scan.verdicts().collect()}[name]
    about = scan.files[name]
    intake = Intake(path, about.encoding, about.delimiter, about.headerless, about.columns, verdict["ragged"], list(verdict["ragged_lines"]), verdict["rows"], list(verdict["ragged_rows"]))
    return scan.table(name), intake


def read_many(spark: SparkSession, path: str, delimiter: str | None = None, headerless: bool | None = None, sample: int = 20) -> tuple[Scan, DataFrame]:
    """(scan, verdicts) of all files under a path or glob, each with its own encoding, delimiter, header and width; scan.table(file) is one of them, scan.rows() all."""
    scan = Scan(spark, path, delimiter, headerless, sample)
    return scan, scan.verdicts()


@dataclass
class About:
    """How one file is read. open_: in which splits a record is under way at the start or the end."""

    delimiter: str
    headerless: bool
    columns: list[str]
    encoding: str = "UTF-8"
    starts: dict[int, tuple[bool, int, int, int]] = field(default_factory=dict)
    open_: list[int] = field(default_factory=list)


def opening(delimiter: str) -> re.Pattern:
    """A quoted field from its opening quote, which begins a cell, to its closing one; group 1 is empty where the line ends first."""
    return re.compile(rb'(?:\A|%s)"(?:[^"]|"")*("?)' % re.escape(delimiter.encode()))


def ends_open(line: bytes, inside: bool, quoted: re.Pattern) -> bool:
    """Whether a quoted cell is open at the line's end; inside: whether one is at its start, which is as if the line began with its quote."""
    line = b'"' + line if inside else line
    return b'"' in line and any(not m.group(1) for m in quoted.finditer(line))


def cells_of(text: str, delimiter: str) -> list[str]:
    """The cells of one record, which may hold line breaks."""
    if '"' not in text:
        return text.split(delimiter)
    try:
        return next(csv.reader([text], delimiter=delimiter, strict=False))
    except (csv.Error, StopIteration):
        return split_line(text, delimiter)


def bare(line: bytes) -> bytes:
    return line[:-1] if line.endswith(b"\r") else line


class Scan:
    """A parallel, quote-aware scan of delimited files.

    Spark deals files out in splits, and a split can't see whether it begins inside a quoted cell. So a first pass reads each split both ways, as
    begun outside and inside of quotes, and says what it would be at its end, how many records begin and how many lines there are. From these
    few numbers, composed in order, follow each split's true state and the numbers of its first record and line. A second
    pass then cuts records and cells; those that lie over the ends of splits are put together from their parts.

    Lines end with a line feed, or a carriage return and one. Empty lines outside of quotes are no records. The driver holds some numbers a split and
    a file's first lines.
    """

    def __init__(self, spark: SparkSession, path: str, delimiter: str | None, headerless: bool | None, sample: int):
        self.spark, self.path = spark, path
        lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))
        self.lines = lines
        self.files: dict[str, About] = {}
        for name, first in sorted(self._first_lines(sample).items()):
            self.files[name] = about_file(first, delimiter, headerless)
        if self.files:
            self._place_splits()

    def _first_lines(self, sample: int) -> dict[str, list[bytes]]:
        def head(batches):
            seen: dict[str, int] = {}
            for batch in batches:
                out = []
                for name, at, line in zip(*(c.to_pylist() for c in batch.columns)):
                    k = seen.get(name, 0)
                    if at == 0 and k < 10 * sample:
                        seen[name] = k + 1
                        out.append((name, k, line))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["file", "k", "line"])

        found: dict[str, list] = {}
        for r in self.lines.where("at = 0").mapInArrow(head, "file string, k bigint, line binary").collect():  # a bounded number of lines a file
            found.setdefault(r["file"], []).append((r["k"], bytes(r["line"])))
        return {name: [line for _, line in sorted(own)] for name, own in found.items()}

    def _place_splits(self) -> None:
        quoted = {name: opening(a.delimiter) for name, a in self.files.items()}

        def both_ways(batches):
            # (file, split) -> lines, valid UTF-8, and for either start: open now, records begun, line and record of the last one begun.
            found: dict[tuple, list] = {}
            for batch in batches:
                for name, at, line in zip(*(c.to_pylist() for c in batch.columns)):
                    own = found.setdefault((name, at), [0, True, [False, 0, 0], [True, 0, 0]])
                    for way in own[2:]:
                        if not way[0] and bare(line):
                            way[1:] = [way[1] + 1, own[0] + 1]
                        if way[0] or b'"' in line:
                            way[0] = ends_open(line, way[0], quoted[name])
                    own[0] += 1
                    if own[1] and not line.isascii():
                        try:
                            line.decode()
                        except UnicodeDecodeError:
                            own[1] = False
            rows = [(*k, v[0], v[1], *v[2], *v[3]) for k, v in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "at", "lines", "valid", "open0", "begun0", "last0", "open1", "begun1", "last1"])

        schema = "file string, at bigint, lines bigint, valid boolean, open0 boolean, begun0 bigint, last0 bigint, open1 boolean, begun1 bigint, last1 bigint"
        found: dict[str, list] = {}
        for r in self.lines.mapInArrow(both_ways, schema).collect():  # a row a split
            found.setdefault(r["file"], []).append(r)
        for name, splits in found.items():
            about, inside, line, record, begun_at = self.files[name], False, 1, 0, 0
            about.encoding = "UTF-8" if all(r["valid"] for r in splits) else "windows-1252"
            for r in sorted(splits, key=lambda r: r["at"]):
                about.starts[r["at"]] = (inside, line, record, begun_at)
                k = int(inside)
                if r[f"begun{k}"]:
                    begun_at = line + r[f"last{k}"] - 1
                record += r[f"begun{k}"]
                line += r["lines"]
                was, inside = inside, r[f"open{k}"]
                if was or inside:
                    about.open_.append(r["at"])
            if inside:  # a quote that is never closed: the last record goes to the file's end
                about.open_ = sorted(set(about.open_))

    def rows(self) -> DataFrame:
        """(file, line, record, cells): every record but headers, by the number of its first line and its own, both from 1; the header counts."""
        plans = {name: (a.delimiter, a.encoding, a.starts, opening(a.delimiter)) for name, a in self.files.items()}
        codec = {"UTF-8": "utf-8", "windows-1252": "cp1252"}

        def text_of(line: bytes, name: str, first: bool) -> str:
            line = line[3:] if first and line.startswith(b"\xef\xbb\xbf") else line
            return line.decode(codec[plans[name][1]], errors="replace")

        def cut(batches, parts: bool):
            """Whole records as cells; or, parts, what splits have of records that lie over their ends."""
            state: dict[tuple, list] = {}

            def take(name, at, line):
                own = state.get((name, at))
                if own is None:
                    inside, number, record, begun = plans[name][2][at]
                    # open, next line, records so far, first line of the record under way, its lines, whether it began before
                    own = state[name, at] = [inside, number, record, begun, [], inside]
                out = None
                if not own[0] and not bare(line):
                    own[1] += 1
                    return None
                if not own[0]:
                    own[2] += 1
                    own[3], own[4], own[5] = own[1], [], False
                own[4].append(line)
                own[0] = own[0] and ends_open(line, True, plans[name][3]) or not own[0] and b'"' in line and ends_open(line, False, plans[name][3])
                own[1] += 1
                if not own[0]:
                    out = (own[3], own[2], b"\n".join(own[4]), own[5])
                    own[4] = []
                return out

            for batch in batches:
                done = []
                for name, at, line in zip(*(c.to_pylist() for c in batch.columns)):
                    got = take(name, at, line)
                    if got and got[3] == parts:
                        done.append((name, got[0], got[1], at, text_of(got[2], name, got[0] == 1)))
                yield from packed(done, parts)
            if parts:
                yield from packed([(name, own[3], own[2], at, text_of(b"\n".join(own[4]), name, own[3] == 1)) for (name, at), own in state.items() if own[4]], parts)

        def packed(rows, parts):
            if rows:
                c = [list(x) for x in zip(*rows)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4])], names=["file", "line", "record", "at", "text"])
                else:
                    own = [cells_of(t[:-1] if t.endswith("\r") else t, plans[n][0]) for n, t in zip(c[0], c[4])]
                    yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(own, pa.list_(pa.string()))], names=["file", "line", "record", "cells"])

        def parse(batches):
            for batch in batches:
                yield from packed([(*r, 0, t) for *r, t in zip(*(x.to_pylist() for x in batch.columns))], False)

        schema = "file string, line bigint, record bigint, cells array<string>"
        out = self.lines.mapInArrow(lambda b: cut(b, False), schema)
        over = [(name, at) for name, a in self.files.items() for at in a.open_]
        if over:
            some = self.spark.createDataFrame(over, "file string, at bigint")  # splits, by name
            ends = self.lines.join(F.broadcast(some), ["file", "at"], "left_semi").mapInArrow(lambda b: cut(b, True), "file string, line bigint, record bigint, at bigint, text string")
            whole = ends.groupBy("file", "record").agg(F.min("line").alias("line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "\n").alias("text"))
            out = out.unionByName(whole.select("file", "line", "record", "text").mapInArrow(parse, schema))
        named = [name for name, a in self.files.items() if not a.headerless]
        return out.where((F.col("record") > 1) | ~F.col("file").isin(named)) if named else out

    def verdicts(self) -> DataFrame:
        """(file, encoding, delimiter, headerless, columns, rows, ragged, ragged_lines, ragged_rows, unusable): a row a file. Lines are of the file, rows count the header and skip empty lines."""
        about = self.spark.createDataFrame([(n, a.encoding, a.delimiter, a.headerless, a.columns) for n, a in self.files.items()], "file string, encoding string, delimiter string, headerless boolean, columns array<string>")
        rows = self.rows().select("file", "line", "record", F.size("cells").alias("width")).join(F.broadcast(about.select("file", F.size("columns").alias("want"))), "file")  # a row a file
        odd = rows.withColumn("odd", F.col("width") != F.col("want"))
        counts = odd.groupBy("file").agg(F.count("*").alias("rows"), F.count_if("odd").alias("ragged"))
        first = odd.where("odd").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("record"))).where("k <= 3")
        first = first.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("record", "line"))), lambda r: r["line"]).alias("ragged_lines"), F.sort_array(F.collect_list("record")).alias("ragged_rows"))
        out = about.join(counts, "file", "left").join(first, "file", "left")
        none = F.array().cast("array<bigint>")
        return out.select("file", "encoding", "delimiter", "headerless", "columns", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("ragged", F.lit(0)).alias("ragged"), F.coalesce("ragged_lines", none).alias("ragged_lines"), F.coalesce("ragged_rows", none).alias("ragged_rows"), ((F.size("columns") == 0) | F.col("rows").isNull()).alias("unusable"))

    def table(self, name: str) -> DataFrame:
        """One file's columns, in no given order of rows."""
        rows, columns = self.rows().where(F.col("file") == name), self.files[name].columns
        return rows.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def about_file(first: list[bytes], delimiter: str | None, headerless: bool | None) -> About:
    """How a file is read, from its first lines."""
    lines = [x.decode("utf-8-sig" if i == 0 else "utf-8", errors="replace").rstrip("\r") for i, x in enumerate(first)]
    try:
        b"\n".join(first).decode()
    except UnicodeDecodeError:
        lines = [x.decode("cp1252", errors="replace").rstrip("\r") for x in first]

    def records(d: str) -> list[str]:
        out: list[str] = []
        open_, quoted = False, opening(d)
        for line in lines:
            if open_:
                out[-1] += "\n" + line
            elif line:
                out.append(line)
            else:
                continue
            open_ = ends_open(line.encode(), open_, quoted)
        return out[:-1] if open_ and len(out) > 1 else out

    sep = delimiter or guess_delimiter(lines, records)
    head = records(sep)
    cells = cells_of(head[0], sep) if head else []
    bare_ = is_headerless(cells) if headerless is None else headerless
    return About(sep, bare_, [f"column_{i + 1}" for i in range(len(cells))] if bare_ else header_names(cells))
