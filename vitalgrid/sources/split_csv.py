"""Delimited files whose quoted cells may hold line ends, read by many tasks per file.

A file is cut into ranges at any line end, so a range may begin inside a quoted
cell. What a line does to that state is a map from {outside, inside} to itself;
maps compose, so each range reports its own (first pass, lines with a quote
only), and one small prefix over the ranges of a file tells in which state each begins. Then
every range puts its own lines together to records (second pass). A record that
goes on in the next range is put together from its pieces, one per range, and
rows are sorted by range and place again; only then is there a shuffle.

Where no quoted cell holds a line end, callers can use Spark's reader as it is.
Quotes count as Python's ``csv`` module counts them: only at the start of a cell does one
open it, inside it a doubled one is a quote, and after it closes the rest of the cell is plain.
Records end in LF or CRLF.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of a record in its range; what a range has of an earlier one's last record comes before all.
_FIRST = -1


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that begins inside (or outside) a quoted cell ends inside one."""
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        at = line.find(sep, at) + 1
        if not at:
            return False


@dataclass(frozen=True)
class Range:
    """A range's state where it begins, and the start of the range that holds the first line of the record it begins in."""

    inside: bool
    opened: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        files, starts, values = (batch.column(k).to_pylist() for k in range(3))
        yield from zip(zip(files, starts, strict=True), values, strict=True)


def _maps(sep: str):
    """Per range with quotes: where each state leads, whether a cell holds a line end if it begins outside, and whether the inside is left."""
    names = ["file", "start", "after_outside", "after_inside", "ends_in_cell", "closes"]

    def row(key, states, ends, closes):
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, *states, ends, closes), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for key, line in _runs(batches):
            if key != at:
                if at is not None:
                    yield row(at, states, ends, closes)
                at, states, ends, closes = key, [False, True], False, False
            body = line.removesuffix("\r")
            states = [inside_after(body, s, sep) for s in states]
            ends, closes = ends or states[0] or "\r" in body, closes or not states[1]
        if at is not None:
            yield row(at, states, ends, closes)

    return run, "file string, start long, after_outside boolean, after_inside boolean, ends_in_cell boolean, closes boolean"


def quoted_ranges(spark: SparkSession, path: str, sep: str) -> dict[tuple[str, int], Range] | None:
    """States of the ranges that begin inside a cell, by file and start; None if no quoted cell of the files holds a line end.

    A row per range comes to the driver.
    """
    run, schema = _maps(sep)
    lines = _lines(spark, path)
    with_quotes = lines.where(F.contains("value", F.lit('"')))
    found = with_quotes.mapInArrow(run, schema)
    if found.where("ends_in_cell").isEmpty():
        return None
    maps = {(r["file"], r["start"]): r for r in found.collect()}
    out, inside, opened, last = {}, False, 0, None
    for file, start in sorted((r["file"], r["start"]) for r in lines.select("file", "start").distinct().collect()):
        if file != last:
            inside, opened, last = False, start, file
        if inside:
            out[file, start] = Range(True, opened)
        r = maps.get((file, start))
        before = inside
        if r:
            inside = r["after_inside"] if before else r["after_outside"]
        if not before or (r and r["closes"]):
            opened = start
    return out


def _records(ranges: dict[tuple[str, int], Range], sep: str):
    """(file, opened, start, number, open, text): records of a range, and pieces of those that go beyond it (``open``)."""
    kinds = {"file": pa.string(), "opened": pa.int64(), "start": pa.int64(), "number": pa.int64(), "open": pa.bool_(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, inside, number, held, opened = None, False, 0, [], 0

        def put(open_: bool):
            if held:
                rows.append((*at[:1], opened, at[1], number, open_, "\n".join(held)))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for key, line in _runs(batches):
            if key != at:
                put(True)
                at, begun = key, ranges.get(key)
                inside, number, held, opened = begun is not None, _FIRST if begun else 0, [], begun.opened if begun else key[1]
            held.append(line)
            if '"' in line:
                inside = inside_after(line.removesuffix("\r"), inside, sep)
            if not inside:
                put(number == _FIRST)
                number, held, opened = number + 1, [], key[1]
                if len(rows) >= 10_000:
                    yield batch()
                    rows = []
        put(inside)
        if rows:
            yield batch()

    return run, "file string, opened long, start long, number long, open boolean, text string"


def read_records(spark: SparkSession, path: str, sep: str, ranges: dict[tuple[str, int], Range]) -> DataFrame:
    """(text): every record of the files but their first one, the header; blank ones are left out, as Spark's reader does."""
    run, schema = _records(ranges, sep)
    rows = _lines(spark, path).mapInArrow(run, schema)
    if ranges:
        # a record's last piece is numbered before the own ones of its range, its first one after all of its range: pieces meet by where the record opened
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n")
        pieces = rows.where("open").groupBy("file", "opened").agg(joined.alias("text"), F.max(F.when(F.col("start") == F.col("opened"), F.col("number"))).alias("number"))
        whole = rows.where("not open").select("file", "opened", "number", "text").unionByName(pieces)
        rows = whole.orderBy("file", "opened", "number")
    text = F.regexp_replace("text", "\r\\z", "")
    return rows.where(~((F.col("opened") == 0) & (F.col("number") == 0))).select(text.alias("text")).where(F.trim("text") != "")
