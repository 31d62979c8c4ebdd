"""Records of delimited files with line ends in quoted cells, against Python's csv module."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vitalgrid.sources import split_csv
from vitalgrid.sources.readers import read_table

AWKWARD = ["40\n35", 'a "b" c', "x,y", "\r\n", "é世\n", "", '"', "plain", "7", "two\nline\nends", ',"\n",', "a\rb"]


def by_module(data: str, sep: str) -> list[tuple]:
    rows = list(csv.reader(io.StringIO(data, newline=""), delimiter=sep))
    width = len(rows[0])
    return [tuple((r + [None] * width)[:width]) for r in rows[1:] if r]


def written(rows, sep=",", end="\n", quoting=csv.QUOTE_ALL) -> str:
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=end, quoting=quoting).writerows(rows)
    return out.getvalue()


def texts(df):
    return [tuple(r) for r in df.collect()]


def awkward_rows(n, seed):
    rng = random.Random(seed)
    return [("key", "a\nb", "c")] + [(str(k), rng.choice(AWKWARD), rng.choice(AWKWARD)) for k in range(n)]


@pytest.mark.parametrize(("suffix", "sep", "end"), [(".csv", ",", "\n"), (".csv", ",", "\r\n"), (".tsv", "\t", "\n")])
def test_cut_anywhere(spark, tmp_path, suffix, sep, end):
    data = written(awkward_rows(7, 3), sep, end)
    path = tmp_path / f"t{suffix}"
    path.write_bytes(data.encode())
    want, size = by_module(data, sep), len(data.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for cut in (2, 5, 16, 40, 97, size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = read_table(spark, str(path))
            assert got.columns == ["key", "a\nb", "c"]
            assert sorted(texts(got)) == sorted(want), cut
            if cut >= 40:
                assert texts(got) == want, cut  # also in the file's order
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_files_and_many_tasks(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    want = []
    for k in range(3):
        data = written(awkward_rows(400, k), quoting=csv.QUOTE_MINIMAL)
        (folder / f"part{k}.csv").write_bytes(data.encode())
        want += by_module(data, ",")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        got = read_table(spark, str(folder))
        # an unquoted empty cell is null here and an empty text to the module
        assert sorted(tuple(x or "" for x in r) for r in texts(got)) == sorted(want)
        lines = split_csv._lines(spark, str(folder))
        assert lines.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_cell_of_the_report(spark, tmp_path):
    (tmp_path / "x.csv").write_text('DTOBITO,IDADE\n20200101,"40\n35"\n20200102,4035\n')
    assert texts(read_table(spark, str(tmp_path / "x.csv"))) == [("20200101", "40\n35"), ("20200102", "4035")]


def test_files_without_such_cells_use_the_plain_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x"\n2,5" pipe\n3,"y""z"\n4,\n')
    assert split_csv.quoted_ranges(spark, str(tmp_path / "x.csv"), ",") is None
    assert texts(read_table(spark, str(tmp_path / "x.csv"))) == [("1", "x"), ("2", '5" pipe'), ("3", 'y"z'), ("4", None)]


@given(st.lists(st.text(alphabet='ab," ', max_size=12), min_size=1, max_size=6))
@settings(max_examples=400, deadline=None)
def test_state_of_a_line_is_that_of_the_module(lines):
    """If the text so far ends inside a cell, the module reads one more line into the same record."""
    inside = False
    for k in range(len(lines)):
        inside = split_csv.inside_after(lines[k], inside, ",")
        data = "\n".join(lines[: k + 1])
        whole = list(csv.reader(io.StringIO(data + "\nZ", newline="")))
        assert inside == (not whole or whole[-1] != ["Z"])
