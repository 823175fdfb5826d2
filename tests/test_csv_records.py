"""Records of CSV files found in blocks: against a reader that takes each file whole, and by hand."""

from __future__ import annotations

import csv
import io
import random
from contextlib import contextmanager

import pytest

from tableinsight.sources.csv import CSV_READ, Dialect, detect_dialects, read_csv, read_csv_robust, read_many_robust
from tableinsight.sources.files import DELIMITERS, csv_row_counts
from tableinsight.sources.records import block_states, in_records, records, text_lines, with_quotes, within_blocks


@contextmanager
def blocks_of(spark, n: int):
    settings = {"spark.sql.files.maxPartitionBytes": str(n), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def found_rows(frame):
    return sorted(tuple("" if v is None else v for v in r) for r in frame.collect())


def test_delimiters_are_counted_outside_quotes(spark, tmp_path):
    notes = "".join(f'{i};"first, line {i}\nsecond, with ""quotes"", here\n\nlast; one";{i * 2}\n' for i in range(50))
    (tmp_path / "notes.csv").write_text("id;note;n\n" + notes)
    names = "".join(f'"Last{i}, first";{i}\n' for i in range(50))
    (tmp_path / "names.csv").write_text("name;n\n" + names)
    every = "".join(f'"a;b|c,d\t{i}"\t"x,y;z"\n' for i in range(20))
    (tmp_path / "every.csv").write_text('"one;two"\t"three,four"\n' + every)
    paths = {n: str(tmp_path / f"{n}.csv") for n in ("notes", "names", "every")}
    found = {k.rsplit("/", 1)[1]: v.delimiter for k, v in detect_dialects(spark, list(paths.values())).items()}
    assert found == {"notes.csv": ";", "names.csv": ";", "every.csv": "\t"}
    for size in (64, 1 << 20):
        with blocks_of(spark, size):
            frame, _ = read_csv_robust(spark, paths["notes"])
            assert frame.columns == ["id", "note", "n"]
            assert found_rows(frame) == sorted(
                (str(i), f'first, line {i}\nsecond, with "quotes", here\n\nlast; one', str(2 * i)) for i in range(50)
            )
    frame, _ = read_csv_robust(spark, paths["names"])
    assert frame.columns == ["name", "n"] and frame.count() == 50 and frame.first().name.endswith(", first")
    assert read_csv_robust(spark, paths["every"])[0].columns == ["one;two", "three,four"]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    """Fields reach over several blocks, yet every block is a task of the scan."""
    body = "".join(f'{i},"{"word " * (i % 40)}\n\n{"tail " * 60}"\n' for i in range(60))  # 24 KB
    path = tmp_path / "wide.csv"
    path.write_text("id,note\n" + body)
    with blocks_of(spark, 240):
        lines = with_quotes(text_lines(spark, [str(path)]), DELIMITERS)
        states = block_states(lines).collect()
        assert len(states) > 50 and sum(r.start for r in states) > 10
        assert lines.rdd.getNumPartitions() > 50
        frame = read_csv(spark, str(path))
        assert frame.dtypes == [("id", "bigint"), ("note", "string")]
        expected = sorted((i, f"{'word ' * (i % 40)}\n\n{'tail ' * 60}") for i in range(60))
        assert found_rows(frame) == expected
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "FileScan csv" not in plan and "FileScan text" in plan
        assert csv_row_counts(spark, [str(path)]).first().n == 60


def test_quotes_inside_plain_text_open_nothing(spark, tmp_path):
    (tmp_path / "inch.csv").write_text('id;what;n\n1;5" pipe;2\n2;a "b" c;3\n3;"x\ny";4\n4;7";5\n')
    path = str(tmp_path / "inch.csv")
    with blocks_of(spark, 9):
        frame, _ = read_csv_robust(spark, path)
        assert found_rows(frame) == [("1", '5" pipe', "2"), ("2", 'a "b" c', "3"), ("3", "x\ny", "4"), ("4", '7"', "5")]
        assert csv_row_counts(spark, [path]).first().n == 4


CASES = {
    "mark and broken header": "﻿\"a\nz\",b\n1,\"x\ny\"\n".encode(),
    "doubled quotes at edges": b'a,b\n1,"""x\n"""\n2,""\n3,"""\n"""\n4,"\n"\n',
    "blank lines": b'a,b\n\n1,"x\n\n\ny"\n\n\n2,z\n  \n',
    "no last line end": b'a,b\n1,"x\ny"',
    "latin": 'a,b\n1,"é\nù"\n2,ç\n'.encode("latin-1"),
    "short and long records": b'a,b\n1,"x\ny",2,3\n4\n"5\n6"\n',
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [5])
def test_like_a_reader_of_whole_files(spark, tmp_path, name, size):
    path = tmp_path / "f.csv"
    path.write_bytes(CASES[name])
    encoding = "ISO-8859-1" if name == "latin" else "UTF-8"
    whole = spark.read.options(**CSV_READ).options(multiLine=True, encoding=encoding).csv(str(path))
    with blocks_of(spark, size):
        frame, _ = read_csv_robust(spark, str(path))
        assert frame.columns == whole.columns
        blank = tuple("" for _ in whole.columns)
        assert [r for r in found_rows(frame) if r != blank] == [
            r for r in found_rows(whole) if r != blank and any(v.strip() for v in r)
        ]


def test_line_breaks_stay_as_they_are(spark, tmp_path):
    """Two-byte line ends in fields are kept; a field left open ends with its file."""
    path = tmp_path / "f.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n2,z\r\n3,"never\nends\r\n')
    with blocks_of(spark, 9):
        rows = found_rows(read_csv_robust(spark, str(path))[0])
    assert rows == [("1", "x\r\ny"), ("2", "z"), ("3", "never\nends")]


def test_random_files(spark, tmp_path):
    """Any texts, any block size: what a writer quoted comes back to the character."""
    rng = random.Random(11)
    pieces = ["a", "é", '"', '""', "\n", "\n\n", ";", ",", "|", " ", "\t", "x" * 30, "'", "\\"]
    for turn in range(2):
        rows = [[str(i), *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(2))] for i in range(120)]
        out = io.StringIO()
        writer = csv.writer(out, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_ALL if turn % 2 else csv.QUOTE_MINIMAL)
        writer.writerows([["id", "b", "c"], *rows])
        path = tmp_path / f"r{turn}.csv"
        path.write_text(out.getvalue(), newline="")
        with blocks_of(spark, (40, 300)[turn]):
            texts = records(spark, [str(path)], [";"]).collect()
            assert sorted(r.record for r in texts) == list(range(121))
            read = [next(csv.reader(io.StringIO(r.text, newline=""), delimiter=";")) for r in texts if r.record]
            assert sorted(read) == sorted(rows)
            frame, _ = read_csv_robust(spark, str(path))
            assert found_rows(frame) == sorted(map(tuple, rows))


def test_broken_and_plain_files_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text("id,t\n2,z\n")
    assert found_rows(read_csv(spark, str(tmp_path))) == [(1, "x\ny"), (2, "z")]
    both = read_many_robust(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert found_rows(both) == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "c.csv").write_text('id,t\n3.5,"p\nq"\n')
    assert dict(read_csv(spark, str(tmp_path)).dtypes) == {"id": "double", "t": "string"}
    assert detect_dialects(spark, [str(tmp_path / "a.csv")]).popitem()[1] == Dialect("utf-8-sig", ",")


def test_only_records_across_blocks_move_twice(spark, tmp_path):
    """The lines of a record meet in their block; of 400 records a block border cuts one at most."""
    texts = [f"{i} first line\n\nsecond, {'x' * (i % 90)} \"\" line" for i in range(400)]
    data = "id,note\n" + "".join(f'{i},"{t}"\n' for i, t in enumerate(texts))
    (tmp_path / "a.csv").write_text(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(data) // 5))
    try:
        lines = in_records(with_quotes(text_lines(spark, [str(tmp_path)]), [","]))
        within = within_blocks(lines)
        plan = within._jdf.queryExecution().executedPlan().toString()
        assert "record" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
        blocks = within.select("block").distinct().count()
        assert blocks > 3
        assert within.filter("not whole").count() <= 2 * (blocks - 1)
        got = {r.record: r.text for r in records(spark, [str(tmp_path)], [","]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {0: "id,note"} | {i + 1: f'{i},"{t}"' for i, t in enumerate(texts)}


def test_line_breaks_are_told_with_the_dialect(spark, tmp_path, monkeypatch):
    """One pass over the lines of a file finds encoding, delimiter and line breaks in fields."""
    (tmp_path / "a.csv").write_text('id;note\n1;"a\nb"\n')
    (tmp_path / "b.csv").write_text("id;note\n2;c\n")

    def again(*_):
        raise AssertionError("the files are read once more")

    monkeypatch.setattr("tableinsight.sources.csv.files_with_open_quotes", again)
    frame, _ = read_csv_robust(spark, str(tmp_path))
    assert sorted(map(tuple, frame.collect())) == [("1", "a\nb"), ("2", "c")]
