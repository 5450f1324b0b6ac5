"""CSV records read in blocks against the standard library's reader, on one whole file at a time."""

import contextlib
import csv
import io
import random

import pytest

from millrace.errors import InvalidInput
from millrace.sources import delimited, files


@contextlib.contextmanager
def blocks(spark, size):
    """Files are cut every `size` bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(seed, rows):
    r = random.Random(seed)
    value = lambda: "".join(r.choice(["a", "é字", '"', ",", "\n", "\r\n", " ", '""', "b" * r.randrange(1, 40)]) for _ in range(r.randrange(1, 9)))
    return [[str(i), value(), value()] for i in range(rows)]


@pytest.mark.parametrize("seed, size, end", [(1, 50, "\n"), (2, 120, "\r\n"), (3, 7, "\n"), (4, 10**6, "\n")])
def test_records_of_any_block_size(spark, tmp_path, seed, size, end):
    rows = written(seed, 40 if size > 7 else 8)
    for name, part in (("one.csv", rows[: len(rows) // 2]), ("two.csv", rows[len(rows) // 2 :])):
        with open(tmp_path / name, "w", newline="") as out:
            made = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL if seed % 2 else csv.QUOTE_ALL)
            made.writerow(["id", "x", "y"])
            made.writerows(part)
    with blocks(spark, size):
        if size < 1000:
            assert delimited._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        got = files.read_csv(spark, str(tmp_path), header=True).collect()
    assert sorted([str(r.id), r.x, r.y] for r in got) == sorted(rows)


def test_a_field_longer_than_many_blocks(spark, tmp_path):
    long = "line, of\n" * 200
    (tmp_path / "long.csv").write_text(f'id,x\n1,"{long}"\n2,short\n3,"{long}""{long}"\n4,"open \n end')
    with blocks(spark, 100):
        texts = {r.text for r in delimited.records(spark, str(tmp_path / "long.csv")).collect()}
    assert texts == {"id,x", f'1,"{long}"', "2,short", f'3,"{long}""{long}"', '4,"open \n end'}


def test_quotes_inside_plain_fields_open_nothing(spark, tmp_path):
    (tmp_path / "pipes.csv").write_text('id,x\n1,5" pipe\n2,"a"b\n3, "c\n4,d"\n\n  \n5,"e\nf"\n')
    with blocks(spark, 9):
        got = files.read_csv(spark, str(tmp_path / "pipes.csv"))
        assert dict(got.dtypes) == {"id": "bigint", "x": "string"}
        assert {r.id for r in got.collect()} == {1, 2, 3, 4, 5} and {r.x for r in got.filter("id IN (1, 5)").collect()} == {'5" pipe', "e\nf"}


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,NAME,,n\nx,y,z,1\nname,NAME,,n\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "a.csv"), header=True, schema="a string, b string").collect()
    got = files.read_csv(spark, str(tmp_path / "a.csv"), header=True)
    assert got.columns == ["name0", "NAME1", "_c2", "n"] and got.count() == 2  # a row that equals the header is a row
    (tmp_path / "b.csv").write_text("other,x\n1,2\n")
    with pytest.raises(InvalidInput):
        files.read_csv(spark, str(tmp_path), header=True)
    (tmp_path / "only.csv").write_text("p,q\n")
    assert files.read_csv(spark, str(tmp_path / "only.csv"), header=True).columns == ["p", "q"]
    (tmp_path / "none.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "none.csv")).columns == []


@pytest.mark.parametrize("seed", [1, 2])
def test_state_of_lines(seed):
    r = random.Random(seed)
    for _ in range(3000):
        line = "".join(r.choice('",a') for _ in range(r.randrange(9)))
        for inside in (False, True):
            state, i = "quoted" if inside else "start", 0
            while i < len(line):
                c = line[i]
                if state == "start":
                    state = "quoted" if c == '"' else "start" if c == "," else "plain"
                elif state == "plain":
                    state = "start" if c == "," else "plain"
                elif c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    state = "plain"
                i += 1
            assert delimited.inside_after(line, inside) == (state == "quoted")

