"""Large CSV files read by ranges, against the parser that takes a file whole."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from musterline.sources.large_sheets import read_large_sheets
from musterline.sources.sheets import read_sheets

COLUMNS = ("row_no", "employee_id", "employee_name", "department", "company_email", "customer_leave", "internal_leave", "problem")


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return sorted((tuple(r) for r in df.select(name, *COLUMNS).collect()), key=repr)


def write(path, header, rows):
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerow(header)
        writer.writerows(rows)


def test_equals_the_whole_file_parser(spark, tmp_path, small_ranges):
    rand = random.Random(6)
    folder = tmp_path / "manager_id=m1"
    folder.mkdir()

    def cell():
        return rand.choice(["", " ", "plain", "a,b", 'say "x"', "two\nlines", "\n\n", "é 日本", "x" * rand.randrange(80), "\\", "007", '"'])

    write(folder / "large.csv", ["Emp ID ", "Name", "Other", "EMAIL"], [[f" {i} ", cell(), cell(), cell()][: rand.choice([2, 4, 4, 4])] for i in range(900)])
    write(folder / "other.csv", ["Department", "Employee ID", "Emp ID", "Name"], [[cell(), str(i), "no", cell(), "more", "cells"] for i in range(40)])
    (folder / "blank.csv").write_text("﻿Employee ID,Name\n\n1,a\n\n\n2,\n", encoding="utf-8")
    (folder / "crlf.csv").write_bytes(b"employee id,name\r\n1,a\r\n2,b")
    (folder / "badge.csv").write_text("Badge,Name\n1,a\n")
    (folder / "header.csv").write_text("Employee ID\n")
    (folder / "bytes.csv").write_bytes(b"Employee ID\n\xff\xfe\n")
    (folder / "notes.txt").write_text("Employee ID\n1\n")
    whole = read_sheets(spark, str(tmp_path)).where("path not like '%notes.txt'")
    ours = read_large_sheets(spark, str(tmp_path))
    assert rows_of(ours) == rows_of(whole)


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_ranges):
    write(tmp_path / "one.csv", ["Employee ID", "Name"], [[i, "n" * 40] for i in range(2000)])
    scan = spark.read.text(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 10
    found = read_large_sheets(spark, str(tmp_path))
    assert found.count() == 2000 and found.where("row_no <> cast(employee_id as long) + 1").count() == 0


def test_open_quotes_and_no_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('Employee ID,Name\n1,"a\n2,b\n')
    (tmp_path / "good.csv").write_text("Employee ID,Name\n1,a\n")
    got = rows_of(read_large_sheets(spark, str(tmp_path)))
    assert [(r[0], r[1], r[2], r[-1]) for r in got] == [("good.csv", 1, "1", None), ("open.csv", 0, None, "OPEN_QUOTE")]
    assert rows_of(read_large_sheets(spark, str(tmp_path), pattern="*.none")) == []


def test_extra_headers_and_file_filter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Badge\n5\n")
    (tmp_path / "b.csv").write_text("Employee ID\n6\n")
    got = rows_of(read_large_sheets(spark, str(tmp_path), {"badge": "employee_id"}, "a*.csv"))
    assert [(r[0], r[2]) for r in got] == [("a.csv", "5")]
