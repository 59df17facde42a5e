"""Workbooks of many tasks."""

from __future__ import annotations

import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sieveworks.sources import workbooks


def test_checksums_of_joined_pieces():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(0, 300)), rng.randbytes(rng.randrange(0, 300))
        assert workbooks.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_segments_of_tasks_are_one_sheet_in_order(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    df = spark.range(5_000).repartition(7).select(F.col("id").cast("string").alias("code"), (F.col("id") / 7).alias("n"), F.concat(F.lit("<a> & \x01"), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 3 == 0, F.lit("x")).alias("sometimes"))
    odd = spark.sql("SELECT * FROM VALUES (1, CAST('NaN' AS DOUBLE), true, DATE '2024-01-02'), (2, 1234567.89D, NULL, NULL), (3, NULL, false, DATE '1999-12-31') AS t(k, v, b, `a \"<d>`)")
    workbooks.write_workbook(spark, path, [("Many", df, ["n"]), ("Odd <&> \"x\"", odd, ["k"]), ("None", odd.filter("false"), ["k"])], frozenset({"k"}))
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and len(z.namelist()) == 7
        assert b'<c t="inlineStr"><is><t xml:space="preserve">1</t></is></c><c/>' in z.read("xl/worksheets/sheet2.xml") and b"<v>1234567.89</v>" in z.read("xl/worksheets/sheet2.xml")
    assert os.listdir(tmp_path) == ["book.xlsx"]
    rows = {}
    for r in workbooks.read_workbooks(spark.read.format("binaryFile").load(path), "path", "content").collect():
        rows.setdefault(r.sheet, []).append((r.place, r.cells))
    many = [c for _, c in sorted(rows["Many"])]
    assert many[0] == ["code", "n", "t", "sometimes"] and [c[0] for c in many[1:]] == [str(k) for k in range(5_000)]
    assert all(c[2] == f"<a> & {k}" and float(c[1]) == k / 7 and c[3] == ("" if k % 3 else "x") for k, c in enumerate(many[1:]))
    assert sorted(rows["Odd <&> \"x\""]) == [(0, ["k", "v", "b", 'a "<d>']), (1, ["1", "", "true", "2024-01-02"]), (2, ["2", "1234567.89", "", ""]), (3, ["3", "", "false", "1999-12-31"])]
    assert rows["None"] == [(0, ["k", "v", "b", 'a "<d>'])]


def test_a_sheet_that_is_full_goes_on_in_another(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    workbooks.write_workbook(spark, path, [("A sheet whose name is 31 letters"[:31], spark.range(95), ["id"])], most_rows=41)
    rows = workbooks.read_workbooks(spark.read.format("binaryFile").load(path), "path", "content").filter("place > 0").collect()
    sheets = sorted({r.sheet for r in rows}, key=lambda n: min(int(r.cells[0]) for r in rows if r.sheet == n))
    assert sorted(int(r.cells[0]) for r in rows) == list(range(95)) and len(sheets) >= 3 and all(len(n) <= 31 for n in sheets)
    for n in sheets:
        own = [int(r.cells[0]) for r in sorted((r for r in rows if r.sheet == n), key=lambda r: r.place)]
        assert own == list(range(own[0], own[0] + len(own))) and len(own) <= 40


def test_sheets_of_one_table_are_read_as_one(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    one = spark.range(1).select(F.lit("other").alias("id"))
    workbooks.write_workbook(spark, path, [("A", spark.range(95), ["id"]), ("A (2)", one, ["id"]), ("B", one.filter("false"), ["id"])], most_rows=41)
    files = spark.read.format("binaryFile").load(path)
    rows = {}
    for r in workbooks.read_workbooks(files, "path", "content", ["A", "A (2)", "B"]).collect():
        rows.setdefault(r.sheet, []).append((r.place, *r.cells))
    assert sorted(rows["A"]) == [(0, "id"), *((k + 1, str(k)) for k in range(95))]
    assert sorted(rows["A (2)"]) == [(0, "id"), (1, "other")] and rows["B"] == [(0, "id")]
    assert len({r.sheet for r in workbooks.read_workbooks(files, "path", "content").collect()}) >= 5


def test_limits_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="31"):
        workbooks.write_workbook(spark, str(tmp_path / "b"), [("x" * 32, spark.range(1), ["id"])])
