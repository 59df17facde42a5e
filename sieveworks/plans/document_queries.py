"""Files, bodies, tables and streams made from the given tables and read back."""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bodies as B
from ..operators import documents as D
from ..operators.shared import staged
from ..sources import sinks as S
from ..sources import table_functions as TF
from ..sources import workbooks as K
from ..streaming import alerts, late
from .common import shared_folder, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _step(sql: str | None) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


# Tables of pages: a header over a row, labels beside values, and cells around a nested table.
def _table_pages(s: SparkSession, d: str) -> DataFrame:
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    html = F.concat(
        F.lit("<table><tr><th>brand<th>size</tr><tr><td>"), cell("p_brand"), F.lit("<td> "), cell("p_size"), F.lit(" </table><p>x</p><table><tr><th>name</th><td>"), cell("p_name"), F.lit("</td></tr><tr><th>type</th><td>"), cell("p_type"),
        F.lit("</td></tr></table><table><tr><td>"), cell("p_partkey"), F.lit("<table><tr><th>in &amp; out</table></td><td>"), cell("p_retailprice"), F.lit("</td></tr>"),
    )
    return spread(table(s, d, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


_TABLES_SQL = """SELECT p_partkey AS page_id, t.* FROM part, LATERAL (VALUES
 (0, 'columns', false, 'brand|size', 0, p_brand || '|' || p_size), (1, 'key-value', false, '', 0, 'name|' || p_name), (1, 'key-value', false, '', 1, 'type|' || p_type),
 (2, 'columns', true, 'in & out', NULL, NULL), (3, 'headerless', false, '', 0, p_partkey || '|' || p_retailprice)) AS t(table_no, orientation, nested, headers, row_no, cells)"""


@_step(_TABLES_SQL)
def web_tables(s: SparkSession, d: str) -> DataFrame:
    """All rows of all tables of a page, by a table function."""
    return TF.tables_of(_table_pages(s, d), "page_id", "html").withColumns({"headers": F.array_join("headers", "|"), "cells": F.array_join("cells", "|")})


@_step("SELECT p_partkey AS page_id, unnest([0, 1, 2, 3]) AS table_no, unnest(['columns', 'key-value', 'columns', 'headerless']) AS orientation, unnest([2, 2, 1, 2])::INT AS columns, unnest([1, 2, 0, 1])::BIGINT AS rows FROM part")
def a_table_shape(s: SparkSession, d: str) -> DataFrame:
    """Orientation, width and rows of every table."""
    rows = TF.tables_of(_table_pages(s, d), "page_id", "html")
    wide = F.max(F.greatest(F.size("headers"), F.coalesce(F.size("cells"), F.lit(0))))
    return rows.groupBy("page_id", "table_no").agg(F.first("orientation").alias("orientation"), wide.alias("columns"), F.count("row_no").alias("rows"))


#: Texts a task, where files are made of them: a worker holds a batch of rows with all that is made of it, and a batch
#: is no larger than the task.
FILE_ROWS = 1_000


# Text documents written from documents.
@_step("SELECT doc_id, CAST(unnest(range(0, len(r))) AS INT) AS pos, md5(unnest(r)) AS md5 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS r FROM documents)")
def src_docx(s: SparkSession, d: str) -> DataFrame:
    """Documents as DOCX files, and their paragraphs by a table function."""
    made = S.docx_files(spread(table(s, d, "documents"), "doc_id", rows=FILE_ROWS).select(F.col("doc_id").alias("path"), "text"))
    rows = TF.paragraphs_of(made, "path", "content")
    return rows.select(F.col("path").alias("doc_id"), "pos", F.md5("text").alias("md5"))


# PDF files written from documents: an embedded font whose codes mean nothing without its map, objects in any order.
PAGE_LINES = 40


def _stream_object(body: bytes) -> bytes:
    packed = zlib.compress(body)
    return b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(packed), packed)


def pdf_of(text: str) -> bytes:
    """A file with the text's lines, ``PAGE_LINES`` a page."""
    lines = text.split("\n")
    codes = {c: k for k, c in enumerate(sorted(set(text), reverse=True), 1)}
    shown = lambda x: b"<" + b"".join(b"%04X" % codes[c] for c in x) + b"> Tj T*"
    pages = [lines[k : k + PAGE_LINES] for k in range(0, len(lines), PAGE_LINES)]
    chars = b"\n".join(b"<%04X> <%s>" % (k, c.encode("utf-16-be", "surrogatepass").hex().encode()) for c, k in codes.items())
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count %d/Kids[%s]/Resources<</Font<</F1 3 0 R>>>>>>" % (len(pages), b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages)))), 3: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R>>", 4: _stream_object(b"1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfchar\n%s\nendbfchar" % (len(codes), chars))}
    for k, page in enumerate(pages):
        objects[5 + 2 * k] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (6 + 2 * k)
        objects[6 + 2 * k] = _stream_object(b"BT /F1 10 Tf " + b"\n".join(map(shown, page)) + b" ET")
    out, places = b"%PDF-1.5\n", {}
    for n in sorted(objects, key=lambda n: zlib.crc32(b"%d" % n)):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, objects[n])
    table_of_places = b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, len(objects) + 1))
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer <</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table_of_places, len(objects) + 1, len(out))


def pdf_files(texts: DataFrame, key: str, text: str) -> DataFrame:
    made = F.pandas_udf(lambda x: x.map(lambda t: pdf_of(t or "")), "binary")
    return texts.select(key, made(text).alias("content"))


@_step(f"SELECT doc_id, (p + 1)::INT AS page, md5(trim(regexp_replace(array_to_string(r[p * {PAGE_LINES} + 1:(p + 1) * {PAGE_LINES}], chr(10)), '\\n+', chr(10), 'g'), chr(10))) AS md5 FROM (SELECT doc_id, r, unnest(range(0, (len(r) + {PAGE_LINES - 1}) // {PAGE_LINES})) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS r FROM documents))")
def src_pdf_text(s: SparkSession, d: str) -> DataFrame:
    """Documents as PDF files, and the text of their pages by a table function."""
    rows = TF.pages_of(pdf_files(spread(table(s, d, "documents"), "doc_id", rows=FILE_ROWS), "doc_id", "text"), "doc_id", "content")
    return rows.select("doc_id", "page", F.md5("text").alias("md5"))


# Bodies of answers: each page as a server might send it.
def _sent(pages: pd.Series, kinds: pd.Series) -> pd.Series:
    out = []
    for html, kind in zip(pages, kinds):
        raw = (html or "").encode()
        if kind in (1, 5):
            packed = gzip.compress(raw, 6, mtime=0)
            out.append(packed if kind == 1 else packed[: len(packed) // 2])
        elif kind in (2, 3):
            out.append(zlib.compress(raw, 6, 15 if kind == 2 else -15))
        elif kind == 6:
            out.append(gzip.compress(zlib.compress(raw), 6, mtime=0))
        else:
            out.append(raw if kind == 0 else (html or "").encode("latin-1", "replace"))
    return pd.Series(out)


def _answers(s: SparkSession, d: str) -> DataFrame:
    kind = (F.col("page_id") % 7).cast("int")
    name = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), kind + 1)
    body = F.pandas_udf(_sent, "binary")("html", kind)
    return spread(table(s, d, "pages"), "page_id", rows=FILE_ROWS).select("page_id", body.alias("body"), name((None, "gzip", "deflate", "Deflate", "identity", "x-gzip", "deflate, gzip")).alias("encoding"), name(("text/html", "text/html; charset=UTF-8", None, "text/html; charset=nonsense", 'text/html; charset="iso-8859-1"', "text/html", "text/html")).alias("content_type"))


@_step("SELECT page_id, CASE WHEN page_id % 7 <> 5 THEN md5(CASE WHEN page_id % 7 = 4 THEN regexp_replace(html, '[^\\x00-\\xFF]', '?', 'g') ELSE html END) END AS md5, CASE WHEN page_id % 7 = 5 THEN NULL WHEN page_id % 7 = 4 THEN 'iso-8859-1' ELSE 'utf-8' END AS charset, CASE WHEN page_id % 7 = 5 THEN 'cut off' END AS error FROM pages")
def src_body(s: SparkSession, d: str) -> DataFrame:
    """Text, characters and errors of answers' bodies."""
    rows = _answers(s, d).select("page_id", B.decoded("body", "encoding", "content_type").alias("b"))
    return rows.select("page_id", F.md5("b.text").alias("md5"), "b.charset", "b.error")


# Streams: events in four slices of time, of which every tenth event comes a slice late.
_SLICES = 4
_SLICE_SQL = f"(SELECT *, least((dayofmonth(ts) - 1) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, {_SLICES - 1})::INT AS slice FROM events)"


def _sliced(s: SparkSession, d: str) -> DataFrame:
    slice_of = F.least(F.floor((F.dayofmonth("ts") - 1) / 8) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0), F.lit(_SLICES - 1)).cast("int")
    return staged(table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", slice_of.alias("slice")), "slices")


@_step(f"SELECT event_type, count(*) AS rows, count_if(ts < seen - INTERVAL 1 DAY) AS late FROM (SELECT e.*, seen FROM {_SLICE_SQL} AS e JOIN (SELECT event_type, slice, max(top) OVER (PARTITION BY event_type ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT event_type, slice, max(ts) AS top FROM {_SLICE_SQL} GROUP BY 1, 2)) AS m ON m.event_type = e.event_type AND m.slice = e.slice) GROUP BY 1")
def stream_late_rows(s: SparkSession, d: str) -> DataFrame:
    """A stream of events in which none is lost: those in time, and those of the side table, by kind."""
    rows = _sliced(s, d)
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    for k in range(_SLICES):
        rows.filter(F.col("slice") == k).write.mode("append").parquet(f"{base}/in")
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/in")
        query = late.write_both(late.marked_late(stream, "event_type", "ts", 86_400), f"{base}/out", f"{base}/checkpoint")
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    kinds = late.read_side(s, f"{base}/out", False).withColumn("late", F.lit(0)).unionByName(late.read_side(s, f"{base}/out", True).withColumn("late", F.lit(1)))
    return kinds.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("late").alias("late"))


@_step("SELECT event_type, run, samples, rate, mean, CASE WHEN rate < mean - 0.1 THEN 'fell' WHEN rate < 0.4 THEN 'low' END AS alert FROM (SELECT *, avg(rate) OVER (PARTITION BY event_type ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean FROM (SELECT event_type, CAST(ts AS DATE) AS run, count(*) AS samples, avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0 END) AS rate FROM events GROUP BY 1, 2))")
def agg_rate_alerts(s: SparkSession, d: str) -> DataFrame:
    """Days on which a kind's share of good events fell, or is low."""
    events = table(s, d, "events").select("event_type", F.col("ts").cast("date").alias("run"), "value")
    return alerts.rate_alerts(events, "run", F.coalesce(F.col("value") > 20, F.lit(False)), by="event_type", floor=0.4, fall=0.1)


# Workbooks.
def _written(s: SparkSession, sheets: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """A workbook in the shared folder, read again."""
    path = f"{shared_folder(s).removeprefix('file:')}/book-{uuid.uuid4().hex}.xlsx"
    K.write_workbook(s, path, sheets, frozenset({"o_clerk"}))
    return K.read_workbooks(s.read.format("binaryFile").load(path).select("path", "content"), "path", "content", [name for name, *_ in sheets])


@_step("SELECT 'Orders' AS sheet, row_number() OVER (ORDER BY o_orderdate, o_orderkey)::INT AS place, concat_ws('|', o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE)) AS cells FROM orders UNION ALL SELECT 'Nations & regions', row_number() OVER (ORDER BY n_name)::INT, n_nationkey || '|' || n_name FROM nation UNION ALL SELECT 'Orders', 0, 'o_orderkey|o_custkey|o_orderstatus|day' UNION ALL SELECT 'Nations & regions', 0, 'n_nationkey|n_name' UNION ALL SELECT 'Empty', 0, 'n_name'")
def snk_xlsx(s: SparkSession, d: str) -> DataFrame:
    """A workbook of three tables, one empty, written by tasks and opened again."""
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    nations = table(s, d, "nation").select("n_nationkey", "n_name")
    rows = _written(s, [("Orders", orders, ["day", "o_orderkey"]), ("Nations & regions", nations, ["n_name"]), ("Empty", nations.filter("false").select("n_name"), ["n_name"])])
    return rows.select("sheet", "place", F.array_join("cells", "|").alias("cells"))


_FILES_SQL = "(SELECT o_orderkey AS file, o_orderstatus AS status, o_orderkey % 4 AS kind, o_orderkey % 11 = 0 AS failed FROM orders)"


@_step(f"SELECT 'Fields' AS sheet, row_number() OVER (ORDER BY lpad(file::VARCHAR, 12, '0'))::INT AS place, lpad(file::VARCHAR, 12, '0') || '|' || CASE kind WHEN 0 THEN 'a|' WHEN 1 THEN '|b' ELSE '|' END || '|' || status AS cells FROM {_FILES_SQL} WHERE NOT failed UNION ALL SELECT 'Fields', 0, 'file|first|second|status' UNION ALL SELECT lpad(file::VARCHAR, 12, '0') || ' 1', t[1], t[2] FROM (SELECT file, unnest([row(0, 'h|k'), row(1, file || '|' || status)]) AS t FROM {_FILES_SQL} WHERE NOT failed AND kind = 2) UNION ALL SELECT 'Failed', row_number() OVER (ORDER BY lpad(file::VARCHAR, 12, '0'))::INT, lpad(file::VARCHAR, 12, '0') || '|no text' FROM {_FILES_SQL} WHERE failed")
def doc_workbook_sheets(s: SparkSession, d: str) -> DataFrame:
    """The sheets of a workbook of many files: fields by the union of their keys, tables, and what failed."""
    k = F.col("o_orderkey") % 4
    fields = F.map_filter(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("first"), F.when(k == 0, "a"), F.lit("second"), F.when(k == 1, "b")), lambda _, v: v.isNotNull())
    cells = F.array(F.array(F.array(F.lit("h"), F.lit("k")), F.array(F.col("o_orderkey").cast("string"), "o_orderstatus")))
    files = table(s, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file"), fields.alias("fields"), F.when(k == 2, cells).otherwise(F.array().cast("array<array<array<string>>>")).alias("tables"), F.when(F.col("o_orderkey") % 11 == 0, "no text").alias("error"))
    return D.workbook_sheets(files).select("sheet", "place", F.array_join("cells", "|").alias("cells"))
