"""Workbooks written by tasks.

Rows become XML in expressions, tasks deflate them into segments in the shared folder, and a commit message names each
segment with its size, checksum and rows. The commit strings the segments of a sheet together without inflating them:
deflated streams that end on a byte may follow each other, and the checksum of the whole is combined from those of
the parts. So the driver moves compressed bytes, a piece at a time, and sees no row. A sheet that passes the format's
rows goes on in another of the same name and a number.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import shutil
import struct
import uuid
import zipfile
import zlib
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Fixed values of the format.
MOST_ROWS, MOST_COLUMNS, MOST_NAME = 1_048_576, 16_384, 31
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml."
_HEAD, _TAIL = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode(), b"</sheetData></worksheet>"
SEGMENT_ROWS = 200_000
CHUNK = 10_000
ROWS = "sheet_no int, sheet string, xml string"


def _escaped(text: Column) -> Column:
    """Text for XML, without the characters that it has no form for."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def text_cell(value: Column) -> Column:
    held = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _escaped(value), F.lit("</t></is></c>"))
    return F.when(value.isNull() | (value == ""), "<c/>").otherwise(held)


def cell(column: str, kind: T.DataType, as_text: bool) -> Column:
    """Numbers with full precision, everything else as text; null, NaN and infinite numbers are empty."""
    value = F.col(column)
    if not isinstance(kind, T.NumericType) or as_text:
        return text_cell(value.cast("string"))
    fine = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf"))
    return F.when(fine, F.concat(F.lit("<c><v>"), value.cast("string"), F.lit("</v></c>"))).otherwise("<c/>")


def sheet_rows(number: int, name: str, df: DataFrame, order: list[str], text_columns: frozenset[str] = frozenset()) -> DataFrame:
    """The rows of one sheet with what orders them."""
    if len(df.columns) > MOST_COLUMNS:
        raise ValueError(f"a sheet has at most {MOST_COLUMNS} columns")
    cells = [cell(f.name, f.dataType, f.name in text_columns) for f in df.schema.fields]
    return df.select(F.lit(number).alias("sheet_no"), F.lit(name).alias("sheet"), F.struct(*order).alias("o"), F.concat(F.lit("<row>"), *cells, F.lit("</row>")).alias("xml"))


def header(df: DataFrame) -> str:
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{_plain(c)}</t></is></c>' for c in df.columns) + "</row>"


def _plain(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


@dataclass
class Segment:
    sheet_no: int
    sheet: str
    part: int
    path: str
    size: int
    raw: int
    crc: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    segments: list


class _Open:
    """A segment that is being written."""

    def __init__(self, folder: str, number: int, name: str, part: int) -> None:
        self.found = Segment(number, name, part, f"{folder}/{uuid.uuid4().hex}", 0, 0, 0, 0)
        self.file, self.packer = open(self.found.path, "wb"), zlib.compressobj(6, zlib.DEFLATED, -15)

    def add(self, rows: list[str]) -> None:
        data = "".join(rows).encode()
        s = self.found
        s.rows, s.raw, s.crc = s.rows + len(rows), s.raw + len(data), zlib.crc32(data, s.crc)
        self.file.write(self.packer.compress(data))

    def close(self) -> Segment:
        self.file.write(self.packer.flush(zlib.Z_FULL_FLUSH))
        self.found.size = self.file.tell()
        self.file.close()
        return self.found


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.folder, self.overwrite = options["path"], f"{options['path']}.parts-{uuid.uuid4().hex}", overwrite
        self.most = int(options.get("mostrows", MOST_ROWS))
        self.headers = {int(k[6:]): v for k, v in options.items() if k.startswith("header")}
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        os.makedirs(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part, done, held, now = TaskContext.get().partitionId(), [], [], None
        for batch in iterator:
            for number, name, xml in zip(*(batch.column(c).to_pylist() for c in ("sheet_no", "sheet", "xml"))):
                if now is None or now.found.sheet_no != number or now.found.rows + len(held) >= min(SEGMENT_ROWS, self.most - 1):
                    if now:
                        now.add(held)
                        done.append(now.close())
                    now, held = _Open(self.folder, number, name, part), []
                held.append(xml)
            if now:
                now.add(held)
                held = []
        if now:
            done.append(now.close())
        return Written(done)

    def commit(self, messages: list) -> None:
        found = sorted((s for m in messages if m for s in m.segments), key=lambda s: (s.sheet_no, s.part))
        names: list[str] = []
        sheets: list[list[Segment]] = []
        given = {h.split("\0", 1)[0] for h in self.headers.values()} | {s.sheet for s in found}
        for number in sorted({s.sheet_no for s in found} | set(self.headers)):
            own = [s for s in found if s.sheet_no == number]
            name = own[0].sheet if own else self.headers[number].split("\0", 1)[0]
            for group, sheet in zip(_groups(own, self.most - 1), chain([name], continued(name, given))):
                names.append(sheet)
                sheets.append([number, *group])
        made = f"{self.path}.{uuid.uuid4().hex}"
        with open(made, "wb") as out:
            book = _Zip(out)
            for name, text in _frame(names):
                book.entry(name, [_packed(text.encode())])
            for k, (number, *group) in enumerate(sheets, 1):
                top = self.headers.get(number, "\0").split("\0", 1)[1].encode()
                book.entry(f"xl/worksheets/sheet{k}.xml", [_packed(_HEAD + top, last=False), *((s.path, s.size, s.raw, s.crc) for s in group), _packed(_TAIL)])
            book.end()
        os.replace(made, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def continued(name: str, given: Collection[str]) -> Iterator[str]:
    """Names of the sheets that a full one goes on in: numbers from 2, without names that other tables have."""
    for k in count(2):
        found = f"{name[: MOST_NAME - len(str(k)) - 3]} ({k})"
        if found not in given:
            yield found


def _groups(segments: list[Segment], most: int) -> list[list[Segment]]:
    groups: list[list[Segment]] = [[]]
    for s in segments:
        if groups[-1] and sum(x.rows for x in groups[-1]) + s.rows > most:
            groups.append([])
        groups[-1].append(s)
    return groups


def _packed(data: bytes, last: bool = True) -> tuple[bytes, int, int, int]:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    out = z.compress(data) + z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
    return out, len(out), len(data), zlib.crc32(data)


def joined_crc(first: int, second: int, size: int) -> int:
    """The checksum of two pieces of data from theirs and the second's size: a checksum is linear over bits, so the
    first is carried through ``size`` zero bytes by repeated squaring of the step of one bit."""
    times = lambda matrix, v: _xor(row for k, row in enumerate(matrix) if v >> k & 1)
    step = [0xEDB88320] + [1 << k for k in range(31)]
    for _ in range(3):
        step = [times(step, row) for row in step]
    while size:
        if size & 1:
            first = times(step, first)
        step = [times(step, row) for row in step]
        size >>= 1
    return first ^ second


def _xor(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


class _Zip:
    """A zip file of entries that are deflated already."""

    def __init__(self, out: io.BufferedWriter) -> None:
        self.out, self.entries = out, []

    def entry(self, name: str, pieces: list[tuple]) -> None:
        size = raw = crc = 0
        for _, n, r, c in pieces:
            size, raw, crc = size + n, raw + r, joined_crc(crc, c, r)
        at, head = self.out.tell(), struct.pack("<HHHHHIIIH", 20, 0, 8, 0, 33, crc, size, raw, len(name))
        if max(at + size, raw) >= 1 << 32:
            raise ValueError("a workbook of 4 GB or more has no form here")
        self.out.write(b"PK\x03\x04" + head + b"\0\0" + name.encode())
        for data, *_ in pieces:
            if isinstance(data, bytes):
                self.out.write(data)
            else:
                with open(data, "rb") as f:
                    shutil.copyfileobj(f, self.out, 1 << 20)
        self.entries.append(b"PK\x01\x02\x14\0" + head + struct.pack("<HHHHII", 0, 0, 0, 0, 0, at) + name.encode())

    def end(self) -> None:
        at = self.out.tell()
        self.out.write(b"".join(self.entries))
        self.out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(self.entries), len(self.entries), self.out.tell() - at, at, 0))


def _frame(names: list[str]) -> list[tuple[str, str]]:
    """The parts beside the sheets."""
    top, each = '<?xml version="1.0" encoding="UTF-8"?>', list(enumerate(names, 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_SHEET}worksheet+xml"/>' for k, _ in each)
    return [
        ("[Content_Types].xml", f'{top}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEET}sheet.main+xml"/>{kinds}</Types>'),
        ("_rels/.rels", f'{top}<Relationships xmlns="{_RELATIONS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{top}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in each) + "</sheets></workbook>"),
        ("xl/_rels/workbook.xml.rels", f'{top}<Relationships xmlns="{_RELATIONS}">' + "".join(f'<Relationship Id="r{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in each) + "</Relationships>"),
    ]


class WorkbookSource(DataSource):
    """``df.write.format("workbook")``: rows of ``ROWS`` that are sorted by sheet and order in each task."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), overwrite)


def write_workbook(spark: SparkSession, path: str, sheets: list[tuple[str, DataFrame, list[str]]], text_columns: frozenset[str] = frozenset(), most_rows: int = MOST_ROWS) -> None:
    """Writes a workbook of (name, table, columns that order it) to a path that driver and executors share. Names
    must be distinct and valid. Each table is sorted in ranges by the tasks that write it; empty tables give a sheet of
    a header. Sheets are written one after another's tasks in one job."""
    spark.dataSource.register(WorkbookSource)
    rows, options = None, {}
    for number, (name, df, order) in enumerate(sheets):
        if len(name) > MOST_NAME:
            raise ValueError(f"a sheet's name has at most {MOST_NAME} characters")
        options[f"header{number}"] = f"{name}\0{header(df)}"
        body = sheet_rows(number, name, df, order, text_columns)
        body = body.repartitionByRange("o").sortWithinPartitions("o").select("sheet_no", "sheet", "xml")
        rows = body if rows is None else rows.unionByName(body)
    rows.write.format("workbook").options(path=path, mostrows=str(most_rows), **options).mode("overwrite").save()


_ROW = re.compile(rb"<row[\s/>]")


def _sheets(content: bytes, tables: Collection[str]) -> Iterator[tuple[str, int, bytes]]:
    """Name, rows of its table in the sheets before and packed XML of each sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        base, before, names, expected = None, 0, iter(()), None
        for k, sheet in enumerate(book.iter(f"{{{_MAIN}}}sheet"), 1):
            name, entry = sheet.get("name"), z.getinfo(f"xl/worksheets/sheet{k}.xml")
            if base is None or name != expected:
                base, before = name, 0
                names = continued(name, tables) if name in tables else iter(())
            expected = next(names, None)
            with z.open(entry) as f:
                xml = f.read()
            yield base, before, gzip.compress(xml, 1)
            if expected is not None:
                before += len(_ROW.findall(xml)) - 1


def _rows(packed: bytes) -> Iterator[list[str]]:
    sheet = None
    for event, node in ElementTree.iterparse(gzip.GzipFile(fileobj=io.BytesIO(packed)), ("start", "end")):
        if event == "start" and node.tag == f"{{{_MAIN}}}sheetData":
            sheet = node
        elif event == "end" and node.tag == f"{{{_MAIN}}}row":
            yield ["".join(x.text or "" for x in c.iter() if x.tag in (f"{{{_MAIN}}}t", f"{{{_MAIN}}}v")) for c in node]
            sheet.clear()


def read_workbooks(files: DataFrame, key: str, content: str, tables: Collection[str] = ()) -> DataFrame:
    """key, sheet, place, cells of workbooks of inline texts and numbers (binary): a task a file parts its sheets, which
    are read by tasks, ``CHUNK`` rows at a time. Sheets that one of ``tables``, the names that were written, goes on in
    are read as one: places go on too, and the header is that of the first."""
    kind, tables = files.schema[key].dataType.simpleString(), frozenset(tables)

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, data in zip(pdf[key], pdf[content]):
                if data is not None:
                    for sheet in _sheets(bytes(data), tables):
                        yield pd.DataFrame([(k, *sheet)], columns=[key, "sheet", "before", "xml"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, sheet, before, packed in zip(pdf[key], pdf["sheet"], pdf["before"], pdf["xml"]):
                rows = ((k, sheet, before + place, cells) for place, cells in enumerate(_rows(packed)) if place or not before)
                while chunk := list(islice(rows, CHUNK)):
                    yield pd.DataFrame(chunk, columns=[key, "sheet", "place", "cells"])

    sheets = files.select(key, content).mapInPandas(parted, f"`{key}` {kind}, sheet string, before int, xml binary")
    sheets = sheets.repartition(files.sparkSession.sparkContext.defaultParallelism)
    return sheets.mapInPandas(read, f"`{key}` {kind}, sheet string, place int, cells array<string>")
