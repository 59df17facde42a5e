"""Table functions whose rows come straight from a parser: one pass over a page or a file, no JSON between.

Use with ``lateralJoin``: ``pages.lateralJoin(html_tables()(F.col("html").outer()))``.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import automata as A
from . import pdf_objects as P
from . import readers as R

HTML_TABLES = "table_no int, orientation string, nested boolean, headers array<string>, row_no int, cells array<string>"
DOCX_PARAGRAPHS = "pos int, text string, in_table boolean, in_textbox boolean, error string"
PDF_PAGES = "page int, text string, error string"


class _HtmlTables:
    def eval(self, html: str) -> Iterator[tuple]:
        for number, t in enumerate(A.parsed_tables(html)):
            shape = (number, t["orientation"], t["nested"], t["headers"])
            if not t["rows"]:
                yield (*shape, None, None)
            for row, cells in enumerate(t["rows"]):
                yield (*shape, row, cells)


class _DocxParagraphs:
    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            for pos, p in enumerate(R._docx(bytes(content))["paragraphs"]):
                yield pos, p["text"], p["in_table"], p["in_textbox"], None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            yield None, None, None, None, type(e).__name__


class _PdfPages:
    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            for page, text in P.page_texts(bytes(content)):
                yield page, text, None
        except (ValueError, RecursionError) as e:
            yield None, None, str(e)


def html_tables():
    """A row a table row: table_no (in the order of their ends), orientation, nested, headers, row_no, cells; a table
    of a header alone has one row with a null row_no. Pages without a table give no row."""
    return F.udtf(_HtmlTables, returnType=HTML_TABLES, useArrow=True)


def docx_paragraphs():
    """A row a paragraph of a DOCX file (binary); a broken file is one row with an error, null gives none."""
    return F.udtf(_DocxParagraphs, returnType=DOCX_PARAGRAPHS, useArrow=True)


def tables_of(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The rows of all tables of pages, beside their key."""
    return pages.select(key, html).lateralJoin(html_tables()(F.col(html).outer())).drop(html)


def paragraphs_of(files: DataFrame, key: str, content: str) -> DataFrame:
    """The paragraphs of DOCX files, beside their key."""
    return files.select(key, content).lateralJoin(docx_paragraphs()(F.col(content).outer())).drop(content)


def pdf_pages():
    """A row a page of a PDF file (binary), in the order of its page tree; a file that is encrypted or no PDF is one
    row with an error, null gives none."""
    return F.udtf(_PdfPages, returnType=PDF_PAGES, useArrow=True)


def pages_of(files: DataFrame, key: str, content: str) -> DataFrame:
    """The pages of PDF files, beside their key."""
    return files.select(key, content).lateralJoin(pdf_pages()(F.col(content).outer())).drop(content)
