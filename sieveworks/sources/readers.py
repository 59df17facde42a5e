"""Readers. Every file format arrives as a table; nothing is fetched."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pdf_objects


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row a file; fields that the schema doesn't name (notes, comments) are dropped."""
    return spark.read.schema(schema).json(path, multiLine=True)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, so leading zeros survive; quotes are doubled, a byte-order mark is skipped."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a file a row (saved pages, plain text, job descriptions)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def folder(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """path, length, content of all files below a folder with the suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.endswith(F.lower("path"), F.lit(suffix.lower()))).select("path", "length", "content")


def dispatch(path: str = "path"):
    """How a file is read, by its extension; unknown ones are error rows."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(ext == "docx", "docx").when(ext == "pdf", "pdf").when(ext.isin("txt", "md"), "plain").when(ext == "doc", "error: legacy format").otherwise("error: unsupported format")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX = "path string, paragraphs array<struct<text:string,in_table:boolean,in_textbox:boolean>>, images int, max_columns int, header_footer string, fonts array<string>, hyperlinks int, error string"


def _docx(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        root = ElementTree.fromstring(z.read("word/document.xml"))
        edges = [ElementTree.fromstring(z.read(n)) for n in sorted(names) if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n)]
    paragraphs = []

    def visit(node: ElementTree.Element, table: bool, box: bool) -> None:
        for child in node:
            if child.tag == _W + "p":
                text = "".join(t.text or "" for t in _own_text(child))
                paragraphs.append({"text": text, "in_table": table, "in_textbox": box})
            visit(child, table or child.tag == _W + "tbl", box or child.tag == _W + "txbxContent")

    visit(root, False, False)
    columns = [int(c.get(_W + "num") or 1) for c in root.iter(_W + "cols")]
    return {
        "paragraphs": paragraphs, "images": sum(n.startswith("word/media/") for n in names), "max_columns": max([1, *columns]), "header_footer": " ".join("".join(t.text or "" for t in e.iter(_W + "t")) for e in edges),
        "fonts": sorted({f.get(_W + "ascii") for f in root.iter(_W + "rFonts") if f.get(_W + "ascii")}), "hyperlinks": sum(1 for _ in root.iter(_W + "hyperlink")), "error": None,
    }


def _own_text(paragraph: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Text of a paragraph without that of text boxes inside it."""
    for child in paragraph:
        if child.tag == _W + "txbxContent":
            continue
        if child.tag == _W + "t":
            yield child
        yield from _own_text(child)


def docx_documents(files: DataFrame) -> DataFrame:
    """Paragraphs and structure of DOCX files (path, content); a broken file is a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    rows.append({"path": path} | _docx(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append({"path": path, "paragraphs": [], "images": 0, "max_columns": 1, "header_footer": "", "fonts": [], "hyperlinks": 0, "error": type(e).__name__})
            yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, DOCX)


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|\[((?:\\.|[^\]\\])*)\]\s*TJ", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
PDF = "path string, valid boolean, encrypted boolean, xfa boolean, form_fields int, pages int, images int, text_ops long, est_chars long, mean_run double, short_share double"
MOST_SAMPLE = 65_536


def inflate(data: bytes) -> bytes:
    """Deflated data as far as it goes; the bytes themselves if they are not deflated."""
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return data


def is_content_stream(data: bytes) -> bool:
    sample = data[:MOST_SAMPLE]
    printable = sum(32 <= b < 127 or b in (9, 10, 13) for b in sample)
    return bool(sample) and printable >= 0.85 * len(sample) and b"BT" in data and b"Tf" in data


def string_length(token: bytes, two_byte: bool) -> int:
    if token[:1] == b"<":
        return sum(c in b"0123456789abcdefABCDEF" for c in token) // (4 if two_byte else 2)
    return len(re.sub(rb"\\(?:[0-7]{1,3}|.)", b"x", token[1:-1], flags=re.S))


def _content_streams(content: bytes) -> Iterator[bytes]:
    for head, body in _STREAM.findall(content):
        if not re.search(rb"/Type\s*/(?:ObjStm|Metadata|XRef)|/Subtype\s*/(?:Image|XML)|/FontFile", head):
            data = inflate(body) if b"FlateDecode" in head else body
            if is_content_stream(data):
                yield data


def pdf_texts(files: DataFrame) -> DataFrame:
    """path, text of the text layers of PDF files (path, content): pages in the order of the page tree, parted by form
    feeds. Without a text layer, encrypted, or no PDF: null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "text": [_pdf_text(c) for c in pdf.content]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def _pdf_text(content: bytes) -> str | None:
    try:
        text = "\f".join(t for _, t in pdf_objects.page_texts(bytes(content)))
    except ValueError:
        return None
    return text if text.strip("\f") else None


def content_stream_flag(data: Column | str) -> Column:
    return F.pandas_udf(lambda x: x.map(lambda b: None if b is None else is_content_stream(bytes(b))), "boolean")(data)


def measured_text(token: Column | str, two_byte: Column | str) -> Column:
    """How many characters a show string stands for."""
    return F.pandas_udf(lambda x, two: pd.Series([string_length(bytes(b), bool(t)) for b, t in zip(x, two)]), "int")(token, two_byte)


def _pdf(content: bytes) -> dict:
    runs, ops, two = [], 0, b"Identity-H" in content
    for data in _content_streams(content):
        for single, many in _SHOW.findall(data):
            ops += 1
            runs.append(sum(string_length(s, two) for s in _STRING.findall(many)) if many else string_length(single, two))
    pages = len(re.findall(rb"/Type\s*/Page\b(?!s)", content)) or max([0, *(int(x) for x in re.findall(rb"/Count\s+(\d+)", content))])
    return {
        "valid": content[:1024].lstrip().startswith(b"%PDF-"), "encrypted": b"/Encrypt" in content, "xfa": b"/XFA" in content, "form_fields": len(re.findall(rb"/FT\s*/(?:Tx|Btn|Ch|Sig)", content)), "pages": pages,
        "images": len(re.findall(rb"/Subtype\s*/Image", content)), "text_ops": ops, "est_chars": sum(runs), "mean_run": sum(runs) / len(runs) if runs else 0.0, "short_share": sum(r <= 12 for r in runs) / len(runs) if runs else 0.0,
    }


def pdf_counters(files: DataFrame) -> DataFrame:
    """Counters of PDF files (path, content) for triage: a byte scan, no rendering."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"path": p} | _pdf(c) for p, c in zip(pdf.path, pdf.content)])

    return files.select("path", "content").mapInPandas(run, PDF)


def negotiated(responses: DataFrame) -> DataFrame:
    """``responses``: id, content_type, body. Those that answer in JSON: bytes and the first 12 sorted keys."""
    v = F.try_parse_json("body")
    ok = F.contains(F.lower("content_type"), F.lit("json")) & v.isNotNull()
    return responses.filter(ok).select("id", "content_type", F.octet_length("body").cast("long").alias("bytes"), F.slice(F.array_sort(F.json_object_keys("body")), 1, 12).alias("keys"))


def market_record(responses: DataFrame) -> DataFrame:
    """``responses``: id, body. A nested market answer as flat columns; a price may be a number or an object
    of currencies."""
    v = F.try_parse_json("body")
    rows = responses.select("id", v.alias("v"))
    g = lambda path, kind: F.try_variant_get("v", path, kind)
    usd = lambda key: F.coalesce(g(f"$.market_data.{key}.usd", "double"), g(f"$.market_data.{key}", "double"))
    names = F.from_json(g("$.categories", "string"), "array<string>")
    return rows.select(
        "id", F.upper(g("$.symbol", "string")).alias("symbol"), g("$.name", "string").alias("name"), g("$.market_cap_rank", "int").alias("rank"), usd("current_price").alias("price_usd"), usd("market_cap").alias("market_cap_usd"),
        usd("fully_diluted_valuation").alias("fdv_usd"), usd("total_volume").alias("volume_usd"), g("$.market_data.circulating_supply", "double").alias("circulating"), g("$.last_updated", "string").alias("last_updated"),
        F.slice(F.filter(names, lambda x: x.isNotNull() & (x != "")), 1, 8).alias("categories"),
    )


def search_hits(responses: DataFrame, most: int = 12) -> DataFrame:
    """``responses``: id, body with a list of coins; the first hits in order."""
    hits = F.from_json(F.get_json_object("body", "$.coins"), "array<struct<id:string,symbol:string,name:string,market_cap_rank:int>>")
    rows = responses.select("id", F.posexplode(F.slice(hits, 1, most)).alias("pos", "h"))
    return rows.select("id", "pos", F.col("h.id").alias("coin"), F.upper("h.symbol").alias("symbol"), F.col("h.name").alias("name"), F.col("h.market_cap_rank").alias("rank"))


def front_matter(texts: DataFrame) -> DataFrame:
    """``texts``: path, text. key and value of ``--- key: value ---`` blocks; nested keys are skipped, quotes
    taken off, and an unquoted value with ``: `` or `` #`` is an error row."""
    block = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    rows = texts.select("path", F.posexplode(F.split(block, r"\r?\n")).alias("pos", "line")).filter(F.regexp_like("line", F.lit(r"^[A-Za-z][\w-]*:")))
    key, raw = F.regexp_extract("line", r"^([\w-]+):", 1), F.trim(F.regexp_replace("line", r"^[\w-]+:", ""))
    quoted = F.regexp_like(raw, F.lit(r"""^(".*"|'.*')$"""))
    bad = ~quoted & F.regexp_like(raw, F.lit(r": | #"))
    value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return rows.select("path", key.alias("key"), F.when(~bad, value).alias("value"), F.when(bad, "unquoted value").alias("error"))
