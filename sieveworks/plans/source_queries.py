"""Readers and writers: files are written to the shared folder and read again."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources import readers as R
from ..sources import sinks as S
from .common import fixture, fixture_sql, shared_folder, table


def _place(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "csv")
    rows = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.concat(F.lit('a "b", '), "p_name").alias("name"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return R.csv_strings(spark, path)


def src_json_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "json")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit("dropped").alias("_notes"))
    S.write_json(rows, path)
    return spark.read.schema("s_suppkey long, s_name string, s_phone string").json(path)


def src_text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "text")
    table(spark, sf_dir, "region").select(F.concat(F.lit("line one\n"), "r_name").alias("value")).repartition(1).write.text(path)
    return R.whole_texts(spark, path).select((F.size(F.split("text", "\n")) - 1).cast("long").alias("lines"))


def src_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "folder")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).repartition(1).write.text(f"{path}/A.PDF")
    return R.folder(spark, path, ".TXT").select(F.col("length").cast("long").alias("bytes"))


def _docx(paragraphs: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
        z.writestr("word/media/image1.png", b"x")
    return out.getvalue()


def src_pdf_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = b"BT /F1 12 Tf (Hello \\(world\\)) Tj [(ab) -20 (cd)] TJ <4142> Tj ET"
    packed = zlib.compress(stream)
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Length 9 /Filter /FlateDecode>> stream\n" + packed + b"\nendstream endobj\n3 0 obj <</Subtype /Image>> endobj"
    files = spark.createDataFrame([("t.pdf", bytearray(pdf)), ("x.pdf", bytearray(b"no")), ("e.pdf", bytearray(b"%PDF-1.7 /Encrypt 3 0 R /Count 4"))], "path string, content binary")
    c = D.triage(R.pdf_counters(files))
    return c.select("path", "pages", "images", "text_ops", "est_chars", "type", "route")


def src_negotiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixture(spark, "id, content_type, body", """(1, 'application/json; charset=utf-8', '{"b": 1, "a": [2]}'), (2, 'text/html', '{"a": 1}'), (3, 'application/json', 'not json')""")
    return R.negotiated(f).select("id", "bytes", F.array_join("keys", ",").alias("keys"))


def src_api_coin(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixture(spark, "id, body", """(1, '{"symbol": "abc", "name": "Abc", "market_cap_rank": 7, "categories": ["x", null, "y"], "market_data": {"current_price": {"usd": 1.5}, "market_cap": 100.0, "circulating_supply": 50}}'), (2, '{"symbol": null}')""")
    return R.market_record(f).select("id", "symbol", "name", "rank", "price_usd", "market_cap_usd", "circulating", F.array_join("categories", ",").alias("categories"))


def src_api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    coins = ", ".join(f'{{"id": "c{k}", "symbol": "s{k}", "name": "n{k}", "market_cap_rank": {k}}}' for k in range(15))
    f = fixture(spark, "id, body", f"(1, '{{\"coins\": [{coins}]}}')")
    return R.search_hits(f).select("id", "pos", "coin", "symbol", "rank")


def src_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixture(spark, "path, text", "('a', concat_ws(chr(10), '---', 'name: my-tool', 'title: \"a: b\"', 'bad: x: y', '  nested: z', '---', 'body: no')), ('b', 'no block')")
    return R.front_matter(f)


def doc_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixture(spark, "path", "('a.DOCX'), ('b.pdf'), ('c.md'), ('d.doc'), ('e.xyz')")
    return f.select("path", R.dispatch().alias("kind"))


def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.as_json(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


def snk_csv_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "tables")
    n = table(spark, sf_dir, "nation")
    S.write_csv_per_table(n.select(F.concat(F.lit("file "), F.col("n_regionkey").cast("string")).alias("source_file"), (F.col("n_nationkey") % 2).alias("table_idx"), "n_name"), path)
    return spark.read.csv(path, header=True).groupBy("source_file", "table_idx").agg(F.count("n_name").alias("n"))


def snk_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.lit("TEXT").alias("type"), F.when(F.col("page_id") % 9 == 0, "no text").alias("error"))
    return S.split_failed(r)[1]


#: Two content streams, and the files made of them.
_STREAMS = (b"BT /F1 12 Tf 1 0 Td (Jo Doe) Tj T* (Work \\(all\\)) Tj ET", b"BT /F1 9 Tf [(Experi) -20 (ence) -300 (2019)] TJ T* <4142> Tj ET")


def _pdfs(spark: SparkSession) -> DataFrame:
    part = lambda n, x: b"%d 0 obj <</Length 9 /Filter /FlateDecode>> stream\n%s\nendstream endobj\n" % (n, zlib.compress(x))
    pages = b"1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R 4 0 R]>> endobj\n3 0 obj <</Type/Page/Contents 5 0 R>> endobj\n4 0 obj <</Type/Page/Contents 6 0 R>> endobj\n"
    rows = [("a.pdf", b"%PDF-1.4\n" + pages + part(5, _STREAMS[0]) + part(6, _STREAMS[1])), ("b.pdf", b"%PDF-1.7 /Encrypt 3 0 R"), ("c.pdf", b"no")]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def src_pdf_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = R.pdf_texts(_pdfs(spark)).filter("text is not null").withColumn("text", F.translate("text", "\f", "\n"))
    return D.sections(texts, "path", "text").select("pos", "line", "section")


def str_content_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, _STREAMS[0]), (2, b"BT no font"), (3, bytes(range(200)) + b"BT Tf"), (4, b"")]
    return spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "id int, data binary").select("id", R.content_stream_flag("data").alias("text"))


def str_measure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat(F.lit("("), "p_name", F.lit("\\n)")), "utf-8").alias("token"), F.lit(False).alias("two"))
    return f.select("p_partkey", R.measured_text("token", "two").alias("n"))


def src_html_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages, a file a host."""
    path = _place(spark, "saved")
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    table(spark, sf_dir, "pages").select(host.alias("host"), F.col("html").alias("value")).repartition("host").write.partitionBy("host").text(path)
    return R.whole_texts(spark, path).select(F.regexp_extract("path", "host=([^/]*)", 1).alias("host"), F.length("text").cast("long").alias("chars"))


def src_jd_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "plain")
    table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value")).repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return R.whole_texts(spark, path).select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("region"), (F.size(F.split("text", "\n")) - 1).cast("long").alias("lines"))


def src_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "binary")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).coalesce(1).sortWithinPartitions("value").write.text(f"{path}/X.BIN")
    return R.folder(spark, path, ".TXT").select(F.md5("content").alias("md5"))


def snk_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written and read again, and the plain twin."""
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("text"))
    made = S.docx_files(names.select(F.col("n_regionkey").cast("string").alias("path"), "text"))
    read = R.docx_documents(made)
    return read.join(made.select("path", "plain"), "path").select("path", F.array_join(F.col("paragraphs.text"), "\n").alias("text"), "plain", "error")


def lint_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixture(spark, "path, text", "('x/my-tool/A.md', concat_ws(chr(10), '---', 'name: my-tool', 'description: does it', '---')), ('x/other/A.md', concat_ws(chr(10), '---', 'name: My_Tool', 'extra: 1', 'license: a: b', '---'))")
    return D.lint(R.front_matter(f))


_EXAMPLE = "(1, 'seats', 4, CAST(12.5 AS DOUBLE)), (2, 'storage', 100, CAST(0.25 AS DOUBLE)), (3, 'support', 1, CAST(90 AS DOUBLE))"


def src_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in example input."""
    return fixture(spark, "id, item, quantity, price", _EXAMPLE)


QUERIES = {f.__name__: f for f in (src_csv, src_json_doc, src_text_file, src_folder, src_pdf_triage, src_negotiate, src_api_coin, src_api_search, doc_dispatch, snk_json, snk_csv_per_table, snk_failed, src_pdf_resume, str_content_stream, str_measure_text, src_html_file, src_jd_text, src_binary, snk_docx, lint_repo, src_example)}
QUERIES["src_skill_md"] = src_front_matter  # the inventory's name of the step
ORACLE_SQL = {
    "src_csv": "SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, 'a \"b\", ' || p_name AS name FROM part",
    "src_json_doc": "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS s_phone FROM supplier",
    "src_text_file": "SELECT 2 * count(*) AS lines FROM region",
    "src_folder": "SELECT sum(length(r_name) + 1)::BIGINT AS bytes FROM region",
    "src_pdf_triage": "SELECT * FROM (VALUES ('t.pdf', 1, 1, 3, 19, 'SCANNED', 'ocr'), ('x.pdf', 0, 0, 0, 0, 'NOT_A_PDF', 'none'), ('e.pdf', 4, 0, 0, 0, 'ENCRYPTED', 'none')) AS t(path, pages, images, text_ops, est_chars, type, route)",
    "src_negotiate": "SELECT * FROM (VALUES (1, 18, 'a,b')) AS t(id, bytes, keys)",
    "src_api_coin": "SELECT * FROM (VALUES (1, 'ABC', 'Abc', 7, 1.5::DOUBLE, 100.0::DOUBLE, 50.0::DOUBLE, 'x,y'), (2, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) AS t(id, symbol, name, rank, price_usd, market_cap_usd, circulating, categories)",
    "src_api_search": "SELECT 1 AS id, k AS pos, 'c' || k AS coin, 'S' || k AS symbol, k AS rank FROM range(12) AS r(k)",
    "src_skill_md": "SELECT * FROM (VALUES ('a', 'name', 'my-tool', NULL), ('a', 'title', 'a: b', NULL), ('a', 'bad', NULL, 'unquoted value')) AS t(path, key, value, error)",
    "doc_dispatch": "SELECT * FROM (VALUES ('a.DOCX', 'docx'), ('b.pdf', 'pdf'), ('c.md', 'plain'), ('d.doc', 'error: legacy format'), ('e.xyz', 'error: unsupported format')) AS t(path, kind)",
    "snk_json": "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region",
    "snk_csv_per_table": "SELECT 'file_' || n_regionkey AS source_file, n_nationkey % 2 AS table_idx, count(*) AS n FROM nation GROUP BY 1, 2",
    "snk_failed": "SELECT url AS file, 'TEXT' AS type, 'no text' AS reason FROM pages WHERE page_id % 9 = 0",
    "src_pdf_resume": "SELECT * FROM (VALUES (0, 'Jo Doe', 'header'), (1, 'Work (all)', 'header'), (2, 'Experience 2019', 'header'), (3, 'AB', 'other')) AS t(pos, line, section)",
    "str_content_stream": "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false)) AS t(id, text)",
    "str_measure_text": "SELECT p_partkey, (length(p_name) + 1)::INT AS n FROM part",
    "src_html_file": "SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host, (sum(length(html)) + count(*))::BIGINT AS chars FROM pages GROUP BY 1",
    "src_jd_text": "SELECT n_regionkey AS region, count(*) AS lines FROM nation GROUP BY 1",
    "src_binary": "SELECT md5(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS md5 FROM nation",
    "snk_docx": "SELECT CAST(n_regionkey AS VARCHAR) AS path, string_agg(n_name, chr(10) ORDER BY n_name) AS text, string_agg(n_name, chr(10) ORDER BY n_name) AS plain, NULL AS error FROM nation GROUP BY 1",
    "lint_repo": "SELECT * FROM (VALUES ('x/other/A.md', 'missing description'), ('x/other/A.md', 'unknown extra'), ('x/other/A.md', 'unreadable license'), ('x/other/A.md', 'name is not kebab case'), ('x/other/A.md', 'name is not its folder''s')) AS t(path, problem)",
    "src_example": f"SELECT * FROM {fixture_sql('id, item, quantity, price', _EXAMPLE)}",
}
