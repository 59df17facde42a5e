"""Bodies, table functions and streams, with hostile inputs."""

from __future__ import annotations

import gzip
import time
import zlib

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import automata, bodies
from sieveworks.sources import sinks, table_functions
from sieveworks.streaming import alerts, late


def test_bodies_of_all_encodings(spark):
    text = "Grüße, <b>€</b> " * 50
    raw, latin = text.encode(), "Grüße".encode("latin-1")
    rows = [
        (1, raw, None, None, text, None), (2, gzip.compress(raw), "GZIP", "text/html; charset=utf-8", text, None), (3, zlib.compress(raw), "deflate", None, text, None), (4, zlib.compress(raw, 9, -15), "deflate", None, text, None),
        (5, zlib.compress(gzip.compress(raw)), "gzip, deflate", None, text, None), (6, gzip.compress(raw[:99]) + gzip.compress(raw[99:]), "x-gzip", None, text, None), (7, gzip.compress(raw)[:-9], "gzip", None, None, "cut off"), (8, b"no gzip", "gzip", None, None, "broken gzip"),
        (9, b"\xff\xff\xff", "deflate", None, None, "broken deflate"), (10, raw, "br", None, None, "unknown encoding br"), (11, latin, None, "text/plain; charset=ISO-8859-1", "Grüße", None), (12, b"<meta charset='latin-1'>" + latin, None, "text/html", "<meta charset='latin-1'>Grüße", None),
        (13, latin, None, "text/html; charset=none-such", "Gr��e", None), (14, b"", None, None, "", None), (15, None, "gzip", None, None, None), (16, b"", "gzip", None, "", None), (17, b"a\xffb", "identity", "x; charset=\"utf-8\"", "a�b", None), (18, latin, "", "text/html; charset=rot13", "Gr��e", None),
    ]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None, e, c) for k, b, e, c, *_ in rows], "id int, body binary, encoding string, kind string")
    got = {r.id: (r.b.text, r.b.error) for r in df.select("id", bodies.decoded("body", "encoding", "kind").alias("b")).collect()}
    assert got == {k: (t, e) for k, *_, t, e in rows}


def test_bodies_are_bounded():
    bomb = gzip.compress(b"\0" * 5_000_000)
    with pytest.raises(ValueError, match="too large"):
        bodies.undo(bomb, "gzip", 1_000_000)
    assert len(bodies.undo(bomb, "gzip", 5_000_000)) == 5_000_000


def test_shapes_of_tables():
    shape = lambda html: [(t["orientation"], t["headers"], t["rows"], t["nested"]) for t in automata.parsed_tables(html)]
    assert shape("<table><tr><th>a<th>b<tr><td>1<td>2</table>") == [("columns", ["a", "b"], [["1", "2"]], False)]
    assert shape("<table><tr><th>k<td>1<td>x<tr><td>2<th>m</table>") == [("key-value", [], [["k", "1", "x"], ["2", "m"]], False)]
    assert shape("<table><tr><th>a<tr><th>b</table>") == [("key-value", [], [["a"], ["b"]], False)]
    assert shape("<table><tr><td>1<tr><th>a</table>") == [("headerless", [], [["1"], ["a"]], False)]
    assert shape("<table><tr><th>a<td>b<tr><th>c<tr><td>d</table>") == [("headerless", [], [["a", "b"], ["c"], ["d"]], False)]
    assert shape("<table><tr><td>o<table><tr><th>i</table>p") == [("columns", ["i"], [], True), ("headerless", [], [["op"]], False)]
    assert shape("<table></table><p>") == [] and automata.parsed_tables(None) == []


def test_table_functions_are_one_pass_and_keep_keys(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a</table><table><tr><td>x<td>y<tr><td>z</table>"), (2, "none"), (3, None), (1, "<table><tr><td>again</table>")], "id int, html string")
    got = table_functions.tables_of(pages, "id", "html")
    assert got._jdf.queryExecution().toString().count("ArrowEvalPythonUDTF") >= 1
    rows = sorted((r.id, r.table_no, r.orientation, r.row_no, r.cells) for r in got.filter("orientation = 'headerless'").collect())
    assert rows == [(1, 0, "headerless", 0, ["again"]), (1, 1, "headerless", 0, ["x", "y"]), (1, 1, "headerless", 1, ["z"])]
    assert [(r.id, r.row_no, r.cells) for r in got.filter("orientation = 'columns'").collect()] == [(1, None, None)]
    files = spark.createDataFrame([(1, bytearray(sinks.docx(["a", "", "Ünï <b>"]))), (2, bytearray(b"broken")), (3, None)], "id int, content binary")
    found = sorted((r.id, r.pos, r.text, r.error) for r in table_functions.paragraphs_of(files, "id", "content").collect())
    assert found[:3] == [(1, 0, "a", None), (1, 1, "", None), (1, 2, "Ünï <b>", None)] and found[3][3] == "BadZipFile" and len(found) == 4


def _stream(spark, path):
    return spark.readStream.schema("k string, ts timestamp, v long").option("maxFilesPerTrigger", 1_000).parquet(path)


def test_late_rows_are_kept_in_a_side_table(spark, tmp_path):
    base, seen, want = str(tmp_path), {}, {True: [], False: []}
    slices = [[("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 08:00:00", 2), ("b", "2024-01-01 12:00:00", 3), (None, "2024-01-01 12:00:00", 4)], [("a", "2024-01-01 09:59:00", 5), ("a", "2024-01-01 08:59:59", 6), ("b", "2024-01-02 00:00:00", 7), (None, "2024-01-01 01:00:00", 8)], [("b", "2024-01-01 12:00:00", 9), ("a", None, 10), ("c", "2020-01-01 00:00:00", 11)]]
    for rows in slices:
        for k, ts, v in rows:
            want[ts is None or (k in seen and ts < seen[k])].append(v)
        for k, ts, v in rows:
            if ts:
                limit = f"{ts[:11]}{int(ts[11:13]) - 1:02d}{ts[13:]}" if int(ts[11:13]) else "2024-01-01 23" + ts[13:]
                seen[k] = max(seen.get(k, ""), limit)
        spark.createDataFrame(rows, "k string, ts string, v long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = late.write_both(late.marked_late(_stream(spark, f"{base}/in"), "k", "ts", 3_600), f"{base}/out", f"{base}/cp")
        assert q.awaitTermination(120) and q.exception() is None
    for kind in (True, False):
        assert sorted(r.v for r in late.read_side(spark, f"{base}/out", kind).collect()) == sorted(want[kind])
    assert want[True] == [6, 8, 9, 10]


def test_a_fall_of_the_rate_is_an_alert(spark, tmp_path):
    base, said = str(tmp_path), []
    listener = alerts.RateAlerts(lambda q, batch, text: said.append((batch, text)), rule=lambda: alerts.RateRule(floor=0.3, fall=0.25))
    spark.streams.addListener(listener)
    try:
        spark.range(0).selectExpr("'k' AS k", "current_timestamp() AS ts", "id AS v").write.parquet(f"{base}/in")
        stream = alerts.observed(_stream(spark, f"{base}/in"), F.col("v") > 0)
        q = stream.writeStream.format("noop").option("checkpointLocation", f"{base}/cp").start()
        for good in (9, 8, 9, 5, 1):
            spark.range(10).selectExpr("'k' AS k", "TIMESTAMP '2024-01-01' AS ts", f"CASE WHEN id < {good} THEN 1 WHEN id = 9 THEN NULL ELSE 0 END AS v").coalesce(1).write.mode("append").parquet(f"{base}/in")
            q.processAllAvailable()
        deadline = time.time() + 30
        while len(said) < 2 and time.time() < deadline:
            time.sleep(0.2)
        q.stop()
    finally:
        spark.streams.removeListener(listener)
    assert [t.split()[0] for _, t in said] == ["fell", "fell"] and "0.867 to 0.500" in said[0][1]


def test_rule_over_runs():
    rule = alerts.RateRule(floor=0.5, fall=0.2, memory=2)
    assert [rule.judge(*r) for r in ((0, 0), (10, 9), (10, 8), (10, 5), (10, 4))] == ["no samples", None, None, "fell from 0.850 to 0.500", "fell from 0.650 to 0.400"]
    assert alerts.RateRule(floor=0.5).judge(10, 1) == "below 0.5: 0.100"
