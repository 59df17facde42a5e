"""Every registered query of the library against its SQL, at the smallest size that is there."""

from __future__ import annotations

import os

import oracle
import pytest

from sieveworks import registry

SF = os.environ.get("SIEVEWORKS_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_its_sql(spark, con, name):
    assert oracle.difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) == ""


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_audit_of_known_resumes(spark):
    rows = {r.check: (r.earned, r.possible) for r in registry.QUERIES["txt_audit"](spark, SF).collect()}
    assert len(rows) == 23 and sum(p for _, p in rows.values()) == 100
    assert rows["email"] == (5.0, 5.0) and rows["dated roles"] == (10.0, 10.0) and rows["standard glyph"] == (3.0, 3.0)
    verdicts = {r.id: r for r in registry.QUERIES["agg_score_pct"](spark, SF).collect()}
    assert verdicts[2].blockers == "too little text,image only" and not verdicts[2]["pass"]
    assert "placeholders" in verdicts[3].blockers and verdicts[1].score > 80


def test_streaming_ok_rate(spark, tmp_path):
    from sieveworks.streaming import forms

    spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:01:00', 'u', 200), (TIMESTAMP '2024-01-01 00:02:00', 'u', 403), (TIMESTAMP '2024-01-01 01:00:00', 'u', 200) AS t(ts, url, status)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, url string, status int").parquet(str(tmp_path / "in"))
    q = forms.ok_rate(stream).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.samples, r.ok_rate) for r in spark.sql("SELECT * FROM rates").collect()] == [(2, 0.5)]


def test_ratios_of_zero_and_null_are_null(spark):
    from pyspark.sql import functions as F

    from sieveworks.functions import finance
    from sieveworks.operators import nutrition, series
    from sieveworks.streaming import forms

    f = spark.sql("SELECT * FROM VALUES (0.0D, 1.0D), (NULL, 1.0D), (1.0D, 0.0D), (2.0D, 3.0D) AS t(a, b)")
    spreads = [r[0] for r in f.select(finance.spread_percent(F.col("a"), F.col("b"), F.lit(2))).collect()]
    assert spreads == [None, None, -100.0, 50.0]
    assert all(v is None for r in f.select(*finance.returns_on_capital(*[F.lit(0.0)] * 6, tax=0.25).values()).collect() for v in r)
    people = spark.sql("SELECT 1 AS id, 30 AS age, 'male' AS sex, 0.0D AS height_cm, 70.0D AS weight_kg, NULL AS body_fat_pct, 'light' AS activity, 60.0D AS goal_kg, false AS pregnant").withColumn("body_fat_pct", F.col("body_fat_pct").cast("double"))
    assert nutrition.plan_targets(people).first()["bmi"] is None
    shares = series.top_share(spark.sql("SELECT * FROM VALUES (1, 0.0D, 'x'), (1, 0.0D, 'y'), (2, 4.0D, 'x') AS t(k, v, n)"), "k", "v", "n").collect()
    assert {r.k: r.share_pct for r in shares} == {1: None, 2: 100.0}
    unlocks = spark.sql("SELECT 1 AS id, '2026-01-10' AS date, 5.0D AS tokens"), spark.sql("SELECT 1 AS id, 0.0D AS circulating, 1.0D AS price")
    assert series.unlock_horizons(*unlocks, F.lit("2026-01-01").cast("date")).first()["pct_30"] is None
    feed = spark.sql("SELECT 'x' AS symbol, TIMESTAMP '2024-01-01' AS ts, 0.0D AS price")
    assert forms.cross_check(feed, feed.withColumn("price", F.lit(2.0))).first()["spread_pct"] is None


def test_json_walk_has_no_limits(spark):
    from pyspark.sql import functions as F

    from sieveworks.operators import json_tree

    deep = "[" * 60 + '{"a.b": 1.50}' + "]" * 60
    rows = spark.createDataFrame([(1, deep), (2, '{"x": [null, true, "T"], "y": {}}'), (3, None), (4, "7")], "id long, j string").withColumn("v", F.try_parse_json("j"))
    got = {r.id: [] for r in rows.collect()}
    for r in json_tree.walk(rows, "id", "v").collect():
        got[r.id].append((r.path, r.leaf, r.value))
    assert got[1] == [("[0]" * 60 + ".a.b", "a.b", "1.5")] and got[3] == [] and got[4] == [("", None, "7")]
    assert got[2] == [(".x[0]", "x", None), (".x[1]", "x", "true"), (".x[2]", "x", "T")]
    many = spark.range(3000).select("id", F.to_json(F.struct(F.sequence(F.lit(1), F.lit(400)).alias("s"))).alias("j")).withColumn("v", F.try_parse_json("j"))
    assert json_tree.walk(many, "id", "v").count() == 1_200_000


def test_json_is_walked_in_its_order_and_depth_is_marked(spark):
    from pyspark.sql import functions as F

    from sieveworks.operators import json_tree

    rows = spark.createDataFrame([(1, '{"a": [' + ",".join(f'{{"k": {n}}}' for n in range(12)) + "]}"), (2, "[]")], "id long, j string").withColumn("v", F.try_parse_json("j"))
    got = json_tree.find(json_tree.walk(rows, "id", "v"), "k", keys=12).orderBy("place").collect()
    assert [r.path for r in got] == [f".a[{n}].k" for n in range(12)] and [r.pos for r in got] == list(range(12))
    deep = spark.createDataFrame([(1, "[" * 60_000 + "1" + "]" * 60_000), (2, "[7]")], "id long, json string")
    import pyspark.sql.functions as S

    real, S.to_json = S.to_json, lambda c: F.col("json")
    try:
        marked = json_tree.walk(deep.withColumn("v", F.lit(1)), "id", "v")
    finally:
        S.to_json = real
    assert sorted((r.id, r.pos, r.path, r.value) for r in marked.collect()) == [(1, -1, None, None), (2, 0, "[0]", "7")]


def test_vendor_marks_anywhere_in_names_or_exactly(spark):
    from pyspark.sql import functions as F

    from sieveworks.functions import web

    f = spark.createDataFrame([(1, "X-My-CF-Ray: 1"), (2, "cf-ray: 2"), (3, "note: cf-ray"), (4, "Set-Cookie: a__cf_bm=1; path=/"), (5, "set-cookie: a=__cf_bm"), (6, None)], "id int, headers string")
    names = lambda exact: {r.id: [(v.vendor, v.engaged) for v in r.v] for r in f.select("id", web.vendor_evidence(F.col("headers"), F.lit(None).cast("string"), exact).alias("v")).collect()}
    assert names(False) == {1: [("Cloudflare", False)], 2: [("Cloudflare", False)], 3: [], 4: [("Cloudflare", True)], 5: [], 6: []}
    assert names(True) == {1: [], 2: [("Cloudflare", False)], 3: [], 4: [], 5: [], 6: []}
