"""Work on each row is dealt to as many tasks as there are cores, however small the file is."""

from __future__ import annotations

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveworks import registry
from sieveworks.functions import automata, finance
from sieveworks.operators.shared import spread

SF = os.environ.get("SIEVEWORKS_SF", "/root/testdata/sf0.001")
NAMES = ("fin_reverse_dcf", "str_styling_strip", "web_harvest", "web_tables", "agg_hier_plan", "j_walk", "src_docx", "src_pdf_text", "src_body", "a_table_shape", "m_dcf_solve", "agg_summary_counts", "plan_check", "flt_value_match", "web_js_state", "flt_key_match", "agg_count_if", "agg_max_default", "join_targets", "j_lenient",)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_rows_are_dealt_to_tasks(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # an exchange that is not merged into fewer tasks again


def test_parts_grow_with_the_rows(spark):
    assert [spread(spark.range(n).coalesce(1), "id", rows=100).rdd.getNumPartitions() for n in (0, 10, 1_001)] == [4, 4, 11]


def test_implied_growth_of_a_batch(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 100.0D, 10.0D, 0.1D), (2, NULL, 10.0D, 0.1D), (3, 100.0D, -1.0D, 0.1D), (4, 100.0D, 10.0D, 0.02D), (5, 1e12D, 10.0D, 0.1D), (6, 100.0D, 10.0D, NULL), (7, CAST('NaN' AS DOUBLE), 10.0D, 0.1D) AS t(id, v, f, d)")
    for fade in (False, True):
        g = finance.implied_growth(F.col("v"), F.col("f"), F.col("d"), F.lit(0.025), 7, fade=fade)
        found = {r.id: r for r in rows.withColumn("g", g).withColumn("back", finance.present_value(F.col("f"), F.col("g"), F.col("d"), F.lit(0.025), 7, fade=fade)).collect()}
        assert [k for k in sorted(found) if found[k].g is not None] == [1] and abs(found[1].back - 100.0) < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_of_every_selector_are_dealt(spark):
    from sieveworks.plans import web_queries

    assert web_queries._product_pages(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_page_is_parsed_once_for_all_selectors(monkeypatch):
    pages = ["<div class='card x'><span class=price>1</span><p id=a><b>2</b></div><span class=price>", None, "", "<ul><li><li></ul>"]
    wanted = ["div.card .price", "div > span", None, "ul li", ".price", "", "#a b"]
    parse, seen = automata._parsed, []
    monkeypatch.setattr(automata, "_parsed", lambda parser, text: seen.append(text) or parse(parser, text))
    found = automata._selector_counts(pd.Series(pages), pd.Series([wanted] * 3 + [["div > p", None]]))
    assert seen == pages[:3] and list(found) == [[1, None, None, 0, 2, None, 1], [0, None, None, 0, 0, None, 0], [0, None, None, 0, 0, None, 0], [None, None]]
    for html in pages:
        alone = [None if pd.isna(n) else int(n) for n in automata._selector_count(pd.Series([html] * len(wanted)), pd.Series(wanted, dtype=object))]
        assert alone == automata._selector_counts(pd.Series([html]), pd.Series([wanted])).iloc[0]
    assert list(automata._selector_counts(pd.Series(pages[:1]), pd.Series([None]))) == [None]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_are_not_repeated_for_each_selector(spark):
    plan = registry.QUERIES["web_selector_count"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("ArrowEvalPython")  # rows are multiplied above, after the parsing


def test_items_and_tables_are_those_of_passes_of_their_own(monkeypatch):
    rng = random.Random(3)
    tokens = ["<table>", "<tr>", "<td>", "<th>", "</td>", "</tr>", "</table>", "<div itemscope itemtype='x/Y'>", "<b itemprop=name>", "</b>", "</div>", "<meta itemprop=size content=3>", "<br/>", "<div itemscope itemprop=own />", "t &amp; é", "<script>'</td><td>'</script>", "<!-- <td> -->", "</br>", "<td"]
    pages = pd.Series(["".join(rng.choice(tokens) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, "", "<table>" * 500])
    items, tables = automata._microdata(pages), automata._tables(pages)
    parse, seen = automata._parsed, []
    monkeypatch.setattr(automata, "_parsed", lambda parser, text: seen.append(text) or parse(parser, text))
    both = automata._items_and_tables(pages)
    assert list(both["items"]) == list(items) and list(both["tables"]) == list(tables) and len(seen) == len(pages)
    assert automata._items_and_tables(pages[:0]).shape == (0, 2)


def test_counts_of_items_and_tables_are_the_sizes():
    rng = random.Random(4)
    tokens = ["<table>", "<tr>", "<td>", "<th/>", "</td>", "</tr>", "</table>", "<div itemscope itemtype='x/Y'>", "<b itemprop=name>", "</b>", "</div>", "<p itemscope itemprop>", "<meta itemscope itemprop=size>", "<br/>", "<DIV ItemScope itemprop=own itemprop=''>", "<div itemscope itemprop=own />", "<td itemscope itemprop=a>", "t &amp; é", "<script>'</td><td>'</script>", "<!-- <td> -->", "</br>", "<td"]
    pages = pd.Series(["".join(rng.choice(tokens) for _ in range(rng.randrange(0, 60))) for _ in range(1000)] + [None, "", "<table><td>" * 500])
    both, counts = automata._items_and_tables(pages), automata._items_and_tables_counts(pages)
    for kind in ("items", "tables"):
        assert counts[kind].tolist() == [len(json.loads(x)) for x in both[kind]] and counts[kind].max() > 3
    assert automata._items_and_tables_counts(pages[:0]).shape == (0, 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["web_harvest", "agg_summary_counts"])
def test_what_is_only_counted_is_not_written_as_json(spark, name):
    assert "from_json" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["web_harvest", "agg_summary_counts"])
def test_a_harvest_parses_a_page_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    evaluated = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(evaluated) == 1 and evaluated[0].split("], [")[0].count("(html#") == 1
