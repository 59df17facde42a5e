"""Elements of pages as nested intervals, and what lies in the scope of what.

One pass of an automaton gives each element the numbers of the tokens that open and close it: a closing tag closes
the innermost open element of its name and all within it, or nothing; void elements close at once; what is left open
ends with the page and is marked. Intervals nest, so an element lies in another's scope exactly if the furthest end
of those opened before it is past its start. That is a running maximum in the order of the page, and each further
step of a descendant selector is one more over the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.automata import VOID, parse_selector

_ELEMENTS = "key {key}, node int, tag string, element_id string, classes array<string>, start int, stop int, depth int, closed boolean"


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.count: dict[str, int] = {}
        self.token = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        self.token += 1
        node = len(self.rows)
        self.rows.append([tag, a.get("id"), list(dict.fromkeys((a.get("class") or "").split())), self.token, None, len(self.open) + 1])
        if tag in VOID:
            self.token += 1
            self.rows[node][4] = self.token
        else:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        self.token += 1
        while True:
            node = self.open.pop()
            self.rows[node][4] = self.token
            self.count[self.rows[node][0]] -= 1
            if self.rows[node][0] == tag:
                return


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "node", "tag", "element_id", "classes", "start", "stop", "depth", "closed"]
    types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    for batch in batches:
        for k, html in enumerate(batch.column("html").to_pylist()):
            p = _Elements()
            p.feed(html or "")
            p.close()
            if p.rows:
                end = p.token + 1
                rows = [(n, r[0], r[1], r[2], r[3], end if r[4] is None else r[4], r[5], r[4] is not None) for n, r in enumerate(p.rows)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([k] * len(rows))), *columns], names=names)


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row an element: key, node (from 0, in page order), tag, element_id, classes, start and stop (token numbers), depth
    (from 1), closed. Void elements are closed. Null pages and pages without a tag have no row."""
    key_type = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInArrow(_elements, _ELEMENTS.format(key=key_type)).withColumnRenamed("key", key)


def _fits(step: tuple) -> Column:
    tag, classes, ident = step
    found = F.lit(True) if tag is None else F.col("tag") == tag
    for c in sorted(classes):
        found = found & F.array_contains("classes", c)
    return found & F.coalesce(F.col("element_id") == ident, F.lit(False)) if ident is not None else found


def matching(found: DataFrame, key: str, selectors: dict[str, str]) -> DataFrame:
    """The elements with a boolean column for each named descendant selector: whether the element fits its last step,
    within elements that fit the steps before it, in order. A selector with anything but tags, classes, ids and
    descent gives null."""
    order = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    for name, selector in selectors.items():
        steps = parse_selector(selector)
        if steps is None:
            found = found.withColumn(name, F.lit(None).cast("boolean"))
            continue
        found = found.withColumn(name, _fits(steps[0]))
        for step in steps[1:]:
            reach = F.max(F.when(F.col(name), F.col("stop"))).over(order)
            found = found.withColumn(name, _fits(step) & F.coalesce(reach > F.col("start"), F.lit(False)))
    return found


def counts(found: DataFrame, key: str, selectors: dict[str, str]) -> DataFrame:
    """Matches of each selector by page; pages without an element have no row."""
    parsed = {n: parse_selector(s) is not None for n, s in selectors.items()}
    each = [(F.count_if(F.col(n)) if ok else F.lit(None).cast("long")).alias(n) for n, ok in parsed.items()]
    return matching(found, key, selectors).groupBy(key).agg(*each)
