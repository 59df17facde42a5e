"""Arrow UDFs for what needs a stack: microdata, tables, selectors, scripts' state, entities.

Each is one vectorised call per batch that returns JSON text (or a number), so that everything after it
is expressions again.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_STATE = re.compile(r"(?:window\.)?(__[A-Za-z0-9_]+__)\s{0,8}=\s{0,8}(?=\{)")
MOST_STATE = 2_000_000
#: The attribute that holds the value of an itemprop, by tag.
_VALUE_OF = {"meta": "content", "link": "href", "a": "href", "area": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "iframe": "src", "embed": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime"}


class _Microdata(HTMLParser):
    """Items open on a stack; an item left open at the end is kept and marked."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.open: list[dict] = []

    def _parent(self) -> dict | None:
        return next((x["item"] for x in reversed(self.open) if x["item"] is not None), None)

    @staticmethod
    def _put(item: dict, names: str, value: object) -> None:
        for name in names.split():
            item[name] = value if name not in item else [*(item[name] if isinstance(item[name], list) else [item[name]]), value]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        entry = {"tag": tag, "item": None, "prop": None, "owner": None, "text": []}
        parent = self._parent()
        if "itemscope" in a:
            entry["item"] = {"@type": (a.get("itemtype") or "").rstrip("/").rsplit("/", 1)[-1]}
            if a.get("itemprop") and parent is not None:
                self._put(parent, a["itemprop"], entry["item"])
            else:
                self.items.append(entry["item"])
        elif a.get("itemprop") and parent is not None:
            held = _VALUE_OF.get(tag)
            if held and a.get(held) is not None:
                self._put(parent, a["itemprop"], a[held])
            elif a.get("content") is not None:
                self._put(parent, a["itemprop"], a["content"])
            else:
                entry |= {"prop": a["itemprop"], "owner": parent}
        if tag not in VOID:
            self.open.append(entry)

    def handle_data(self, data: str) -> None:
        for x in self.open:
            if x["prop"]:
                x["text"].append(data)

    def _close(self, x: dict) -> None:
        if x["prop"]:
            self._put(x["owner"], x["prop"], " ".join("".join(x["text"]).split()))

    def handle_endtag(self, tag: str) -> None:
        if any(x["tag"] == tag for x in self.open):
            while True:
                x = self.open.pop()
                self._close(x)
                if x["tag"] == tag:
                    return

    def finish(self) -> list[dict]:
        for x in reversed(self.open):
            self._close(x)
            if x["item"] is not None:
                x["item"]["@unclosed"] = True
        return self.items


class _Tables(HTMLParser):
    """Tables on a stack, so nested ones stand beside their parents, marked."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"rows": [], "cell": None, "nested": bool(self.open)})
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self.open[-1]["cell"] = []
            self.open[-1]["rows"][-1].append((tag == "th", self.open[-1]["cell"]))

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th"):
            self.open[-1]["cell"] = None
        elif self.open and tag == "table":
            self.done.append(self.open.pop())

    def finish(self) -> list[dict]:
        found = []
        for t in [*self.done, *reversed(self.open)]:
            rows = [[(h, " ".join("".join(c).split())) for h, c in r] for r in t["rows"] if r]
            if not rows:
                continue
            cells = [[c for _, c in r] for r in rows]
            head = [any(h for h, _ in r) for r in rows]
            if all(head) and len(rows) > 1:
                shape = {"orientation": "key-value", "headers": [], "rows": cells}
            elif head[0] and sum(head) == 1:
                shape = {"orientation": "columns", "headers": cells[0], "rows": cells[1:]}
            else:
                shape = {"orientation": "headerless", "headers": [], "rows": cells}
            found.append(shape | {"nested": t["nested"]})
        return found


class _Both(HTMLParser):
    """Microdata and tables of one pass over the page: each is told of every tag and text in its order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items, self.tables = _Microdata(), _Tables()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.items.handle_starttag(tag, attrs)
        self.tables.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        self.items.handle_data(data)
        self.tables.handle_data(data)

    def handle_endtag(self, tag: str) -> None:
        self.items.handle_endtag(tag)
        self.tables.handle_endtag(tag)


class _Counts(HTMLParser):
    """How many items and tables _Microdata and _Tables find, by their rules of nesting; nothing is kept of them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items = self.tables = self.scopes = 0
        self.open: list[tuple[str, bool]] = []
        self.filled: list[bool] = []

    def updatepos(self, i: int, j: int) -> int:
        """No one asks for lines and columns, so they are not counted."""
        return j

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.filled.append(False)
        elif tag in ("td", "th") and self.filled and not self.filled[-1]:
            self.filled[-1] = True
            self.tables += 1
        scope = False
        if attrs:
            a = dict(attrs)
            scope = "itemscope" in a
            self.items += scope and not (self.scopes and a.get("itemprop"))
        if tag not in VOID:
            self.open.append((tag, scope))
            self.scopes += scope

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.filled:
            self.filled.pop()
        if any(x[0] == tag for x in reversed(self.open)):
            while True:
                last, scope = self.open.pop()
                self.scopes -= scope
                if last == tag:
                    return


_PART = re.compile(r"([.#]?)([A-Za-z_][\w-]*)")


def parse_selector(selector: str) -> list[tuple[str | None, frozenset[str], str | None]] | None:
    """Steps (tag, classes, id) of a descendant selector; null for combinators and attributes."""
    steps = []
    for token in selector.split():
        if not re.fullmatch(r"[A-Za-z_][\w-]*(?:[.#][A-Za-z_][\w-]*)*|(?:[.#][A-Za-z_][\w-]*)+", token):
            return None
        tag, classes, ident = None, set(), None
        for kind, name in _PART.findall(token):
            if kind == ".":
                classes.add(name)
            elif kind == "#":
                ident = name
            else:
                tag = name.lower()
        steps.append((tag, frozenset(classes), ident))
    return steps or None


class _Selectors(HTMLParser):
    """Matches of several selectors, each a list of steps, counted in one pass over the page."""

    def __init__(self, selectors: list[list]) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors, self.counts, self.open = selectors, [0] * len(selectors), []

    @staticmethod
    def _fits(step: tuple, node: tuple) -> bool:
        return (step[0] is None or step[0] == node[0]) and step[1] <= node[1] and (step[2] is None or step[2] == node[2])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        node = (tag, frozenset((a.get("class") or "").split()), a.get("id"))
        for k, steps in enumerate(self.selectors):
            if self._fits(steps[-1], node):
                need = len(steps) - 2
                for above in reversed(self.open):
                    if need >= 0 and self._fits(steps[need], above):
                        need -= 1
                self.counts[k] += need < 0
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(x[0] == tag for x in self.open):
            while self.open.pop()[0] != tag:
                pass


def _parsed(parser: HTMLParser, text: str | None):
    parser.feed(text or "")
    parser.close()
    return parser


def state_objects(text: str | None) -> dict[str, object]:
    """__NAME__ = {...}: braces are matched with strings and escapes in mind."""
    found = {}
    for m in _STATE.finditer(text or ""):
        depth, quote, k, end = 0, "", m.end(), min(len(text), m.end() + MOST_STATE)
        while k < end:
            c = text[k]
            if quote:
                if c == "\\":
                    k += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    try:
                        found[m[1]] = json.loads(text[m.end() : k + 1])
                    except ValueError:
                        pass
                    break
            k += 1
    return found


def _microdata(pages: pd.Series) -> pd.Series:
    """JSON array of the page's items."""
    return pages.map(lambda t: json.dumps(_parsed(_Microdata(), t).finish(), ensure_ascii=False))


def parsed_tables(html: str | None) -> list[dict]:
    """{orientation, headers, rows, nested} of each table. A table whose rows, more than one, each hold a th is
    key-value: the th labels its row. With a th in the first row alone that row is the header."""
    return _parsed(_Tables(), html).finish()


def _tables(pages: pd.Series) -> pd.Series:
    """JSON array of the tables."""
    return pages.map(lambda t: json.dumps(parsed_tables(t), ensure_ascii=False))


def _items_and_tables(pages: pd.Series) -> pd.DataFrame:
    """What _microdata and _tables return, of one pass over each page."""
    rows = []
    for text in pages:
        found = _parsed(_Both(), text)
        rows.append((json.dumps(found.items.finish(), ensure_ascii=False), json.dumps(found.tables.finish(), ensure_ascii=False)))
    return pd.DataFrame(rows, columns=["items", "tables"], dtype=object)


def _items_and_tables_counts(pages: pd.Series) -> pd.DataFrame:
    """The sizes of what _items_and_tables returns."""
    rows = []
    for text in pages:
        found = _parsed(_Counts(), text)
        rows.append((found.items, found.tables))
    return pd.DataFrame(rows, columns=["items", "tables"], dtype="int64")


def _js_state(pages: pd.Series) -> pd.Series:
    """JSON object of the page's state objects by name."""
    return pages.map(lambda t: json.dumps(state_objects(t), ensure_ascii=False))


def _selector_count(pages: pd.Series, selectors: pd.Series) -> pd.Series:
    """Matches of a descendant selector; null for one that is not supported."""
    steps = {s: parse_selector(s) if s is not None else None for s in selectors.unique()}
    return pd.Series([None if steps[s] is None else _parsed(_Selectors([steps[s]]), t).counts[0] for t, s in zip(pages, selectors)], dtype="Int32")


def _selector_counts(pages: pd.Series, selectors: pd.Series) -> pd.Series:
    """The same for each of a page's selectors, in their order; the page is parsed once."""
    known, out = {}, []
    for text, wanted in zip(pages, selectors):
        if wanted is None:
            out.append(None)
            continue
        for s in wanted:
            if s not in known:
                known[s] = parse_selector(s) if s is not None else None
        steps = [known[s] for s in wanted]
        readable = [x for x in steps if x is not None]
        counts = iter(_parsed(_Selectors(readable), text).counts if readable else ())
        out.append([None if x is None else next(counts) for x in steps])
    return pd.Series(out, dtype=object)


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html_lib.unescape(t) if t is not None else None)


def microdata(html: Column | str) -> Column:
    return F.pandas_udf(_microdata, "string")(html)


def tables(html: Column | str) -> Column:
    return F.pandas_udf(_tables, "string")(html)


def items_and_tables(html: Column | str) -> Column:
    """A struct of microdata and tables, for who takes both."""
    return F.pandas_udf(_items_and_tables, "items string, tables string")(html)


def items_and_tables_counts(html: Column | str) -> Column:
    """A struct of the numbers of items and tables, for who only counts them."""
    return F.pandas_udf(_items_and_tables_counts, "items long, tables long")(html)


def js_state(html: Column | str) -> Column:
    return F.pandas_udf(_js_state, "string")(html)


def selector_count(html: Column | str, selector: Column | str) -> Column:
    return F.pandas_udf(_selector_count, "int")(html, selector)


def selector_counts(html: Column | str, selectors: Column | str) -> Column:
    return F.pandas_udf(_selector_counts, "array<int>")(html, selectors)


def unescape(text: Column | str) -> Column:
    return F.pandas_udf(_unescape, "string")(text)


TABLES_TYPE = "array<struct<orientation:string,headers:array<string>,rows:array<array<string>>,nested:boolean>>"


def columns_of(lines: list[str]) -> list[list[str]]:
    """Cells of a block's lines: columns are parted where two or more character columns are blank in every line,
    with something on either side. Rows without a cell are gone."""
    width = max(map(len, lines), default=0)
    solid = [any(len(x) > k and x[k] != " " for x in lines) for k in range(width)]
    cuts, k = [], 0
    while k < width:
        end = k
        while end < width and not solid[end]:
            end += 1
        if end - k >= 2 and k > 0 and end < width:
            cuts.append(k)
        k = end + 1 if end == k else end
    bounds = [0, *cuts, width]
    rows = [[x[a:b].strip(" ") for a, b in zip(bounds, bounds[1:])] for x in lines]
    return [r for r in rows if any(r)]


def _cut_columns(blocks: pd.Series) -> pd.Series:
    return pd.Series([columns_of(list(x)) for x in blocks])


def cut_columns(lines: Column | str) -> Column:
    return F.pandas_udf(_cut_columns, "array<array<string>>")(lines)
