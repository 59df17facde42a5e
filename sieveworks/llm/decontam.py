"""Benchmark decontamination by template windows.

Numbers, units that follow them, and names (capitalised words) become typed placeholders; what is left in
lower case is a template, the same for a question and for its copies with other figures. Windows of
template tokens are hash-joined with those of the benchmark. Where windows meet, the slots must agree:
under the copy, one benchmark value stands for one document value and the other way round; otherwise the
windows met by chance.

A window of mostly slots is no template that tells: such windows are joined with their values, so exact
copies of sums, tables and short items are found, and only those. An item shorter than a window is one
window of its own length; one of fewer than five tokens is no evidence and is reported apart. Each item is also searched as it reads in lower case, where it has no names.

Items that no document can tell apart (the same windows, equal values at the same slots) are one class and are
searched once. A text's windows meet the distinct templates of the benchmark first; a class comes in by the rarest
of its windows, enough of them that no pair is missed, and positions are joined last, for the pairs that count.

Everything is DataFrame expressions. Windows of documents are never shuffled: they stream through a
hash join with the benchmark's windows, which are broadcast after their number has been counted;
beyond ``broadcast_rows`` the join shuffles instead. A window's hash is put together from those of
its halves, so each costs a few steps however long it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stage

UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "ms", "kb", "mb", "gb", "tb",
    "mph", "kmh", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "usd", "eur", "gbp", "percent", "dollars", "dollar", "euros", "euro", "cents", "cent", "pounds", "pound",
    "seconds", "second", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "meters", "meter", "metres", "metre",
    "kilometers", "kilometres", "miles", "mile", "feet", "foot", "inches", "inch", "grams", "gram", "kilograms", "kilogram", "liters", "litres", "degrees",
)
#: Tokens an item must have for its exact match to be evidence.
EVIDENCE = 5
_OPEN, _CLOSE = "\u0002", "\u0003"
_NUMBER = r"(?<![\p{L}\p{N}])[$€£]?\d+(?:[.,:/]\d+)*%?"
_UNIT = rf"{_CLOSE}\x20?((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\p{{L}}\p{{N}}])"
_NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
_TOKEN = rf"{_OPEN}[^{_CLOSE}]*{_CLOSE}|[\p{{L}}\p{{N}}]+"


def marked(text: Column) -> Column:
    """The text in lower case with slots as U+0002, their type (n, u, v), their value, U+0003."""
    t = F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "  ")
    t = F.regexp_replace(t, _NUMBER, f"{_OPEN}n$0{_CLOSE}")
    t = F.regexp_replace(t, _UNIT, f"{_CLOSE} {_OPEN}u$1{_CLOSE}")
    return F.lower(F.regexp_replace(t, _NAME, f"{_OPEN}v$0{_CLOSE}"))


def tokens(marked_text: Column) -> Column:
    return F.regexp_extract_all(marked_text, F.lit(_TOKEN), F.lit(0))


def _sizes(lengths: Iterable[int]) -> list[int]:
    """The window lengths that those are put together from, in ascending order: a window of n tokens is one of
    the greatest power of two below n and one of the rest."""
    found, left = set(), set(lengths)
    while left:
        n = left.pop()
        found.add(n)
        if n > 1:
            half = 1 << ((n - 1).bit_length() - 1)
            left |= {half, n - half} - found
    return sorted(found)


def with_windows(rows: DataFrame, lengths: Iterable[int], min_words: int) -> DataFrame:
    """``rows``: words (marked tokens) and others. Replaces words by at: array<struct<len, pos, hash>> of the windows
    of each of the lengths, pos from 1. The hash is the template's where at least ``min_words`` tokens (or
    all) are no slots, else that of the tokens with their values."""
    lengths, others = sorted(lengths), [c for c in rows.columns if c != "words"]
    slot = lambda x: F.startswith(x, F.lit(_OPEN))
    rows = rows.select(*others, "words", F.size("words").alias("_n"), F.transform("words", lambda x: F.xxhash64(F.when(slot(x), F.substring(x, 1, 2)).otherwise(x))).alias("_h1"), F.transform("words", lambda x: slot(x).cast("int")).alias("_c1"))

    def joined(name: str, n: int, two: Callable[[Column, Column], Column]) -> Column:
        half = 1 << ((n - 1).bit_length() - 1)
        many = F.greatest(F.col("_n") - n + 1, F.lit(0))
        return F.when(F.col("_n") >= n, F.zip_with(F.slice(f"_{name}{half}", F.lit(1), many), F.slice(f"_{name}{n - half}", F.lit(half + 1), many), two)).otherwise(F.slice(f"_{name}{half}", 1, 0))

    for n in _sizes(lengths)[1:]:
        rows = rows.withColumns({f"_h{n}": joined("h", n, lambda a, b: F.xxhash64(a, b)), f"_c{n}": joined("c", n, lambda a, b: a + b)})

    def located(n: int) -> Column:
        most = n - min(min_words, n)
        literal = lambda i: F.xxhash64(F.lit("values"), F.slice("words", i + 1, F.lit(n)))
        both = F.zip_with(f"_h{n}", f"_c{n}", lambda h, c: F.struct(h.alias("h"), c.alias("c")))  # once a text: a lambda may hold no other array
        return F.transform(both, lambda x, i: F.struct(F.lit(n).alias("len"), (i + 1).alias("pos"), F.when(x["c"] > most, literal(i)).otherwise(x["h"]).alias("hash")))

    return rows.select(*others, (F.flatten(F.array(*map(located, lengths))) if len(lengths) > 1 else located(lengths[0])).alias("at"))


def parsed(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with words, the marked tokens of a text."""
    return rows.withColumn("words", tokens(marked(text)))


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, version (of its text), low, words: the tokens of each item, and (low) as it reads in lower case."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    items = items.select("item_id", F.xxhash64("text").alias("version"), F.posexplode(F.array(F.col("text"), F.lower("text"))).alias("low", "text"))
    return parsed(items, F.col("text")).select("item_id", "version", "low", "words")


def benchmark_windows(benchmark: DataFrame, length: int, min_words: int) -> DataFrame:
    """item_id, version, low, length, item_pos, hash, n_item: the distinct windows of each item with their first
    places, and those that only its lower-case form has. n_item counts the former."""
    items = item_words(benchmark).withColumn("n", F.size("words")).filter("n > 0")
    rows = with_windows(items, range(1, length + 1), min_words)
    rows = rows.select("item_id", "version", "low", "n", F.inline_outer("at")).filter(F.col("len") == F.least("n", F.lit(length)))
    rows = rows.groupBy("item_id", "version", F.col("len").alias("length"), "hash").agg(F.min(F.struct("low", "pos")).alias("at"))
    rows = rows.select("item_id", "version", "length", "hash", "at.low", F.col("at.pos").alias("item_pos"))
    return rows.withColumn("n_item", F.count_if(F.col("low") == 0).over(Window.partitionBy("item_id", "version")))


def item_classes(benchmark: DataFrame, windows: DataFrame) -> DataFrame:
    """item_id, version, rep_id, rep_version: items that no document can tell apart are one class, and the smallest
    stands for it. They have the same windows at the same places, and equal values at the same slots."""
    own = windows.groupBy("item_id", "version").agg(F.array_sort(F.collect_list(F.struct("length", "hash", "low", "item_pos"))).alias("w"))
    slots = F.filter("words", lambda x: F.startswith(x, F.lit(_OPEN)))
    places = F.transform(slots, lambda x: F.array_position(slots, x))
    form = item_words(benchmark).groupBy("item_id", "version").agg(F.array_sort(F.collect_list(F.struct("low", places.alias("p"), F.size("words").alias("n")))).alias("f"))
    key = [F.xxhash64(F.lit(seed), "w", "f").alias(f"key{seed}") for seed in (1, 2)]
    return own.join(form, ["item_id", "version"]).select("item_id", "version", *key).withColumn("rep", F.min(F.struct("item_id", "version")).over(Window.partitionBy("key1", "key2"))).select("item_id", "version", F.col("rep.item_id").alias("rep_id"), F.col("rep.version").alias("rep_version"))


def _telling(side: DataFrame, need: Column) -> DataFrame:
    """Of each item's places the rarest, one more than can be missing from a pair that counts: such a pair meets one."""
    shared = side.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("hash", "length")))
    places = shared.groupBy("item_id", "version", "item_pos").agg(F.max("many").alias("many"), F.first("n_item").alias("n_item"))
    of_item = Window.partitionBy("item_id", "version")
    ranked = places.withColumns({"k": F.row_number().over(of_item.orderBy("many", "item_pos")), "all": F.count(F.lit(1)).over(of_item)}).filter(F.col("k") <= F.col("all") - need + 1)
    return side.join(ranked.select("item_id", "version", "item_pos"), ["item_id", "version", "item_pos"]).select("hash", "length", "item_id", "version").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 8, share: float = 0.5, enough: int = 6, min_words: int = 4, broadcast_rows: int = 1_000_000, least_tokens: int = 1, most_tokens: int | None = None) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds the item or a re-parameterised copy of it:
    n_windows of the item's n_item distinct windows meet, n_slots slot values agree. Of several copies in
    a document each is judged by itself, and the one with the most windows is given.

    A pair counts from ``share`` of the item's windows on, or ``enough`` windows (with 8 tokens each, 6
    windows are 13 tokens in a row). Every item of ``least_tokens`` tokens or more is searched; windows with fewer than
    ``min_words`` tokens that are no slots meet with equal values only. Null, empty and blank texts hold
    nothing. A very long text is read whole, and each of its windows meets an item once. Rows that repeat
    a doc_id are judged each by its own text and give one pair; repeated items with other ids give a
    pair each, those with one id give one. Rows with a null doc_id or item_id give none. Ties between copies
    go to the first. An empty table on either side gives an empty result. Only doc_id, text and item_id are read.
    """
    agree, classes = _agreed(docs, benchmark, length, share, enough, min_words, broadcast_rows, least_tokens, most_tokens)
    members = classes.select(F.col("rep_id").alias("_r"), F.col("rep_version").alias("_v"), F.col("item_id").alias("member"))
    all_items = agree.join(members, (F.col("item_id") == F.col("_r")) & (F.col("version") == F.col("_v"))).withColumn("item_id", F.col("member"))
    return _best(all_items)


def contaminated_classes(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """As ``contaminated``, with a row a document and class of items that no document can tell apart: item_id is the
    class's smallest, n_items its size. A benchmark of one template gives a row a document, not a row an item. Items of
    fewer than ``EVIDENCE`` tokens are no evidence and are not searched (see ``short_matches``)."""
    settings = dict(length=8, share=0.5, enough=6, min_words=4, broadcast_rows=1_000_000, least_tokens=EVIDENCE, most_tokens=None) | options
    agree, classes = _agreed(docs, benchmark, **settings)
    sizes = classes.groupBy(F.col("rep_id").alias("item_id"), F.col("rep_version").alias("version")).agg(F.countDistinct("item_id").alias("n_items"))
    return _best(agree.join(sizes, ["item_id", "version"]), "n_items")


def short_matches(docs: DataFrame, benchmark: DataFrame, least_tokens: int = EVIDENCE, **options: object) -> DataFrame:
    """The pairs of items too short to be evidence: a report of its own, on which nothing is dropped."""
    return contaminated_classes(docs, benchmark, least_tokens=1, most_tokens=least_tokens - 1, **options)


def _best(agree: DataFrame, *more: str) -> DataFrame:
    best = agree.groupBy("doc_id", "item_id").agg(F.max(F.struct("met", -F.col("k.kind"), -F.col("k.copy"), F.size("v").alias("n_slots"), "n_item", *more)).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.met").cast("long").alias("n_windows"), "best.n_item", "best.n_slots", *(f"best.{c}" for c in more))


def _agreed(docs: DataFrame, benchmark: DataFrame, length: int, share: float, enough: int, min_words: int, broadcast_rows: int, least_tokens: int, most_tokens: int | None) -> tuple[DataFrame, DataFrame]:
    """The copies whose slots agree, of the items that stand for their classes, and the classes."""
    enough_words = item_words(benchmark).filter("low = 0").filter((F.size("words") >= least_tokens) & (F.size("words") <= (most_tokens if most_tokens is not None else 1 << 30))).select("item_id", "version")
    windows = stage(benchmark_windows(benchmark, length, min_words).join(enough_words, ["item_id", "version"], "left_semi"), "benchmark-windows")
    lengths = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}  # at most ``length`` rows
    small = sum(lengths.values()) <= broadcast_rows
    held = F.broadcast if small else (lambda df: df)
    classes = stage(item_classes(benchmark, windows), "benchmark-classes")
    reps = classes.filter("item_id = rep_id AND version = rep_version").select("item_id", "version")
    side = stage(windows.join(reps, ["item_id", "version"], "left_semi"), "benchmark-sides")
    need = F.greatest(F.least(F.ceil(F.col("n_item") * share), F.lit(enough)), F.lit(1))
    texts = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("row"))
    words = parsed(texts, F.col("text")).select("doc_id", "row", "words")
    each = with_windows(words, sorted(lengths) or [length], min_words).select("doc_id", "row", F.inline_outer("at"))  # not inline: the filter Spark would infer from it repeats the whole expression
    # A text's windows meet the distinct templates; items come in by the rarest of their windows, positions last.
    templates = side.select(F.col("hash").alias("_h"), F.col("length").alias("_l")).distinct()
    places = each.join(held(templates), (F.col("hash") == F.col("_h")) & (F.col("len") == F.col("_l"))).select("doc_id", "row", "hash", F.col("len").alias("length"), "pos").distinct()
    places = stage(places, "windows-met")
    found = stage(places.select("doc_id", "row", "hash", "length").distinct(), "templates-met")
    maybe = found.join(held(_telling(side, need)), ["hash", "length"]).select("doc_id", "row", "item_id", "version").distinct()
    key = ["doc_id", "row", "item_id", "version"]
    whole = maybe.join(held(side), ["item_id", "version"]).join(found, ["doc_id", "row", "hash", "length"])
    pairs = whole.groupBy(*key).agg(F.countDistinct("item_pos").alias("n_windows"), F.first("n_item").alias("n_item")).filter(F.col("n_windows") >= need)
    pairs = stage(pairs, "pairs-met")
    met = pairs.select(*key).join(held(side), ["item_id", "version"]).join(places, ["doc_id", "row", "hash", "length"])
    met = met.select(*key, "low", "pos", "item_pos", F.col("length").alias("len"), "n_item").distinct()

    # Slots: only of documents and items that met, so their texts are few; counted before broadcasting.
    ids = pairs.select("doc_id", "row").distinct()
    few = ids.count() <= broadcast_rows
    read = texts.join(F.broadcast(ids) if few else ids, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    read = parsed(read, F.col("text")).select("doc_id", "row", F.col("words").alias("dw"))
    own = item_words(benchmark)
    items = own.filter("low = 0").select("item_id", "version", F.col("words").alias("bw")).join(own.filter("low = 1").select("item_id", "version", F.col("words").alias("lw")), ["item_id", "version"])
    # Each copy is judged by itself: windows of one alignment, windows of alignments closer than half an
    # item (a copy with words put in or left out), and all windows of the pair.
    own = met.join(pairs.select(*key), key).withColumn("align", (F.col("pos") - F.col("item_pos")).cast("long"))
    ordered = Window.partitionBy(*key).orderBy("align")
    apart = F.coalesce((F.col("align") - F.lag("align").over(ordered)) * 2 > F.col("n_item") + F.col("len"), F.lit(False))
    own = own.withColumn("apart", apart.cast("long")).withColumn("run", F.sum("apart").over(ordered))
    slots = own.groupBy(*key, "n_item").agg(F.collect_list(F.struct("pos", "item_pos", "len", "low", "align", "run")).alias("at"))
    slots = slots.join(read, ["doc_id", "row"]).join(items, ["item_id", "version"])

    def values(a: Column) -> Column:
        item = F.when(a["low"] == 0, F.slice("bw", a["item_pos"], a["len"])).otherwise(F.slice("lw", a["item_pos"], a["len"]))
        inside = F.zip_with(F.slice("dw", a["pos"], a["len"]), item, lambda d, b: F.struct(b.alias("b"), d.alias("d")))
        return F.filter(inside, lambda x: F.startswith(x["b"], F.lit(_OPEN)))

    # Texts stay behind here: a window goes on with its slots only.
    slots = slots.select(*key, "n_item", F.explode(F.transform("at", lambda a: F.struct(a["item_pos"].alias("item_pos"), a["align"].alias("align"), a["run"].alias("run"), values(a).alias("v")))).alias("a"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), g.alias("copy")) for k, g in enumerate((F.lit(0).cast("long"), F.col("a.run"), F.col("a.align")))))
    slots = slots.select(*key, "n_item", "a.item_pos", "a.v", F.explode(kinds).alias("k"))
    copies = slots.groupBy(*key, "k").agg(F.first("n_item").alias("n_item"), F.size(F.collect_set("item_pos")).alias("met"), F.array_distinct(F.flatten(F.collect_set("v"))).alias("v")).filter(F.col("met") >= need)
    # One to one: as many values on either side as there are pairs of them.
    one_way = F.size(F.array_distinct(F.transform("v", lambda x: x["b"])))
    other = F.size(F.array_distinct(F.transform("v", lambda x: x["d"])))
    agree = copies.filter((F.size("v") == one_way) & (F.size("v") == other))
    return agree, classes


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000, least_tokens: int = 1, **options: object) -> DataFrame:
    """``docs`` without the documents that hold an item of ``least_tokens`` tokens or more (a pipeline should ask for
    ``EVIDENCE``); rows with a null doc_id stay."""
    ids = stage(contaminated_classes(docs, benchmark, broadcast_rows=broadcast_rows, least_tokens=least_tokens, **options).select(F.col("doc_id").alias("_held")).distinct(), "held")
    few = ids.count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_held"), "left_anti")
