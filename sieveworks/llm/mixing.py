"""Mixing sources to target weights by Sainte-Lague apportionment.

Word budgets of the sources are turned into blocks of equally many words. Blocks are dealt to sources
by the highest quotients v / (2 k - 1), those of a source to buckets of a thousand shards in the same
way, and those of a bucket to its shards, so every shard has an integer quota. In a shard, documents stand in a seeded order; its quota is taken as
whole passes over the shard plus one run of consecutive blocks that begins at a seeded block.

Everything is DataFrame expressions. Apart from the scan, work is on (doc_id, source, size) rows: one
aggregation by source, one by shard, and windows inside shards and buckets of bounded size. Of a whole
source only its buckets meet, one for 200 million words, so a source with a third of all rows is dealt
out over its shards. Sources themselves meet in one task: their number must be that of a table of names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *columns: Column) -> Column:
    """60 bits of md5 over the seed and the columns: alike in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sainte_lague(parties: DataFrame, votes: str, seats: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``quota``: how many of ``seats`` (the same in all rows of a group) each row gets by the
    highest quotients votes / (2 k - 1). Equal quotients go by ``order``.

    With P parties the divisor lies between V / (N + P / 2) and V / (N - P / 2), so only the seats
    between those two roundings are in doubt. They are about 3 P, however many seats there are.
    Without votes nobody gets a seat.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = parties.withColumns({"_v": F.sum(votes).over(whole), "_p": F.count(F.lit(1)).over(whole)})
    share = F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(F.lit(0.0))
    low = F.greatest(F.floor(share * (F.col(seats) - F.col("_p") / 2) - 0.5), F.lit(0)).cast("long")
    high = (F.ceil(share * (F.col(seats) + F.col("_p") / 2) + 0.5)).cast("long")
    sums = sums.withColumns({"_low": low, "_high": F.when(share > 0, F.greatest(high, low)).otherwise(low)})
    sums = sums.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    doubt = sums.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    best = whole.orderBy(F.desc_nulls_last(F.col(votes) / (2 * F.col("_k") - 1)), *(F.asc_nulls_last(c) for c in order), "_k")
    won = doubt.withColumn("_won", (F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_left"))).cast("long"))
    keep = [c for c in parties.columns]
    return won.groupBy(*keep, "_low").agg(F.sum("_won").alias("_more")).select(*keep, (F.col("_low") + F.col("_more")).alias("quota"))


def source_targets(totals: DataFrame, weights: Sequence[float], volume: float, most: float) -> DataFrame:
    """``totals``: source, source_size. Adds ``target``: ``volume`` times all words shared by weight,
    where no source is given over ``most`` times its words and the excess is shared again.

    In ascending order of most * size / weight, the sources that stop at their limit come first; the
    level at which the others share follows from running sums.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = totals.withColumn("_rank", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most))
    ordered = one.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    ranked = ranked.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_share": F.sum("_w").over(ordered.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("source_size").over(one) * float(volume),
        "_at": F.row_number().over(ordered),
    })
    ranked = ranked.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_share"))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_at", "_level"))
    ranked = ranked.withColumn("_level", F.min(fits).over(one)["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return ranked.select("source", "source_size", "_rank", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), volume: float = 1.5, most: float = 2.0, block: int = 8, shard_words: int = 200_000, seed: int = 17, bucket: int = 1_000, carry: Sequence[str] = ()) -> DataFrame:
    """Which part of each document the mix takes.

    Returns doc_id, size, source_size, target, taken, full (whole passes), part (words of one more,
    partial pass), pieces (where these words stand: array of first word from 0 and count, in order), and
    the columns named in ``carry``. Only doc_id, text and source are read besides.

    A null text has size 0 and takes 0. A null source is a source, the last one. Documents of size 0
    take 0. A very long text counts whole; its shard is as long. Repeated rows are rows of their own: each
    has its place in the shard's order. A null doc_id is a doc_id. An empty table gives an empty result.
    Reruns agree: all order is by md5 of the seed and doc_id, then size.
    """
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), *carry)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, volume, most)
    one = Window.partitionBy(F.lit(0))
    seats = targets.withColumn("_seats", F.round(F.sum("target").over(one) / block).cast("long"))
    quotas = sainte_lague(seats, "target", "_seats", [], ["_rank"]).withColumn("_shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))

    # Sources are few: their table is far below any broadcast limit, and Spark checks its size itself.
    dealt = sized.join(quotas.select(F.col("source").alias("_s"), "source_size", "target", F.col("quota").alias("_quota"), "_shards", "_rank"), F.col("source").eqNullSafe(F.col("_s")))
    dealt = dealt.withColumn("_key", seeded(seed, F.col("doc_id"))).withColumn("_shard", F.col("_key") % F.col("_shards"))

    shards = dealt.groupBy("_rank", "_shard").agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota")).withColumn("_bucket", F.floor(F.col("_shard") / bucket))
    buckets = shards.groupBy("_rank", "_bucket").agg(F.sum("_words").alias("_votes"), F.first("_quota").alias("_quota"))
    buckets = sainte_lague(buckets, "_votes", "_quota", ["_rank"], ["_bucket"]).select("_rank", "_bucket", F.col("quota").alias("_seats"))
    shards = shards.drop("_quota").join(buckets, ["_rank", "_bucket"])
    parts = sainte_lague(shards, "_words", "_seats", ["_rank", "_bucket"], ["_shard"]).withColumnRenamed("quota", "_mine")
    blocks = F.greatest(F.ceil(F.col("_words") / block), F.lit(1)).cast("long")
    parts = parts.select(F.col("_rank").alias("_r"), F.col("_shard").alias("_h"), "_words", "_mine", blocks.alias("_blocks"))
    parts = parts.withColumns({
        "_full": F.least(F.floor(F.col("_mine") / F.col("_blocks")), F.lit(int(most))).cast("long"),
        "_from": seeded(seed, F.col("_r"), F.col("_h")) % F.col("_blocks"),
    })
    parts = parts.withColumn("_run", F.when(F.col("_full") >= int(most), F.lit(0)).otherwise(F.col("_mine") % F.col("_blocks")).cast("long"))
    # The run of blocks as one or, past the end of the shard, two stretches of words.
    upto = F.col("_from") + F.col("_run")
    parts = parts.withColumns({
        "_a0": F.least(F.col("_from") * block, F.col("_words")), "_a1": F.least(upto * block, F.col("_words")),
        "_b1": F.least(F.greatest(upto - F.col("_blocks"), F.lit(0)) * block, F.col("_words")),
    })
    placed = dealt.join(parts, (F.col("_rank") == F.col("_r")) & (F.col("_shard") == F.col("_h")))
    line = Window.partitionBy("_r", "_h").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_end", F.sum("size").over(line)).withColumn("_start", F.col("_end") - F.col("size"))

    def common(lo: Column, hi: Column) -> Column:
        return F.greatest(F.least(F.col("_end"), hi) - F.greatest(F.col("_start"), lo), F.lit(0))

    def piece(lo: Column, hi: Column) -> Column:
        return F.struct((F.greatest(F.col("_start"), lo) - F.col("_start")).cast("long").alias("first"), common(lo, hi).cast("long").alias("count"))

    # The stretch at the shard's beginning stands before the other in a document that holds both.
    pieces = F.filter(F.array(piece(F.lit(0), F.col("_b1")), piece(F.col("_a0"), F.col("_a1"))), lambda x: x["count"] > 0)
    part = (common(F.col("_a0"), F.col("_a1")) + common(F.lit(0), F.col("_b1"))).cast("long")
    placed = placed.withColumns({"part": part, "pieces": pieces}).withColumnRenamed("_full", "full")
    taken = (F.col("full") * F.col("size") + F.col("part")).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "full", "part", "pieces", *carry)


def apply_mix(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` as the mix takes them: a document stands once for each whole pass, and once more, cut to the
    words that were drawn, for a partial pass. Columns are those of ``docs``, whatever their names; documents
    with taken 0 are gone. In a cut text, the drawn words are joined by one space, and n_chars, where
    there is one, is that of the cut text. Null texts and blank ones have nothing to take. Rows with a null
    doc_id and rows that repeat one are mixed as rows of their own: rows alike in doc_id, source and text
    share out what the mix takes of them. An empty table gives an empty result."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.select("row", "row.doc_id", "row.source", "row.text")
    keys = {"k1": F.xxhash64("doc_id", "source", "text"), "k2": F.hash(F.col("text").isNull(), "text", F.col("source").isNull(), "source", "doc_id")}
    row = row.withColumns(keys)
    alike = Window.partitionBy("k1", "k2")
    plan = mix(row.select("doc_id", "source", "text", "k1", "k2"), carry=("k1", "k2"), **options).select("k1", "k2", "taken", "full", "part", "pieces")
    plan = plan.withColumn("n2", F.row_number().over(alike.orderBy(F.desc("taken"), "pieces"))).filter("taken > 0").withColumnsRenamed({"k1": "p1", "k2": "p2"})
    rows = row.select("row", "k1", "k2", F.row_number().over(alike.orderBy(F.xxhash64("row"))).alias("n1"))
    # n1 and n2 are compared beside the join's keys, so that texts keep the partitioning of the window above.
    joined = rows.join(plan, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")) & (F.col("n1") - F.col("n2") == 0))
    times = F.concat(F.array_repeat(F.lit(False), F.col("full").cast("int")), F.when(F.col("part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = joined.select("row", "pieces", F.explode(times).alias("cut"))
    words = F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1))
    drawn = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["count"].cast("int")))), " ")
    text = F.when(F.col("cut"), drawn).otherwise(F.col("row.text"))
    rows = rows.select("row", text.alias("text"))
    changed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))
