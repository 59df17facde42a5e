"""Lines, blocks of lines, and the blank columns of a block.

Lines end at LF, CR LF or CR; a form feed stands for a blank line. A block is a run of lines that are not blank. Which columns of a block are
blank is found without padding or gathering its lines: each line gives bitmaps of its solid columns, 64 columns to a
word, the words of a block are combined by ``bit_or``, and runs are islands of the columns that no line fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_LINES, LEAST_GAP, _WORD = 3, 2, 64


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), line, blank; null texts have none."""
    rows = texts.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\f"), F.lit("\n\n")), r"\r\n|[\r\n]")).alias("pos", "line"))
    return rows.withColumn("blank", F.regexp_like("line", F.lit(r"\A[ \t\x0B]*\z")))


def text_blocks(lines: DataFrame, key: str, least: int = LEAST_LINES) -> DataFrame:
    """The lines of blocks of at least ``least`` lines: key, block (the number of the block's first line), pos, line.
    A line's block is its number less the blank lines' count before it; both windows are of one text."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begun = lines.withColumn("_after", F.coalesce(F.max(F.when(F.col("blank"), F.col("pos"))).over(order), F.lit(-1)))
    rows = begun.filter(~F.col("blank")).withColumn("block", F.col("_after") + 1)
    size = F.count(F.lit(1)).over(Window.partitionBy(key, "block"))
    return rows.withColumn("_n", size).filter(F.col("_n") >= least).select(key, "block", "pos", "line")


def column_gaps(blocks: DataFrame, key: str, least: int = LEAST_GAP) -> DataFrame:
    """Runs of at least ``least`` columns that are blank in every line of a block: key, block, start, stop (exclusive),
    width. Only spaces are blank; columns past a line's end are blank, the block is as wide as its longest line. Runs
    at the margins are given too: those with start = 0 or stop = width."""
    last = F.floor((F.length("line") - 1) / _WORD).cast("int")
    words = F.transform(F.sequence(F.lit(0), last), lambda w: F.struct(w.alias("word"), F.substring(F.col("line"), w * _WORD + 1, F.lit(_WORD)).alias("part")))
    parts = blocks.filter(F.length("line") > 0).select(key, "block", F.length("line").alias("n"), F.inline(words))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    bit = lambda k: F.when(F.substring(F.col("part"), k, F.lit(1)) != " ", F.call_function("shiftleft", one, k - 1)).otherwise(none)
    solid = F.aggregate(F.sequence(F.lit(1), F.length("part")), none, lambda bits, k: bits.bitwiseOR(bit(k)))
    maps = parts.withColumn("bits", solid).groupBy(key, "block", "word").agg(F.bit_or("bits").alias("bits"), F.max("n").alias("n"))
    width = F.max("n").over(Window.partitionBy(key, "block"))
    clear = lambda k: (F.call_function("shiftright", F.col("bits"), k).bitwiseAND(one) == 0) & (F.col("word") * _WORD + k < F.col("width"))
    blank = F.transform(F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), clear), lambda k: F.col("word") * _WORD + k)
    columns = maps.withColumn("width", width).select(key, "block", "width", F.explode(blank).alias("at"))
    island = columns.withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy(key, "block").orderBy("at")))
    runs = island.groupBy(key, "block", "island").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop"), F.max("width").alias("width"))
    return runs.filter(F.col("stop") - F.col("start") >= least).select(key, "block", "start", "stop", "width")
