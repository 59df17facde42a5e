"""Connected components of a link table, by rounds of Spark jobs.

Large-star and small-star: in every round a node's larger neighbours are linked to its smallest
neighbour, then its smaller ones to their smallest. Links only ever get replaced, never multiplied, and
the number of rounds grows with the logarithm of the longest path. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_path, write_table


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links``: a, b (long). Returns node, component (smallest node reachable) for every node that has a
    link to another; links of a node to itself and null ends are ignored."""
    spark = links.sparkSession
    path = write_table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    edges = spark.read.schema("u long, v long").parquet(path)
    before = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    for _ in range(most_rounds if before["n"] else 1):
        large = _star(edges, larger=True)
        small = _star(large, larger=False)
        new_path = write_table(small, "links")
        drop_path(spark, path)
        path, edges = new_path, spark.read.schema("u long, v long").parquet(new_path)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges: u > v. One star operation; the smallest neighbour of each node is an aggregate, so a node
    with very many neighbours is not gathered."""
    if larger:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("c"))
    joined = both.join(least, "n")
    if larger:
        joined = joined.filter("m > n")
        return joined.select(F.col("m").alias("u"), F.col("c").alias("v")).filter("u <> v").distinct()
    own = joined.select(F.col("m").alias("u"), F.col("c").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("c").alias("v")))
    return own.filter("u <> v").distinct()
