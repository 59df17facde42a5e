"""Rules that are prefixes of paths, as an equi-join.

A path is exploded to its prefixes of the lengths that rules have, and those meet the rules under host and prefix, so
the work is one row a path and length, however many rules there are. Candidates of a path come from one row, so they
are combined before they are exchanged. A rule table of up to ``most`` rows is broadcast, after it is counted; beyond
that each host's rules are spread over parts of a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup

MOST_RULES = 500_000


def matches(paths: DataFrame, rules: DataFrame, key: str, most: int = MOST_RULES) -> DataFrame:
    """``paths``: key, host, path. ``rules``: host, rule, and columns of their own. All pairs where the rule is a
    prefix of the path of its host: key, and the rule's columns. Empty and null rules match nothing, nor do null hosts
    and paths. The distinct lengths of rules, never more than the longest rule has characters, go to the driver."""
    rules = rules.filter((F.col("rule") != "") & F.col("host").isNotNull())
    sizes = sorted(r.n for r in rules.select(F.length("rule").alias("n")).distinct().collect())
    lengths = F.array(*(F.lit(n) for n in sizes)).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    probes = paths.select(key, "host", F.explode(prefixes).alias("rule"))
    return lookup(probes, rules, ["host", "rule"], F.col(key), most).drop("host")


def longest(paths: DataFrame, rules: DataFrame, key: str, tie: str = "allow", most: int = MOST_RULES) -> DataFrame:
    """``rules``: host, kind, rule, pos. The longest rule that is a prefix of each path: key, kind, rule, pos; paths
    that none matches have no row. Of equally long rules the allowing one wins, then the first in the file; with
    ``tie='file_order'`` the first in the file."""
    if tie not in ("allow", "file_order"):
        raise ValueError("tie is allow or file_order")
    first = F.when(F.col("kind") == "allow", 0).otherwise(1) if tie == "allow" else F.lit(0)
    order = F.struct((-F.length("rule")).alias("l"), first.alias("t"), "pos")
    best = F.min_by(F.struct("kind", "rule", "pos"), order).alias("best")
    return matches(paths, rules, key, most).groupBy(key).agg(best).select(key, "best.*")


def allowed(paths: DataFrame, rules: DataFrame, key: str, tie: str = "allow", most: int = MOST_RULES) -> DataFrame:
    """Every path: key, allowed, matched_rule. What no rule matches is allowed."""
    best = longest(paths, rules, key, tie, most)
    out = paths.select(key).join(best, key, "left")
    return out.select(key, (F.coalesce(F.col("kind"), F.lit("allow")) == "allow").alias("allowed"), F.col("rule").alias("matched_rule"))


def path_of(url: Column | str) -> Column:
    """The path of an absolute URL, without query and fragment."""
    return F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
