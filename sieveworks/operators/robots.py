"""robots.txt as rows: agent groups by gaps and islands, then the longest matching rule.

Wildcards are plain characters and a closing ``$`` is dropped; rules are prefixes of a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Agents that scrape, whose bans are reported by name.
SCRAPERS = ("gptbot", "ccbot", "claudebot", "google-extended", "bytespider", "amazonbot", "perplexitybot", "scrapy")


def directives(files: DataFrame) -> DataFrame:
    """``files``: id, robots. One row a directive: id, pos, key, value, grp; comments and blank lines are
    gone. Consecutive user-agent lines open one group, and the next rule ends the list of its agents."""
    lines = files.select("id", F.posexplode(F.split("robots", r"\r\n|\r|\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.withColumn("bare", bare).filter(F.instr("bare", ":") > 0)
    rows = rows.select("id", "pos", F.lower(F.trim(F.substring_index("bare", ":", 1))).alias("key"), F.trim(F.regexp_replace("bare", "^[^:]*:", "")).alias("value"))
    # Sitemaps and unknown directives belong to no group and don't close one.
    known = rows.filter(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("id").orderBy("pos")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    known = known.withColumn("grp", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return known.unionByName(rows.filter(F.col("key") == "sitemap").withColumn("grp", F.lit(None).cast("long")))


def rules_of(files: DataFrame, agent: str = "*") -> DataFrame:
    """The rules that hold for one agent: host (the file's id), kind, rule, pos, and value as written. They are what
    ``prefix_rules`` joins with paths."""
    d = directives(files)
    wanted = d.filter(F.col("key") == "user-agent").filter(F.lower("value") == agent.lower()).select("id", "grp").distinct()
    rules = d.filter(F.col("key").isin("allow", "disallow") & (F.col("value") != "")).join(wanted, ["id", "grp"], "left_semi")
    return rules.select(F.col("id").alias("host"), F.col("key").alias("kind"), F.regexp_replace("value", r"\$$", "").alias("rule"), "pos", "value")


def robots_facts(files: DataFrame, path: str = "/", agent: str = "*", tie: str = "allow") -> DataFrame:
    """id, allowed, matched_rule, crawl_delay, sitemaps, bans for one agent and path. Of equally long rules
    the allowing one wins, or the first with ``tie='file_order'``. An empty rule matches nothing."""
    d = directives(files)
    agents = d.filter("key = 'user-agent'").select("id", "grp", F.lower("value").alias("agent"))
    wanted = agents.filter(F.col("agent") == agent.lower()).select("id", "grp").distinct()
    rules = d.join(wanted, ["id", "grp"], "left_semi")
    prefix = F.regexp_replace("value", r"\$$", "")
    hit = rules.filter(F.col("key").isin("allow", "disallow") & (F.col("value") != "") & F.startswith(F.lit(path), prefix))
    first = F.when(F.col("key") == "allow", 0).otherwise(1) if tie == "allow" else F.lit(0)
    best = hit.groupBy("id").agg(F.min_by(F.struct("key", "value"), F.struct((-F.length(prefix)).alias("l"), first.alias("t"), "pos")).alias("best"))
    delay = rules.filter("key = 'crawl-delay'").groupBy("id").agg(F.min_by(F.col("value").try_cast("double"), "pos").alias("crawl_delay"))
    maps = d.filter("key = 'sitemap'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    banned = d.filter("key = 'disallow' and value = '/'").select("id", "grp").distinct().join(agents.filter(F.col("agent").isin(*SCRAPERS)), ["id", "grp"]).groupBy("id").agg(F.array_sort(F.collect_set("agent")).alias("bans"))
    out = files.select("id").join(best, "id", "left").join(delay, "id", "left").join(maps, "id", "left").join(banned, "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", (F.coalesce(F.col("best.key"), F.lit("allow")) == "allow").alias("allowed"), F.col("best.value").alias("matched_rule"), "crawl_delay", F.coalesce(F.col("s.value"), none).alias("sitemaps"), F.coalesce("bans", none).alias("bans"))
