"""robots.txt: parsing with DataFrame functions, and rule matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import robots_regex
from ..storage import stored

#: Fixed value: what announces a reservation of text and data mining.
RESERVATION = r"(?i)2019/790|article\s*4|text.and.data.mining|tdm|content-signal"


def directives(files: DataFrame) -> DataFrame:
    """site, line_no, key, value and star (whether the group is for all agents) of each line; comments and lines that are no directive are left out."""
    rows = files.select("site", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r?\n")).alias("line_no", "raw"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).where(F.col("line").rlike(r"^[A-Za-z-]+\s*:"))
    rows = rows.select("site", "line_no", F.lower(F.regexp_extract("line", r"^([A-Za-z-]+)", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[A-Za-z-]+\s*:\s*(.*)$", 1)).alias("value"))
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("site").orderBy("line_no"))
    return rows.withColumn("star", F.coalesce(agent == "*", F.lit(False)))


def summary(files: DataFrame) -> DataFrame:
    """site, disallow, allow, crawl_delay, sitemaps, signals (a map), tdm_reservation and restricts_ai_tdm of each file."""
    d = directives(files)
    own = lambda key: F.transform(F.array_sort(F.collect_list(F.when((F.col("key") == key) & F.col("star") & (F.col("value") != ""), F.struct("line_no", "value")))), lambda x: x["value"])
    pairs = d.where("key = 'content-signal'").select("site", "line_no", F.explode(F.split("value", ",")).alias("pair")).select("site", "line_no", F.lower(F.trim(F.split_part("pair", F.lit("="), F.lit(1)))).alias("k"), F.lower(F.trim(F.split_part("pair", F.lit("="), F.lit(2)))).alias("v"))
    signals = pairs.groupBy("site", "k").agg(F.max_by("v", "line_no").alias("v")).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("signals"))
    delay = F.max_by(F.expr("try_cast(value as double)"), F.when((F.col("key") == "crawl-delay") & F.col("star"), F.col("line_no")))
    sites = d.groupBy("site").agg(own("disallow").alias("disallow"), own("allow").alias("allow"), delay.alias("crawl_delay"), F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == "sitemap", F.struct("line_no", "value")))), lambda x: x["value"]).alias("sitemaps"))
    flags = files.select("site", F.coalesce(F.col("body"), F.lit("")).rlike(RESERVATION).alias("tdm_reservation"))
    signal = lambda k: F.coalesce(F.try_element_at("signals", F.lit(k)), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    joined = flags.join(sites, "site", "left").join(signals, "site", "left")
    made = joined.select("site", *(F.coalesce(c, none).alias(c) for c in ("disallow", "allow", "sitemaps")), "crawl_delay", "signals", "tdm_reservation")
    return made.withColumn("restricts_ai_tdm", (signal("ai-train") == "no") | (signal("ai-input") == "no") | (F.col("tdm_reservation") & (signal("ai-train") != "yes")))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (site, path) with allowed: unless the longest disallow pattern that matches is longer than the longest allow pattern of the site.

    The path is URL-decoded first; a broken escape stays as it is. rules (site, kind, pattern) are gathered by site, each of which has
    a few; a site without rules allows all. A site of many pages is a skewed join at worst, as the rules are written first.
    """
    pattern = F.struct("kind", F.length("pattern").alias("n"), robots_regex(F.col("pattern")).alias("regex"))
    held = stored(rules.groupBy("site").agg(F.collect_list(pattern).alias("rules")), "rules")
    path = F.coalesce(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.col("path"))

    def longest(kind: str) -> Column:
        hits = F.filter("rules", lambda r: (r["kind"] == kind) & F.rlike("__path", r["regex"]))
        return F.coalesce(F.array_max(F.transform(hits, lambda r: r["n"])), F.lit(-1))

    joined = urls.withColumn("__path", path).join(held, "site", "left")
    return joined.withColumn("allowed", F.coalesce(longest("disallow") <= longest("allow"), F.lit(True))).select(*urls.columns, "allowed")
