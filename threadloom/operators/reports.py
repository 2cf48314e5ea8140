"""Totals of an archive: records, interactions, dates, sources, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Posts from which topics may be tried.
READY = 100


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """kind and n of each table, and of `all` of them."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in tables.items()]
    counted = reduce(DataFrame.unionAll, rows)
    return counted.unionAll(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("all").alias("kind"), "n"))


def every_kind(tables: dict[str, DataFrame]) -> DataFrame:
    """All records in one table with their type; columns that a kind lacks are null."""
    rows = [df.withColumn("type", F.lit(kind)) for kind, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def interaction_totals(posts: DataFrame, links: DataFrame, resources: DataFrame) -> DataFrame:
    """One row: quotes, attachments and links of posts, and the records of links and resources."""
    have = set(posts.columns)
    total = lambda c: F.coalesce(F.sum(F.col(c)) if c in have else F.lit(0), F.lit(0)).cast("long")
    post_links = F.coalesce(F.sum(F.coalesce(F.size("links"), F.lit(0))), F.lit(0)).cast("long") if "links" in have else F.lit(0).cast("long")
    made = posts.agg(total("quote_count").alias("total_quotes"), total("attachment_count").alias("total_attachments"), post_links.alias("post_links"))
    return made.join(F.broadcast(links.agg(F.count("*").alias("archive_links")))).join(F.broadcast(resources.agg(F.count("*").alias("archive_resources"))))


def date_range(times: DataFrame, epoch: Column) -> DataFrame:
    """One row: the first and last time in seconds; nulls for none."""
    return times.agg(F.min(epoch).alias("date_min"), F.max(epoch).alias("date_max"))


def records_per_page(requests: DataFrame, records: DataFrame) -> DataFrame:
    """requests (url and others) with records_added: how many records name the page as their source."""
    added = records.groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("records_added"))
    return requests.join(added, "url", "left").withColumn("records_added", F.coalesce("records_added", F.lit(0)))


def source_stats(posts: DataFrame, source: str, comments: Column) -> DataFrame:
    """source, posts, comments and the name of its file (null without posts)."""
    made = posts.groupBy(source).agg(F.count("*").alias("posts"), F.coalesce(F.sum(comments), F.lit(0)).cast("long").alias("comments"))
    name = F.concat(F.regexp_replace(F.coalesce(F.col(source), F.lit("")), r"[^\p{L}\p{N}_]", "_"), F.lit(".jsonl"))
    return made.withColumn("file", F.when(F.col("posts") > 0, name))


def readiness(posts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """posts, status and ready: whether there are posts to analyse, and enough for topics."""
    made = posts.groupBy(*(by or [])).agg(F.count("*").alias("posts"))
    status = F.when(F.col("posts") == 0, "blocked_for_post_topics").otherwise("ready_for_post_smoke_analysis")
    return made.select(*(by or []), "posts", status.alias("status"), (F.col("posts") >= READY).alias("ready"))


def stamp(when: Column) -> Column:
    """A time as a part of file names."""
    return F.date_format(when, "yyyy-MM-dd'T'HH-mm-ss")
