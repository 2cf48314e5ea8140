"""What a crawl may visit next: filters with reasons, caps, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Answers after which a request is tried again, besides those from 500 on.
RETRIED = (403, 408, 425, 429)
EXCLUDED_TITLE = "introductions"


def excluded_forum(url: Column, title: Column, excluded: list[str]) -> Column:
    """Whether a forum is left out by its id, its slug, slug and id, or its title."""
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1))
    slug, number = (F.regexp_extract(path, r"/forums/([^/]+)\.([0-9]+)/?", i) for i in (1, 2))
    names = F.array(slug, number, F.concat(slug, F.lit("."), number))
    by_name = (number != "") & F.arrays_overlap(names, F.array(*(F.lit(x) for x in excluded)).cast("array<string>"))
    return F.coalesce(by_name, F.lit(False)) | (F.lower(F.trim(F.coalesce(title, F.lit("")))) == EXCLUDED_TITLE)


def decided(found: DataFrame, visited: DataFrame, origin: str, excluded: list[str], allowed: Column) -> DataFrame:
    """found (seq, url, kind) with the canonical url and a decision: queued, or why not.

    In turn: no URL, another origin, an excluded forum, visited before, robots, and found before under the same canonical
    URL. allowed is a condition over found's columns. Of equal URLs the first by seq is queued.
    """
    rows = found.withColumn("canonical", F.coalesce(urls.canonical(F.col("url")), F.lit("")))
    seen = visited.select(F.col("url").alias("canonical")).distinct().withColumn("__seen", F.lit(True))
    rows = rows.join(seen, "canonical", "left")
    reason = (
        F.when(F.col("canonical") == "", "no_url")
        .when(~F.col("canonical").startswith(origin), "other_origin")
        .when((F.col("kind") == "forum") & excluded_forum(F.col("canonical"), F.lit(None).cast("string"), excluded), "excluded_forum")
        .when(F.coalesce("__seen", F.lit(False)), "visited")
        .when(~allowed, "robots")
    )
    rows = rows.withColumn("reason", reason).drop("__seen")
    first = rows.where("reason IS NULL").groupBy("canonical").agg(F.min("seq").alias("__first"))
    decision = F.coalesce("reason", F.when(F.col("seq") == F.col("__first"), "queued").otherwise("queued_before"))
    return rows.join(first, "canonical", "left").select(*found.columns, "canonical", decision.alias("decision"))


def capped(pages: DataFrame, by: str, order: str, most: int | None) -> DataFrame:
    """The first pages of each key; all of them where `most` is none or 0."""
    if not most:
        return pages
    return pages.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__rn") <= most).drop("__rn")


def threads_to_read(threads: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """Threads that are no redirects, the first `most` of them in order."""
    real = threads.where(~F.coalesce(F.col("redirect"), F.lit(False))).orderBy(*order)
    return real.limit(most) if most else real


def forums_asked(forums: DataFrame, ids: list[str], addresses: list[str]) -> DataFrame:
    """Forums by id or URL; all of them where nothing is asked for."""
    return forums.where(F.col("id").isin(ids) | F.col("url").isin(addresses)) if ids or addresses else forums


def retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRIED) | (status >= 500), F.lit(False))


def tail(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The last rows, as a progress table keeps them."""
    return rows.orderBy(F.desc(order)).limit(most)
