"""Duplicates: keep-first merges, identity risks, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identity of each kind of record, by which snapshots are merged.
LINK_KEY = ("source_url", "post_id", "link_url", "resource_type")
PAGE_KEY = ("url", "kind")


def content_hash(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON with sorted keys; equal for equal rows."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def merge_key(df: DataFrame, kind: str) -> Column:
    """forums, threads and posts by id, or by content where it is null; links and resources, and pages, by several columns; all else by content."""
    if kind in ("forums", "threads", "posts"):
        return F.coalesce(F.col("id").cast("string"), content_hash(df))
    parts = LINK_KEY if kind in ("links", "resources") else PAGE_KEY if kind == "pages" else ()
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts)) if parts else content_hash(df)


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given. The least row is found by aggregation, which combines before the shuffle, so a hot key costs a row for each task."""
    kept = df.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(key))).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return kept.select("row.*")


def merge_snapshots(df: DataFrame, kind: str, order: list[str]) -> DataFrame:
    return keep_first(df, [merge_key(df.drop(*order), kind)], [F.col(c) for c in order])


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """One row: how many ids occur more than once; nulls do not count."""
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("k")).count().where("count > 1").agg(F.count("*").alias("duplicate_ids"))


def duplicate_risk(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows less different identities; a null identity is one."""
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).cast("long").alias("duplicate_risk"))


def not_yet(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in the progress table."""
    return df.join(done.select(on), on, "left_anti")


def priority(queue: DataFrame, kinds: tuple[str, ...] = ("index", "thread", "forum")) -> DataFrame:
    """A frontier in crawl order: by kind, first come first served."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return queue.orderBy(F.when(place == 0, len(kinds) + 1).otherwise(place), "seq")


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
