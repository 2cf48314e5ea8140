"""Descriptive aggregates: top terms, entropy, lengths, histograms, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import running


def top(df: DataFrame, key: Column, name: str, k: int, first: Column | None = None) -> DataFrame:
    """name and n of the k most frequent keys; ties by where a key first stands, if `first` says, else by key."""
    counted = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"), (F.min(first) if first is not None else F.min(key)).alias("tie"))
    return counted.orderBy(F.desc("n"), "tie", name).limit(k).drop("tie")


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term and n over all content terms."""
    return docs.select(F.explode(T.content_terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def lexical_baseline(counts: DataFrame) -> DataFrame:
    """One row: vocabulary, tokens and the entropy of terms in bits; the entropy of nothing is null."""
    # sum(n/t * log2(n/t)) = sum(n log2 n)/t - log2 t, in one pass
    one = counts.agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return one.select("vocabulary", "tokens", F.when(F.col("tokens") > 0, F.log2("tokens") - F.col("s") / F.col("tokens")).alias("entropy_bits"))


def lexicon_totals(docs: DataFrame, lexicons: dict[str, list[str]], by: list[str], text_col: str = "text") -> DataFrame:
    """by, lexicon and hits; zeros are rows too."""
    content = T.content_terms(F.col(text_col))
    hits = docs.select(*by, content.alias("content")).select(*by, *(T.lexicon_hits(F.col("content"), ws).alias(k) for k, ws in lexicons.items()))
    return hits.groupBy(*by).agg(*(F.sum(k).alias(k) for k in lexicons)).unpivot(by, list(lexicons), "lexicon", "hits")


def value_at(df: DataFrame, value: str, places: dict[str, str]) -> DataFrame:
    """One row: for each name, the value at a place in ascending order, given as SQL over n (how many there are), from 0. Values are counted first, so each is seen once, and summed by ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    summed = running(counts, ["v"], F.col("c"))
    run = summed.join(F.broadcast(summed.agg(F.max("upto").alias("n"))))
    return run.agg(*(F.min(F.when(F.col("upto") > F.expr(f"cast({at} as bigint)"), F.col("v"))).alias(k) for k, at in places.items()))


def length_stats(df: DataFrame, value: str) -> DataFrame:
    """min, upper median, nearest-rank median and 90th percentile, and max; nulls for no rows."""
    return value_at(df, value, {"min_length": "0", "upper_median": "floor(n / 2)", "median": "least(n - 1, floor((n - 1) * 0.5))", "p90": "least(n - 1, floor((n - 1) * 0.9))", "max_length": "n - 1"})


def per_month(df: DataFrame, iso: Column) -> DataFrame:
    return df.select(T.month(iso).alias("month")).where("month IS NOT NULL").groupBy("month").agg(F.count("*").alias("n"))


def status_histogram(requests: DataFrame, status: str = "status") -> DataFrame:
    return requests.groupBy(F.coalesce(F.col(status).cast("string"), F.lit("network_error")).alias("status")).agg(F.count("*").alias("n"))


def rates(df: DataFrame, **flags: Column) -> DataFrame:
    """One row: the share of rows for which each flag holds; a null flag counts as false; 0 for no rows."""
    return df.agg(*(F.coalesce(F.avg(F.when(flag, 1.0).otherwise(0.0)), F.lit(0.0)).alias(name) for name, flag in flags.items()))


def post_features(posts: DataFrame) -> DataFrame:
    """The 24 columns of an archive's feature index, from posts whose missing columns count as null. forum_id comes from the forum's URL where the forum has no id."""
    from ..functions import urls as U

    have = set(posts.columns)
    col = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind)
    text, kinds = col("body_text"), dict(posts.dtypes)
    forum = kinds.get("forum", "")
    forum_id = F.col("forum.id") if "id:" in forum else U.page_id(F.col("forum.url")) if "url:" in forum else col("forum_id")
    posted = F.col("posted_at.iso") if kinds.get("posted_at", "").startswith("struct") else col("posted_at")
    flag = lambda name: F.coalesce(col(name, "boolean"), F.lit(False))
    number = lambda name: F.coalesce(col(name, "long"), F.lit(0)).cast("long")
    ws = T.words(text)
    return posts.select(
        F.nullif(col("id").cast("string"), F.lit("")).alias("post_id"), col("thread_id").alias("thread_id"), col("thread_title").alias("thread_title"), forum_id.alias("forum_id"), col("author").alias("author"), posted.alias("posted_at"),
        T.utf16_length(text).alias("body_text_length"), T.utf16_length(col("body_html")).alias("body_html_length"),
        F.size(ws).cast("long").alias("word_count"), F.size(F.array_distinct(ws)).cast("long").alias("unique_word_count"),
        T.sentence_count(text).alias("sentence_count"), T.char_count(text, "?").alias("question_count"), T.char_count(text, "!").alias("exclamation_count"), T.url_count(text).alias("url_count"),
        number("quote_count").alias("quote_count"), number("attachment_count").alias("attachment_count"),
        (F.coalesce(F.size("links"), F.lit(0)) if "links" in have else F.lit(0)).cast("long").alias("link_count"), number("reactions_count").alias("reaction_count"),
        flag("has_reactions").alias("has_reactions"), T.is_blank(text).alias("empty_body"), flag("edited").alias("edited"), flag("deleted").alias("deleted"), flag("ignored").alias("ignored"), col("source_url").alias("source_url"),
    )


def document_features(posts: DataFrame, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """id, thread_id, tokens, unique_tokens, body_chars and counts; with a limit, the first rows in the order given."""
    have = set(posts.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    body = F.col("body_text")
    if limit is not None:
        posts = posts.orderBy(*(order or ["id"])).limit(limit)
    return posts.select(
        "id", col("thread_id", "string").alias("thread_id"), F.size(T.terms(body)).cast("long").alias("tokens"), F.size(F.array_distinct(T.content_terms(body))).cast("long").alias("unique_tokens"), T.body_length(col("body_text_length", "long"), body).alias("body_chars"),
        *(F.coalesce(col(c, "long"), F.lit(0)).cast("long").alias(c) for c in ("quote_count", "attachment_count", "link_count")),
    )
