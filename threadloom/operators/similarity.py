"""Pairs of similar documents by exact Jaccard similarity of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

WORDS = 5
SIMILARITY = 0.8


def shingles(text: Column, size: int = WORDS) -> Column:
    """The set of 64-bit hashes of runs of `size` words in lower case; of all words, if they are fewer."""
    ws = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # shifted copies side by side: each is made once for a row, where a slice inside a lambda would be made for each run
    n = F.size(ws) - size + 1
    shifted = F.arrays_zip(*(F.slice(ws, i + 1, F.greatest(n, F.lit(0))) for i in range(size)))
    runs = F.transform(shifted, lambda s: F.xxhash64(F.concat_ws(" ", *(s[str(i)] for i in range(size)))))
    return F.array_distinct(F.when(n > 0, runs).otherwise(F.array(F.xxhash64(F.array_join(ws, " ")))))


def jaccard_pairs(docs: DataFrame, id_col: str, text_col: str, least: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """a < b, jaccard of different texts as similar as `least`. Copies of a text stand for one, under the smallest id.

    Sets that similar share one of their first n - ceil(least * n) + 1 shingles in any common order; with the rarest first,
    a common passage seldom stands among these. Candidates of a shingle meet by a join, then their whole sets are compared.
    """
    once = docs.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("t")).agg(F.min(id_col).alias("id"))
    sets = stored(once.select("id", shingles(F.col("t"), size).alias("s")), "sets")
    flat = sets.select("id", F.explode("s").alias("h"))
    counted = flat.join(flat.groupBy("h").agg(F.count("*").alias("n")), "h")
    ordered = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("o"))
    first = F.size("o") - F.ceil(F.size("o") * least).cast("int") + 1
    prefix = ordered.select("id", F.size("o").alias("size"), F.posexplode(F.slice("o", 1, first)).alias("at", "x")).where("x.n > 1")
    prefix = stored(prefix.select("id", "size", "at", F.col("x.h").alias("h")), "prefixes")
    x, y = (prefix.select(F.col("id").alias(i), F.col("size").alias(f"n{i}"), F.col("at").alias(f"at{i}"), "h") for i in "ab")
    # what two sets can still have in common from their places on must reach the share of both that is asked for
    rest = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    enough = (F.least("na", "nb") >= least * F.greatest("na", "nb")) & ((1 + least) * rest >= least * (F.col("na") + F.col("nb")) - 1e-6)
    pairs = x.join(y, "h").where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")).where(F.col("jaccard") >= least)
