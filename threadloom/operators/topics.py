"""Topic baselines by pyspark.ml, and measures of topics."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored


def vectors(docs: DataFrame, text_col: str = "text", size: int = 5000, least_docs: int = 2):
    """docs without the text but with its count vector, written once, as later fits read it many times, and the model that made it; the vocabulary is bounded."""
    rows = docs.select("*", T.content_terms(F.col(text_col)).alias("terms")).where(F.size("terms") > 0)
    rows = stored(rows.drop(text_col) if text_col != "terms" else rows, "terms")
    model = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=size, minDF=least_docs).fit(rows)
    return stored(model.transform(rows).drop("terms"), "counts"), model


def lda_topics(docs: DataFrame, k: int = 10, rounds: int = 10, top: int = 10, seed: int = 1, size: int = 5000) -> DataFrame:
    """topic, place, term and weight of each topic's first terms."""
    rows, model = vectors(docs, size=size)
    found = LDA(k=k, maxIter=rounds, seed=seed, featuresCol="counts", optimizer="online").fit(rows).describeTopics(top)
    names = F.array(*map(F.lit, model.vocabulary))
    return found.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "x")).select("topic", "place", F.element_at(names, F.col("x.termIndices") + 1).alias("term"), F.col("x.termWeights").alias("weight"))


def kmeans_topics(docs: DataFrame, id_col: str, k: int = 20, seed: int = 1, size: int = 2000) -> DataFrame:
    """id and cluster of each document with terms, by TF-IDF."""
    rows, _ = vectors(docs, size=size)
    scored = stored(IDF(inputCol="counts", outputCol="features").fit(rows).transform(rows).select(id_col, "features"), "tfidf")
    return KMeans(k=k, seed=seed, maxIter=10).fit(scored).transform(scored).select(id_col, F.col("prediction").alias("cluster"))


def diversity(topics: DataFrame, topic: str = "topic", term: str = "term") -> DataFrame:
    """One row: the share of different terms among all topics' first terms."""
    return topics.agg((F.count_distinct(term) / F.count(term)).alias("diversity"))
