"""The training-data pipeline: language ID, near duplicates, repeated passages, mixture of sources, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, common, langid, mixing, neardup, suffixdedup

VOCABULARY = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, with that language; null and empty texts and those without a letter go. The model is learnt from the labelled documents.

    Without a labelled document none has a language, so none stays. Repeated rows stay repeated; other columns pass through.
    """
    found = langid.predict(docs, langid.fit(docs)).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a similarity of 0.8 or more on five-word shingles: that of the smallest id, a null id first. Texts without words, null ones among them, are one group; repeated rows are copies."""
    return neardup.without_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document (or place) has, and their new lengths. Every row stays; a text of nothing but repeats becomes empty, a null one stays null."""
    cut = suffixdedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or twice. Null sources are a source; rows of equal id, source and text are taken alike; an empty table stays empty."""
    key, copies, copy = (common.free_name(docs, x) for x in ("__key", "__copies", "__copy"))
    own = F.xxhash64("doc_id", "source", "text").alias(key)
    sized = docs.select(own, "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    chosen = mixing.mix(sized, columns=(key,)).where("copies > 0").groupBy(key).agg(F.max("copies").alias(copies))
    joined = docs.withColumn(key, own).join(chosen, key)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, the token ids and the text that they decode to, a row per row; a null or empty text has no ids and decodes to an empty one."""
    return bpe.encode_decode(docs, common.tokenizer_path(VOCABULARY), columns=("source", "lang"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", passages),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(to := common.folder(spark, f"stage{i}"))
        docs = spark.read.parquet(to)
    return STAGES[-1][1](spark, docs, sf_dir)
