"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Rank ranges on each of LEVELS levels: a source of 10**11 documents leaves about 6,000 to the exact window.
FANOUT = 256
LEVELS = 3
#: The greatest chance of inclusion that is left to the draw; documents beyond it come first in it.
CERTAIN = 1 - 1e-6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row per source: source, source_size, target, copies (whole, for all its documents), rest (words still wanted), chance (the rest's share of its words) and squares (the sum of its squared sizes).

    sizes: source, size. Sources stand in code-point order, null last, and take the weights in turn. A target stops
    at `most` times its source's size. The shares of those that stop go to the others by weight: with sources sorted
    by cap over weight, those that stop are a prefix, found with running sums. One row per source goes through the
    two windows, so their size is the number of sources.
    """
    wide = F.col("size").cast("decimal(19,0)")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((wide * wide).cast("decimal(38,0)")).cast("double").alias("squares"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cycle = F.array(*map(F.lit, weights))
    per = (
        per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", share * F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
    )
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") >= F.col("cap"))
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.least(final["level"] * F.col("weight"), F.col("cap").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        per.withColumn("target", target)
        .withColumn("copies", F.least(F.floor(rate), F.lit(most)).cast("long"))
        .withColumn("chance", rate - F.col("copies"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("source", "source_size", "target", "copies", "rest", "chance", "squares")
    )


def odds_of(size: Column, chance: Column, source_size: Column, squares: Column) -> Column:
    """A document's odds of inclusion in the rest: its chance is in proportion to its size, so that the words expected are those wanted."""
    own = F.least(F.when(squares > 0, chance * size * source_size / squares).otherwise(0.0), F.lit(CERTAIN))
    return own / (1 - own)


def rank(doc_id: Column, size: Column, odds: Column, seed: str = SEED) -> Column:
    """Pareto rank q = (u / (1 - u)) / odds as q / (1 + q), which keeps the order and lies between 0 and 1. u comes from the MD5 of id and size."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), size.cast("string"))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    q = (u / (1 - u)) / odds
    return q / (1 + q)


def mix(docs: DataFrame, id_col: str = "doc_id", size_col: str = "size", source_col: str = "source", seed: str = SEED, fanout: int = FANOUT, columns: tuple[str, ...] = (), **targets) -> DataFrame:
    """A row per row of docs: doc_id, source, size, source_size, target, taken (words) and copies, and the columns asked for.

    Every document of a source is taken floor(target / source size) times as a whole. The remaining words are drawn
    without replacement by Pareto order sampling: a document's odds of inclusion grow with its size, documents enter by
    ascending rank (random odds by inclusion odds) until the words taken come nearest to what is wanted, so a source's words
    miss its target by half a document at most. Reruns draw alike.
    Only documents that can be drawn are ranked: none of a source whose whole copies fill its target, and none without
    words. They are counted by rank range on LEVELS levels of `fanout` ranges each, and only the range in which the target
    falls is put in order, so no source is gathered in one task.
    Null ids and sources are values like others; null sizes count 0. Rows of equal id and size have equal ranks and are
    interchangeable; so many of them as are wanted are drawn. An empty table gives an empty result; other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), *columns)
    slim = checkpointed(slim)
    per = checkpointed(source_targets(slim, **targets))
    rows = slim.join(per.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = rows.withColumn("odds", F.when(F.col("rest") > 0, odds_of(F.col("size"), F.col("chance"), F.col("source_size"), F.col("squares"))).otherwise(0.0))
    rows = rows.withColumn("rank", F.when(F.col("odds") > 0, rank(F.col("doc_id"), F.col("size"), F.col("odds"), seed)))
    left = F.col("rank")
    for i in range(LEVELS):
        place = F.least(F.floor(left * fanout), F.lit(fanout - 1))
        rows = rows.withColumn(f"range{i}", place)
        left = left * fanout - F.col(f"range{i}")
    # by source, the range of each level in which the running sum first reaches what is wanted, and the words before it
    here, before = F.col("rank").isNotNull(), F.lit(0).cast("long")
    below = F.lit(False)
    for i in range(LEVELS):
        sums = rows.where(here).groupBy("source", "rest", before.alias("before"), F.col(f"range{i}").alias("edge")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("edge")
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(run)).where(F.col("upto") >= F.col("rest"))
        found = sums.groupBy("source").agg(F.min(F.struct("edge", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        found = checkpointed(found.select(F.col("source").alias("source_"), F.col("at.edge").alias(f"edge{i}"), F.col("at.before").alias(f"before{i}")))
        rows = rows.join(found, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
        below = below | (here & F.coalesce(F.col(f"range{i}") < F.col(f"edge{i}"), F.lit(True)))
        here, before = here & F.coalesce(F.col(f"range{i}") == F.col(f"edge{i}"), F.lit(False)), F.col(f"before{i}")
    out = ["doc_id", "source", "size", *columns, "source_size", "target", "copies"]
    settled = rows.where(~here).select(*out, below.alias("drawn"))
    run = Window.partitionBy("source", *(f"range{i}" for i in range(LEVELS))).orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    exact = rows.where(here).withColumn("upto", before + F.sum("size").over(run))
    exact = exact.select(*out, (F.col("upto") - F.col("size") / 2 <= F.col("rest")).alias("drawn"))
    taken = settled.unionAll(exact).withColumn("copies", F.col("copies") + F.col("drawn").cast("long"))
    return taken.select("doc_id", "source", "size", *columns, "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of every document. Null texts have no words; a null source is a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
named AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(size AS HUGEINT) * size) AS DOUBLE) AS squares, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sized GROUP BY source),
caps AS (SELECT *, 2 * source_size AS cap, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights FROM named),
levels AS (SELECT *, (total - coalesce(CAST(sum(cap) OVER before AS DOUBLE), 0)) / CAST(weights - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level FROM caps
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, CAST(cap AS DOUBLE) / weight) AS level FROM levels WHERE NOT level * weight >= cap),
targets AS (SELECT source, source_size, squares, CASE WHEN l.level * weight >= cap THEN CAST(cap AS DOUBLE) ELSE least(f.level * weight, CAST(cap AS DOUBLE)) END AS target FROM levels l LEFT JOIN final f ON true),
rates AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 2) AS copies, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
wanted AS (SELECT *, target - copies * source_size AS rest, rate - copies AS chance FROM rates),
drawn AS (SELECT d.doc_id, d.source, d.size, o.source_size, o.target, o.copies, o.rest,
    CASE WHEN rest > 0 AND squares > 0 THEN least(chance * d.size * o.source_size / squares, CAST('{certain}' AS DOUBLE)) ELSE 0 END AS p,
    (CAST(CAST(('0x' || substr(md5(concat_ws(':', 'mix', d.doc_id, d.size)), 1, 12)) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM sized d JOIN wanted o ON d.source IS NOT DISTINCT FROM o.source),
odds AS (SELECT *, p / (1 - p) AS odds FROM drawn),
qs AS (SELECT *, CASE WHEN odds > 0 THEN (u / (1 - u)) / odds END AS q FROM odds),
ranks AS (SELECT *, CASE WHEN odds > 0 THEN q / (1 + q) ELSE 1.0 END AS rank FROM qs),
runs AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranks),
mixed AS (SELECT *, CAST(copies + CASE WHEN rest > 0 AND odds > 0 AND CAST(upto AS DOUBLE) - size / 2.0 <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM runs)
"""
OP6_SQL = "WITH " + MIX_SQL.format(docs="documents", certain=repr(CERTAIN)) + "SELECT doc_id, size, source_size, target, size * n AS taken FROM mixed"
