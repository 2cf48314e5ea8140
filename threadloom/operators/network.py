"""Interaction networks: edges, degrees, co-occurrence, PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed, shared_folder, stored
from .components import connected

#: Items of a block whose pairs are made in one row.
BLOCK = 512


def reply_edges(turns: DataFrame, thread: str, order: str, author: str) -> DataFrame:
    """source, target and weight: how often an author's turn follows another's in a thread."""
    before = F.lag(author).over(Window.partitionBy(thread).orderBy(order))
    pairs = turns.select(F.col(author).alias("source"), before.alias("target")).where("target IS NOT NULL")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def quote_edges(posts: DataFrame) -> DataFrame:
    """source, target and weight: how often an author quotes another, from posts with quotes (a list with authors). Authors who quote themselves have no edge."""
    said = posts.where(F.col("author").isNotNull()).select(F.col("author").alias("source"), F.explode("quotes.author").alias("target"))
    return said.where("target IS NOT NULL AND source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def participation_edges(turns: DataFrame, thread: str, author: str) -> DataFrame:
    """source < target and weight: in how many threads two authors both write."""
    once = turns.where(F.col(author).isNotNull()).select(thread, author).distinct()
    return pairs_within(once, thread, author).groupBy("source", "target").agg(F.count("*").alias("weight"))


def pairs_within(once: DataFrame, by: str, item: str) -> DataFrame:
    """by, source and target: each two different items of a key, smaller first. Rows of once are distinct.

    A key's items are dealt into blocks of about BLOCK, and each two blocks of a key meet, so no row holds more than two
    blocks, and a crowd spreads over tasks: it has as many rows as pairs of blocks. The number of pairs is the square of the
    crowd all the same; leave keys out beforehand that are too large to mean anything.
    """
    sizes = once.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).alias("__parts"))
    dealt = once.join(sizes, by).withColumn("__block", F.pmod(F.xxhash64(item), "__parts"))
    blocks = stored(dealt.groupBy(by, "__block").agg(F.sort_array(F.collect_list(item)).alias("__items")), "blocks")
    left = blocks.select(by, F.col("__block").alias("__x"), F.col("__items").alias("__a"))
    right = blocks.select(by, F.col("__block").alias("__y"), F.col("__items").alias("__b"))
    met = left.join(right, by).where("__x <= __y").select(by, F.explode("__a").alias("__one"), (F.col("__x") == F.col("__y")).alias("__same"), "__b")
    ends = met.select(by, "__one", F.explode(F.filter("__b", lambda y: ~F.col("__same") | (y > F.col("__one")))).alias("__two"))
    return ends.select(by, F.least("__one", "__two").alias("source"), F.greatest("__one", "__two").alias("target"))


def pairs_of(df: DataFrame, items: Column) -> DataFrame:
    """Each two different items of a row's sorted array, smaller first; for arrays of a small bound."""
    after = lambda i: F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0)))
    made = F.flatten(F.transform(items, lambda a, i: F.transform(after(i), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return df.select(F.inline(made))


def cooccurrence(items: DataFrame, doc: str, item: str, least_count: int = 3, least_jaccard: float = 0.05) -> DataFrame:
    """source < target, both, and jaccard of items that stand in the same documents. Items of fewer than least_count documents take no part."""
    once = items.select(doc, item).distinct()
    sizes = once.groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    both = pairs_within(once.join(sizes.select(item), item), doc, item).groupBy("source", "target").agg(F.count("*").alias("both"))
    named = lambda side: sizes.select(F.col(item).alias(side), F.col("n").alias(f"n_{side}"))
    scored = both.join(named("source"), "source").join(named("target"), "target")
    jaccard = F.col("both") / (F.col("n_source") + F.col("n_target") - F.col("both"))
    return scored.withColumn("jaccard", jaccard).where(F.col("jaccard") >= least_jaccard).select("source", "target", "both", "jaccard")


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, weighted_in and weighted_out."""
    ends = edges.select(F.inline(F.array(*(F.struct(F.col(n).alias("node"), F.lit(i).alias("i"), F.lit(1 - i).alias("o"), F.col("weight").alias("w")) for n, i in (("source", 0), ("target", 1))))))
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"), F.sum(F.col("i") * F.col("w")).alias("weighted_in"), F.sum(F.col("o") * F.col("w")).alias("weighted_out"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node and rank after so many rounds; weights count, and the rank of nodes without outgoing edges spreads evenly. A round uses the ranks before it twice, so each ends in a checkpoint."""
    shared_folder(edges.sparkSession)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().checkpoint()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    total = Window.partitionBy("source")
    shares = edges.select("source", "target", (F.col("weight") / F.sum("weight").over(total)).alias("share")).checkpoint()
    dead = nodes.join(shares.select(F.col("source").alias("node")).distinct(), "node", "left_anti").checkpoint()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = ranks.join(dead, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        sent = shares.join(ranks, shares["source"] == ranks["node"]).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(sent, "node", "left").join(F.broadcast(lost)).select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")).checkpoint()
    return ranks


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """a < b: the undirected edges without loops, once each."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles and clustering of each node. An edge goes to its end of smaller degree, so that no node pairs more than about the root of all edges."""
    pairs = neighbourhoods(edges)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    named = lambda side: degree.select(F.col("node").alias(side), F.col("degree").alias(f"d{side}"))
    sized = pairs.join(named("a"), "a").join(named("b"), "b")
    low = F.struct("da", "a") < F.struct("db", "b")
    out = sized.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    corners = pairs_within(out, "u", "v").select("u", F.col("source").alias("a"), F.col("target").alias("b"))
    closed = corners.join(pairs, ["a", "b"])
    per = closed.select(F.explode(F.array("u", "a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    made = degree.join(per, "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))
    return made.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def assortativity(edges: DataFrame) -> DataFrame:
    """One row: edges, and the correlation of the degrees at their ends."""
    pairs = neighbourhoods(edges)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    named = lambda side: degree.select(F.col("node").alias(side), F.col("degree").alias(f"d{side}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    ways = both.select(F.inline(F.array(F.struct(F.col("da").alias("x"), F.col("db").alias("y")), F.struct(F.col("db").alias("x"), F.col("da").alias("y")))))
    return ways.agg((F.count("*") / 2).cast("long").alias("edges"), F.corr("x", "y").alias("assortativity"))


def unanswered(turns: DataFrame, thread: str, order: str) -> DataFrame:
    """The last turn of each thread: what nothing follows."""
    last = turns.groupBy(thread).agg(F.max(order).alias(order))
    return turns.join(last, [thread, order], "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """component (its smallest node), nodes and edges of each connected component, directions aside."""
    pairs = neighbourhoods(edges)
    roots = checkpointed(connected(pairs))
    nodes = roots.groupBy("root").agg(F.count("*").alias("nodes"))
    inside = pairs.join(roots, pairs["a"] == roots["node"]).groupBy("root").agg(F.count("*").alias("edges"))
    return nodes.join(inside, "root").select(F.col("root").alias("component"), "nodes", "edges")


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node and centrality after so many rounds of power iteration over the undirected graph, of length 1. Each round ends in a checkpoint."""
    pairs = neighbourhoods(edges)
    both = checkpointed(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = both.select(F.col("a").alias("node")).distinct().withColumn("centrality", F.lit(1.0))
    for _ in range(rounds):
        # a node keeps its own share, so that graphs of two sides settle too
        got = both.join(now, both["b"] == now["node"]).groupBy(F.col("a").alias("node")).agg(F.sum("centrality").alias("got"))
        raw = checkpointed(now.join(got, "node").select("node", (F.col("centrality") + F.col("got")).alias("centrality")))
        length = raw.agg(F.sqrt(F.sum(F.col("centrality") * F.col("centrality"))).alias("length"))
        now = checkpointed(raw.join(F.broadcast(length)).select("node", (F.col("centrality") / F.col("length")).alias("centrality")))
    return now


def power_law(degrees_: DataFrame, degree: str = "degree", least: int = 1) -> DataFrame:
    """One row: nodes of at least the least degree, and the exponent that fits their degrees best (maximum likelihood, whole numbers)."""
    made = degrees_.where(F.col(degree) >= least).agg(F.count("*").alias("nodes"), F.sum(F.log(F.col(degree) / (least - 0.5))).alias("s"))
    return made.select("nodes", F.when(F.col("s") > 0, 1 + F.col("nodes") / F.col("s")).alias("gamma"))
