"""Connected components by contraction: tasks join what they see, and only edges between the remaining roots go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed, trimmed


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1, the smallest node that the edges a, b lead to: labels sink along edges and pointers until nothing changes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, before[side], least)
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == before).all():
            return label


def coded(nodes: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each node's place among the different ones, and these. Arrow cannot tell structs apart, so their fields are taken one by one."""
    if not pa.types.is_struct(nodes.type):
        made = nodes.dictionary_encode()
        return made.indices.to_numpy(), made.dictionary
    codes = np.zeros(len(nodes), np.int64)
    for field in nodes.flatten():
        made = field.dictionary_encode(null_encoding="encode")
        _, first, codes = np.unique(codes * len(made.dictionary) + made.indices.to_numpy(), return_index=True, return_inverse=True)
    return codes, nodes.take(pa.array(first))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges (a, b, and the order of both), each node with its root: the node of the smallest order that these edges lead to."""
    parts = list(batches)
    if not parts or not sum(p.num_rows for p in parts):
        return
    table = pa.Table.from_batches(parts)
    codes, distinct = coded(pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks())
    order = np.concatenate([table.column("x").to_numpy(), table.column("y").to_numpy()])
    first = np.zeros(len(distinct), np.int64)
    first[codes] = order
    ranked = np.argsort(first, kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[ranked] = np.arange(len(distinct))
    half = len(codes) // 2
    roots = local_roots(place[codes[:half]], place[codes[half:]], len(distinct))
    up = pa.array(ranked[roots])
    own = pa.array(ranked)
    made = pa.RecordBatch.from_arrays([distinct.take(own), distinct.take(up), pa.array(first[ranked[roots]])], names=["node", "root", "z"])
    for i in range(0, made.num_rows, 1 << 16):
        yield made.slice(i, 1 << 16)


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node of the edges (a, b: of one type, which may be a struct of plain fields); nodes without edges have no row.

    In a round each task joins the edges it has, and sends every node once with the root it found. Where a node's roots
    differ, edges between them go on; a node that was no task's root is done, and keeps a pointer to one of its roots.
    The order that makes a root is a hash that changes with the round, so even of a path a constant share of nodes is done
    in each, and rounds are about the logarithm of the longest path. A hub is as many rows as there are tasks, not as it has
    edges. Pointers are then followed by doubling. A task holds the edges of its partition; each round ends in a
    checkpoint.
    """
    kind = dict(edges.dtypes)["a"]
    live = edges.where("a <> b").select("a", "b")
    pointers: list[DataFrame] = []
    rounds = 0
    while True:
        ranked = live.select("a", "b", F.xxhash64("a", F.lit(rounds)).alias("x"), F.xxhash64("b", F.lit(rounds)).alias("y"))
        seen = ranked.mapInArrow(trimmed(joined), f"node {kind}, root {kind}, z long")
        met = checkpointed(seen.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("z", "root"))).alias("roots")))
        least = F.col("roots")[0]["root"]
        done = ~F.exists("roots", lambda r: r["root"] == F.col("node"))
        pointers.append(met.where(done).select("node", least.alias("up")))
        live = met.where(F.size("roots") > 1).select(least.alias("b"), F.explode(F.slice("roots", 2, F.size("roots") - 1)).alias("r")).select(F.col("r.root").alias("a"), "b")
        rounds += 1
        if live.isEmpty():
            break
    ups = pointers[0]
    for more in pointers[1:]:
        ups = ups.unionAll(more)
    steps = 1
    while steps < rounds:
        ups = checkpointed(ups)
        further = ups.select(F.col("node").alias("up"), F.col("up").alias("top"))
        ups = ups.join(further, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        steps *= 2
    ups = checkpointed(ups)
    smallest = checkpointed(ups.groupBy("up").agg(F.min("node").alias("m")).select("up", F.least("up", "m").alias("root")))
    below = ups.join(smallest, "up").select("node", "root")
    return below.unionAll(smallest.select(F.col("up").alias("node"), "root"))
