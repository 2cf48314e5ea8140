"""One document of each group of near duplicates: SimHash with Golay keys, widened to a Jaccard similarity of shingle sets.

At a similarity of 0.8, fingerprints of 64 bits differ by up to about 14 bits, which no keys of bounded number can bridge.
So the fingerprint of a document has further segments, each a hash of the shingles that come first under some orders of
all shingles (MinHash); documents that agree on a segment, or whose SimHash fingerprints link, are candidates, and the
shingle sets of candidates decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import checkpointed, forget, free_name, per_worker, released, slices
from .simhash import fingerprint, links, shingle_hashes
from .suffixdedup import row_id

SHINGLE = 5
SIMILARITY = 0.8
#: Segments and orders in each: documents of similarity s agree on a segment with probability s ** ORDERS.
SEGMENTS = 16
ORDERS = 4
#: Weight of a block of candidates that meets another in a tile: a document weighs 1, and 1 more for each 8 KB of its set.
TILE = 256
#: Shingles that a tile counts at a time.
COLUMNS = 4096


def orders(n: int = SEGMENTS * ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends, by rule."""
    made = np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(2 * n)], np.uint64)
    return made[:n] | np.uint64(1), made[n:]


def segments(hashes: np.ndarray) -> np.ndarray:
    """The segments of a set of shingle hashes; those of the empty set are all alike."""
    times, plus = per_worker("orders", orders)
    least = np.full(len(times), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[i : i + 2048, None] * times + plus).min(axis=0))
    least = least.reshape(SEGMENTS, ORDERS)
    out = np.arange(1, SEGMENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ORDERS):
        out = (out ^ least[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of 64-bit hashes."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def alike(side: np.ndarray, root: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of rows of different roots and a similarity of `least` or more, as many as it takes to join all such roots. Rows of side 0 meet those of side 1, or each other where there are none of side 1."""
    size = np.array([len(x) for x in sets])
    code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.cumsum(count > 1) - 1
    row, code = row[count[code] > 1], shared[code[count[code] > 1]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    both = np.zeros((len(a), len(b)))
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        i, j = np.searchsorted(code, [start, start + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[row[i:j], code[i:j] - start] = 1
        both += grid[a] @ grid[b].T
    every = size[a][:, None] + size[b] - both
    close = np.where(every > 0, both / np.maximum(every, 1), 1.0) >= least
    parent = {int(r): int(r) for r in root}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(close & (root[a][:, None] != root[b])), strict=True):
        x, y = find(int(root[a[i]])), find(int(root[b[j]]))
        if x != y:
            parent[x] = y
            out.append((int(a[i]), int(b[j])))
    return out


def further(spread: DataFrame, found: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The edges a, b that `found` lacks: those between candidates of a key (spread: rid, key) that found leaves in different components.

    A key's candidates are dealt into blocks by weight, and each two blocks meet in a tile, so a key of any frequency spreads over
    tasks. A component heavier than a block has blocks of its own, which do not meet each other. Every pair of a key whose ends
    are not joined yet is compared; keys of the same candidates count once, and up to three have met as ends.
    """
    roots = checkpointed(connected(found).select(F.col("node").alias("rid"), "root"))
    labelled = spread.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    parted = labelled.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("own"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y AND n > 3")
    keys = checkpointed(parted.groupBy("n", "own").agg(F.min("key").alias("key")).select("key"))
    weights = held.select("rid", (F.octet_length("set") / 8192 + 1).alias("weight"))
    members = checkpointed(labelled.join(keys, "key").join(weights, "rid"))
    sums = checkpointed(members.groupBy("key", "root").agg(F.sum("weight").alias("sum")))
    small = sums.where(F.col("sum") <= TILE).groupBy("key").agg(F.sum("sum").alias("rest"))
    heavy = F.col("sum") > TILE
    dealt = checkpointed(sums.join(small, "key", "left").select("key", "root", F.when(heavy, F.col("root")).alias("own"), F.ceil(F.when(heavy, F.col("sum")).otherwise(F.col("rest")) / TILE).alias("parts")))
    salt = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("root")).otherwise(F.col("rid"))), "parts")
    forget(spread.sparkSession)
    placed = checkpointed(members.join(dealt, ["key", "root"]).select("key", "rid", "root", "own", F.xxhash64("own", salt).alias("block")))
    blocks = checkpointed(placed.select("key", "own", "block").distinct())
    met = blocks.select("key", F.col("own").alias("own_a"), F.col("block").alias("a")).join(blocks.select("key", F.col("own").alias("own_b"), F.col("block").alias("b")), "key")
    met = met.where("a <= b AND (own_a IS NULL OR own_b IS NULL OR own_a <> own_b)")
    sides = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    tiles = checkpointed(met.select("key", F.xxhash64("key", "a", "b").alias("tile"), F.posexplode(sides).alias("side", "block")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        tile = None

        def done() -> pa.RecordBatch:
            pairs = alike(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[3] for r in rows], least)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][2] for i, _ in pairs], pa.int64()), pa.array([rows[j][2] for _, j in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for own, side, root, rid, held in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if rows and own != tile:
                    yield done()
                    rows = []
                tile = own
                rows.append((side, root, rid, np.frombuffer(held.as_py(), "<u8")))
        if rows:
            yield done()

    sent = placed.join(tiles, ["key", "block"]).select("tile", "side", "root", "rid").join(held, "rid").select("tile", "side", "root", "rid", "set")
    return sent.repartition("tile").sortWithinPartitions("tile").mapInArrow(released(compare), "a long, b long")


def edges(docs: DataFrame, sketches: DataFrame, least: float, shingle: int) -> DataFrame:
    """a and b: row ids of different shingle sequences whose sets are as similar as `least` or more.

    sketches: rid, fp and segments, a row for each different sequence. A segment's documents are first compared with the first and
    the last of them by row id: two for each segment and document at most, found by aggregation. Those that this leaves in
    different components are then compared with each other. Edges that join what is joined already may be missing.
    """
    spread = sketches.select("rid", F.explode(F.concat("segments", F.array(F.xxhash64("fp")))).alias("key"))
    ends = spread.groupBy("key").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).where("x < y")
    near = spread.join(ends, "key").select("rid", F.explode(F.array("x", "y")).alias("other"))
    prints = sketches.groupBy("fp").agg(F.min("rid").alias("rid"))
    linked = links(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), "rid"), "a").join(prints.select(F.col("fp").alias("b"), F.col("rid").alias("other")), "b").select("rid", "other")
    pairs = checkpointed(near.unionAll(linked).where("rid <> other").select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            own = [np.unique(shingle_hashes(t or "", shingle)).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["rid", "set"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keep = [similarity(x.as_buffer(), y.as_buffer()) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select("rid", "text").join(asked, "rid", "left_semi").dropDuplicates(["rid"])
    held = checkpointed(texts.mapInArrow(released(sets), "rid long, set binary"))
    both = pairs.join(held.select(F.col("rid").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("rid").alias("b"), F.col("set").alias("y")), "b")
    found = checkpointed(both.select("a", "b", "x", "y").mapInArrow(released(decide), "a long, b long"))
    forget(docs.sparkSession)
    # written, so that no task has a worker that compares and one that joins edges beside it
    more = checkpointed(further(spread, found, held, least))
    forget(docs.sparkSession)
    return found.unionAll(more)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, one of each group: the one of the smallest id (null first). Groups are what links of similarity `least` or more lead to; equal words in A-Z's lower case are the same text.

    Texts without words are one group. Repeated rows count as copies, too. Columns stay as they are.
    """
    keyed = docs.select(row_id(docs[id_col], docs[text_col]).alias("rid"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            same, prints, parts = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text or "", shingle)
                same.append(xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())))
                prints.append(fingerprint(hashes))
                parts.append(segments(hashes))
            lists = pa.ListArray.from_arrays(np.arange(0, len(parts) * SEGMENTS + 1, SEGMENTS, dtype=np.int32), np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], names=["rid", "doc_id", "same", "fp", "segments"])

    kind = dict(docs.dtypes)[id_col]
    rows = checkpointed(keyed.mapInArrow(released(sketch), f"rid long, doc_id {kind}, same binary, fp long, segments array<long>"))
    heads = rows.groupBy("same").agg(F.min(F.struct("doc_id", "rid")).alias("head"), F.count("*").alias("n"))
    nodes = checkpointed(rows.join(heads.select("same", "head", "n"), "same").where("rid = head.rid").dropDuplicates(["rid"]).select("rid", "doc_id", "fp", "segments"))
    forget(docs.sparkSession)
    roots = connected(edges(keyed, nodes, least, shingle))
    grouped = nodes.select("rid", "doc_id").join(roots.withColumnRenamed("node", "rid"), "rid")
    first = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("head")).select(F.col("head.rid").alias("rid"))
    beaten = grouped.select("rid").join(first, "rid", "left_anti")
    copies = rows.join(nodes.select("rid"), "rid", "left_anti").select("rid")
    again = rows.groupBy("rid").count().where("count > 1").select("rid")
    own = free_name(docs, "__rid")
    dropped = checkpointed(beaten.unionAll(copies).distinct().select(F.col("rid").alias(own)))
    repeated = checkpointed(again.select(F.col("rid").alias(own)).join(dropped, own, "left_anti"))
    marked = docs.withColumn(own, row_id(docs[id_col], docs[text_col]))
    once = marked.join(dropped, own, "left_anti").join(repeated, own, "left_anti")
    rest = marked.join(repeated, own, "left_semi").dropDuplicates([own])
    return once.unionAll(rest).drop(own)
