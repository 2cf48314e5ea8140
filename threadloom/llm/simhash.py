"""Near duplicates by SimHash fingerprints, found through Golay codewords.

The binary Golay code of length 23 is perfect: every word lies within three bits of exactly one codeword. The keys of a
segment are the codewords nearest to it and to each of its 23 neighbours (one or six of them). Two segments that differ
in one or two bits have a word between them that is a neighbour of both (or is one of them), so they share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import checkpointed, released, slices, table

SHINGLE = 3
SEED = 42
#: Differing bits up to which fingerprints link; the keys below are made for two.
BITS = 2
#: The segments of a fingerprint: first bit and length.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the Golay code, without its highest term (a fixed value).
GENERATOR = 0b10001110101 | 1 << 11
#: Runs of a key up to this length are compared pair by pair; longer ones meet at the words between them.
PAIRWISE = 64


def remainders() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each single bit of a 23-bit word by the generator, and for each remainder the error of at most three bits that leaves it."""
    columns = np.zeros(23, np.int64)
    for i in range(23):
        word = 1 << i
        for j in range(22, 10, -1):
            if word >> j & 1:
                word ^= GENERATOR << j - 11
        columns[i] = word
    errors = np.zeros(2048, np.int64)
    bits = range(23)
    for chosen in ([(i,) for i in bits], [(i, j) for i in bits for j in range(i)], [(i, j, k) for i in bits for j in range(i) for k in range(j)]):
        for places in chosen:
            left = 0
            for i in places:
                left ^= int(columns[i])
            errors[left] = sum(1 << i for i in places)
    return columns, errors


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the 12-bit indices of the codewords nearest to it and to its 23 neighbours; repeats are -1."""
    columns, errors = remainders()
    left = np.zeros(len(words), np.int64)
    for i in range(23):
        left ^= np.where(words >> i & 1, columns[i], 0)
    flips = np.concatenate([[0], 1 << np.arange(23)])
    near = words[:, None] ^ flips
    found = np.sort((near ^ errors[left[:, None] ^ np.concatenate([[0], columns])]) >> 11, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints (repeated) and their keys.

    Of three segments with two errors or fewer in all, one has none. It stands whole in the key, beside a Golay key of
    the next segment, in which there are two errors at most.
    """
    parts = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    owners, keys = [], []
    for i in range(len(parts)):
        codes = golay_keys(parts[(i + 1) % len(parts)])
        rows, columns = np.nonzero(codes >= 0)
        owners.append(prints[rows])
        keys.append(i << 34 | parts[i][rows] << 12 | codes[rows, columns])
    return np.concatenate(owners), np.concatenate(keys)


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the text's shingles of words, A-Z in lower case; of all its words, if they are fewer; of nothing, if there are none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    n, digest = max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[starts[i] : ends[min(i + size, len(words)) - 1]], seed) for i in range(n)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half the hashes have it."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits) of each row. Null texts and texts without a word have the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [fingerprint(shingle_hashes(t or "", shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(released(run), "doc_id long, fp long")


def between(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join exactly the components of the links within one run: prints that share a word one bit away or less are two bits apart at most."""
    near = prints[:, None] ^ np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    owners, near = np.repeat(prints, 65), near.reshape(-1)
    order = np.lexsort((owners, near))
    owners, near = owners[order], near[order]
    first = owners[np.searchsorted(near, near)]
    apart = owners != first
    return owners[apart], first[apart]


def links(prints: DataFrame) -> DataFrame:
    """a and b: pairs of different fingerprints (fp, distinct) that differ in BITS or fewer.

    Fingerprints are sent by key and sorted. Short runs of a key are compared pair by pair; in runs of more than PAIRWISE,
    fingerprints are linked through the words between them (65 for each) instead, which gives the same components with no
    more edges than words. A run is a set of distinct fingerprints that share 33 bits' worth of key.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                owners, keys = keys_of(batch.column(0).slice(i, 4096).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners.view(np.int64))], names=["key", "fp"])

    def compare(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        found = []
        for start, size in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
            run = prints[start : start + size]
            found.append(between(run))
        short = np.repeat(sizes <= PAIRWISE, sizes)
        keys, prints = keys[short], prints[short]
        for step in range(1, PAIRWISE):
            same = np.flatnonzero(keys[step:] == keys[:-step])
            if not len(same):
                break
            a, b = prints[same], prints[same + step]
            near = np.bitwise_count(a ^ b) <= BITS
            found.append((a[near], b[near]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            both = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(both[0], both[0, -1])) if both.shape[1] else 0
            if cut:
                yield from compare(both[0, :cut], both[1, :cut].copy().view(np.uint64))
            held = [both[:, cut:]]
        if held and held[0].shape[1]:
            yield from compare(held[0][0], held[0][1].copy().view(np.uint64))

    rows = prints.select("fp").mapInArrow(released(keyed), "key long, fp long")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(released(linked), "a long, b long").distinct()


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grouped(prints: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links lead to, itself included) of each row of prints.

    Equal fingerprints count once before anything is joined. Rows without an id keep their place in a component, and have
    its id; a component of none but such rows has a null id.
    """
    prints = checkpointed(prints.select("doc_id", "fp"))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected(links(nodes.select("fp")))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written before the join, so that a component of most fingerprints is a skewed join that Spark can split
    least = checkpointed(labelled.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = checkpointed(labelled.join(least, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and the smallest id that links lead to. Texts without words have the fingerprint zero and link like others."""
    found = grouped(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")
