"""Token-id files: ids ranked by their frequency within a block, in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folder, slices, table, tokenizer_path
from .words import word_table

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: The lengths of the four values that a control byte describes, two bits each, the first value in the lowest bits.
LENGTHS = (1 + (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3)).astype(np.uint8)
#: Text of which a block of a file is made.
BLOCK_BYTES = 2 << 20


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values; the last control byte is filled up with zero bits."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    data[start] = values & np.uint32(0xFF)
    for i in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > i)
        data[start[more] + i] = values[more] >> np.uint32(8 * i) & np.uint32(0xFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values: the table gives the lengths of each control byte's four values, and so the places of all."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    values = raw[start].astype(np.uint32)
    for i in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > i)
        values[more] |= raw[start[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return values


def ranking(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids by falling frequency, equal ones by id, and the rank of each id. The ids are a vocabulary's, so a table of counts holds them."""
    counts = np.bincount(ids)
    different = np.flatnonzero(counts)
    ranked = different[np.argsort(-counts[different], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    return ranked.astype("<u4"), rank[ids]


def ended(ids: np.ndarray, upto: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id behind each text's, and how many each text then has."""
    out = np.full(len(ids) + len(upto) - 1, end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[upto[1:] + np.arange(len(upto) - 1)] = False
    out[own] = ids
    return out, np.diff(upto) + 1


BLOCKS = "shard int, block int, doc_ids binary, missing binary, lengths binary, before long, n long, ranked binary, control binary, data binary"
BLOCK_SCHEMA = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in BLOCKS.split(", ")])


def write(docs: DataFrame, path: str, to: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes the ids of docs to the folder `to`, ascending by document id over files and within them; null ids come first, equal ones by a hash of the text.

    A file holds blocks: the documents' ids (64 bits), which of them are null, how many token ids each has (32 bits), how many
    ids the file's earlier blocks have, the block's different token ids by falling frequency (32 bits), and the ranks of all
    its token ids as control and data bytes. A block can be read by itself, and texts are encoded once. The shard is the
    file's place in the order. Null and empty texts have the end id alone; repeated rows are documents of their own; an
    empty table gives no blocks. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, before = word_table(path), TaskContext.get().partitionId(), 0
        for block, batch in enumerate(slices(batches, 1, block_bytes)):
            ids, sizes = ended(*words.stream(batch.column(1)), end_id)
            ranked, ranks = ranking(ids)
            control, data = pack(ranks)
            docs_ = batch.column(0)
            row = {
                "shard": shard,
                "block": block,
                "doc_ids": docs_.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "missing": docs_.is_null().to_numpy(zero_copy_only=False).tobytes(),
                "lengths": sizes.astype("<u4").tobytes(),
                "before": before,
                "n": len(ids),
                "ranked": ranked.tobytes(),
                "control": control,
                "data": data,
            }
            before += len(ids)
            yield pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

    # rows of one id (or of none) are told apart, so that they are no range of their own
    frame = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    frame.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(to)


def starts(blocks: DataFrame) -> DataFrame:
    """shard and base: the ids in all shards before. One row per shard passes through a single window."""
    sizes = blocks.groupBy("shard").agg(F.sum("n").alias("total"))
    return sizes.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))


def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their file's base, as the documents in them."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            start = r["base"] + r["before"]
            ids = np.frombuffer(r["ranked"], "<u4")[unpack(r["control"], r["data"], r["n"])]
            lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
            ends = np.cumsum(lengths)
            docs = pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(r["missing"], bool))
            parts = [ids[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def placed(blocks: DataFrame) -> DataFrame:
    """blocks with base; that is a row for each file, so the broadcast is bounded by their number."""
    return blocks.join(F.broadcast(starts(blocks)), "shard")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of each document in a folder's blocks."""
    return placed(blocks).mapInArrow(reading, "doc_id long, start long, n_tokens long, ids binary")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as read, with the CRC of their ids instead of these."""
    for batch in batches:
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written files hold of every document. A null or empty text has the end id alone."""
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY)
    write(docs, path, to := folder(spark, "ids"))
    return placed(spark.read.parquet(to)).mapInArrow(lambda batches: digest(reading(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")
