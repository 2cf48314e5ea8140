"""BPE encoding and decoding by distinct-word tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load_tokenizer, per_worker, slices, table, tokenizer_path, trimmed
from .words import word_table

VOCABULARY = "word_bpe_49k.json"
#: Text that is encoded at a time.
PART = 2 << 20
Batches = Iterator[pa.RecordBatch]


def encoding(path: str) -> Callable[[Batches], Batches]:
    """Batches of id, text and further columns, as batches of id, n_tokens, ids and these columns."""

    def run(batches: Batches) -> Batches:
        words = word_table(path)
        for batch in slices(batches, 1, PART):
            ids = [x.astype("<u4") for x in words.encode(batch.column(1))]
            made = [pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], names=[names[0], "n_tokens", "ids", *names[2:]])

    return run


def pieces_of(path: str) -> list[str]:
    """The piece of each id."""
    made = load_tokenizer(path)
    return [made.id_to_token(i) or "" for i in range(max(made.get_vocab(with_added_tokens=True).values()) + 1)]


def decoding(path: str, place: int) -> Callable[[Batches], Batches]:
    """Batches with the column decoded behind theirs, from the ids in column `place`."""

    def run(batches: Batches) -> Batches:
        piece = per_worker(f"pieces {path}", lambda: pieces_of(path)).__getitem__
        for batch in slices(batches, place, PART):
            texts = [None if x is None else " ".join(map(piece, np.frombuffer(x, "<u4").tolist())) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: the id, n_tokens, ids (little-endian unsigned 32-bit integers) and the columns asked for.

    A worker splits the words of its documents, encodes each distinct word once and puts the ids back by position. Its
    table is bounded, and made anew from the input if an executor is lost. Null and empty texts have no ids; repeated rows
    are rows of their own, and an empty table gives none. Of the columns asked for, those of the names made here are left out.
    """
    kinds = dict(docs.dtypes)
    columns = tuple(c for c in columns if c not in (id_col, "n_tokens", "ids"))
    frame = docs.select(id_col, text_col, *columns)
    return frame.mapInArrow(encoding(path), ", ".join([f"`{id_col}` {kinds[id_col]}", "n_tokens long", "ids binary", *(f"`{c}` {kinds[c]}" for c in columns)]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with the column decoded: the pieces of its ids with one space between, as the vocabulary's library joins them. Null ids give null."""
    kept = encoded.drop("decoded")
    return kept.mapInArrow(decoding(path, kept.columns.index(ids_col)), ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), "decoded string"]))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """decode(encode(...)) in one step, so that a task has one Python worker, which gives its free memory back at the end of the task. Columns asked for that are named as those made here are left out."""
    kinds = dict(docs.dtypes)
    columns = tuple(c for c in columns if c not in (id_col, "n_tokens", "ids", "decoded"))
    run = trimmed(lambda batches: decoding(path, 2)(encoding(path)(batches)))
    return docs.select(id_col, text_col, *columns).mapInArrow(run, ", ".join([f"`{id_col}` {kinds[id_col]}", "n_tokens long", "ids binary", *(f"`{c}` {kinds[c]}" for c in columns), "decoded string"]))


def digest(batches: Batches) -> Batches:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text."""
    for batch in batches:
        sha = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string()) for column in batch.columns[2:]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *sha], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both operators and the digests in one step, so that a task has one Python worker. Null and empty texts have no ids and decode to an empty text."""
    path = tokenizer_path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(lambda batches: digest(decoding(path, 2)(encoding(path)(batches))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
