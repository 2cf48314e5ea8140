"""What the training-data operators share: inputs, checkpoints, tokenizer files and bounded batches."""

from __future__ import annotations

import functools
import os
import re
import sys
import types
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import checkpointed, folder, forget, give_back, shared_folder, stored, trimmed  # noqa: F401  the operators take them from here

#: A word of the contracts: a run of bytes other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes for df to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text of a slice is about `most` bytes; a longer text is a slice of its own."""
    for batch in batches:
        start = total = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if i > start and total + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def tokenizer_path(name: str) -> str:
    """A public vocabulary file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer, single-threaded, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gives, kept for as long as this Python worker lives: a worker runs many tasks, and what is kept only saves making it again."""
    held = sys.modules.setdefault("_threadloom_worker", types.ModuleType("_threadloom_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def release() -> None:
    """Gives up what per_worker keeps, and returns the worker's free memory to the system."""
    sys.modules.setdefault("_threadloom_worker", types.ModuleType("_threadloom_worker")).__dict__.clear()
    give_back()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, in a worker that holds nothing before it and nothing after it: workers outlive their tasks, and share their executor's memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return wrapped
