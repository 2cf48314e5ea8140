"""Passages that documents repeat: runs of words meet at the minimiser that they share, those of equal surroundings together, the others run by run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, checkpointed, free_name, released, slices, stored, table
from .hashing import STEP, mixed

#: A repeated passage has so many words at least.
PASSAGE = 50
#: A minimiser is the least hash of so many words in a row; the others follow: each run of PASSAGE words holds one.
GRAM = 10
GRAMS = PASSAGE - GRAM + 1


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in turn, and how many words each has. Arrow splits and numbers the words, so each distinct one is hashed once."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    words = split.flatten().dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    blank = np.fromiter((w == "" for w in words.dictionary.to_pylist()), bool, len(words.dictionary))
    codes = words.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = ~blank[codes]
    return own[codes[real]], np.bincount(text[real], minlength=len(texts))


def minimisers(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes, with the places where documents end: the hashes and places of the minimisers, and first and last start of the runs of PASSAGE words that each stands for.

    Each run of PASSAGE words within a document has one minimiser, the leftmost of its least grams, which depends on
    nothing but the run; so equal runs have theirs at the same place.
    """
    none = np.zeros(0, np.int64)
    if len(words) < PASSAGE:
        return none.astype(np.uint64), none, none, none
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = grams * STEP + words[i : len(words) - GRAM + 1 + i]
    grams = mixed(grams)
    starts = np.arange(len(words) - PASSAGE + 1)
    within = starts + PASSAGE <= ends[np.searchsorted(ends, starts, side="right")]
    picked = starts + np.lib.stride_tricks.sliding_window_view(grams, GRAMS).argmin(axis=1)
    starts, picked = starts[within], picked[within]
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    new = np.flatnonzero(np.concatenate([[True], np.diff(picked) != 0]))
    last = np.append(new[1:], len(picked)) - 1
    return grams[picked[new]], picked[new], starts[new], starts[last]


class Lines:
    """Hashes of any stretch of words, from sums of the words times powers of STEP."""

    def __init__(self, words: np.ndarray) -> None:
        power = np.full(len(words) + 1, STEP)
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.inverse = np.full(len(words) + 1, np.uint64(pow(int(STEP), -1, 1 << 64)))
        self.inverse[0] = 1
        self.inverse = np.multiply.accumulate(self.inverse)
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = (stop - start).astype(np.uint64)
        return mixed((self.upto[stop] - self.upto[start]) * self.inverse[start] + size * np.uint64(0x94D049BB133111EB))


def row_id(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_id(docs[id_col], docs[text_col]).alias("rid"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def contexts(rows: DataFrame) -> DataFrame:
    """The minimisers of all texts: row and document, gram hash h, place of the first of the n runs of PASSAGE words that it stands for, and a hash c of all words of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 4 << 20):
            words, sizes = hashed(batch.column(2))
            ends = np.cumsum(sizes)
            hashes, at, first, last = minimisers(words, ends)
            doc = np.searchsorted(ends, at, side="right")
            line = Lines(words).hashes(first, last + PASSAGE) + mixed((at - first).astype(np.uint64))
            ids = pa.array(doc)
            own = [pa.array(hashes.view(np.int64)), pa.array(line.view(np.int64)), pa.array(first - (ends - sizes)[doc], pa.int32()), pa.array(last - first + 1, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), *own], names=["rid", "doc_id", "h", "c", "pos", "n"])

    return rows.mapInArrow(released(run), "rid long, doc_id long, h long, c long, pos int, n int")


def runs(rows: DataFrame) -> DataFrame:
    """Of rows with `asked`, a list of pos, n and h: each run of PASSAGE words that starts at one of n places from pos on, with h and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words, sizes = hashed(batch.column(2))
            asked = batch.column(3)
            flat = asked.flatten()
            pos, n, h = (flat.field(i).to_numpy() for i in range(3))
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(asked).to_numpy())
            of = np.repeat(np.arange(len(n)), n)
            place = pos[of].astype(np.int64) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = place + (np.cumsum(sizes) - sizes)[doc[of]]
            keys = Lines(words).hashes(start, start + PASSAGE)
            ids = pa.array(doc[of])
            made = pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array(h[of]), pa.array(keys.view(np.int64)), pa.array(place, pa.int32())], names=["rid", "doc_id", "h", "key", "start"])
            for i in range(0, made.num_rows, 1 << 16):
                yield made.slice(i, 1 << 16)

    return rows.select("rid", "doc_id", "text", "asked").mapInArrow(released(run), "rid long, doc_id long, h long, key long, start int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, start, stop, first_doc_id and first_start: stretches of words (from start up to stop) that stand in an earlier place too.

    The order of places is by document id (null first), row and word. Every word of a stretch stands at the same distance
    in the earlier place; that word may be part of a stretch itself, but the first of all is in none, so taking out
    all stretches leaves one copy of each passage. Every run of PASSAGE words that stands in an earlier place is in a stretch.
    Texts of fewer than PASSAGE words, empty and null ones have no rows. A text that repeats itself is treated like two.

    Equal runs share their minimiser's gram. Places where all runs of a minimiser are equal (its context) meet the first of
    these. Only the firsts of a gram with several contexts are taken apart into runs, each of which meets its first place:
    if a run stands before in another context, it stands in the first place of that one, too. Words are compared by
    hashes of 64 bits of the gram and of the stretch each. First places are written before the joins with them, so a frequent
    one is a skewed join that Spark can split.
    """
    rows = identified(docs, id_col, text_col)
    places = stored(contexts(rows), "contexts")
    grams = stored(places.groupBy("h").agg(F.count("*").alias("times"), (F.min("c") < F.max("c")).alias("open")).where("times > 1").select("h", "open"), "grams")
    again = stored(places.join(grams, "h"), "again")
    first = stored(again.groupBy("h", "c", "open").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "rid", "pos", "n")).alias("f")).select("h", "c", "open", "times", *(F.col(f"f.{x}").alias(f"f_{x}") for x in ("doc_id", "rid", "pos", "n"))), "first")
    copies = again.drop("open").join(first.where("times > 1"), ["h", "c"]).where("rid <> f_rid OR pos <> f_pos")
    asked = first.where("open").groupBy(F.col("f_rid").alias("rid")).agg(F.collect_set(F.struct(F.col("f_pos").alias("pos"), F.col("f_n").alias("n"), "h")).alias("asked"))
    keyed = stored(runs(rows.join(stored(asked, "asked"), "rid")), "runs")
    least = stored(keyed.groupBy("h", "key").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "rid", "start")).alias("f")).where("times > 1").select("h", "key", *(F.col(f"f.{x}").alias(f"f_{x}") for x in ("doc_id", "rid", "start"))), "least")
    single = keyed.join(least, ["h", "key"]).where("rid <> f_rid OR start <> f_start")
    ends = lambda start, n, f_start: (F.col(start).alias("start"), (F.col(start) + n).cast("int").alias("stop"), F.col("f_doc_id").alias("first_doc_id"), F.col(f_start).alias("first_start"))
    return copies.select("rid", "doc_id", *ends("pos", F.col("n") + PASSAGE - 1, "f_pos")).unionAll(single.select("rid", "doc_id", *ends("start", F.lit(PASSAGE), "f_start")))


def stretches(found: DataFrame) -> DataFrame:
    """rid, doc_id and stretches (start, stop, first_doc_id), merged where they touch, of each row that has any. A row's stretches are as many as its words at most."""
    spans = F.array_sort(F.collect_set(F.struct("start", "stop", "first_doc_id", "first_start")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(2).to_pylist():
                merged: list[dict] = []
                for x in own:
                    if merged and x["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], x["stop"])
                    else:
                        merged.append({k: x[k] for k in ("start", "stop", "first_doc_id")})
                out.append(merged)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("first_doc_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["rid", "doc_id", "stretches"])

    return found.groupBy("rid", "doc_id").agg(spans.alias("spans")).mapInArrow(join, "rid long, doc_id long, stretches array<struct<start:int,stop:int,first_doc_id:bigint>>")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the stretches; what stood between kept parts is one line end."""
    places = [m.span() for m in WORD_RE.finditer(text)]
    parts, at = [], 0
    for start, stop in [*spans, (len(places), len(places))]:
        if start > at:
            parts.append(text[places[at][0] : places[start - 1][1]])
        at = max(at, stop)
    return "\n".join(parts)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the repeated stretches taken out of their texts. Rows and other columns stay; a text of nothing but repeats becomes empty, a null one stays null. Repeated rows (of equal id and text) count as one and keep the same text."""
    own = free_name(docs, "__rid")
    spans = checkpointed(stretches(repeats(docs, id_col, text_col)).select(F.col("rid").alias(own), F.col("stretches").alias(free_name(docs, "__stretches"))))
    joined = docs.withColumn(own, row_id(F.col(id_col), F.col(text_col))).join(spans, own, "left").drop(own)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            texts = [t if not own else cut(t, [(x["start"], x["stop"]) for x in own]) for t, own in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(released(run), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per stretch of a document's words that stands in an earlier place: its words' places and the first document. Documents without such a stretch have none; repeated rows have their stretches once."""
    found = stretches(repeats(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.explode("stretches").alias("s")).select("doc_id", F.col("s.start").alias("start_word"), F.col("s.stop").alias("stop_word"), F.col("s.first_doc_id").alias("first_doc_id"))
