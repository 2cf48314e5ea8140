"""Language identification: known words by per-language log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, table

UNKNOWN = "und"
#: The fit reads about so many labelled rows of a language at most: those whose text hash is below a cut that lets so many through;
FIT_ROWS = 1000
#: and rows of so many languages at most, those with the most labelled rows.
FIT_LANGS = 500
LONGEST = 5
SMOOTH = 0.5
#: Held-out rows are those with remainder 0.
FOLDS = 5
LETTERS = re.compile(r"[^\W\d_]+")
#: Words that a task keeps scored; beyond it, the table starts anew.
CACHE = 1 << 18
#: A document's score is over this many words' worth of evidence at most, so that the logistic does not saturate.
EVIDENCE = 32.0


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo FOLDS; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % FOLDS


def words_of(text: str) -> Counter:
    """Lower-cased runs of letters with their counts. What `\\w` has beside letters and digits (superscripts, fractions, enclosed numbers) parts words."""
    counts = Counter(LETTERS.findall(text.lower()))
    for word in [w for w in counts if not w.isalpha()]:
        n = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += n
    return counts


class Model:
    """Log frequencies by language of whole words and of n-grams of `^word$`, from LONGEST letters down to one, each less its mean."""

    def __init__(self, langs: list[str], units: dict[str, dict[str, int]], logs: np.ndarray):
        """units: by kind ("w" or the n-gram's length) and text, the row in logs."""
        self.langs, self.units, self.logs = langs, units, logs

    @classmethod
    def from_counts(cls, langs: list[str], rows: list[tuple[str, str, str, int]]) -> Model:
        """rows: language, kind, text and count."""
        column = {x: i for i, x in enumerate(langs)}
        units: dict[str, dict[str, int]] = {}
        place = 0
        for _, kind, unit, _ in rows:
            own = units.setdefault(kind, {})
            if unit not in own:
                own[unit], place = place, place + 1
        logs = np.zeros((place, len(langs)))
        for lang, kind, unit, n in rows:
            logs[units[kind][unit], column[lang]] += n
        for own in units.values():
            at = np.fromiter(own.values(), np.int64, len(own))
            logs[at] = np.log((logs[at] + SMOOTH) / (logs[at].sum(axis=0) + SMOOTH * (len(own) + 1)))
        return cls(langs, units, logs - logs.mean(axis=1, keepdims=True) if langs else logs)

    def word(self, word: str) -> np.ndarray:
        """A known word's log frequencies; else those of the longest known n-grams that cover it, on the average."""
        if (known := self.units.get("w", {}).get(word)) is not None:
            return self.logs[known]
        padded = f"^{word}$"
        for n in range(min(LONGEST, len(padded)), 0, -1):
            own = self.units.get(str(n), {})
            found = [g for i in range(len(padded) - n + 1) if (g := own.get(padded[i : i + n])) is not None]
            if found:
                return self.logs[found].mean(axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Predictions of a model, with a row of scores kept for each distinct word met."""

    def __init__(self, model: Model):
        self.model, self.place, self.rows, self.used = model, {}, np.zeros((1024, len(model.langs))), 0

    def learn(self, counts: Counter) -> None:
        new = [w for w in counts if w not in self.place]
        if self.used + len(new) > CACHE:
            self.place, self.used, new = {}, 0, list(counts)
        while self.used + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for word in new:
            self.rows[self.used] = self.model.word(word)
            self.place[word] = self.used
            self.used += 1

    def predict(self, text: str) -> tuple[str, float]:
        counts = words_of(text)
        if not counts or not self.model.langs:
            return UNKNOWN, 0.0
        self.learn(counts)
        at = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        size = n.sum()
        odds = n @ self.rows[at] * (min(size, EVIDENCE) / size)
        odds = np.exp(odds - odds.max())
        best = int(odds.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, most_langs: int = FIT_LANGS) -> Model:
    """A model of all words and n-grams of about `rows` distinct texts of each language, of the `most_langs` languages with the most labelled rows.

    The texts of a language are those with the smallest hashes, so the sample is the same in every run and does not
    depend on where rows lie; copies of a text teach once. Rows without language or text teach nothing; a table without
    labelled rows gives a model that knows no language. What comes to the driver is bounded by the sample.
    """
    slim = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in slim.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, np.zeros((0, 0)))
    cut = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, rows / sizes[lang]) * (1 << 62))))])
    key = F.shiftrightunsigned(F.xxhash64("text"), 2)
    chosen = slim.where(key <= cut[F.col("lang")]).dropDuplicates(["lang", "text"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(text).items():
                    counts[lang, "w", word] += n
            for (lang, _, word), n in list(counts.items()):
                padded = f"^{word}$"
                for k in range(1, LONGEST + 1):
                    for i in range(len(padded) - k + 1):
                        counts[lang, str(k), padded[i : i + k]] += n
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], pa.string()) for j in range(3)] + [pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "kind", "unit", "n"])

    counted = chosen.select("lang", "text").mapInArrow(released(parts), "lang string, kind string, unit string, n long").groupBy("lang", "kind", "unit").agg(F.sum("n").alias("n"))
    learnt = counted.select("lang", "kind", "unit", "n").toArrow()
    return Model.from_counts(langs, sorted(zip(*(c.to_pylist() for c in learnt.columns), strict=True)))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the whole text alone.

    Null and empty texts and texts without a letter: `und`, 0. Ties go to the language of the smaller name. The model
    goes to the executors as a broadcast; its size is bounded by the fit's parameters. Other columns pass through;
    columns named lang_pred or score are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.units, model.logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for batch in slices(batches, place):
            found = [scorer.predict(text or "") for text in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(released(run), ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), "lang_pred string, score double"]))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows whose fold is 0 teach nothing. A null id is in no fold, so not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.coalesce(fold(F.col("doc_id")) != 0, F.lit(True))))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held_out, "text"), model).drop("text")
