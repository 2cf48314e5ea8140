"""Distinct-word tables: each distinct word that a worker meets is encoded once, and ids go back by position."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import load_tokenizer, per_worker

#: Words and characters that a worker keeps encoded; beyond either, the words that most slices of text had stay, up to half of it.
TABLE = 400_000
TABLE_CHARS = 16 << 20
#: Plain words that are encoded as one text, and texts that are encoded at a time.
TOGETHER = 256
AT_ONCE = 64
#: Upper-case letters whose lower case, unlike them, may form one character with a mark.
MARKED = r"[A-Z][\x{0300}-\x{036f}]"
#: A full stop or comma that is a piece of its own: a letter before it, white space or the end behind it.
STOP, APART = r"([a-z])([,.])([ \n]|$)", r"\1 \2\3"


class WordTable:
    """Ids of texts by way of their distinct words.

    The tokenizer lower-cases, drops white space and never joins over it, and Unicode composition does not reach over it, so
    the ids of a text are those of the words between its white space in turn. A to Z are lower-cased before, except in texts
    where that could change how marks compose, or which hold what may be a special string. Words of letters are encoded many
    at a time, as each ends with its only piece that ends a word; the others, and those where the count of such pieces
    shows that this fails, one by one.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.words: list[str] = []
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text, with an empty one before white space at the beginning."""
        texts = texts.fill_null("")
        lower = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=STOP, replacement=APART)
        as_is = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, MARKED))
        return pc.ascii_split_whitespace(pc.if_else(as_is, texts, lower))

    def shrink(self) -> None:
        """Keeps the words that were met in the most slices, and in more than one: up to half of the table."""
        order = np.argsort(-self.uses, kind="stable")[: TABLE // 2]
        order = order[(self.uses[order] > 1) & (np.cumsum(self.length[order]) <= TABLE_CHARS // 2)]
        self.words = [self.words[i] for i in order.tolist()]
        self.place = dict(zip(self.words, range(len(self.words)), strict=True))
        self.flat = self.flat[spread(self.start[order], self.size[order])]
        self.size, self.uses, self.length = self.size[order], self.uses[order] >> 1, self.length[order]
        self.start = np.cumsum(self.size) - self.size

    def learn(self, new: list[str]) -> None:
        """Encodes words that the table lacks."""
        plain, others = [], []
        for w in new:
            (plain if w.isalpha() and w.islower() else others).append(w)
        flat, sizes, done = [self.flat], [self.size], []
        for i in range(0, len(plain), TOGETHER * AT_ONCE):
            parts = [plain[j : j + TOGETHER] for j in range(i, min(i + TOGETHER * AT_ONCE, len(plain)), TOGETHER)]
            for part, made in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(made.ids, np.uint32)
                ends = np.flatnonzero(self.final[ids]) + 1
                if len(ends) == len(part):
                    flat.append(ids)
                    sizes.append(np.diff(ends, prepend=0))
                    done += part
                else:
                    others += part
        for i in range(0, len(others), 4096):
            made = [x.ids for x in self.tokenizer.encode_batch_fast(others[i : i + 4096], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, made), np.int64, len(made)))
            flat.append(np.fromiter((x for ids in made for x in ids), np.uint32, int(sizes[-1].sum())))
        done += others
        self.place.update(zip(done, range(len(self.words), len(self.words) + len(done)), strict=True))
        self.words += done
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size
        self.uses = np.concatenate([self.uses, np.zeros(len(done), np.int32)])
        self.length = np.concatenate([self.length, np.fromiter(map(len, done), np.int64, len(done))])

    def numbers(self, distinct: list[str]) -> np.ndarray:
        """The place of each of a slice's distinct words in the table."""
        find = lambda words: np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        known = find(distinct)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            chars = sum(len(distinct[i]) for i in missing.tolist())
            if self.words and (len(self.words) + len(missing) > TABLE or int(self.length.sum()) + chars > TABLE_CHARS):
                self.shrink()
                known = find(distinct)
                missing = np.flatnonzero(known < 0)
            new = [distinct[i] for i in missing.tolist()]
            self.learn(new)
            known[missing] = find(new)
        self.uses[known] += 1
        return known

    def stream(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's begin (with the end behind the last); a null is an empty text.

        Words are numbered by Arrow, so Python sees each distinct one of the texts once.
        """
        split = self.split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        words = split.flatten().dictionary_encode()
        codes = self.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        size = self.size[codes]
        upto = np.concatenate([[0], np.cumsum(size)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return self.flat[spread(self.start[codes], size)], upto

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; a null is an empty one."""
        ids, upto = self.stream(texts)
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            yield ids[a:b]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def word_table(path: str) -> WordTable:
    """The worker's table for a vocabulary."""
    return per_worker(f"words {path}", lambda: WordTable(path))
