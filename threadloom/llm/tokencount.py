"""Token counts by a compiled finite-state transducer.

A BPE encoding is the one sequence of pieces in which each adjacent pair is what BPE makes of the two joined. So the
last piece of each prefix of a word follows from the last pieces of its shorter prefixes, and only those positions
matter from which a longer piece may still come. The set of these positions - where each stands in the trie of pieces,
which piece ends there, and how many pieces precede it, counted from the present one - is a state; the difference in the
number of pieces is the count on the transition. States and transitions are compiled as texts ask for them, within a
bound. White space leads from every state to the start: the state map of a chunk of text is therefore a run of
transitions up to its first white space and a constant beyond. Chunks are run side by side and their maps composed in
order: those with white space need nothing before them; a run of others takes its states from its neighbours in rounds,
each over all chunks whose entry changed, and as such states soon forget where they began, a few rounds settle it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load_tokenizer, per_worker, slices, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: States and symbols of a compiled table; beyond either, it is compiled anew from what comes next.
MOST_STATES = 250_000
MOST_SYMBOLS = 192
#: Code points in a chunk at most, and chunks that run side by side at least, where there is text for them.
CHUNK = 1024
SIDE_BY_SIDE = 4096
SPACE, LETTER, DIGIT, OTHER = range(4)
#: Fixed values of the vocabulary's splitting pattern: what may follow an apostrophe as a word of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """BPE of one word, by the ranks of a vocabulary file, over letters of which the last ends the word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(m): i for i, m in enumerate(pairs)}
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]

    def apply(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts


class Transducer:
    """The lazily compiled transducer of a vocabulary: table[state, symbol] is the next state (-1: not compiled), count[state, symbol] the pieces emitted."""

    def __init__(self, path: str, most_states: int = MOST_STATES):
        self.merges = Merges(path)
        self.tokenizer = load_tokenizer(path)
        self.letters = byte_letters()
        self.most_states = most_states
        self.specials = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.compat: dict[tuple[int, int], bool] = {}
        # the trie of pieces: children by letter, and the piece that ends at a node within a word, or with it
        self.child: list[dict[str, int]] = [{}]
        self.inner: list[int] = [-1]
        self.final: list[int] = [-1]
        self.spelled: list[list[str]] = []
        for piece in self.merges.vocab:
            ends = piece.endswith(self.merges.end) and piece != self.merges.end
            text = piece.removesuffix(self.merges.end) if ends else piece
            node = 0
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.child[node][c]
            (self.final if ends else self.inner)[node] = len(self.spelled)
            self.spelled.append([*text[:-1], text[-1] + self.merges.end] if ends else list(text))
        self.clear()

    def clear(self) -> None:
        self.symbol = np.full(0x110000, -1, np.int16)
        self.chars: list[str] = []
        self.kind: list[int] = []
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.table = np.full((1024, MOST_SYMBOLS), -1, np.int32)
        self.count = np.zeros((1024, MOST_SYMBOLS), np.int16)
        self.start = self.state(("start", ()))
        self.symbol_of(" ")

    def state(self, what: tuple) -> int:
        if (n := self.states.get(what)) is None:
            n = self.states[what] = len(self.known)
            self.known.append(what)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        return n

    def symbol_of(self, char: str) -> int:
        n = self.symbol[ord(char)] = len(self.chars)
        self.chars.append(char)
        self.kind.append(self.kind_of(char))
        return int(n)

    def kind_of(self, char: str) -> int:
        """As the vocabulary's own splitting has it."""
        if self.tokenizer.normalizer.normalize_str(char) == " ":
            return SPACE
        pieces = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return LETTER if pieces(f"a{char}") == 1 else OTHER if pieces(f"{char}!") == 1 else DIGIT

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two pieces apart; -1 stands for the word's beginning."""
        if left < 0:
            key = (right, right)
            if (found := self.compat.get(key)) is None:
                found = self.compat[key] = len(self.merges.apply(self.spelled[right])) == 1
            return found
        key = (left, right + len(self.spelled))
        if (found := self.compat.get(key)) is None:
            parts = self.merges.apply(self.spelled[left] + self.spelled[right])
            found = self.compat[key] = parts == ["".join(self.spelled[left]), "".join(self.spelled[right])]
        return found

    #: Positions in a word: (node reached since, piece that ends there, pieces up to there less those up to the latest).
    ROOT = ((0, -1, 0),)

    def feed(self, items: tuple, char: str) -> tuple[tuple, int]:
        """The positions after one more character of the word, and by how many its pieces grow."""
        total = 0
        for byte in char.encode():
            letter, moved, last = self.letters[byte], [], None
            for node, piece, n in items:
                if (to := self.child[node].get(letter)) is not None:
                    moved.append((to, piece, n))
                    if last is None and self.inner[to] >= 0 and self.fits(piece, self.inner[to]):
                        last = (self.inner[to], n + 1)
            if last is None:
                raise ValueError(f"the vocabulary has no piece for {char!r}")
            items = tuple((node, piece, n - last[1]) for node, piece, n in moved if self.child[node] or self.final[node] >= 0) + ((0, last[0], 0),)
            total += last[1]
        return items, total

    def ended(self, items: tuple) -> int:
        """By how many the pieces grow as the word ends: its last letter is then another one."""
        for node, piece, n in items:
            if self.final[node] >= 0 and self.fits(piece, self.final[node]):
                return n + 1
        raise ValueError("the vocabulary has no piece for a word's end")

    def word(self, text: str) -> int:
        items, total = self.ROOT, 0
        for c in text:
            items, n = self.feed(items, c)
            total += n
        return total + self.ended(items)

    def step(self, what: tuple, char: str, kind: int) -> tuple[tuple, int]:
        """The next state and the pieces emitted. States: start, letter and other (in a word of that kind, with its positions), apostrophe (a word that begins with one, and the letters since)."""
        mode, held = what
        if mode == "apostrophe":
            if kind == LETTER:
                if held + char in CONTRACTIONS:
                    return ("start", ()), self.word("'" + held + char)
                if any(x.startswith(held + char) for x in CONTRACTIONS):
                    return (mode, held + char), 0
            if kind == OTHER and not held:
                items, n = self.feed(self.ROOT, "'")
                items, m = self.feed(items, char)
                return ("other", items), n + m
            to, n = ("start", ()), self.word("'")
            for c in held:
                to, m = self.step(to, c, LETTER)
                n += m
            to, m = self.step(to, char, kind)
            return to, n + m
        n = 0
        if mode != "start" and (mode, kind) not in (("letter", LETTER), ("other", OTHER)):
            mode, n = "start", self.ended(held)
        if kind == SPACE:
            return ("start", ()), n
        if kind == DIGIT:
            return ("start", ()), n + self.word(char)
        if mode == "start":
            if char == "'":
                return ("apostrophe", ""), n
            mode, held = ("letter" if kind == LETTER else "other"), self.ROOT
        items, m = self.feed(held, char)
        return (mode, items), n + m

    def compile(self, state: int, symbol: int) -> None:
        to, n = self.step(self.known[state], self.chars[symbol], self.kind[symbol])
        to = self.state(to)
        self.table[state, symbol], self.count[state, symbol] = to, n

    def symbols(self, points: np.ndarray) -> np.ndarray:
        found = self.symbol[points]
        if (found < 0).any():
            new = np.unique(points[found < 0])
            if len(self.chars) + len(new) > MOST_SYMBOLS:
                self.clear()
                new = np.unique(points)
                if len(new) >= MOST_SYMBOLS:
                    raise OverflowError
            for p in new:
                if self.symbol[p] < 0:
                    self.symbol_of(chr(p))
            found = self.symbol[points]
        return found

    def advance(self, at: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.table[at, by]
        if (to < 0).any():
            for pair in np.unique(at[to < 0].astype(np.int64) * MOST_SYMBOLS + by[to < 0]):
                self.compile(int(pair) // MOST_SYMBOLS, int(pair) % MOST_SYMBOLS)
            to = self.table[at, by]
        return to, self.count[at, by]

    def run(self, points: np.ndarray) -> np.ndarray:
        """Pieces emitted at each code point of a stream that begins at the start state."""
        try:
            codes = self.symbols(points)
        except OverflowError:  # too many different characters at once: take them by halves
            cut = len(points) // 2
            while cut and self.kind_of(chr(points[cut - 1])) != SPACE:
                cut -= 1
            if not cut:
                return self.slowly(points)
            return np.concatenate([self.run(points[:cut]), self.run(points[cut:])])
        if len(self.known) > self.most_states:
            self.clear()
            codes = self.symbols(points)
        width = max(16, min(CHUNK, len(points) // SIDE_BY_SIDE))
        rows = -(-len(points) // width)
        blank = int(self.symbol[ord(" ")])
        grid = np.full(rows * width, blank, np.int16)
        grid[: len(codes)] = codes
        grid = grid.reshape(rows, width)
        space = np.array(self.kind)[grid] == SPACE
        # the place of each chunk's first white space; its width, if it has none
        head = np.where(space.any(axis=1), space.argmax(axis=1), width)
        out = np.zeros((rows, width), np.int16)
        # beyond the heads, all chunks side by side: the constant part of their maps
        state = np.full(rows, self.start)
        tails = np.where(np.arange(width) < head[:, None], blank, grid)
        for i in range(width):
            state, out[:, i] = self.advance(state, tails[:, i])
        # the heads, all at once: their entries are settled behind a chunk with a white space, else taken to be the start until the chunk before says otherwise
        leaves, settled = state.copy(), head < width
        leaves[~settled] = self.start
        enters = np.concatenate([[self.start], leaves[:-1]])
        ready = np.arange(rows)
        while len(ready):
            state, live = enters[ready], np.arange(len(ready))
            for i in range(width):
                live = live[head[ready[live]] >= i] if i else live
                if not len(live):
                    break
                state[live], out[ready[live], i] = self.advance(state[live], grid[ready[live], i])
            open_ = ready[~settled[ready]]
            changed = leaves[open_] != state[~settled[ready]]
            leaves[open_] = state[~settled[ready]]
            ready = open_[changed & (open_ + 1 < rows)] + 1
            enters[ready] = leaves[ready - 1]
        return out.reshape(-1)[: len(points)]

    def slowly(self, points: np.ndarray) -> np.ndarray:
        """The same without a table, for a stretch without white space that has more characters than a table holds."""
        what, out = ("start", ()), np.zeros(len(points), np.int16)
        for i, p in enumerate(points):
            char = chr(p)
            what, out[i] = self.step(what, char, self.kind_of(char))
        return out

    def normal(self, text: str) -> tuple[str, int]:
        """The text as the vocabulary's normaliser leaves it, with a blank for each special string, and the number of these."""
        found = 0
        if "<|" in text:
            for special in self.specials:
                found += text.count(special)
                text = text.replace(special, " ")
        if text.isascii():
            return text.lower(), found
        return self.tokenizer.normalizer.normalize_str(text), found

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of pieces of each text."""
        made = [self.normal(t) for t in texts]
        stream = "\n".join([x for x, _ in made] + [""])
        points = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(x) + 1 for x, _ in made])
        total = np.concatenate([[0], np.cumsum(self.run(points), dtype=np.int64)])
        return total[ends] - total[np.concatenate([[0], ends[:-1]])] + np.array([n for _, n in made], np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row's whole text, without a shuffle.

    Null and empty texts count 0; repeated rows are counted each; an empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = per_worker(f"transducer {path}", lambda: Transducer(path))
        for batch in slices(batches, 1, 4 << 20):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = machine.counts(texts)
            size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    frame = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return frame.mapInArrow(run, f"doc_id {dict(frame.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document; null and empty texts have none."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
