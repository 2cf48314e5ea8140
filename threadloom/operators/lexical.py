"""Style and register: marker phrases, densities, lexical diversity, readability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The classes of the study's framework, and the phrases that it names for modes and levels. The phrases of the
# content types, of `syncretic`, of the entity types and of the senses are this library's own.
CONTENT_TYPES = {
    "question": "how do|how can|what is|why does|is it possible",
    "tutorial": "step by step|here's how|first|then|finally",
    "experience_report": "last night i|i experienced|i contacted|happened to me",
    "debate": "i disagree|versus|vs|on the contrary|however",
    "book_resource": "read|book|edition|recommend",
    "request": "does anyone have|looking for|can someone send|please share",
}
DISCOURSE = {
    "instructional": "first|then|next",
    "testimonial": "i felt|i saw|it seemed",
    "skeptical": "i doubt|has anyone proven|what if",
    "devotional": "praise|thank|honor",
    "syncretic": "i mix|i combine|blended with|together with",
}
KNOWLEDGE = {"novice": "new to|beginner", "intermediate": "i've been practicing|i have been practicing", "expert": "in the tradition of|according to|historically"}
ENTITIES = {
    "demonic": "demon demons goetic asmodeus paimon lucifer",
    "angelic": "angel angels archangel archangels seraphim cherubim",
    "deity": "god gods goddess goddesses hekate odin",
    "elemental": "elemental elementals gnome sylph salamander undine",
    "planetary": "saturn jupiter mars venus mercury sun moon",
    "ancestral": "ancestor ancestors lineage forebears",
    "abstract": "egregore egregores servitor servitors thoughtform thoughtforms",
}
EMOTIONS = {"awe": "awe wonder sublime", "fear": "fear afraid terror dread", "joy": "joy happy bliss", "anger": "anger angry rage", "doubt": "doubt unsure sceptical"}
SENSES = {
    "sight": "see saw light dark colour bright shadow glow",
    "hearing": "hear heard sound voice whisper silence",
    "touch": "touch warm cold tingling pressure",
    "smell": "smell scent incense smoke",
    "taste": "taste bitter sweet salt",
}
#: Imperatives that begin a sentence of instructions.
IMPERATIVES = "light draw take place stand sit say burn hold close open breathe visualise visualize mix add pour".split()
GRATITUDE = "thank you|thanks|grateful|appreciate"
CHALLENGE = {"evidence": "source|proof|evidence|citation", "doctrine": "that is wrong|not how|incorrect", "safety": "dangerous|be careful|do not try"}
CITATION = r"\b(?:19|20)[0-9]{2}\b|\bpp?\.\s?[0-9]+|\bet al\b|\bibid\b"


def markers(text: Column, classes: dict[str, str]) -> Column:
    """A struct with the number of phrases of each class."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(*(F.regexp_count(low, F.lit(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])")).cast("long").alias(k) for k, p in classes.items()))


def strongest(counts: Column, classes: dict[str, str], none: str = "other") -> Column:
    """The class of most phrases, the first of equal ones; `none` where there are none."""
    best = F.greatest(*(counts[k] for k in classes))
    out = F.when(best == 0, F.lit(none))
    for k in classes:
        out = out.when(counts[k] == best, F.lit(k))
    return out


def density(tokens: Column, lexicon: list[str], per: int = 1000) -> Column:
    """Tokens of the lexicon for each `per` tokens; null for no tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: t.isin(lexicon))) * float(per) / F.size(tokens))


def ttr(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once for a row: a lambda that names an expression would make it again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mtld_forward(tokens: Column, cut: float = 0.72) -> Column:
    """Mean length of runs whose type-token ratio stays above the cut, forwards; the last run counts in part.

    One pass over the tokens of a row. A token is new to its run if it last stood before the run began, so its last place is
    all that has to be known of it: places come from one sort of the row's tokens, not from a growing set.
    """
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def with_last(sorted_: Column) -> Column:
        """The place of each token and the one where it stood before, -1 for none."""
        same = lambda x, k: (k > 0) & (F.get(sorted_, k - 1)["t"] == x["t"])
        return F.transform(sorted_, lambda x, k: F.struct(x["i"].alias("i"), F.when(same(x, k), F.get(sorted_, k - 1)["i"]).otherwise(-1).alias("last")))

    before = bound(F.array_sort(placed), with_last)
    start = F.struct(F.lit(0).alias("begun"), F.lit(0).alias("types"), F.lit(0).alias("n"), F.lit(0.0).alias("factors"))

    def step(s: Column, x: Column) -> Column:
        types = s["types"] + F.when(x["last"] < s["begun"], 1).otherwise(0)
        n = s["n"] + 1
        full = types / n <= cut
        return F.struct(
            F.when(full, x["i"] + 1).otherwise(s["begun"]).alias("begun"),
            F.when(full, 0).otherwise(types).alias("types"),
            F.when(full, 0).otherwise(n).alias("n"),
            (s["factors"] + F.when(full, 1.0).otherwise(0.0)).alias("factors"),
        )

    def finish(s: Column) -> Column:
        return s["factors"] + F.when(s["n"] > 0, (1 - s["types"] / s["n"]) / (1 - cut)).otherwise(0.0)

    factors = F.aggregate(F.array_sort(before), start, step, finish)
    return F.when(factors > 0, F.size(tokens) / factors).otherwise(F.size(tokens).cast("double"))


def ari(text: Column) -> Column:
    """Automated readability index from letters, words and sentences; null without words."""
    chars = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]"))
    n = T.word_count(text)
    sentences = F.greatest(T.sentence_count(text), F.lit(1))
    return F.when(n > 0, 4.71 * chars / n + 0.5 * n / sentences - 21.43)


def register_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with counts of step markers, numbered lines, second persons and citations."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    count = lambda p: F.regexp_count(low, F.lit(p)).cast("long")
    return docs.select("*", count(r"\b(?:first|next|then|finally|step [0-9]+)\b").alias("step_markers"), count(r"(?m)^\s*[0-9]+[.)]").alias("numbered_lines"), count(r"\b(?:you|your|yours)\b").alias("second_person"), count(CITATION).alias("citations"))


def cleaned(text: Column) -> Column:
    """Text without mail addresses and telephone numbers, URLs and Markdown marks; case stays, blanks are normalised."""
    plain = F.regexp_replace(T.without_personal_data(F.coalesce(text, F.lit(""))), r"(?i)\b(?:https?://|www\.)[^\x20\x09-\x0D]+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[*`~>#]+", " ")
    return F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))


def study_tokens(text: Column, shortest: int = 2, longest: int = 25) -> Column:
    """Terms of the cleaned text without stop words, of so many letters."""
    return F.filter(T.terms(cleaned(text)), lambda t: F.length(t).between(shortest, longest) & ~t.isin(T.STOP_WORDS))


def lexicon_counts(tokens: Column, lexicons: dict[str, str]) -> Column:
    """A struct with the number of tokens of each lexicon (words with blanks between)."""

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(words))).cast("long")

    return F.struct(*(hits(words.split()).alias(k) for k, words in lexicons.items()))


def imperatives(text: Column) -> Column:
    """Sentences that begin with an imperative."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?:^|[.!?]\s+)(?:{'|'.join(IMPERATIVES)})(?![A-Za-z0-9_])")).cast("long")


def steps_similarity(a: Column, b: Column) -> Column:
    """The longest common subsequence of two sequences, by the length of the longer one; null where both are empty.

    A row of the table of lengths is carried over the first sequence, so memory is that of the second.
    """
    width = F.size(b)
    zero = F.transform(b, lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(made: Column, y: Column) -> Column:
            j = F.size(made)
            left = F.coalesce(F.get(made, j - 1), F.lit(0))
            corner = F.coalesce(F.get(before, j - 1), F.lit(0))
            return F.concat(made, F.array(F.when(x == y, corner + 1).otherwise(F.greatest(left, F.get(before, j)))))

        return F.aggregate(b, F.array().cast("array<int>"), cell)

    common = F.coalesce(F.get(F.aggregate(a, zero, row), width - 1), F.lit(0))
    longer = F.greatest(F.size(a), width)
    return F.when(longer > 0, common / longer)
