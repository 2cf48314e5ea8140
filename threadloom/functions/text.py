"""Column functions over text: two tokenizers, counts, lengths, months, abbreviated integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and lexicons of the lexical baseline.
STOP_WORDS = "the and for that with this from have are was were has had not but you your about into they them their there what when where which how can all any our out who why".split()
LEXICONS = {
    "ritual_practice": "ritual spell ceremony altar circle candle incense invocation banish cleanse protection offering divination sigil grimoire".split(),
    "tradition_terms": "ceremonial hermetic chaos witchcraft wicca thelema goetia tarot astrology alchemy shamanic folk pagan".split(),
    "epistemic_discussion": "proof evidence skeptical doubt believe experience theory source historical academic".split(),
    "resource_requests": "book pdf ebook download scan text file copy recommend library".split(),
}
#: Word characters with apostrophes and hyphens; the classes are spelt out, since \w differs between regex engines.
TERM = r"[\p{L}\p{N}_'’-]+"
#: Runs of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: Unicode white space, as (?U)\s has it.
SPACE = r"(?U)\s"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9() -]{7,}[0-9]"


def found(text: Column, pattern: str) -> Column:
    """All matches; none for a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def terms(text: Column) -> Column:
    """Terms in lower case."""
    return F.transform(found(text, TERM), F.lower)


def content_terms(text: Column, stop: list[str] = STOP_WORDS, shortest: int = 3) -> Column:
    return F.filter(terms(text), lambda t: (F.length(t) >= shortest) & ~t.isin(stop))


def words(text: Column) -> Column:
    return found(F.lower(text), WORD)


def word_count(text: Column) -> Column:
    """The number of words, without a list of them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lexicon_hits(content: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(content, lambda t: t.isin(lexicon))).cast("long")


def sentence_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[.!?]+(?=\s|$)")).cast("long")


def char_count(text: Column, char: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def url_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?i)https?://|www\.")).cast("long")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def is_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")) == 0


def spaced(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def body_length(recorded: Column, text: Column) -> Column:
    """The recorded length, unless it is null or 0; else the text's own."""
    return F.coalesce(F.nullif(recorded, F.lit(0)), F.length(F.coalesce(text, F.lit("")))).cast("long")


def month(iso: Column) -> Column:
    """The month as written, whatever the offset; null where the text is no timestamp."""
    return F.when(F.try_to_timestamp(iso).isNotNull(), F.substring(iso, 1, 7))


def abbreviated_int(text: Column) -> Column:
    """`2.6K`, `1.1M`, `25,001` as integers; null where there is no number."""
    plain = F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit(","), F.lit(""))
    number = F.nullif(F.regexp_extract(plain, r"([0-9]+(?:\.[0-9]+)?)\s*([KMBkmb])?", 1), F.lit("")).cast("double")
    unit = F.upper(F.regexp_extract(plain, r"([0-9]+(?:\.[0-9]+)?)\s*([KMBkmb])?", 2))
    times = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.floor(number * times + 0.5).cast("long")


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", "_")


def without_personal_data(text: Column) -> Column:
    """Mail addresses and telephone numbers as [email] and [phone]."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), PHONE, "[phone]")
