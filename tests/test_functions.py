import hashlib
import random
import unicodedata

import pytest
from hypothesis import given, seed, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import privacy, urls
from threadloom.functions import text as T
from threadloom.operators import aggregate, lexical


def known(text):
    """Whether all code points were assigned by Unicode 13, which the JVM knows."""
    return all(unicodedata.category(c) != "Cn" and c not in NEWER for c in text)


#: Letters and digits that Unicode gained between 13 and the model's version, in the planes that the test draws from.
NEWER = {c for c in map(chr, range(0x110000)) if not unicodedata.ucd_3_2_0.name(c, "") and unicodedata.category(c)[0] in "LN"}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def many(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_abbreviated_integers(spark):
    assert many(spark, T.abbreviated_int, ["2.6K", "13.5K", "1.1M", "25,001", "—", None, "3B"]) == [2600, 13500, 1100000, 25001, None, None, 3_000_000_000]


def test_canonical_urls(spark):
    expected = {
        " https://Talk.Example/topics/lantern.7/UNREAD ": "https://talk.example/topics/lantern.7/",
        "https://talk.example/topics/q.5/post-12?UTM_Campaign=z&page=3": "https://talk.example/topics/q.5/?page=3",
        "https://talk.example/topics/q.5/post-x": "https://talk.example/topics/q.5/post-x/",
        "http://talk.example?sidecar=1&sid=2&FBCLID=3#end": "http://talk.example/?sidecar=1",
        "https://talk.example:443/a/./b/../c": "https://talk.example/a/c/",
        "http://talk.example:443/../../x/..": "http://talk.example:443/",
        "https://talk.example/a..b/.c": "https://talk.example/a..b/.c/",
        "/topics/q.5/": "",
        "": "",
    }
    assert many(spark, urls.canonical, list(expected)) == list(expected.values())
    assert not many(spark, urls.canonical, [None])[0]


def test_ids_and_types(spark):
    assert many(spark, urls.page_id, ["https://b.example/threads/a.123/page-4/?x=1#top", "/members/alice.7/", None, "/x"]) == ["123", "7", None, None]
    assert many(spark, urls.page_type, ["https://b.example/forums/x.9/", "https://b.example/threads/a.1/", "https://b.example/", "https://b.example/members/x", "https://b.example/q"]) == ["forum", "thread", "index", "member", "other"]
    assert many(spark, urls.slug, ["/forums/general.9/", "/x", None]) == ["general", "", ""]


def test_resource_types(spark):
    kinds = many(spark, lambda u: urls.resource_type(u, F.lit("")), ["/ritual.pdf", "/book.epub", "/manual.docx", "/archive.zip", "/A.DOCX", "/épdfé", "/a_pdf", "/x?file", None])
    assert kinds == ["pdf", "ebook", "document", "archive", None, "pdf", None, "download", None]


def test_domains(spark):
    assert many(spark, urls.authority, ["https://U:p@Host.example:8080/x", "/relative", None]) == ["u:p@host.example:8080", "", ""]
    assert many(spark, urls.host, ["https://U:p@Host.example:8080/x", "/relative", None]) == ["host.example", None, None]


def test_months_follow_the_written_offset(spark):
    assert many(spark, T.month, ["2024-01-01T00:30:00+05:00", "2024-02-30", "x", None]) == ["2024-01", None, None, None]


def test_hashes(spark):
    assert many(spark, privacy.always_short_hash, [None, ""]) == ["e3b0c44298fc1c14"] * 2
    assert many(spark, privacy.short_hash, [None, "", "a"]) == [None, "", "ca978112ca1bbdca"]
    assert many(spark, privacy.full_hash, ["A" * 64, "x"])[0] == "a" * 64


def test_post_features(spark):
    text = "Über 3 Wege? Naïve ΑΒΓ, αβγ! 猫 und 猫!! www.x.example 🙂"
    kind = "id string, body_text string, body_html string, forum struct<url:string>, posted_at struct<iso:string>, quote_count int, links array<string>, reactions_count int, has_reactions boolean, edited boolean"
    rows = [("p9", text, "<i>🙂</i>", ("/forums/tea.31/",), ("2023-05-06",), 4, ["x"], 7, True, False), ("", " \n", None, None, None, None, None, None, None, True)]
    blank, full = sorted(aggregate.post_features(spark.createDataFrame(rows, kind)).collect(), key=lambda r: r["post_id"] or "")
    assert (full["word_count"], full["unique_word_count"]) == (12, 10)
    assert (full["question_count"], full["exclamation_count"], full["url_count"], full["sentence_count"]) == (1, 3, 1, 3)
    assert (full["body_text_length"], full["body_html_length"]) == (len(text) + 1, 9)
    assert (full["forum_id"], full["posted_at"], full["quote_count"], full["link_count"], full["reaction_count"], full["has_reactions"]) == ("31", "2023-05-06", 4, 1, 7, True)
    assert (blank["post_id"], blank["empty_body"], blank["edited"], blank["link_count"], blank["word_count"], blank["forum_id"]) == (None, True, True, 0, 0, None)
    assert len(full) == 24


def test_lengths_keep_the_three_medians(spark):
    stats = aggregate.length_stats(spark.createDataFrame([(10,), (20,), (None,)], "n int"), "n").first()
    assert (stats["upper_median"], stats["median"], stats["p90"], stats["min_length"], stats["max_length"]) == (20, 10, 10, 10, 20)
    assert aggregate.length_stats(spark.createDataFrame([], "n int"), "n").first()["median"] is None


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "text string, source string")
    assert aggregate.term_counts(docs).count() == 0
    base = aggregate.lexical_baseline(aggregate.term_counts(docs)).first()
    assert (base["vocabulary"], base["tokens"], base["entropy_bits"]) == (0, 0, None)


def test_body_length_treats_zero_as_missing(spark):
    df = spark.createDataFrame([(0, "abc"), (None, None), (7, "x")], "n int, t string")
    assert [r[0] for r in df.select(T.body_length(F.col("n"), F.col("t"))).collect()] == [3, 0, 7]


@seed(7)
@settings(max_examples=10, deadline=None, database=None, derandomize=True)
@given(st.lists(st.text(max_size=40).filter(known), min_size=1, max_size=20))
def test_terms_agree_with_a_model(spark, texts):
    """Texts of code points that both Unicode versions have: the JVM's is older than the model's."""
    import regex

    model = [[t.lower() for t in regex.findall(r"[\p{L}\p{N}_'’-]+", x)] for x in texts]
    made = many(spark, lambda c: F.size(T.terms(c)), texts)
    assert made == [len(x) for x in model]


def test_small_texts(spark):
    assert many(spark, T.spaced, [" a\t\u2003b \n", "", None]) == ["a b", "", None]
    assert many(spark, T.file_name, ["a b/ç-1", "x_y"]) == ["a_b_ç_1", "x_y"]
    assert many(spark, T.word_count, ["One two, 3!", None]) == [3, 0]


def test_salted_hashes(spark):
    assert many(spark, lambda c: privacy.short_hash(c, "s"), ["a"]) == [hashlib.sha256(b"sa").hexdigest()[:16]]


def test_lexical_diversity_equals_a_plain_walk(spark):
    def plain(tokens, cut=0.72):
        seen, n, factors = set(), 0, 0.0
        for t in tokens:
            seen.add(t)
            n += 1
            if len(seen) / n <= cut:
                seen, n, factors = set(), 0, factors + 1
        factors += (1 - len(seen) / n) / (1 - cut) if n else 0.0
        return len(tokens) / factors if factors > 0 else float(len(tokens))

    r = random.Random(0)
    texts = [" ".join(r.choice("abcdefghijkl") for _ in range(r.randint(0, 80))) for _ in range(60)] + ["a a a", "a b c"]
    made = many(spark, lambda c: lexical.mtld_forward(T.terms(c)), texts)
    assert made == pytest.approx([plain(t.split()) for t in texts])


def test_step_similarity_equals_a_plain_table(spark):
    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1] / max(len(a), len(b)) if a or b else None

    r = random.Random(1)
    pairs = [tuple([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2)) for _ in range(80)] + [([], []), (["a"], [])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    made = [x["s"] for x in rows.select("i", lexical.steps_similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert made == pytest.approx([plain(a, b) for a, b in pairs])
