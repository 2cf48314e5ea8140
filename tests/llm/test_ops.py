import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import bpe, common, htmltext, idfiles, langid, matroska, mixing, neardup, neighbours, registry, simhash, suffixdedup, tokencount, words
from threadloom.operators import components

SF = "/root/testdata/sf0.001"
PATH = common.tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABHTİ   '''!?.-0123éßñΣǅ½²̱́\x1c\x85漢字🙂ﬁ\n\t.,,  "
ODD = [None, "", " ", "\n\t", "x", "é", "<|endoftext|> a", "A" * 50_000, "don't 'll 's!", "ａｂ \x00 \x1c", "a b c " * 3000]


def odd_docs(spark):
    rows = [(i if i % 4 else None, t, None if i % 3 else "en", None if i % 2 else "s", None) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[4]], SCHEMA)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def fuzz(n, seed=0, size=60):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def sf(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def library():
    return common.load_tokenizer(PATH)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_every_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


# op1


def test_held_out_languages(spark, sf):
    found = registry.QUERIES["op1_language_id"](spark, SF).toPandas().merge(sf[["doc_id", "lang", "text"]], on="doc_id")
    assert [bool(x) for x in found.held_out] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]
    assert (found[found.held_out].lang_pred == found[found.held_out].lang).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_language_of_odd_texts(spark, sf):
    model = langid.fit(docs_of(spark, []).unionByName(spark.createDataFrame(sf)))
    made = langid.predict(odd_docs(spark).withColumn("score", F.lit("clash")), model).toPandas()
    assert len(made) == len(ODD) + 2
    letters = made.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert (made[~letters].lang_pred == "und").all() and (made[~letters].score == 0).all() and (made[letters].lang_pred != "und").all()
    empty = langid.fit(docs_of(spark, []))
    assert langid.predict(docs_of(spark, ["a"]), empty).first()["lang_pred"] == "und"


def test_texts_without_a_letter(spark):
    assert langid.words_of("² ½ ① x² 12 a_b") == {"x": 1, "a": 1, "b": 1}
    model = langid.Model.from_counts(["a", "b"], [("a", "1", "x", 3), ("b", "1", "y", 3)])
    made = [r["lang_pred"] for r in langid.predict(docs_of(spark, ["²", "½ ①", "7", None, "x", "y"]), model).orderBy("doc_id").collect()]
    assert made == ["und"] * 4 + ["a", "b"]


def test_languages_equal_a_plain_scorer(spark, sf):
    """All counts of the labelled rows, one word at a time, without tables or batches."""
    import math

    train = sf[[zlib.crc32(str(i).encode()) % 5 != 0 for i in sf.doc_id]].dropna(subset=["lang", "text"]).drop_duplicates(["lang", "text"])
    langs = sorted(set(train.lang))
    units = {}
    for lang, text in zip(train.lang, train.text, strict=True):
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"^{word}$"
            for kind, unit in [("w", word), *((n, padded[i : i + n]) for n in range(1, 6) for i in range(len(padded) - n + 1))]:
                own = units.setdefault(kind, {}).setdefault(unit, dict.fromkeys(langs, 0))
                own[lang] += 1
    totals = {k: {x: sum(u[x] for u in own.values()) for x in langs} for k, own in units.items()}

    def logs(kind, unit):
        raw = [math.log((units[kind][unit][x] + 0.5) / (totals[kind][x] + 0.5 * (len(units[kind]) + 1))) for x in langs]
        return [v - sum(raw) / len(raw) for v in raw]

    def word(w):
        if w in units["w"]:
            return logs("w", w)
        padded = f"^{w}$"
        for n in range(min(5, len(padded)), 0, -1):
            found = [logs(n, padded[i : i + n]) for i in range(len(padded) - n + 1) if padded[i : i + n] in units[n]]
            if found:
                return [sum(v) / len(found) for v in zip(*found, strict=True)]
        return [0.0] * len(langs)

    made = {r["doc_id"]: r["lang_pred"] for r in registry.QUERIES["op1_language_id"](spark, SF).collect()}
    for i, text in list(zip(sf.doc_id, sf.text, strict=True))[:60]:
        found = [word(w) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        total = [sum(v) for v in zip(*found, strict=True)]
        assert made[i] == (langs[total.index(max(total))] if found else "und")


def test_backoff():
    model = langid.Model.from_counts(["a", "b"], [("a", "w", "foo", 5), ("b", "w", "bar", 5), ("a", "3", "oox", 3), ("b", "1", "z", 9), ("a", "1", "q", 1)])
    assert model.word("foo").argmax() == 0 and model.word("boox").argmax() == 0 and model.word("zzz").argmax() == 1 and not model.word("éé").any()


# op2


def test_main_text(spark):
    article = "<article><h1>T &amp; x</h1><p>One  two<br>three<p>Four &copy; 5</article>"
    html = f'<html><head><title>no</title><script>var t="</p>"</script></head><body><nav>menu</nav><div class="ad">buy</div><div class="cookie-notice">ok</div>{article}<aside>side</aside><div id="comments"><p>me too</p></div><form>f</form><footer>foot</footer></body></html>'
    rows = [(1, "https://a.example/1", html), (2, "https://a.example/2", None), (3, None, ""), (None, "x", "<p>bare <b>bold</b></p><div>next</div>"), (None, "x", "<p>bare <b>bold</b></p><div>next</div>")]
    found = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).toPandas()
    assert sorted(found.text) == sorted(["T & x\nOne two\nthree\nFour © 5", "", "", "bare bold\nnext", "bare bold\nnext"])
    assert (found.n_chars == found.text.map(len)).all()
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SNIPPETS = [
    ("<p>one <b>two</b> three</p>", "one two three"),
    ('<p>see <a href="/x">this link</a> for more.</p>', "see this link for more."),
    ("<p>Hello <script>x('</p>')</script>world</p>", "Hello world"),
    ('<p>Hello <span class="ad">buy</span> world</p>', "Hello world"),
    ("<p>x <svg><text>q</text></svg> y</p>", "x y"),
    ('<div class="content with-sidebar"><p>text</p></div>', "text"),
    ('<div id="main" class="layout-header-fixed"><article>text</article></div>', "text"),
    ("<form><p>all in one</p></form>", "all in one"),
    ("<p>Intro</p><form><p>name</p></form>", "Intro"),
    ("<p>Intro</p><article>Teaser</article><p>Real text</p>", "Intro\nTeaser\nReal text"),
    ('<h2>Story</h2><p>Body</p><article class="comment">me</article>', "Story\nBody"),
    ('<article>Story</article><div id="comments"><article>me</article><p>too</p></div>', "Story"),
    ('<article><header><h1>T</h1></header>Story</article><div class="sidebar"><article>other</article></div>', "T\nStory"),
    ("<head><title>no</title><p>a &lt;b&gt; &amp;amp; <math>x</math> a < b", "a <b> &amp; x a < b"),
    ("<p title=it's>It's</p><p data-x=\"a>b\">c\u200bd&nbsp;\ufeffe</p>", "It's\nc\u200bd \ufeffe"),
    ("<div>a<p>b</div>c", "a\nb\nc"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1\n2\n3"),
    ("<p>a<br/>b<p hidden>q</p>z", "a\nb\nz"),
    ("<p>a<!-- <p>no</p> -->b</p><textarea><p>no</textarea>c", "ab\nc"),
    ("<nav><p>menu<p>menu</nav><p>a <i>b <u>c</i> d</u> e", "a b c d e"),
    ("a <aside>b <p>c</aside> d </div></p> e", "a\nd\ne"),
    ("<", "<"),
    ("<p", ""),
]


@pytest.mark.parametrize(("html", "text"), SNIPPETS)
def test_markup(html, text):
    assert "\n".join(htmltext.blocks_of(html)) == text


def random_page(r):
    """Markup of random trees, and its blocks by a walk over the tree itself."""
    blocks, part = [], []

    def flush():
        if text := " ".join("".join(part).split()):
            blocks.append(text)
        part.clear()

    def node(depth, hidden, inline):
        kind = r.random()
        if depth > 4 or kind < 0.4:
            word = r.choice(["ab ", " c", "&amp;", "&eacute;t ", "\n x"])
            if not hidden:
                part.append({"&amp;": "&", "&eacute;t ": "ét "}.get(word, word))
            return word
        if kind < 0.6:
            tag, own = r.choice([("b", ""), ("a", ' href="/ad"'), ("span", ""), ("math", ""), ("span", ' class="ad"'), ("em", " hidden")])
            gone = bool(own) and tag != "a"
            return f"<{tag}{own}>" + "".join(node(depth + 1, hidden or gone, True) for _ in range(r.randint(0, 3))) + f"</{tag}>"
        if kind < 0.7 or inline:
            return f"<script>{r.choice(['x', '</p', '<p>'])}</script>"
        tag, own = r.choice([("div", ""), ("section", ""), ("blockquote", ""), ("nav", ""), ("footer", ""), ("div", ' class="cookie-notice"'), ("ul", ""), ("div", ' role="navigation"'), ("div", ' class="has-ads page-header"')])
        gone = tag in ("nav", "footer") or own in (' class="cookie-notice"', ' role="navigation"')
        flush()
        body = "".join(node(depth + 1, hidden or gone, False) for _ in range(r.randint(0, 4)))
        flush()
        return f"<{tag}{own}>{body}</{tag}>"

    html = "".join(node(0, False, False) for _ in range(r.randint(1, 6)))
    flush()
    return html, blocks


def test_markup_equals_a_walk_over_the_tree():
    r = random.Random(0)
    for _ in range(3000):
        html, blocks = random_page(r)
        assert htmltext.blocks_of(html) == blocks, html


def host_pages(n=40, seed=0):
    """Pages of one host whose boilerplate no tag tells: a line, a list of short blocks, and a run within a paragraph."""
    r = random.Random(seed)
    own = lambda k: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(k))
    line, tail = "subscribe now to our letter and never miss any story again", "read more of what we wrote about this here"
    menu = "".join(f"<div>{x}</div>" for x in "home about news sport culture travel food contact imprint".split())
    pages, texts = [], []
    for i in range(n):
        a, b = own(20), own(15)
        pages.append(f"<div>{line}</div>{menu}<p>{a}</p><p>{b} {tail}</p>" if i % 8 else f"<p>{a}</p><p>{b}</p>")
        texts.append(f"{a}\n{b}")
    return pages, texts


def brute_runs(texts, run, least, share):
    """Texts without the tokens that a run of `run` tokens covers which stands in so many different texts."""
    pages = {t: t.replace("\n", " \n ").split(" ") for t in set(texts) if t}
    seen = {}
    for t, w in pages.items():
        for i in range(len(w) - run + 1):
            seen.setdefault(tuple(w[i : i + run]), set()).add(t)
    out = {"": ""}
    for t, w in pages.items():
        gone = {j for i in range(len(w) - run + 1) if len(seen[tuple(w[i : i + run])]) >= max(least, share * len(pages)) for j in range(i, i + run)}
        left = " ".join(x for i, x in enumerate(w) if x == "\n" or i not in gone)
        out[t] = "\n".join(x.strip() for x in left.split("\n") if x.strip())
    return [out[t] for t in texts]


@pytest.mark.parametrize("portion", [2000, 1 << 20])
@pytest.mark.parametrize("partitions", [1, 4, 31])
def test_runs_of_a_host_decide(spark, partitions, portion):
    pages, texts = host_pages()
    pages, texts = pages + [pages[1]] * 50, texts + [texts[1]] * 50  # copies are one page
    rows = [(i, f"https://h.example/{i}", p) for i, p in enumerate(pages)] + [(1000 + i, f"https://few.example/{i}", pages[1 + i]) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions).withColumn("host", F.lit("clash")).withColumn("keys", F.lit(1))
    found = {r["page_id"]: r["text"] for r in htmltext.main_text(df, portion=portion).collect()}
    assert [found[i] for i in range(len(pages))] == texts
    assert [found[1000 + i] for i in range(3)] == ["\n".join(htmltext.blocks_of(p)) for p in pages[1:4]]


@pytest.mark.parametrize("portion", [600, 1 << 20])
def test_runs_equal_brute_force(spark, portion):
    r = random.Random(4)
    lines = [" ".join(r.choice("abcdefg") * 2 for _ in range(r.randint(3, 14))) for _ in range(8)]
    texts = ["\n".join(r.choice(lines) if r.random() < 0.6 else " ".join(r.choice("abcdefg") for _ in range(r.randint(1, 20))) for _ in range(r.randint(0, 5))) for _ in range(60)]
    rows = [(i, "https://h.example/", "".join(f"<p>{x}</p>" for x in t.split("\n"))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for share in (0.1, 0.3):
        made = [x["text"] for x in htmltext.main_text(df, run=4, share=share, portion=portion).orderBy("page_id").collect()]
        assert made == brute_runs(texts, 4, 4, share)
        assert share > 0.1 or made != texts


def test_suffix_ranks_against_slices():
    tokens = np.random.default_rng(0).integers(0, 3, 200)
    rank = htmltext.suffix_ranks(tokens, 8)
    for i, j in itertools.combinations(range(193), 2):
        assert (rank[i] == rank[j]) == (tokens[i : i + 8].tolist() == tokens[j : j + 8].tolist())


def test_op2_on_the_table(spark):
    """The table's articles hold nothing but h1, p, b and br."""
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    found = {r["page_id"]: r["text"] for r in registry.QUERIES["op2_html_text"](spark, SF).collect()}
    for i, html in zip(pages.page_id, pages.html, strict=True):
        inside = html[html.index("<article>") : html.index("</article>")]
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|br|h1)>", inside))
        assert found[i] == "\n".join(x for x in parts if x)


# op3, op10


def test_counts_of_every_code_point(library):
    machine = tokencount.Transducer(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c % 17 == 0 or 0xA700 <= c < 0xA800 or 0x10D00 <= c < 0x10E00)]
    for i in range(0, len(points), 2000):
        part = points[i : i + 2000]
        assert machine.counts(part).tolist() == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_counts_without_white_space(library):
    r = random.Random(2)
    texts = ["".join(r.choice(x) for _ in range(30_000)) for x in ("abcdefghij", "ab", "!?.,-", "a1!'", "'sretvlmd")] + ["ab" * 20_000, "a" * 30_000]
    assert tokencount.Transducer(PATH).counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def clashing(spark, rows=None):
    """Odd documents (or none) with extra columns of the names that operators make."""
    df = odd_docs(spark) if rows is None else docs_of(spark, rows)
    for name in ("n_tokens", "ids", "__rid", "rid", "fp", "media", "n_bytes", "start", "size", "decoded", "key"):
        df = df.withColumn(name, F.lit("clash"))
    return df


OPERATORS = {
    "counts": lambda df: tokencount.count_tokens(df, PATH),
    "media": lambda df: matroska.digest(matroska.store(df)),
    "packets": lambda df: matroska.packets(matroska.store(df)),
    "prints": lambda df: simhash.grouped(simhash.fingerprints(df)),
    "encode": lambda df: bpe.decode(bpe.encode(df, PATH, columns=("ids", "n_tokens", "size", "decoded")), PATH),
    "repeats": suffixdedup.without_repeats,
    "near": neardup.without_near_duplicates,
    "mix": lambda df: mixing.mix(df.withColumn("size", F.length("text"))),
    "languages": lambda df: langid.predict(df, langid.fit(df)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_empty_tables(spark, name):
    assert OPERATORS[name](clashing(spark, [])).count() == 0
    made = OPERATORS[name](clashing(spark))
    n = made.count()
    assert len(set(made.columns)) == len(made.columns)
    assert n == {"packets": n, "near": len({" ".join((t or "").lower().split()) for t in ODD})}.get(name, len(ODD) + 2)
    if name in ("repeats", "near"):
        assert made.columns == clashing(spark).columns and {r["__rid"] for r in made.collect()} == {"clash"}


def test_id_files_with_clashing_names(spark, tmp_path):
    idfiles.write(clashing(spark), PATH, str(tmp_path / "ids"))
    assert idfiles.read(spark.read.parquet(str(tmp_path / "ids"))).count() == len(ODD) + 2


def test_counts_equal_the_library(library):
    texts = [t or "" for t in ODD] + fuzz(1500)
    assert tokencount.Transducer(PATH).counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_with_a_small_table(library):
    texts = fuzz(300, 1) + ["".join(chr(c) for c in range(0x4E00, 0x4F00)), "x" * 5000]
    machine = tokencount.Transducer(PATH, most_states=50)
    for i in range(0, len(texts), 40):
        assert machine.counts(texts[i : i + 40]).tolist() == [len(e.ids) for e in library.encode_batch(texts[i : i + 40], add_special_tokens=False)]


def test_word_table_equals_the_library(library):
    table = words.WordTable(PATH)
    texts = ODD + fuzz(1500, 2) + ["Ḫ H̱ word. İx, éa, x,,", "A<|EndOfText|>"]
    for x, e in zip(table.encode(texts), library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert x.tolist() == e.ids


def test_word_table_that_shrinks(library, monkeypatch):
    monkeypatch.setattr(words, "TABLE", 40)
    table = words.WordTable(PATH)
    r = random.Random(9)
    for _ in range(30):
        texts = [" ".join(f"w{r.randint(0, 30)} {r.choice(['the', 'of', 'x.,'])}" for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in table.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(table.place) == len(table.words) <= 40 + 33


def test_encode_and_decode(spark, library):
    made = bpe.decode(bpe.encode(odd_docs(spark), PATH, columns=("source",)), PATH).toPandas()
    assert len(made) == len(ODD) + 2
    expected = sorted((tuple(e), library.decode(e, skip_special_tokens=False)) for e in (x.ids for x in library.encode_batch([t or "" for t in [*ODD, ODD[4], ODD[4]]], add_special_tokens=False)))
    assert sorted((tuple(np.frombuffer(i, "<u4").tolist()), d) for i, d in zip(made.ids, made.decoded, strict=True)) == expected
    assert bpe.encode(docs_of(spark, []), PATH).count() == 0


def test_op3_and_op10_on_the_table(spark, sf, library):
    ids = dict(zip(sf.doc_id, (e.ids for e in library.encode_batch(sf.text.tolist(), add_special_tokens=False)), strict=True))
    for r in registry.QUERIES["op3_token_counts"](spark, SF).collect():
        assert (r["n_tokens"], r["over_limit"]) == (len(ids[r["doc_id"]]), len(ids[r["doc_id"]]) > 2048)
    for r in registry.QUERIES["op10_bpe_encode_decode"](spark, SF).collect():
        own = ids[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()


# op4


@pytest.mark.parametrize("size", [0, 1, 576, 577, 576 * 9, 576 * 256, 576 * 600 + 5])
def test_matroska_round_trip(size):
    payload, n = matroska.payload_of("x" * size)
    data = matroska.write(payload)
    parsed = matroska.parse(data)
    assert n == size and b"".join(data[p.start : p.start + p.size] for p in parsed.packets) == payload
    assert parsed.doc_type == "matroska" and [c for _, _, c in parsed.cues] == parsed.clusters
    assert [p.timestamp for p in parsed.packets] == [i * matroska.TICKS for i in range(len(payload) // 576)]


def test_lacings_of_uneven_frames():
    frames = [b"a" * n for n in (1, 700, 255, 0, 510, 3)]
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        body = matroska.laced(frames, lacing)
        sizes, at = matroska.sizes_of(body, 0, len(body), lacing)
        assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)
    with pytest.raises(ValueError):
        matroska.parse(matroska.write(b"x" * 576)[:-3])


def test_media_of_odd_texts(spark):
    made = matroska.digest(matroska.store(odd_docs(spark))).toPandas()
    assert len(made) == len(ODD) + 2 and (made.payload_bytes % 576 == 0).all() and (made.payload_bytes > 0).all()
    assert matroska.packets(matroska.store(docs_of(spark, ["x" * 5000]))).count() == 9
    assert made.groupby("payload_sha256").media_sha256.nunique().max() == 1


def test_clusters_of_unknown_size():
    payload, _ = matroska.payload_of("x" * 576 * 600)
    data = matroska.write(payload)
    at = [p for p in range(len(data) - 4) if data[p : p + 4] == b"\x1f\x43\xb6\x75"]
    made, last = b"", 0
    for p in at:
        _, body, _ = matroska.read_vint(data, p, keep=True)
        _, _, width = matroska.read_vint(data, body)
        made += data[last:body] + (((1 << 7 * width) - 1) | 1 << 7 * width).to_bytes(width, "big")
        last = body + width
    made += data[last:]
    parsed, whole = matroska.parse(made), matroska.parse(data)
    assert [(p.timestamp, p.size, p.cluster) for p in parsed.packets] == [(p.timestamp, p.size, p.cluster) for p in whole.packets]
    assert len(parsed.clusters) == 3 and len(parsed.packets) == 600 and len(parsed.cues) == 3
    assert whole.tracks == [matroska.Track(1, 2, "A_PCM/INT/LIT", matroska.TICKS * matroska.SCALE)]


def test_laced_frames_take_their_track_s_duration():
    e, n = matroska.element, matroska.number
    frames = [b"a" * 3, b"b" * 5, b"c" * 4]

    def made(tracks, blocks):
        return e(matroska.SEGMENT, tracks + e(matroska.CLUSTER, n(matroska.TIMESTAMP, 10) + blocks))

    block = matroska.vint(2) + b"\x00\x05\x80" [:2] + bytes([matroska.XIPH << 1]) + matroska.laced(frames, matroska.XIPH)
    timed = e(matroska.TRACKS, e(matroska.TRACK_ENTRY, n(matroska.TRACK_NUMBER, 2) + n(matroska.DEFAULT_DURATION, 40_000_000)))
    assert [p.timestamp for p in matroska.parse(made(timed, e(matroska.SIMPLE_BLOCK, block))).packets] == [15, 55, 95]
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, block) + n(matroska.BLOCK_DURATION, 30))
    assert [p.timestamp for p in matroska.parse(made(b"", group)).packets] == [15, 25, 35]


def test_op4_on_the_table(spark, sf):
    for r, text in zip(registry.QUERIES["op4_media_columns"](spark, SF).orderBy("doc_id").collect(), sf.sort_values("doc_id").text, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        data = matroska.write(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest())


# op5


def brute_groups(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_groups(spark, sf):
    def plain(text):
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        w = common.WORD_RE.findall(own)
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    sf = sf.sort_values("doc_id")
    prints = [plain(t) for t in sf.text]
    ids = sf.doc_id.tolist()
    expected = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, brute_groups(prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op5_simhash_groups"](spark, SF).collect()} == expected


def test_golay_keys():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 23, 500)
    for b in (a, a ^ 1 << r.integers(0, 23, 500), a ^ 1 << r.integers(0, 23, 500) ^ 0, a ^ (1 << r.integers(0, 23, 500)) ^ (1 << r.integers(0, 23, 500))):
        x, y = simhash.golay_keys(a), simhash.golay_keys(b)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(x, y, strict=True))
    assert set((simhash.golay_keys(a) >= 0).sum(axis=1)) <= {1, 6}


@pytest.mark.parametrize("pairwise", [4, 64])
def test_dense_groups(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    r = random.Random(1)
    prints = sorted({base ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 5))) for base in (5, 1 << 40, (1 << 62) - 1) for _ in range(60)})
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")
    assert [c["component_id"] for c in simhash.grouped(rows).orderBy("doc_id").collect()] == brute_groups(prints)


def test_groups_of_odd_texts(spark):
    made = simhash.grouped(simhash.fingerprints(odd_docs(spark))).toPandas()
    assert len(made) == len(ODD) + 2
    assert simhash.grouped(simhash.fingerprints(docs_of(spark, []))).count() == 0
    assert {r["fp"] for r in simhash.fingerprints(docs_of(spark, [None, "", " \n"])).collect()} == {0}


def test_components_of_a_long_path(spark):
    n = 60
    path = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 30], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.connected(path).collect()}
    assert roots == {i: 0 if i <= 30 else 31 for i in range(n + 1)}
    assert components.connected(path.limit(0)).count() == 0


# op6


def test_mixture_equals_a_plain_one(spark):
    r = random.Random(0)
    rows = [(i, r.choice(["a", "b", "c", None, "é"]), r.randint(0, 50)) for i in range(400)] + [(None, "a", 5), (7, "a", 9), (7, "a", 9)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("rank", F.lit(1)), fanout=4).toPandas()
    assert len(made) == len(rows)
    names = sorted({s for _, s, _ in rows if s is not None}) + [None]
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in target]
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
    for s in names:
        own = made[made.source.isna()] if s is None else made[made.source == s]
        assert own.target.iloc[0] == pytest.approx(target[s]) and own.source_size.iloc[0] == size[s]
        assert abs(own.taken.sum() - target[s]) <= 25 and (own.taken <= 2 * own["size"]).all()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long"), fanout=64).toPandas()
    key = lambda d: sorted(map(str, zip(d.doc_id, d.source, d["size"], d.taken, strict=True)))
    assert key(made) == key(again)


def test_mixture_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    zero = mixing.mix(spark.createDataFrame([(1, None, 0), (2, "a", None)], "doc_id long, source string, size long")).toPandas()
    assert zero.taken.tolist() == [0, 0]


def test_mixture_uses_no_python(spark):
    plan = registry.QUERIES["op6_mix_sources"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# op7


@pytest.mark.parametrize("tile", [7, 4096])
def test_neighbours_equal_brute_force(spark, tile):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(150, 8)).astype(np.float32)
    vectors[20:70] = vectors[20]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [None] * 8), (280, [1.0]), (None, [1.0] * 8), (0, [float(x) for x in vectors[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    made = neighbours.nearest(df, neighbours.is_query(F.col("vec_id")), 20, tile=tile).toPandas()
    for q in range(0, 150, 20):
        scores = [(-neighbours.products(vectors[[q]].astype(float), vectors[[i]].astype(float))[0], i) for i in range(150) if i != q]
        own = made[made.query_id == q].sort_values("rank")
        assert list(zip(-own.score, own.vec_id, strict=True)) == sorted(scores)[:20] and own["rank"].tolist() == list(range(1, 21))
    assert set(made.query_id) == set(range(0, 150, 20))


def test_vectors_of_several_lengths_and_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "COLUMNS", 64)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=200 if i % 2 else 3).tolist()) for i in range(0, 300, 5)]
    made = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), neighbours.is_query(F.col("vec_id")), 3).toPandas()
    vectors = {i: np.array(v) for i, v in rows}
    for q in range(0, 300, 20):
        near = sorted((-neighbours.products(vectors[q][None], v[None])[0], i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:3]
        own = made[made.query_id == q].sort_values("rank")
        assert list(zip(-own.score, own.vec_id, strict=True)) == near


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], kind), neighbours.is_query(F.col("vec_id"))).count() == 0
    assert [r["vec_id"] for r in neighbours.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind), neighbours.is_query(F.col("vec_id"))).collect()] == [1]


# op8


def brute_repeats(texts):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        flags = [False] * len(w)
        for j in range(len(w) - 49):
            if seen.setdefault(tuple(w[j : j + 50]), (i, j)) != (i, j):
                flags[j : j + 50] = [True] * 50
        out[i] = {j for j, f in enumerate(flags) if f}
    return out


def passages(seed=0):
    r = random.Random(seed)
    own = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    shared = [own(n) for n in (50, 60, 120, 49)]
    texts = [" ".join([*own(r.randint(0, 80)), *r.choice(shared), *own(r.randint(0, 80))]) for _ in range(60)]
    return [*texts, texts[0], " ".join(own(300)), None, ""]


def test_repeats_equal_brute_force(spark):
    texts = passages()
    found = {i: set() for i in range(len(texts))}
    for r in suffixdedup.stretches(suffixdedup.repeats(docs_of(spark, texts))).collect():
        for s in r["stretches"]:
            assert s["first_doc_id"] <= r["doc_id"]
            found[r["doc_id"]] |= set(range(s["start"], s["stop"]))
    assert found == brute_repeats(texts)


def test_texts_without_repeats(spark):
    texts = passages(1)
    made = suffixdedup.without_repeats(docs_of(spark, texts).withColumn("start", F.lit(1))).orderBy("doc_id").collect()
    assert len(made) == len(texts) and made[-2]["text"] is None and made[-3]["text"] == texts[-3]
    left = brute_repeats([r["text"] for r in made])
    assert not any(left.values())
    assert {w for t in texts for w in (t or "").split()} == {w for r in made for w in (r["text"] or "").split()}


def marked(spark, texts):
    found = {i: set() for i in range(len(texts))}
    for r in suffixdedup.stretches(suffixdedup.repeats(docs_of(spark, texts))).collect():
        for s in r["stretches"]:
            found[r["doc_id"]] |= set(range(s["start"], s["stop"]))
    return found


def test_repeats_through_a_frequent_line(spark):
    r = random.Random(7)
    own = lambda n: [f"v{r.randint(0, 10**7)}" for _ in range(n)]
    line = own(30)
    texts = [" ".join([*own(40), *line, *own(40)]) for _ in range(1000)]
    for _ in range(60):
        before = own(30)
        texts += [" ".join([*own(40), *before, *line, *own(40)]) for _ in range(2)]
    r.shuffle(texts)
    expected = brute_repeats(texts)
    assert sum(map(len, expected.values())) >= 60 * 60
    assert marked(spark, texts) == expected


@pytest.mark.parametrize("size", [51, 60])
def test_one_copy_of_a_passage_among_recurring_words(spark, size):
    r = random.Random(size)
    shared = [f"p{i}" for i in range(size)]
    around = lambda: [f"z{int(r.paretovariate(0.7)) % 1000}" for _ in range(60)]
    texts = [" ".join([*around(), *shared, *around()]) for _ in range(1200)]
    found = marked(spark, texts)
    assert found == brute_repeats(texts)
    assert sum(not set(range(60, 60 + size)) <= own for own in found.values()) == 1


def test_repeats_in_odd_texts(spark):
    made = suffixdedup.without_repeats(odd_docs(spark)).toPandas()
    assert len(made) == len(ODD) + 2
    assert any(t == "a b c" for t in made.text.dropna().map(lambda t: " ".join(t.split())))
    assert suffixdedup.repeats(docs_of(spark, [])).count() == 0


def test_minimisers_are_in_every_window():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 400).astype(np.uint64)
    h, at, first, last = suffixdedup.minimisers(hashes, np.array([170, 180, 400]))
    covered = sorted(s for a, b in zip(first, last, strict=True) for s in range(a, b + 1))
    assert covered == [*range(0, 121), *range(180, 351)]
    assert all(a - 0 >= f and a + suffixdedup.GRAM <= f + 50 and a >= la for a, f, la in zip(at, first, last, strict=True))


# op9


def test_variable_length_coding():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = idfiles.pack(values)
        assert len(control) == -(-n // 4) and idfiles.unpack(control, data, n).tolist() == values.tolist()


def test_ranking():
    ranked, ranks = idfiles.ranking(np.array([7, 9, 9, 7, 9, 1], np.uint32))
    assert ranked.tolist() == [9, 7, 1] and ranked[ranks].tolist() == [7, 9, 9, 7, 9, 1]


def test_id_files(spark, library, tmp_path):
    docs = odd_docs(spark)
    idfiles.write(docs, PATH, str(tmp_path / "ids"), block_bytes=1000)
    rows = sorted(idfiles.read(spark.read.parquet(str(tmp_path / "ids"))).collect(), key=lambda r: r["start"])
    start, found = 0, []
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        start += len(ids)
        found.append((r["doc_id"], ids))
    assert [x is not None for x, _ in found] == sorted(x is not None for x, _ in found)
    assert [x for x, _ in found if x is not None] == sorted(x for x, _ in found if x is not None)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(((d["doc_id"], [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2]) for d in docs.collect()), key=key)
    idfiles.write(docs_of(spark, []), PATH, str(tmp_path / "none"))
    assert idfiles.read(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_op9_on_the_table(spark, sf, library):
    rows = sorted(registry.QUERIES["op9_token_id_files"](spark, SF).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, (doc_id, text) in zip(rows, sf.sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op8_on_the_table(spark, sf):
    texts = sf.sort_values("doc_id")
    found = {i: set() for i in range(len(texts))}
    place = {d: i for i, d in enumerate(texts.doc_id)}
    for r in registry.QUERIES["op8_suffix_repeats"](spark, SF).collect():
        found[place[r["doc_id"]]] |= set(range(r["start_word"], r["stop_word"]))
    split = [" ".join(common.WORD_RE.findall(t or "")) for t in texts.text]
    assert found == brute_repeats(split)


# near duplicates and the pipeline


def near_texts():
    r = random.Random(3)
    base = [[f"w{r.randint(0, 10**6)}" for _ in range(300)] for _ in range(6)]
    edit = lambda w, n: [x if i not in set(r.sample(range(300), n)) else "new" for i, x in enumerate(w)]
    return [" ".join(x) for x in base] + [" ".join(edit(base[0], 2)), " ".join(base[1]).upper(), " ".join(base[2]), " ".join(edit(base[3], 120)), "short text", "short text", "", None]


def test_one_of_each_group_stays(spark):
    texts = near_texts()
    kept = sorted(r["doc_id"] for r in neardup.without_near_duplicates(docs_of(spark, texts).withColumn("fp", F.lit(1))).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 9, 10, 12]
    assert neardup.without_near_duplicates(docs_of(spark, [])).count() == 0
    odd = neardup.without_near_duplicates(odd_docs(spark)).toPandas()
    assert len(odd) == len({" ".join((t or "").lower().split()) for t in ODD})


def brute_near(texts):
    """The first text of each component of exact similarity 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


@pytest.mark.parametrize("tile", [16, 256])
def test_stars_of_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    r = random.Random(5)
    texts = []
    for star in range(2):
        base = [f"s{star}w{i}" for i in range(300)]
        made = [" ".join(base)]
        for i in range(220):
            own = list(base)
            for j in range(6):
                own[r.randrange(50 * j + 5, 50 * j + 45)] = f"edit{i}x{j}"
            made.append(" ".join(own))
        texts += made
    r.shuffle(texts)
    expected = brute_near(texts)
    assert len(expected) == 2
    assert sorted(x["doc_id"] for x in neardup.without_near_duplicates(docs_of(spark, texts)).collect()) == expected


def test_tiles_equal_brute_force(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    r = np.random.default_rng(0)
    sets = [np.sort(r.choice(40, r.integers(0, 40), replace=False)).astype(np.uint64) for _ in range(60)]
    for side in (np.zeros(60, int), np.arange(60) % 2):
        for least in (0.4, 0.6):
            joined = simple = {i: i for i in range(60)}
            pairs = [(i, j) for i, j in itertools.combinations(range(60), 2) if (side[i] != side[j] or not side.any()) and neardup.similarity(sets[i].tobytes(), sets[j].tobytes()) >= least]
            groups = []
            for found in (pairs, neardup.alike(side, np.arange(60), sets, least)):
                joined = dict(simple)
                for i, j in found:
                    old, new = joined[i], joined[j]
                    joined = {k: new if v == old else v for k, v in joined.items()}
                groups.append({frozenset(k for k in joined if joined[k] == v) for v in joined.values()})
            assert groups[0] == groups[1]


def brute_cut(texts):
    """The texts (in the order of places) without the words that a run of 50 covers which stands in an earlier place."""
    out = []
    for own, text in zip(brute_repeats([" ".join(common.WORD_RE.findall(t or "")) for t in texts]).values(), texts, strict=True):
        places = [m.span() for m in common.WORD_RE.finditer(text or "")]
        runs = [[k for k, _ in g] for gone, g in itertools.groupby(((i, i in own) for i in range(len(places))), key=lambda x: x[1]) if not gone]
        out.append("\n".join(text[places[r[0]][0] : places[r[-1]][1]] for r in runs) if own else text)
    return out


def test_pipeline_equals_brute_force(spark, library, tmp_path):
    """Each stage on what the one before kept, against a plain version of it."""
    import duckdb

    import corpus_pipeline as p

    rows = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id").to_dict("records")[:140]
    r = random.Random(11)
    passage = " ".join(f"q{i}" for i in range(70))
    base = rows[3]["text"].split()
    extra = [rows[5]["text"].upper(), " ".join([*base[:-1], "changed"]), *(" ".join([*(f"z{r.randint(0, 10**6)}" for _ in range(60)), passage]) for _ in range(5)), "123 ½", "", None]
    rows += [{"doc_id": 10_000 + i, "text": t, "lang": None, "source": rows[i]["source"], "n_chars": len(t or "")} for i, t in enumerate(extra)]
    docs = spark.createDataFrame([tuple(x[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for x in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in p.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(to := common.folder(spark, "test"))
        docs = spark.read.parquet(to)
        kept.append(sorted((x.asDict() for x in docs.collect()), key=lambda x: x["doc_id"]))
    language, near, cut, mixed, ids = kept
    assert [x["doc_id"] for x in language] == [x["doc_id"] for x in rows if any(c.isalpha() for c in x["text"] or "")]
    assert all(x["lang"] == y["lang"] for x, y in zip(language, rows, strict=False) if x["doc_id"] == y["doc_id"] and y["lang"])
    ascii_lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    first = brute_near([" ".join(common.WORD_RE.findall(ascii_lower(x["text"]))) for x in language])
    assert [x["doc_id"] for x in near] == [language[i]["doc_id"] for i in first] and len(near) <= len(language) - 2
    assert [x["text"] for x in cut] == brute_cut([x["text"] for x in near]) and sum(x["text"] != y["text"] for x, y in zip(cut, near, strict=True)) >= 4
    c = duckdb.connect()
    table = __import__("pandas").DataFrame(cut)
    c.register("cut", table)
    taken = dict(c.sql("WITH " + mixing.MIX_SQL.format(docs="cut", certain=repr(mixing.CERTAIN)) + "SELECT doc_id, n FROM mixed WHERE n > 0").fetchall())
    assert {k: len(list(g)) for k, g in itertools.groupby(x["doc_id"] for x in mixed)} == taken
    texts = {x["doc_id"]: x["text"] for x in mixed}
    assert [x["doc_id"] for x in ids] == [x["doc_id"] for x in mixed]
    for x in ids:
        own = library.encode(texts[x["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(x["ids"], "<u4").tolist() == own and x["decoded"] == library.decode(own, skip_special_tokens=False)
    assert p.run(spark, str(tmp_path)).count() == len(ids)


def test_queries_that_sql_expresses(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in registry.ORACLE_SQL.items():
        a, b = registry.QUERIES[name](spark, SF).toPandas(), c.sql(sql).df()
        cols = sorted(a.columns)
        row = lambda d: sorted(json.dumps([round(v, 9) if isinstance(v, float) else int(v) for v in r]) for r in d[cols].astype(object).itertuples(index=False))  # noqa: E731, B023
        assert row(a) == row(b)


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_a_task_of_the_pipeline_has_one_python_worker(spark):
    """Workers share their executor's memory and outlive their tasks, so two in a task are four for two cores."""
    import corpus_pipeline as p

    docs = odd_docs(spark)
    made = p.token_ids(spark, docs, SF)
    assert python_steps(made) == 1
    apart = bpe.decode(bpe.encode(docs, PATH, columns=("source", "lang")), PATH)
    assert made.columns == apart.columns and made.dtypes == apart.dtypes
    assert sorted(map(str, made.collect())) == sorted(map(str, apart.collect()))
    texts = ["a b c d e f g", "a b c d e f g h", "x y z", "", "a b c d e f g"]
    keyed = docs_of(spark, texts).select(suffixdedup.row_id(F.col("doc_id"), F.col("text")).alias("rid"), "text")
    sketches = spark.createDataFrame([(r.rid, 1, neardup.segments(simhash.shingle_hashes(r.text, 2)).tolist()) for r in keyed.collect()[:4]], "rid long, fp long, segments array<long>")
    assert python_steps(neardup.edges(keyed, sketches, 0.8, 2)) == 0
