"""Main text of web pages: the markup says what stands outside the article, and a host's suffix arrays which runs its pages share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, stored, table
from .hashing import STEP, mixed

#: A repeated run has so many tokens at least (a power of two),
RUN = 8
#: and stands on so many different pages of its host at least, and on such a share of them.
PAGES = 4
SHARE = 0.5
#: Bytes of pages that one suffix array takes; a host of more has several, and their counts are added up.
PORTION = 1 << 20

# Fixed values of HTML: elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("script style noscript noembed noframes template head title svg iframe object canvas audio video select textarea button datalist option".split())
APART = frozenset("nav footer aside menu dialog search".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "li", "dd", "dt", "caption", "tbody", "thead", "tfoot", "legend", "summary"} | {"li", "dd", "dt"}
TABLES = frozenset("table caption tbody thead tfoot tr td th".split())
SCOPE = frozenset("table td th caption template object html".split())
IN_HEAD = frozenset("head html meta link base title script style noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert toolbar".split())
#: What closes an open element of the same family, and where the search for it ends.
FAMILY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
FENCES = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "td": "tr table", "th": "tr table", "tr": "tbody thead tfoot table"}

#: A class or id marks an element as not the article if its first or last word is one of these,
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead topbar footer sidebar widget notice notices alert cookie cookies consent gdpr popup modal newsletter subscribe signup login share sharing social "
    "pagination pager toolbar skip related recommended".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: unless its first word speaks of a state or a layout, or its last one of what holds the article.
STATES = frozenset("has with without no not is js layout page body".split())
HOLDERS = frozenset("layout page content body wrapper wrap container main grid site text article entry post story".split())
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))                                                # a comment
    |(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|[^>=]++)*+)(?:>|\Z)  # a tag: quotes count in values only
    |[!?/][^>]*+(?:>|\Z))""",
    re.S | re.X,
)
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attributes(text: str) -> dict[str, str]:
    """An element's attributes by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    if TELLING.search(text):
        for name, *values in ATTRIBUTE.findall(text):
            found.setdefault(name.lower(), unescape("".join(values)))
    return found


def mark(names: str, inside: bool) -> str:
    """The word by which a class or id marks an element, or nothing. A header inside an article is the article's."""
    for token in names.split():
        parts = WORDS.findall(CAMEL.sub(" ", token).lower())
        if not parts or parts[0] in STATES:
            continue
        if parts[0] in COMMENTS or parts[-1] in COMMENTS:
            return "comments"
        if parts[-1] not in HOLDERS:
            for word in (parts[0], parts[-1]):
                if word in MARKS and not (word == "header" and inside):
                    return word
    return ""


class Page:
    """Blocks of visible text in page order, each a list of pieces with the marked element that holds them.

    Block elements end a block, inline ones never do. What an element hides by its tag, role or state is dropped at once,
    and nothing but its own text. What a name (or a form) marks is decided when the whole page is known.
    """

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, int]] = []  # tag, hidden, the marked element around it
        self.hidden = 0
        self.now = -1  # the innermost open marked element
        self.above: list[int] = []  # of marked elements: the marked element around each, its mark, and what it holds
        self.kind: list[str] = []
        self.holds: list[set[str]] = []
        self.articles = False
        self.pieces: list[tuple[str, int]] = []
        self.blocks: list[list[tuple[str, int]]] = []

    def flush(self) -> None:
        if self.pieces:
            self.blocks.append(self.pieces)
            self.pieces = []

    def pop(self, i: int) -> None:
        """Closes the element at place i and all within it."""
        self.now = self.open[i][2]
        self.hidden -= sum(x[1] for x in self.open[i:])
        del self.open[i:]

    def close(self, tags: tuple[str, ...], fences: frozenset[str] | list[str]) -> bool:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.pop(i)
                return True
            if self.open[i][0] in fences:
                break
        return False

    def start(self, tag: str, rest: str) -> None:
        if tag in ("html", "body"):
            self.close(("head",), ())
            return self.flush()
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.pop(len(self.open) - 1)
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P:
                self.close(("p",), SCOPE | {"button"})
            if tag in FAMILY:
                self.close(FAMILY[tag], FENCES[tag].split())
        if tag in VOID:
            return
        own = attributes(rest) if rest else {}
        inside = any(t in ("article", "main") for t, _, _ in self.open)
        hide = tag in HIDDEN or tag in APART or (tag == "header" and not inside)
        if own and tag != "main":
            hide = hide or "hidden" in own or own.get("role", "").strip().lower() in ROLES or own.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(own.get("style", "")))
        self.open.append((tag, hide, self.now))
        self.hidden += hide
        if self.hidden:
            return
        word = "" if tag == "main" else mark(f"{own.get('class', '')} {own.get('id', '')}", inside) or ("form" if tag == "form" or own.get("role") == "form" else "")
        if tag in ("main", "article", "p") and not word:
            self.articles = self.articles or (tag == "article" and self.now < 0)
            at = self.now
            while at >= 0:
                self.holds[at].add(tag)
                at = self.above[at]
        if word:
            self.above.append(self.now)
            self.kind.append(word)
            self.holds.append(set())
            self.now = len(self.kind) - 1

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return self.flush()
        if tag in BLOCKS:
            self.flush()
            fences = ("table",) if tag in TABLES - {"table"} else () if tag == "table" else SCOPE
            self.close((tag,), fences)
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if self.open[i][1] or (self.open[i + 1][2] if i + 1 < len(self.open) else self.now) != self.open[i][2]:
                    self.pop(i)
                else:
                    del self.open[i]
                return

    def data(self, text: str) -> None:
        if self.open and self.open[-1][0] == "head" and text.strip():
            self.pop(len(self.open) - 1)
        if not self.hidden:
            self.pieces.append((text, self.now))

    def read(self, html: str) -> None:
        at = 0
        while found := TAG.search(html, at):
            if found.start() > at:
                self.data(html[at : found.start()])
            at = found.end()
            if not (tag := found[2]):
                continue
            tag = tag.lower()
            if found[1]:
                self.end(tag)
                continue
            rest = found[3]
            self.start(tag, rest)
            if rest.endswith("/") and tag not in BLOCKS and tag not in VOID:
                self.end(tag)
            elif tag in RAW:
                over = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                if tag == "xmp":
                    self.data(html[at : over.start() if over else len(html)])
                at = over.start() if over else len(html)
        if at < len(html):
            self.data(html[at:])
        self.flush()

    def kept(self) -> list[str]:
        """The blocks without what marked elements hold.

        A mark does not count for an element around the main element, nor for one around an article where no article stands
        free, but comments do. A form that holds all that is left, in paragraphs, is the page itself.
        """
        gone = [not ("main" in own or ("article" in own and not self.articles and word != "comments")) for word, own in zip(self.kind, self.holds, strict=True)]

        def texts() -> list[str]:
            under = list(gone)
            for i, up in enumerate(self.above):
                under[i] = under[i] or (up >= 0 and under[up])
            made = (" ".join(unescape("".join(t for t, i in block if i < 0 or not under[i])).split()) for block in self.blocks)
            return [x for x in made if x]

        found = texts()
        if not found and "form" in self.kind:
            gone = [x and not (word == "form" and "p" in own) for x, word, own in zip(gone, self.kind, self.holds, strict=True)]
            found = texts()
        return found


def blocks_of(html: str) -> list[str]:
    """The blocks that the markup leaves to the article, with one space for white space and character references decoded."""
    page = Page()
    page.read(html)
    return page.kept()


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """For each position, a number that is equal for positions whose next `length` (a power of two) tokens are equal, in the suffix array's order: prefix doubling, stopped at that depth."""
    rank = np.unique(tokens, return_inverse=True)[1].reshape(-1).astype(np.int64)
    step = 1
    while step < length:
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        rank = np.unique(rank * (rank.max(initial=0) + 2) + after, return_inverse=True)[1].reshape(-1).astype(np.int64)
        step *= 2
    return rank


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The tokens of all pages in turn by number, the page of each, a hash of each number's word, and the words. Line ends between blocks are tokens."""
    split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n "), " ")
    words = split.flatten().dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy())), hashes, distinct


def run_keys(hashes: np.ndarray, starts: np.ndarray, run: int) -> np.ndarray:
    """A hash of the `run` tokens from each start on; hashes: of the stream's tokens."""
    keys = np.zeros(len(starts), np.uint64)
    for i in range(run):
        keys = keys * STEP + hashes[starts + i]
    return mixed(keys).view(np.int64)


def starts_of(page: np.ndarray, run: int) -> np.ndarray:
    """The positions from which a whole run stands on the same page."""
    return np.flatnonzero(page[: len(page) - run + 1] == page[run - 1 :]) if len(page) >= run else np.zeros(0, np.int64)


def shared_runs(texts: list[str], least: float, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the runs that stand on `least` or more of the texts, and on how many.

    The pages' streams stand in one suffix array. A longer substring that so many pages share is a chain of such runs, each
    of which they share, so a deeper order would cover the same tokens.
    """
    tokens, page, hashes, _ = stream(texts)
    starts = starts_of(page, run)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = suffix_ranks(tokens, run)[starts]
    order = np.argsort(rank, kind="stable")  # pages rise within a rank
    rank, on = rank[order], page[starts][order]
    new = np.concatenate([[True], np.diff(rank) != 0])
    spread = np.bincount(np.cumsum(new) - 1, weights=new | np.concatenate([[True], np.diff(on) != 0])).astype(np.int64)
    firsts = starts[order[np.flatnonzero(new)]]
    return run_keys(hashes[tokens], firsts[spread >= least], run), spread[spread >= least]


def counted_runs(texts: list[str], wanted: np.ndarray, run: int = RUN) -> np.ndarray:
    """On how many of the texts each wanted run stands."""
    tokens, page, hashes, _ = stream(texts)
    starts = starts_of(page, run)
    keys = run_keys(hashes[tokens], starts, run)
    order = np.argsort(wanted)
    at = order[np.minimum(np.searchsorted(wanted, keys, sorter=order), len(wanted) - 1)]
    hit = wanted[at] == keys
    pairs = np.unique(np.stack([at[hit], page[starts[hit]]]), axis=1)
    return np.bincount(pairs[0], minlength=len(wanted))


def without_runs(text: str, keys: np.ndarray, run: int = RUN) -> str:
    """The text without the tokens that runs of these keys cover; what else a block has stays, and a block without tokens goes."""
    if not text or not len(keys):
        return text
    tokens, page, hashes, words = stream([text])
    starts = starts_of(page, run)
    hit = starts[np.isin(run_keys(hashes[tokens], starts, run), keys)]
    if not len(hit):
        return text
    covered = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + run, -1)
    gone = np.cumsum(covered)[:-1] > 0
    left = " ".join(words[t] for t, out in zip(tokens.tolist(), gone.tolist(), strict=True) if words[t] == "\n" or not out)
    return "\n".join(x for part in left.split("\n") if (x := part.strip()))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def portions(pages: DataFrame, large: DataFrame) -> DataFrame:
    """host, parts, part, own and text of each different page of a host, in the order of these columns within a partition.

    pages: host, html. A host's pages are dealt into parts by a hash of their text, so equal pages meet, and no part is much
    larger than PORTION. Copies go before the shuffle, where they are in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in slices(batches, 1):
            rows = []
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = "\n".join(blocks_of(html)) if html else ""
                own = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                if text and (host, own) not in seen:
                    seen.add((host, own))
                    rows.append((host, own, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["host", "own", "text"])

    made = pages.select("host", "html").mapInArrow(released(run), "host string, own long, text string").join(large, "host", "left")
    dealt = made.select("host", F.coalesce("parts", F.lit(1)).alias("parts"), "own", "text").withColumn("part", F.pmod("own", "parts"))
    return dealt.select("host", "parts", "part", "own", "text")


def in_portions(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows in order, by their first three columns, without those that equal the one before in the first `width`."""
    key, rows, last = None, [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if rows:
                    yield key, rows
                key, rows, last = row[:3], [], None
            if row[:width] != last:
                rows.append(row[3:])
                last = row[:width]
    if rows:
        yield key, rows


def host_runs(pages: DataFrame, run: int = RUN, least: int = PAGES, share: float = SHARE, portion: int = PORTION) -> DataFrame:
    """host and keys (a list, not empty): the runs that stand on `least` or more of a host's different pages, and on `share` or more of them.

    pages: host, html. A host of more bytes than a portion is dealt into parts. A run that stands on a share of all its pages
    does so in one part at least, so the parts' shared runs are all there can be; their counts in all parts then decide. The
    answer does not depend on partitions. A host has as many such runs as 1 / share pages have tokens, at most.
    """
    sizes = pages.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"))
    large = stored(sizes.where(F.col("bytes") > portion).select("host", F.ceil(F.col("bytes") / portion).alias("parts")), "hosts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, parts, _), rows in in_portions(batches, 4):
            need = max(1 if parts > 1 else least, share * len(rows))
            keys, n = shared_runs([r[1] for r in rows], need, run) if len(rows) >= need else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if parts > 1 or len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([parts], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([keys.tolist()], pa.list_(pa.int64()))], names=["host", "parts", "pages", "keys"])

    spread = portions(pages, large).repartition("host", "parts", "part").sortWithinPartitions("host", "parts", "part", "own")
    found = stored(spread.mapInArrow(released(find), "host string, parts long, pages long, keys array<long>"), "runs")
    whole = found.where("parts = 1").select("host", "keys")
    split = found.where("parts > 1")
    several = stored(split.groupBy("host", "parts").agg(F.sum("pages").alias("pages"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")).where((F.size("keys") > 0) & (F.col("pages") >= least)), "candidates")
    if several.isEmpty():
        return whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, _, _), rows in in_portions(batches, 4):
            wanted, texts = np.array(rows[0][1], np.int64), [r[2] for r in rows[1:]]
            n = counted_runs(texts, wanted, run) if texts else np.zeros(len(wanted), np.int64)
            for i in range(0, len(wanted), 1 << 16):
                own = wanted[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(own), pa.string()), pa.array(own), pa.array(n[i : i + (1 << 16)])], names=["host", "key", "n"])

    own = pages.join(several.select("host"), "host", "left_semi")
    rows = portions(own, large).select("host", "parts", "part", "own", F.lit(None).cast("array<long>").alias("keys"), "text")
    asked = several.select("host", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("own"), "keys", F.lit(None).cast("string").alias("text"))
    counted = asked.unionByName(rows).repartition("host", "parts", "part").sortWithinPartitions("host", "parts", "part", "own").mapInArrow(released(count), "host string, key long, n long")
    enough = counted.groupBy("host", "key").agg(F.sum("n").alias("n")).join(several.select("host", "pages"), "host").where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))
    return whole.unionByName(enough.groupBy("host").agg(F.collect_list("key").alias("keys")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least: int = PAGES, share: float = SHARE, portion: int = PORTION) -> DataFrame:
    """page_id, url, text (blocks joined by line ends) and n_chars of each row.

    Markup drops what stands outside the article; of the rest, the runs go that pages of the host share (see host_runs). Hosts of
    fewer than `least` different pages lose no run. Pages are joined with the runs of their hosts: Spark sends these to all
    executors only if the files that hold them are small. Null and empty pages, and pages without text, give an empty text.
    Rows without a url share a host without a name. Repeated rows are rows of their own; an empty table gives an empty
    result. Other columns are not read.
    """
    frame = pages.select(host_of(pages[url_col]).alias("host"), pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    shared = stored(host_runs(frame.select("host", "html"), run, least, share, portion), "shared")
    kind = dict(frame.dtypes)["page_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = ["\n".join(blocks_of(html)) if html else "" for html in batch.column(2).to_pylist()]
            for i, keys in enumerate(batch.column(3)):
                if keys.is_valid and texts[i]:
                    texts[i] = without_runs(texts[i], keys.values.to_numpy(), run)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return frame.join(shared, "host", "left").select("page_id", "url", "html", "keys").mapInArrow(released(cut), f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: markup rules, then the runs that a host's pages share. Pages without html have an empty text."""
    return main_text(table(spark, sf_dir, "pages"))
