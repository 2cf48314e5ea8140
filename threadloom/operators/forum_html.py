"""Captured forum pages as tables: forums, threads, posts with quotes and attachments, links, page navigation.

A page is parsed once, into one row of nested columns; the tables are explosions of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import privacy, urls

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a page says that shows its posts to members only.
WALL = re.compile(r"you must log in or register|log in to view|register(?:ed)? to (?:see|view) all posts|you do not have permission to view this page|you must be logged in", re.I)
#: Marks of a member's and of a guest's page.
MEMBER, GUEST = ("p-navgroup--member", "p-navgroup-link--user"), ("p-navgroup--guest", "p-navgroup-link--logIn", "p-navgroup-link--register")


class Node:
    """An element with its attributes, its children and texts in order, and its parent."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def has(self, *names: str) -> bool:
        own = self.get("class").split()
        return any(n in own for n in names)

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def one(self, *tests: Callable[[Node], bool]) -> Node | None:
        """The first match of the first test that has one."""
        return next((n for t in tests for n in self.walk() if t(n)), None)

    def raw(self, skip: Callable[[Node], bool] = lambda n: False) -> str:
        return "".join(c if isinstance(c, str) else "" if skip(c) else c.raw(skip) for c in self.children)

    def text(self) -> str:
        return re.sub(r"\s+", " ", self.raw()).strip()


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def tree(html: str) -> Node:
    made = Tree()
    made.feed(html)
    made.close()
    return made.root


def css(name: str) -> Callable[[Node], bool]:
    return lambda n: n.has(name)


def id_of(url: str | None) -> str | None:
    m = re.search(r"\.(\d+)/?(?:page-\d+)?(?:[/?#]|$)", url or "")
    return m[1] if m else None


def number(text: str | None) -> int | None:
    m = re.search(r"(\d+(?:\.\d+)?)\s*([KMB])?", (text or "").replace("\xa0", " ").replace(",", ""), re.I)
    return int(float(m[1]) * {"K": 1e3, "M": 1e6, "B": 1e9}.get((m[2] or "").upper(), 1) + 0.5) if m else None


def body_text(body: Node | None) -> str:
    """Without signature, buttons, unfurled links, scripts and styles; quotes stay."""
    if body is None:
        return ""
    text = body.raw(lambda n: n.tag in ("script", "style") or n.has("message-signature", "bbCodeBlock-button", "js-unfurl"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text.replace("\xa0", " "))).strip()


def epoch_of(iso: str) -> int | None:
    """Seconds since 1970 of an ISO time (UTC where it names no offset); null for none, and for 0."""
    try:
        when = datetime.fromisoformat(iso.strip())
    except ValueError:
        return None
    return math.floor((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()) or None


def time_of(node: Node | None) -> dict | None:
    """A time element's ISO text, its seconds (as recorded, else by the text) and its title or text."""
    if node is None:
        return None
    epoch, iso = node.get("data-time").strip(), node.get("datetime")
    seconds = int(m[0]) if (m := re.match(r"[+-]?\d+", epoch)) else None
    return {"iso": iso or None, "epoch": seconds if epoch else epoch_of(iso), "text": node.get("title") or node.text() or None}


def logged_in(root: Node) -> bool:
    """Whether a page is a member's: by its navigation, else by its links, else by the document's class."""
    links = [n.get("href") for n in root.all(lambda n: n.tag == "a")]
    if root.one(lambda n: n.has(*MEMBER)) or any("/logout/" in x or x == "/account/" for x in links):
        return True
    if root.one(lambda n: n.has(*GUEST)) or any("/login/" in x for x in links):
        return False
    top = root.one(lambda n: n.tag == "html")
    return top is not None and top.has("is-logged-in")


def login_wall(root: Node) -> bool:
    """Whether a page asks for a login and shows no post."""
    shown = root.one(lambda n: n.has("message--post", "message-body") or (n.tag == "article" and n.has("message")))
    return bool(WALL.search(root.text())) and shown is None


def forum(node: Node, base: str) -> dict | None:
    """A board's node with its counts and the forums under it; null for one without a forum's link."""
    places = [t for t in node.all(css("node-title")) for t in t.all(lambda n: n.tag == "a")]
    link = next(iter(places), None) or node.one(lambda n: n.tag == "a" and "/forums/" in n.get("href"))
    if link is None or "/forums/" not in (url := absolute(link.get("href"), base)):
        return None
    stats = [dd.text() for box in node.all(lambda n: n.has("node-statsMeta", "node-stats", "pairs")) for dd in box.all(lambda n: n.tag == "dd")]
    under = [a for box in node.all(lambda n: n.has("node-subNodesFlat", "subNodeFlatList")) for a in box.all(lambda n: n.tag == "a")]
    sub = [{"id": id_of(u), "title": a.text(), "url": u} for a in under if "/forums/" in (u := absolute(a.get("href"), base))]
    told = node.one(css("node-description"))
    kind = "category" if node.has("node--category") else "forum"
    count = lambda i: number(stats[i]) if i < len(stats) else None
    about = {"description": told.text() if told else None, "threads_count": count(0), "messages_count": count(1), "sub_forums": sub}
    return {"type": kind, "id": id_of(url) or node.get("data-node-id") or None, "url": url, "title": link.text()} | about


def quote(node: Node) -> dict:
    member = re.search(r"member:\s*['\"]?([^'\",]+)", node.get("data-attributes"))
    title = node.one(css("bbCodeBlock-title"))
    said = re.match(r"(.*?)\s+said:", title.text()) if title else None
    post = re.search(r"post:\s*(\d+)", node.get("data-source"))
    inner = node.one(css("bbCodeBlock-expandContent"), css("bbCodeBlock-content"))
    author = node.get("data-quote").strip() or (member[1].strip() if member else None) or (said[1].strip() if said else None)
    return {"author": author, "source_post": post[1] if post else None, "text": (inner or node).text()}


def resource_class(url: str, label: str) -> str | None:
    """The class of a link, by the same rules as the column function."""
    path, text = re.split(r"[?#]", url, maxsplit=1)[0], f"{url} {label}".lower()
    said = lambda words: re.search(urls.bounded(words), text)
    ends = lambda words: re.search(rf"\.(?:{'|'.join(words)})$", path)
    tests = {"pdf": ends(["pdf"]) or said(["pdf"]), "document": ends(urls.DOCUMENT), "ebook": said(urls.EBOOK_WORDS) or ends(urls.EBOOK), "archive": ends(urls.ARCHIVE), "download": said(urls.DOWNLOAD_WORDS)}
    return next((k for k, found in tests.items() if found), None)


def links_of(root: Node, base: str) -> list[dict]:
    """Links and areas with absolute addresses, whether they leave the base's host, and their class; scripts, mail and telephones are left out."""
    out, home = [], urlsplit(base).hostname
    for a in root.all(lambda n: n.tag in ("a", "area") and "href" in n.attrs):
        href = a.get("href")
        if href and not re.match(r"(?:javascript|mailto|tel):", href, re.I):
            url = absolute(href, base)
            about = {"text": a.text() or None, "title": a.get("title") or None, "rel": a.get("rel") or None, "download": a.get("download") or None}
            out.append({"url": url} | about | {"external": host_of(url) != home, "resource_type": resource_class(url, a.text())})
    return out


def absolute(href: str, base: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def host_of(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


def post(node: Node, base: str) -> dict:
    place = re.search(r"post-(\d+)", node.get("data-content")) or re.search(r"post-(\d+)", node.get("id"))
    name = node.one(css("username"))
    shown = node.one(css("message-attribution-opposite"))
    count = re.search(r"#?([\d,]+)", shown.text()) if shown else None
    bar = node.one(css("reactionsBar-link"), css("sv-rating-count"))
    reacted = re.search(r"\d[\d,]*", bar.text()) if bar else None
    files = [a for box in node.all(lambda n: n.has("message-attachments", "attachmentList")) for a in box.all(lambda n: n.tag == "a" and n.get("href") != "")]
    return {
        "id": place[1] if place else None, "author": node.get("data-author") or (name.text() if name else None) or None, "author_id": id_of(name.get("href")) if name else None,
        "post_number": number(count[1]) if count else None, "posted_at": time_of(node.one(lambda n: n.tag == "time")), "edited": node.one(css("message-lastEdit")) is not None,
        "body_text": body_text(node.one(css("bbWrapper"), css("message-userContent"))), "quotes": [quote(q) for q in node.all(css("bbCodeBlock--quote"))],
        "attachments": [{"name": a.text() or None, "url": absolute(a.get("href"), base)} for a in files], "links": links_of(node, base),
        "reactions_count": 0 if bar is None else number(reacted[0]) if reacted else int(bool(bar.text())), "deleted": node.has("message--deleted"), "ignored": node.has("message--ignored", "is-ignored"),
    }


def thread_row(node: Node, base: str) -> dict | None:
    link = node.one(lambda n: n.tag == "a" and "/threads/" in n.get("href"))
    if link is None:
        return None
    numbers = {re.sub(r"\W", "", dt.text().lower()): dd.text() for dl in node.all(lambda n: n.tag == "dl") for dt in dl.all(lambda n: n.tag == "dt") for dd in dl.all(lambda n: n.tag == "dd")}
    url = absolute(link.get("href"), base)
    icons = lambda name: node.one(css(f"structItem-status--{name}")) is not None
    return {"id": id_of(url), "url": url, "title": link.text(), "author": node.get("data-author") or None, "reply_count": number(numbers.get("replies")), "view_count": number(numbers.get("views")), "sticky": icons("sticky"), "locked": icons("locked"), "redirect": icons("redirect") or node.has("structItem--redirect")}


def navigation(root: Node, base: str) -> dict:
    nav = root.one(css("pageNav"))
    if nav is None:
        return {"current": 1, "last": 1, "next": None}
    pages = [a for li in nav.all(css("pageNav-page")) for a in li.all(lambda n: n.tag == "a")]
    numbers = [int(a.text()) for a in pages if a.text().isdigit()]
    now = nav.one(css("pageNav-page--current"))
    current, last = number(now.text()) or 1 if now else 1, max([1, *numbers])
    after = nav.one(css("pageNav-jump--next"), lambda n: n.tag == "a" and n.get("rel") == "next")
    href = after.get("href") if after else None
    if href is None and current < last:
        href = next((re.sub(r"page-\d+", f"page-{current + 1}", a.get("href")) for a in pages if re.search(r"page-\d+", a.get("href"))), None)
    return {"current": current, "last": last, "next": absolute(href, base) if href else None}


def page(html: str | None, base: str | None) -> dict:
    root, base = tree(html or ""), base or ""
    found = [post(n, base) for n in root.all(lambda n: n.has("message--post") or (n.tag == "article" and n.has("message")))]
    title = root.one(css("p-title-value"), lambda n: n.tag == "h1")
    return {
        "title": title.text() if title else None,
        "logged_in": logged_in(root),
        "login_wall": login_wall(root),
        "navigation": navigation(root, base),
        "posts": found,
        "forums": [x for n in root.all(css("node")) if (x := forum(n, base))],
        "threads": [t for n in root.all(css("structItem")) if (t := thread_row(n, base))],
        "links": links_of(root, base),
    }


LINK = "struct<url:string,text:string,title:string,rel:string,download:string,external:boolean,resource_type:string>"
QUOTE = "struct<author:string,source_post:string,text:string>"
TIME = "struct<iso:string,epoch:bigint,text:string>"
POST = (
    f"struct<id:string,author:string,author_id:string,post_number:bigint,posted_at:{TIME},edited:boolean,body_text:string,quotes:array<{QUOTE}>,"
    f"attachments:array<struct<name:string,url:string>>,links:array<{LINK}>,reactions_count:bigint,deleted:boolean,ignored:boolean>"
)
FORUM = "struct<type:string,id:string,url:string,title:string,description:string,threads_count:bigint,messages_count:bigint,sub_forums:array<struct<id:string,title:string,url:string>>>"
THREAD = "struct<id:string,url:string,title:string,author:string,reply_count:bigint,view_count:bigint,sticky:boolean,locked:boolean,redirect:boolean>"
NAVIGATION = "struct<current:bigint,last:bigint,next:string>"
PAGE = f"title string, logged_in boolean, login_wall boolean, navigation {NAVIGATION}, posts array<{POST}>, forums array<{FORUM}>, threads array<{THREAD}>, links array<{LINK}>"


def parsed(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url and a page's columns. Null and broken pages have empty ones."""
    kinds = ["title", "logged_in", "login_wall", "navigation", "posts", "forums", "threads", "links"]

    schema = to_arrow(PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [page(h, u) for u, h in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], schema[k]) for k in kinds)], names=["url", *kinds])

    return pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"url string, {PAGE}")


def to_arrow(ddl: str) -> dict[str, pa.DataType]:
    return {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(ddl).fields}


def posts(parsed_pages: DataFrame) -> DataFrame:
    return parsed_pages.select(F.col("url").alias("source_url"), F.regexp_extract("url", r"\.([0-9]+)/?", 1).alias("thread_id"), F.explode("posts").alias("p")).select("source_url", "thread_id", "p.*")


def exploded(parsed_pages: DataFrame, kind: str) -> DataFrame:
    """forums, threads or links, a row each, with their page's URL."""
    return parsed_pages.select(F.col("url").alias("source_url"), F.explode(kind).alias("x")).select("source_url", "x.*")


def pseudonymous(posts_: DataFrame, salt: str = "") -> DataFrame:
    """posts as they may leave the restricted layer: authors, their ids and the authors of quotes as short hashes."""
    hashed = lambda c: privacy.short_hash(c, salt)
    quotes = F.transform("quotes", lambda q: q.withField("author", hashed(q["author"])))
    return posts_.withColumns({"author": hashed(F.col("author")), "author_id": hashed(F.col("author_id")), "quotes": quotes})


def threads_in_pages(posts_: DataFrame, most: int) -> DataFrame:
    """A row per thread: thread_id and its posts over all its pages, by page and place; the pages after the one that reaches `most` posts do not count.

    posts_: thread_id, page, place and post. A thread's posts are one row, which holds its pages until the cap.
    """
    sizes = posts_.groupBy("thread_id", "page").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("thread_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    kept = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("thread_id", "page")
    ordered = F.array_sort(F.collect_list(F.struct("page", "place", "post")))
    return posts_.join(kept, ["thread_id", "page"]).groupBy("thread_id").agg(F.transform(ordered, lambda x: x["post"]).alias("posts"))


def self_test(parsed_pages: DataFrame) -> DataFrame:
    """url and how many posts, threads, forums and links a page gave: pages that give nothing show a changed theme."""
    return parsed_pages.select("url", *(F.coalesce(F.size(k), F.lit(0)).alias(k) for k in ("posts", "threads", "forums", "links")), "navigation.last")
