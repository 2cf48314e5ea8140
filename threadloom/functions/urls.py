"""Column functions over URLs: canonical forms, domains, ids, page types, resource classes, robots patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"(?i)^(?:sid|_xftoken|fbclid|utm_[^=]*)(?:=|$)"
# Extensions and words of the resource classes, in the order in which they are tried.
DOCUMENT = "doc docx odt rtf txt xls xlsx ppt pptx".split()
EBOOK = "epub mobi azw azw3 fb2".split()
EBOOK_WORDS = "ebook e-book book novel grimoire manual".split()
ARCHIVE = "zip rar 7z tar gz iso".split()
DOWNLOAD_WORDS = "download attachment file upload".split()


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments resolved; a path without any passes as it is."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        shorter = F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
        return F.when(part == ".", kept).when(part == "..", shorter).otherwise(F.concat(kept, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), empty, step)
    # a path that ends in dots names a folder
    ends = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), F.concat(F.array_join(parts, "/"), ends)).otherwise(path)


def canonical(url: Column) -> Column:
    """Without fragment, session cursors (/unread, /post-N at the end) and tracking keys, with a slash at the end of the path and a lower-case host; '' for what is no absolute URL.

    The scheme's own port goes, and dot segments are resolved. Percent signs and letters beyond ASCII stay as they are.
    """
    url = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(https://.*):443$", "$1"), r"^(http://.*):80$", "$1")
    path = without_dots(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1))
    query = F.regexp_extract(url, r"^[^?]*\?(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)/unread/?$", "/"), r"(?i)/post-[0-9]+/?$", "/")
    path = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike(TRACKING) & (x != "")), "&")
    whole = F.concat(head, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(F.coalesce(head, F.lit("")) == "", "").otherwise(whole)


def authority(url: Column) -> Column:
    """Network location in lower case, with port and user; '' for relative and broken URLs."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def host(url: Column) -> Column:
    """Host in lower case; null for relative and broken URLs."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def page_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"\.([0-9]+)/?(?:page-[0-9]+)?(?:[/?#]|$)", 1), F.lit(""))


def slug(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"/(?:forums|threads)/([^./]+)\.[0-9]+", 1)


def page_type(url: Column, site: str | None = None) -> Column:
    """thread, forum, member, index or other; `site` is the host whose root is an index."""
    root = url.rlike("^https?://[^/?#]*/?(?:$|[?#])") if site is None else url.rlike(site.replace(".", r"\.") + r"/?($|\?|#)")
    return F.when(url.rlike("/threads/"), "thread").when(url.rlike("/forums/"), "forum").when(url.rlike("/members/"), "member").when(root | url.rlike("/forums/?$"), "index").otherwise("other")


def bounded(words: list[str]) -> str:
    """Any of the words between ASCII word borders."""
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])"


def resource_type(url: Column, label: Column) -> Column:
    """pdf, document, ebook, archive, download or null. Words are sought in lower case, extensions as they stand, but for pdf."""
    text = F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit(" "), F.coalesce(label, F.lit(""))))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^?#]*)", 1)
    ends = lambda words: path.rlike(r"\.(?:" + "|".join(words) + ")$")
    return (
        F.when((F.regexp_extract(path, r"(?i)\.([a-z0-9]{2,8})$", 1) == "pdf") | text.rlike(bounded(["pdf"])), "pdf")
        .when(ends(DOCUMENT), "document")
        .when(text.rlike(bounded(EBOOK_WORDS)) | ends(EBOOK), "ebook")
        .when(ends(ARCHIVE), "archive")
        .when(text.rlike(bounded(DOWNLOAD_WORDS)), "download")
    )


def robots_regex(pattern: Column) -> Column:
    """A robots pattern as a regex: `*` is any text, all else stands for itself, anchored at the start."""
    literal = F.regexp_replace(pattern, r"([\\^$.|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")))


def links(html: Column) -> Column:
    """href values of anchors, as written in double quotes."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
