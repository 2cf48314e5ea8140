"""Queries that write archives from the driver's tables to the shared folder and read them back, and those of pages, crawls and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy, urls
from ..functions import text as T
from ..operators import aggregate, dedup, forum_html, frontier, network, quality, reports, robots
from ..sources import archive, sinks
from ..storage import folder
from .catalogue import page_links, read, register

#: Bytes of a part in these queries; the library's own default is that of sinks.
PART = 100_000


def text_lines(df: DataFrame, line: Column, name: str) -> str:
    """A new folder of text files with one line per row."""
    df.select(line.alias("value")).write.text(to := folder(df.sparkSession, name))
    return to


# ---- JSON lines, CSV


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines; every fiftieth has lost its end, every fortieth is followed by a blank line."""
    e = read(spark, d, "events")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    broken = F.expr("substring(line, 1, length(line) - 1)")
    e = e.select("event_id", line.alias("line")).withColumn("line", F.when(F.col("event_id") % 50 == 7, broken).otherwise(F.col("line")))
    path = text_lines(e, F.when(F.col("event_id") % 40 == 0, F.concat("line", F.lit("\n"))).otherwise(F.col("line")), "lines")
    return archive.lines(spark, path)


@register("SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 <> 7")
def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    good, _ = archive.parsed(event_lines(spark, d), "event_id long, user_id long, event_type string")
    return good.select("event_id", "user_id", "event_type")


@register("SELECT event_id FROM events WHERE event_id % 50 = 7")
def jsonl_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """The ids that the quarantined lines still show."""
    _, bad = archive.parsed(event_lines(spark, d), "event_id long, user_id long, event_type string")
    return bad.select(F.regexp_extract("raw", '"event_id":([0-9]+)', 1).cast("long").alias("event_id"))


@register("SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(coalesce(text, '')) AS text_hash, coalesce(lang, '') AS lang FROM documents")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with their quotes, commas and line ends, through a CSV file."""
    sinks.write_csv(read(spark, d, "documents").select("doc_id", "text", "lang"), to := folder(spark, "csv"))
    back = archive.index_table(spark, to)
    return back.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), F.coalesce("lang", F.lit("")).alias("lang"))


@register(
    r"""SELECT link_url, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS link_url FROM pages) GROUP BY link_url"""
)
def links_index(spark: SparkSession, d: str) -> DataFrame:
    """The links index: its columns in their order, those that are not known empty, written as CSV and read back."""
    sinks.write_csv(sinks.index_rows(page_links(spark, d).select("link_url"), "links"), to := folder(spark, "index"))
    back = archive.index_table(spark, to)
    assert back.columns == sinks.INDEX["links"]
    return back.groupBy("link_url").agg(F.count("*").alias("n"))


# ---- parts, ZIP archives, manifests

DOC_LINES_SQL = (
        "l AS (SELECT doc_id, strlen('{\"doc_id\":' || doc_id || ',\"lang\":' || coalesce('\"' || lang || '\"', "
        "'null') || ',\"source\":' || coalesce('\"' || source || '\"', 'null') || '}') + 1 AS b FROM documents), "
    "r AS (SELECT *, sum(b) OVER (ORDER BY doc_id) - b AS start FROM l), "
    f"p AS (SELECT doc_id, b, 2 * CAST(start // {PART // 2} AS BIGINT) + CASE WHEN b > {PART // 2} THEN 1 ELSE 0 END AS part FROM r)"
)


def doc_parts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.split_parts(read(spark, d, "documents").select("doc_id", "lang", "source"), ["doc_id"], PART)


@register(
    f"WITH {DOC_LINES_SQL} SELECT part, '.part-' || lpad(CAST(part AS VARCHAR), 6, '0') AS name, count(*) AS entry_count, CAST(sum(b) AS BIGINT) AS bytes, "
    "CAST((SELECT count(*) FROM documents) AS BIGINT) AS logical_entry_count FROM p GROUP BY part"
)
def part_manifest(spark: SparkSession, d: str) -> DataFrame:
    parts = doc_parts(spark, d)
    return sinks.part_manifest(parts, sinks.line_bytes(parts.select("doc_id", "lang", "source")))


def part_archives(spark: SparkSession, d: str) -> DataFrame:
    """A ZIP file per part: its lines, a README, and for even slices the crawl's metadata."""
    line = F.concat(F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit('"}\n'))
    bodies = doc_parts(spark, d).groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))), lambda x: x["l"]), "").alias("posts"))
    name = F.concat(F.lit("part-"), F.col("part").cast("string"))
    extra = F.when(F.col("part") % 4 == 0, F.struct(F.lit("metadata/crawl.json").alias("entry"), F.lit("{}").alias("text")))
    entries = F.array_compact(F.array(F.struct(F.lit("data/posts.jsonl").alias("entry"), F.col("posts").alias("text")), F.struct(F.lit("README.txt").alias("entry"), F.lit("x").alias("text")), extra))
    return sinks.zipped(bodies.select(name.alias("archive"), F.inline(entries)))


@register(
    f"WITH {DOC_LINES_SQL}, z AS (SELECT 'part-' || part AS archive, part, CAST(sum(strlen('{{\"id\":\"' || doc_id || '\"}}') + 1) AS BIGINT) AS bytes FROM p GROUP BY part) "
    "SELECT archive, 'data/posts.jsonl' AS entry, bytes, true AS crc_ok FROM z UNION ALL SELECT archive, 'README.txt', 1, true FROM z "
    "UNION ALL SELECT archive, 'metadata/crawl.json', 2, true FROM z WHERE part % 4 = 0"
)
def zip_entries(spark: SparkSession, d: str) -> DataFrame:
    return archive.zip_entries(part_archives(spark, d))


@register(f"WITH {DOC_LINES_SQL} SELECT 'part-' || part AS archive, CAST(row_number() OVER (PARTITION BY part ORDER BY doc_id) AS BIGINT) AS line_no, CAST(doc_id AS VARCHAR) AS id FROM p")
def zip_lines(spark: SparkSession, d: str) -> DataFrame:
    good, _ = archive.parsed(archive.zip_lines(part_archives(spark, d), "data/posts.jsonl"), "id string")
    return good.select(F.col("file").alias("archive"), "line_no", "id")


MISSING_SQL = ", ".join(f"('{x}')" for x in archive.REQUIRED if x not in ("README.txt", "data/posts.jsonl"))


@register(
    f"WITH {DOC_LINES_SQL}, z AS (SELECT DISTINCT part FROM p) SELECT 'part-' || part AS archive, entry FROM z, (VALUES {MISSING_SQL}) m(entry) "
    f"WHERE entry <> 'metadata/crawl.json' OR part % 4 <> 0"
)
def missing_entries(spark: SparkSession, d: str) -> DataFrame:
    return archive.missing_entries(archive.zip_entries(part_archives(spark, d)))


@register(f"WITH {DOC_LINES_SQL} SELECT 'part-' || part AS archive, 'metadata/requests.jsonl' AS entry FROM p GROUP BY part")
def optional_entries(spark: SparkSession, d: str) -> DataFrame:
    """Which optional entries archives have: those of the written ones, with a request log added to their lists."""
    entries = archive.zip_entries(part_archives(spark, d)).select("archive", "entry")
    log = entries.select("archive").distinct().withColumn("entry", F.lit("metadata/requests.jsonl"))
    return archive.optional_entries(entries.unionByName(log))


BINS_SQL = """m AS (SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS seq, name, bytes, bytes + strlen(name) + 80 AS need FROM (
  SELECT 'data/' || coalesce(source, '') || '-' || coalesce(lang, '') AS name, CAST(1000 + sum(n_chars) % 9000 AS BIGINT) AS bytes FROM documents GROUP BY coalesce(source, ''), coalesce(lang, ''), name)),
r AS (SELECT seq, CAST(0 AS INTEGER) AS bin, 22 + need AS used FROM m WHERE seq = 0
  UNION ALL SELECT m.seq, CASE WHEN used + need > 28000 THEN bin + 1 ELSE bin END, CASE WHEN used + need > 28000 THEN 22 + need ELSE used + need END FROM r JOIN m ON m.seq = r.seq + 1)"""


@register(f"WITH RECURSIVE {BINS_SQL} SELECT m.seq, m.name, m.bytes, r.bin FROM m JOIN r ON m.seq = r.seq")
def next_fit_bins(spark: SparkSession, d: str) -> DataFrame:
    """Entries of an archive filled into bins in turn."""
    name = F.concat(F.lit("data/"), F.coalesce("source", F.lit("")), F.lit("-"), F.coalesce("lang", F.lit("")))
    sizes = read(spark, d, "documents").groupBy(name.alias("name")).agg((1000 + F.sum("n_chars") % 9000).alias("bytes"))
    names = sizes.agg(F.array_sort(F.collect_list(F.struct("name", "bytes"))).alias("all")).select(F.posexplode("all").alias("seq", "e"))  # one per source and language
    return sinks.packed(names.select(F.lit("archive").alias("archive"), "seq", "e.name", "e.bytes"), 28_000).select("seq", "name", "bytes", "bin")


@register(
    "WITH c(entry, records) AS (VALUES ('README.txt', 1), "
    + ", ".join(f"('{x}', 1)" for x in sinks.SNAPSHOT if x.endswith(".json"))
    + ", ('metadata/requests.jsonl', (SELECT count(*) FROM events)), "
    + ", ".join(f"('{entry}', {n})" for kind, n in (("forums", "(SELECT count(*) FROM nation)"), ("threads", "(SELECT count(*) FROM pages)"), ("posts", "(SELECT count(*) FROM documents)"), ("links", "(SELECT count(*) FROM labels)"), ("resources", "0")) for entry in (f"data/{kind}.jsonl", f"index/{kind}.csv"))
    +
        ", ('data/pages.jsonl', 0), ('index/post_features.csv', (SELECT count(*) FROM documents)), ('data/all.ndjson', (SELECT count(*) "
        "FROM nation) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels))) "
    "SELECT entry, CAST(records AS BIGINT) AS records FROM c"
)
def archive_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A whole archive, written and read back: its 23 entries with their records."""
    docs, events = read(spark, d, "documents"), read(spark, d, "events")
    records = {
        "forums": read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title")),
        "threads": read(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url"),
        "posts": docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("author"), F.col("text").alias("body_text"), F.col("n_chars").alias("body_text_length")),
        "links": read(spark, d, "labels").select(F.concat(F.lit("https://b.example/"), F.col("doc_id").cast("string")).alias("link_url")),
        "requests": events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("status")),
    }
    about = reports.readiness(docs)
    sinks.write_snapshot(to := folder(spark, "snapshot"), records, {"analysis/profile.json": about, "metadata/crawl.json": reports.date_range(events, F.unix_seconds(F.col("ts").cast("timestamp")))}, "an archive")
    return sinks.snapshot_entries(spark, to)


# ---- checkpoints, mixed files, listings, comments


def checkpoint_folders(spark: SparkSession, d: str) -> DataFrame:
    """Events in two checkpoints that overlap, read back."""
    e, to = read(spark, d, "events"), folder(spark, "checkpoints")
    for n, kept in ((1, F.col("event_id") % 3 < 2), (2, F.col("event_id") % 3 > 0)):
        sinks.write_json_lines(e.where(kept).select(F.col("event_id").cast("string").alias("id"), F.lit(n).alias("version")), f"{to}/cp-000{n}/data/posts.jsonl")
    return archive.checkpoints(spark, to, "posts", "id string, version int")


@register("SELECT CAST(event_id AS VARCHAR) AS id, CAST(CASE WHEN event_id % 3 = 2 THEN 2 ELSE 1 END AS INTEGER) AS version FROM events")
def checkpoint_merge(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each id over all checkpoints."""
    return dedup.merge_snapshots(checkpoint_folders(spark, d), "posts", ["checkpoint", "line_no"]).select("id", "version")


@register(
    "SELECT 'cp-0001' AS checkpoint, count(*) FILTER (event_id % 3 < 2) AS records, count(*) FILTER (event_id % 3 < 2) AS new FROM events "
    "UNION ALL SELECT 'cp-0002', count(*) FILTER (event_id % 3 > 0), count(*) FILTER (event_id % 3 = 2) FROM events"
)
def merge_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What each checkpoint holds, and how much of it is new."""
    rows = checkpoint_folders(spark, d)
    first = rows.groupBy("id").agg(F.min("checkpoint").alias("first"))
    return rows.join(first, "id").groupBy("checkpoint").agg(F.count("*").alias("records"), F.count_if(F.col("checkpoint") == F.col("first")).alias("new"))


@register("SELECT coalesce(event_type, 'unknown') AS type, count(*) AS n FROM events GROUP BY 1")
def legacy_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of mixed records by their type."""
    path = text_lines(read(spark, d, "events"), F.to_json(F.struct(F.col("event_type").alias("type"), "event_id")), "legacy")
    return archive.type_counts(archive.typed_records(archive.lines(spark, path)))


@register(
    "SELECT CAST(doc_id AS VARCHAR) AS id, substr(coalesce(text, ''), 1, 40) AS title, CASE WHEN doc_id % 7 = 0 THEN '[deleted]' WHEN doc_id % 7 = 1 THEN NULL ELSE lang END AS author, "
    "CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS score, source AS subreddit FROM documents WHERE doc_id % 10 <> 9"
)
def listing_posts(spark: SparkSession, d: str) -> DataFrame:
    """Captured listings of 25: other kinds than posts go, missing fields take defaults, nulls stay."""
    docs = read(spark, d, "documents")
    quoted = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    bare = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    rows = docs.select(
        "doc_id",
        F.floor(F.col("doc_id") / 25).alias("page"),
        quoted(F.substring(F.coalesce("text", F.lit("")), 1, 40)).alias("title"),
        quoted(F.when(F.col("doc_id") % 7 != 1, F.col("lang"))).alias("author"),
        quoted(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 10 == 9, "more").otherwise("t3").alias("kind"),
        F.coalesce(F.col("n_chars").cast("string"), F.lit("null")).alias("score"),
    )
    author = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit(',"author":'), bare("author")))
    score = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit(',"score":'), F.col("score")))
    child = F.concat(
        F.lit('{"kind":"'), F.col("kind"), F.lit('","data":{"id":"'), F.col("doc_id").cast("string"), F.lit('","title":'), bare("title"), F.lit(',"subreddit":'), bare("source"), author, score, F.lit("}}")
    )
    page = rows.groupBy("page").agg(F.concat(F.lit('{"data":{"children":['), F.array_join(F.collect_list(child), ","), F.lit("]}}")).alias("raw"))
    return archive.listing_posts(page).select("id", "title", "author", "score", "subreddit")


def comment_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a chain of replies: post and the JSON of its comments."""
    turn = F.struct("turn", F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("author"), F.col("text").alias("body"))).alias("j"))
    convs = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn), asc=False).alias("turns"))

    def wrap(inner: Column, t: Column) -> Column:
        own = F.substr(t["j"], F.lit(1), F.length(t["j"]) - 1)
        return F.concat(F.lit('{"data":{"children":[{"kind":"t1","data":'), own, F.lit(',"replies":'), inner, F.lit("}}]}}"))

    return convs.select(F.col("conv_id").alias("post"), F.aggregate("turns", F.lit('""'), wrap).alias("raw"))


COMMENTS_SQL = (
    "SELECT conv_id AS post, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS depth, conv_id || '-' || turn AS id, "
    "coalesce(role, '[deleted]') AS author, sha256(coalesce(text, '')) AS body FROM conversations"
)


@register(COMMENTS_SQL)
def comment_trees(spark: SparkSession, d: str) -> DataFrame:
    found = archive.comment_tree(spark, comment_pages(spark, d))
    return found.select("post", "depth", "id", "author", F.sha2("body", 256).alias("body"))


@register(f"SELECT post, id FROM ({COMMENTS_SQL}) WHERE depth < 2")
def capped_comments(spark: SparkSession, d: str) -> DataFrame:
    return archive.capped_comments(archive.comment_tree(spark, comment_pages(spark, d)), 2).select("post", "id")


# ---- pages of a board


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def thread_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a thread's page: its turns are posts, and each but the first quotes the author before."""
    n = F.col("turn").cast("string")
    post = F.concat(
        F.lit('<article class="message message--post'), F.when(F.col("turn") % 5 == 4, " message--deleted").otherwise(""), F.lit('" data-author="'), F.coalesce("role", F.lit("")),
        F.lit('" data-content="post-'), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.lit('"><time datetime="2024-01-01T00:00:'), F.lpad(n, 2, "0"), F.lit('Z"></time>'),
        F.lit('<ul class="message-attribution-opposite"><li>#'), (F.col("turn") + 1).cast("string"), F.lit('</li></ul><div class="bbWrapper">'), escaped(F.col("text")), F.lit("</div>"),
        F.coalesce(F.concat(F.lit('<blockquote class="bbCodeBlock--quote" data-quote="'), F.col("before"), F.lit('" data-source="post: '), (F.col("conv_id") * 1000 + F.col("turn") - 1).cast("string"), F.lit('"></blockquote>')), F.lit("")),
        F.lit('<a class="reactionsBar-link">A and '), n, F.lit(' others</a><script>x("</div>")</script></article>'),
    )
    posts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("h")))), lambda x: x["h"]), "")
    turns = read(spark, d, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    made = turns.groupBy("conv_id").agg(posts.alias("posts"), F.count("*").alias("n"))
    nav = F.concat(
        F.lit('<nav class="pageNav"><ul><li class="pageNav-page pageNav-page--current"><a href="/threads/t.'), F.col("conv_id").cast("string"), F.lit('/">1</a></li><li class="pageNav-page"><a href="/threads/t.'),
        F.col("conv_id").cast("string"), F.lit("/page-"), F.col("n").cast("string"), F.lit('">'), F.col("n").cast("string"), F.lit("</a></li></ul></nav>"),
    )
    url = F.concat(F.lit("https://b.example/threads/t."), F.col("conv_id").cast("string"), F.lit("/"))
    return made.select(url.alias("url"), F.concat(F.lit('<html class="x"><h1 class="p-title-value">T</h1>'), nav, "posts", F.lit("</html>")).alias("html"))


@register(
    r"""SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(conv_id * 1000 + turn AS VARCHAR) AS id, role AS author, turn + 1 AS post_number, CAST(1704067200 + turn AS BIGINT) AS epoch,
turn AS reactions_count, turn % 5 = 4 AS deleted, sha256(trim(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS body FROM conversations"""
)
def thread_posts(spark: SparkSession, d: str) -> DataFrame:
    found = forum_html.posts(forum_html.parsed(thread_pages(spark, d)))
    return found.select("thread_id", "id", "author", "post_number", F.col("posted_at.epoch").alias("epoch"), "reactions_count", "deleted", F.sha2("body_text", 256).alias("body"))


BEFORE_SQL = "b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"


@register(
    f"WITH {BEFORE_SQL} SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, before AS quoted, CAST(conv_id * 1000 + turn - 1 AS VARCHAR) AS source_post "
    f"FROM b WHERE before IS NOT NULL"
)
def thread_quotes(spark: SparkSession, d: str) -> DataFrame:
    found = forum_html.posts(forum_html.parsed(thread_pages(spark, d))).select("id", F.explode("quotes").alias("q"))
    return found.select("id", F.col("q.author").alias("quoted"), "q.source_post")


@register(f"WITH {BEFORE_SQL} SELECT role AS source, before AS target, count(*) AS weight FROM b WHERE role <> before GROUP BY ALL")
def quote_edges(spark: SparkSession, d: str) -> DataFrame:
    return network.quote_edges(forum_html.posts(forum_html.parsed(thread_pages(spark, d))))


@register(
    "SELECT 'https://b.example/threads/t.' || conv_id || '/' AS url, count(*)::INTEGER AS posts, 0 AS threads, 0 AS forums, 2 AS links, count(*) AS last "
    "FROM conversations GROUP BY conv_id"
)
def page_self_test(spark: SparkSession, d: str) -> DataFrame:
    return forum_html.self_test(forum_html.parsed(thread_pages(spark, d)))


@register(
    "SELECT 'https://b.example/threads/t.' || conv_id || '/' AS url, CAST(1 AS BIGINT) AS current, count(*) AS last, "
    "CASE WHEN count(*) > 1 THEN 'https://b.example/threads/t.' || conv_id || '/page-2' END AS next FROM conversations GROUP BY conv_id"
)
def page_navigation(spark: SparkSession, d: str) -> DataFrame:
    return forum_html.parsed(thread_pages(spark, d)).select("url", "navigation.current", "navigation.last", "navigation.next")


@register("SELECT substr(sha256('salt' || role), 1, 16) AS author, count(*) AS posts FROM conversations WHERE role IS NOT NULL GROUP BY role")
def pseudonymous_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts as they leave the restricted layer, counted by pseudonym."""
    found = forum_html.pseudonymous(forum_html.posts(forum_html.parsed(thread_pages(spark, d))), "salt")
    return found.where("author IS NOT NULL").groupBy("author").agg(F.count("*").alias("posts"))


@register(
    "SELECT conv_id, list(turn ORDER BY turn)::VARCHAR AS turns FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn "
    "FROM conversations) WHERE (rn - 1) // 2 * 2 < 3 GROUP BY conv_id"
)
def threads_over_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns on pages of two, joined over pages until three or more are there."""
    rows = dedup.numbered(read(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], [F.col("turn")])
    placed = rows.select(F.col("conv_id").alias("thread_id"), F.floor((F.col("rn") - 1) / 2).alias("page"), F.col("rn").alias("place"), F.col("turn").alias("post"))
    found = forum_html.threads_in_pages(placed, 3)
    return found.select(F.col("thread_id").alias("conv_id"), F.concat(F.lit("["), F.array_join("posts", ", "), F.lit("]")).alias("turns"))


BOARD_SQL = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation"


def board_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each region as a board's page: its nations are forums, every third with a forum under it, every fifth a bare category."""
    k = F.col("n_nationkey").cast("string")
    under = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('<div class="node-subNodesFlat"><a href="/forums/sub.'), (F.col("n_nationkey") + 100).cast("string"), F.lit('/">Sub</a><a href="/x">no</a></div>'))).otherwise("")
    title = F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit('<h3 class="node-title"><a href="/categories/c.'), k, F.lit('/">'), "n_name", F.lit("</a></h3>"))).otherwise(
        F.concat(F.lit('<h3 class="node-title"><a href="/forums/f.'), k, F.lit('/">'), "n_name", F.lit("</a></h3>"))
    )
    stats = F.concat(F.lit('<div class="node-statsMeta"><dl><dt>Threads</dt><dd>'), k, F.lit('.5K</dd></dl><dl><dt>Messages</dt><dd>1,00'), (F.col("n_nationkey") % 10).cast("string"), F.lit("</dd></dl></div>"))
    node = F.concat(F.lit('<div class="node node--forum">'), title, stats, under, F.lit("</div>"))
    guest = F.lit('<div class="p-navgroup--guest"><a href="/login/">in</a></div>')
    wall = F.when(F.col("n_regionkey") % 2 == 0, "<p>You must be logged in to see this.</p>").otherwise("")
    made = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", node.alias("h")))), lambda x: x["h"]), "").alias("h"))
    return made.select(F.concat(F.lit("https://b.example/r."), F.col("n_regionkey").cast("string"), F.lit("/")).alias("url"), F.concat(F.lit("<html>"), guest, wall, "h", F.lit("</html>")).alias("html"))


@register(
        f"SELECT 'https://b.example/forums/f.' || k || '/' AS url, CAST(k AS VARCHAR) AS id, trim(name) AS title, "
        f"CAST(k * 1000 + 500 AS BIGINT) AS threads_count, CAST(1000 + k % 10 AS BIGINT) AS messages_count, "
    f"CASE WHEN k % 3 = 0 THEN CAST(k + 100 AS VARCHAR) ELSE '' END AS sub_forums FROM ({BOARD_SQL}) WHERE k % 5 <> 4"
)
def board_forums(spark: SparkSession, d: str) -> DataFrame:
    found = forum_html.exploded(forum_html.parsed(board_pages(spark, d)), "forums")
    return found.select("url", "id", "title", "threads_count", "messages_count", F.array_join(F.transform("sub_forums", lambda x: x["id"]), ",").alias("sub_forums"))


@register("SELECT 'https://b.example/r.' || n_regionkey || '/' AS url, false AS logged_in, n_regionkey % 2 = 0 AS login_wall FROM nation GROUP BY n_regionkey")
def login_states(spark: SparkSession, d: str) -> DataFrame:
    return forum_html.parsed(board_pages(spark, d)).select("url", "logged_in", "login_wall")


@register(
    r"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || link AS url, false AS external FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS link FROM pages) WHERE starts_with(link, '/')"""
)
def absolute_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of all pages with absolute addresses, and whether they leave the page's host."""
    pages = read(spark, d, "pages").select("page_id", "url", "html")
    parsed = forum_html.parsed(pages.select(F.concat_ws("#", "url", F.concat(F.lit("page="), F.col("page_id").cast("string"))).alias("url"), "html"))
    links = parsed.select(F.regexp_extract("url", r"#page=([0-9]+)$", 1).cast("long").alias("page_id"), F.explode("links").alias("l"))
    return links.select("page_id", "l.url", "l.external")


# ---- robots and the frontier

ROBOTS = (
        "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /fr/\nDisallow: /*.html\nAllow: /fr/2\nCrawl-delay: 3\nDisallow: /de/1 # some\nSitemap: "
        "https://s.example/map.xml\nContent-Signal: ai-train=no, search=yes\n",
    "user-agent: *\nallow: /en/\ndisallow: /en/\ndisallow: /es%201/\n",
)
RULES = (
    (("disallow", "/fr/", "^/fr/"), ("disallow", "/*.html", "^/.*[.]html"), ("allow", "/fr/2", "^/fr/2"), ("disallow", "/de/1", "^/de/1")),
    (("allow", "/en/", "^/en/"), ("disallow", "/en/", "^/en/"), ("disallow", "/es%201/", "^/es%201/")),
)
PATH_SQL = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
HOST_SQL = r"lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


def rule_sql(site: int, kind: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches({PATH_SQL}, '{regex}') THEN {len(pattern)} ELSE -1 END" for k, pattern, regex in RULES[site] if k == kind)
    return f"greatest({hits}, -1)"


ALLOWED_SQL = "CASE WHEN " + " WHEN ".join(f"length({HOST_SQL}) % 3 = {i} THEN {rule_sql(i, 'disallow')} <= {rule_sql(i, 'allow')}" for i in range(2)) + " ELSE true END"


def robots_files(spark: SparkSession, d: str) -> DataFrame:
    """The hosts of all pages, of which a third each has one of two files, and the rest none."""
    site = urls.authority(F.col("url"))
    hosts = read(spark, d, "pages").select(site.alias("site")).distinct()
    body = F.when(F.length("site") % 3 == 0, ROBOTS[0]).when(F.length("site") % 3 == 1, ROBOTS[1])
    return hosts.withColumn("body", body)


@register(
    f"SELECT DISTINCT {HOST_SQL} AS site, CASE WHEN length({HOST_SQL}) % 3 = 0 THEN '/fr/ /*.html /de/1' WHEN length({HOST_SQL}) % 3 = 1 THEN '/en/ /es%201/' ELSE '' END AS disallow, "
    f"CASE WHEN length({HOST_SQL}) % 3 = 0 THEN 3.0 END AS crawl_delay, length({HOST_SQL}) % 3 = 0 AS tdm_reservation, length({HOST_SQL}) % 3 = 0 AS restricts_ai_tdm FROM pages"
)
def robots_summaries(spark: SparkSession, d: str) -> DataFrame:
    return robots.summary(robots_files(spark, d)).select("site", F.array_join("disallow", " ").alias("disallow"), "crawl_delay", "tdm_reservation", "restricts_ai_tdm")


def page_rules(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", "url", urls.authority(F.col("url")).alias("site"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    found = robots.summary(robots_files(spark, d))
    rules = found.select("site", F.lit("disallow").alias("kind"), F.explode("disallow").alias("pattern")).unionAll(found.select("site", F.lit("allow").alias("kind"), F.explode("allow").alias("pattern")))
    return robots.allowed(pages, rules)


@register(f"SELECT page_id, {ALLOWED_SQL} AS allowed FROM pages")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    return page_rules(spark, d).select("page_id", "allowed")


FRONTIER_SQL = rf"""c AS (SELECT page_id, {ALLOWED_SQL} AS allowed, regexp_replace(url, '#.*$', '') AS u FROM pages),
k AS (SELECT page_id, allowed, lower(regexp_extract(u, '^([a-z]+://[^/?]*)', 1)) AS head, regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1) AS path,
  list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:sid|_xftoken|fbclid|utm_[^=]*)(?:=|$)')) AS q FROM c),
f AS (SELECT page_id, allowed, head || CASE WHEN suffix(path, '/') THEN path ELSE path || '/' END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical FROM k),
v AS (SELECT DISTINCT canonical FROM f WHERE page_id % 10 = 0),
w AS (SELECT *, CASE WHEN NOT starts_with(canonical, 'https://') THEN 'other_origin' WHEN canonical IN (SELECT canonical FROM v) THEN 'visited' WHEN NOT allowed THEN 'robots' END AS reason FROM f)
SELECT page_id, coalesce(reason, CASE WHEN page_id = min(page_id) OVER (PARTITION BY canonical, reason IS NULL) THEN 'queued' ELSE 'queued_before' END) AS decision FROM w"""


@register(f"WITH {FRONTIER_SQL}")
def frontier_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each page's URL, if every tenth was visited before."""
    found = page_rules(spark, d).select(F.col("page_id").alias("seq"), "url", F.lit("thread").alias("kind"), "allowed")
    visited = found.where("seq % 10 = 0").select(urls.canonical(F.col("url")).alias("url"))
    made = frontier.decided(found, visited, "https://", [], F.col("allowed"))
    return made.select(F.col("seq").alias("page_id"), "decision")


@register(
    f"SELECT k, k = 5 OR lower(trim(name)) = 'introductions' OR 'f' || k IN ('f7', 'f9') AS excluded FROM ({BOARD_SQL})"
)
def excluded_forums(spark: SparkSession, d: str) -> DataFrame:
    """Forums left out by id, or by slug and id."""
    url = F.concat(F.lit("https://b.example/forums/f"), F.col("n_nationkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string"), F.lit("/"))
    out = frontier.excluded_forum(url, F.col("n_name"), ["5", "f7", "f9.9"])
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), out.alias("excluded"))


@register("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 3")
def page_cap(spark: SparkSession, d: str) -> DataFrame:
    return frontier.capped(read(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 3)


@register("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1 ORDER BY doc_id LIMIT 200")
def thread_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first threads that are no redirects."""
    threads = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4 == 1).alias("redirect"))
    return frontier.threads_to_read(threads, ["doc_id"], 200).select("doc_id")


@register("SELECT event_id, (event_id % 600) IN (403, 408, 425, 429) OR event_id % 600 >= 500 AS again FROM events")
def retryable_requests(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", frontier.retryable(F.col("event_id") % 600).alias("again"))


@register("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5000")
def progress_tail(spark: SparkSession, d: str) -> DataFrame:
    return frontier.tail(read(spark, d, "events").select("event_id"), "event_id", 5000)


@register("SELECT k, name FROM (SELECT n_nationkey AS k, n_name AS name FROM nation) WHERE k IN (1, 2, 7)")
def forums_asked(spark: SparkSession, d: str) -> DataFrame:
    """Forums by id or by URL."""
    rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    named = rows.withColumn("id", F.col("k").cast("string")).withColumn("url", F.concat(F.lit("/forums/"), "id"))
    return frontier.forums_asked(named, ["1", "2"], ["/forums/7"]).select("k", "name")


@register(
    "SELECT event_id, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 ELSE 3 END AS place FROM events WHERE event_type IS NOT NULL "
    "ORDER BY place, event_id LIMIT 1000"
)
def frontier_order(spark: SparkSession, d: str) -> DataFrame:
    """The head of a queue: by kind, then first come first served."""
    queue = read(spark, d, "events").where("event_type IS NOT NULL").select("event_id", F.col("event_type").alias("kind"), F.col("event_id").alias("seq"))
    place = F.when(F.col("kind") == "click", 0).when(F.col("kind") == "view", 1).otherwise(3)
    return dedup.priority(queue, ("click", "view")).limit(1000).select("event_id", place.alias("place"))


# ---- totals, gates, rules


def archive_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"forums": read(spark, d, "nation"), "threads": read(spark, d, "pages"), "posts": read(spark, d, "documents"), "links": page_links(spark, d), "resources": read(spark, d, "labels")}


COUNTS_SQL = (
    "k AS (SELECT 'forums' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'threads', count(*) FROM pages UNION ALL SELECT 'posts', count(*) FROM documents UNION ALL "
    r"""SELECT 'links', coalesce(sum(len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"'))), 0)::BIGINT FROM pages UNION ALL SELECT 'resources', count(*) FROM labels)"""
)


@register(f"WITH {COUNTS_SQL} SELECT kind, n FROM k UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM k")
def record_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.record_counts(archive_tables(spark, d))


@register("SELECT 'label' AS type, doc_id, coalesce(quality, -1) AS quality, '' AS text FROM labels UNION ALL SELECT 'document', doc_id, -1, coalesce(md5(text), '') FROM documents")
def every_kind(spark: SparkSession, d: str) -> DataFrame:
    """Records of two kinds in one table; columns that a kind lacks are null."""
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("text"))
    made = reports.every_kind({"label": read(spark, d, "labels").select("doc_id", "quality"), "document": docs})
    return made.select("type", "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("text", F.lit("")).alias("text"))


@register(
    r"""SELECT CAST(coalesce(sum(turn), 0) AS BIGINT) AS total_quotes, CAST(0 AS BIGINT) AS total_attachments, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]'))) AS BIGINT) AS post_links,
(SELECT CAST(count(*) AS BIGINT) FROM pages) AS archive_links, (SELECT CAST(count(*) AS BIGINT) FROM labels) AS archive_resources FROM conversations"""
)
def interaction_totals(spark: SparkSession, d: str) -> DataFrame:
    posts = read(spark, d, "conversations").select(F.col("turn").alias("quote_count"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]"), F.lit(0)).alias("links"))
    return reports.interaction_totals(posts, read(spark, d, "pages"), read(spark, d, "labels"))


@register("SELECT CAST(floor(min(epoch_us(ts)) / 1000000) AS BIGINT) AS date_min, CAST(floor(max(epoch_us(ts)) / 1000000) AS BIGINT) AS date_max FROM events")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    return reports.date_range(read(spark, d, "events"), F.unix_seconds(F.col("ts").cast("timestamp")))


@register("SELECT strftime(min(ts), '%Y-%m') AS first_month, strftime(max(ts), '%Y-%m') AS last_month FROM events")
def month_coverage(spark: SparkSession, d: str) -> DataFrame:
    months = read(spark, d, "events").select(T.month(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("m"))
    return months.agg(F.min("m").alias("first_month"), F.max("m").alias("last_month"))


@register(r"""SELECT url, CAST(sum(n) AS BIGINT) AS records_added FROM (SELECT url, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"')) AS n FROM pages) GROUP BY url""")
def records_per_page(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    links = pages.select(F.col("url").alias("source_url"), F.explode(urls.links(F.col("html"))).alias("link_url"))
    return reports.records_per_page(pages.select("url").distinct(), links)


@register(
    "SELECT source, count(*) AS posts, CAST(coalesce(sum(n_chars % 4), 0) AS BIGINT) AS comments, regexp_replace(coalesce(source, ''), '[^A-Za-z0-9_]', "
    "'_', 'g') || '.jsonl' AS file FROM documents GROUP BY source"
)
def source_stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.source_stats(read(spark, d, "documents"), "source", F.col("n_chars") % 4)


@register("SELECT source, count(*) AS posts, 'ready_for_post_smoke_analysis' AS status, count(*) >= 100 AS ready FROM documents GROUP BY source")
def topic_readiness(spark: SparkSession, d: str) -> DataFrame:
    return reports.readiness(read(spark, d, "documents"), ["source"])


MEASURES_SQL = (
        "m AS (SELECT user_id, count(*) FILTER (user_id % 7 <> 0) AS posts, user_id % 5 <> 0 AS integrity_ok, "
        "CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 3 = 1 THEN false END AS stopped, "
        "CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 4 - 1 END AS queue_remaining, CASE WHEN user_id % 6 <> 0 THEN avg(CASE WHEN event_type = 'error' "
        "THEN 1.0 ELSE 0.0 END) END AS error_rate, "
    "count(*) FILTER (event_type = 'error') AS errors, user_id % 2 AS duplicate_posts FROM events GROUP BY user_id)"
)


def user_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of an archive for each user, which take every branch of the gates."""
    u = F.col("user_id")
    error = F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    made = read(spark, d, "events").groupBy("user_id").agg(F.count_if(u % 7 != 0).alias("posts"), error.alias("rate"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return made.select(
        "user_id",
        "posts",
        (u % 5 != 0).alias("integrity_ok"),
        F.when(u % 3 == 0, True).when(u % 3 == 1, False).alias("stopped"),
        F.when(u % 4 != 0, u % 4 - 1).alias("queue_remaining"),
        F.when(u % 6 != 0, F.col("rate")).alias("error_rate"),
        F.col("errors").alias("n_errors"),
        (u % 2).alias("duplicate_posts"),
        F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("line "), i.cast("string"))).alias("errors"),
    )


GATES_SQL = (
        "g AS (SELECT user_id, seq, gate, status FROM m, LATERAL (VALUES (0, 'archive_integrity', CASE WHEN integrity_ok THEN 'PASS' ELSE 'BLOCK' END), (1, "
        "'post_availability', CASE WHEN posts > 0 THEN 'PASS' ELSE 'BLOCK' END), "
        "(2, 'coverage_completion', CASE WHEN NOT coalesce(stopped, false) AND coalesce(queue_remaining, 0) = 0 THEN 'PASS' ELSE 'REVIEW' END), (3, "
        "'request_error_rate', CASE WHEN error_rate < 0.1 THEN 'PASS' ELSE 'REVIEW' END), "
        "(4, 'identity_deduplication', CASE WHEN duplicate_posts = 0 THEN 'PASS' ELSE 'REVIEW' END), (5, 'privacy_and_quote_risk', 'REVIEW'), (6, "
        "'construct_validity', 'REVIEW')) v(seq, gate, status))"
)


@register(f"WITH {MEASURES_SQL}, {GATES_SQL} SELECT user_id, seq, gate, status, CASE WHEN seq = 0 AND status = 'BLOCK' THEN 'line 1; line 2; line 3; line 4; line 5' END AS reason FROM g")
def gate_branches(spark: SparkSession, d: str) -> DataFrame:
    """Every gate of many archives, with the first errors of broken ones."""
    made = quality.gates(user_measures(spark, d), ("user_id",))
    return made.select("user_id", "seq", "gate", "status", F.when((F.col("seq") == 0) & (F.col("status") == "BLOCK"), F.col("reason")).alias("reason"))


@register(
    f"WITH {MEASURES_SQL}, {GATES_SQL} SELECT user_id, CASE WHEN bool_or(status = 'BLOCK') THEN 'BLOCK' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE "
    f"'PASS' END AS overall FROM g GROUP BY user_id"
)
def gate_overall(spark: SparkSession, d: str) -> DataFrame:
    return quality.overall(quality.gates(user_measures(spark, d), ("user_id",)), ("user_id",))


@register(f"WITH {MEASURES_SQL}, {GATES_SQL} SELECT user_id, seq, gate FROM g WHERE status <> 'PASS'")
def gate_actions(spark: SparkSession, d: str) -> DataFrame:
    return quality.next_actions(quality.gates(user_measures(spark, d), ("user_id",)), ("user_id",)).select("user_id", "seq", "gate")


@register(
        f"WITH {MEASURES_SQL} SELECT user_id, name, pass FROM m, LATERAL (VALUES ('posts_present', posts > 0), ('request_error_rate', "
        f"error_rate IS NULL OR error_rate < 0.1), ('duplicate_keys', duplicate_posts = 0)) v(name, pass)"
)
def archive_gates(spark: SparkSession, d: str) -> DataFrame:
    return quality.archive_gates(user_measures(spark, d).withColumn("posts_wanted", F.lit(True)), ("user_id",)).select("user_id", "name", "pass")


@register(f"WITH {MEASURES_SQL} SELECT user_id, CAST((posts = 0)::INT + (errors > 0)::INT + (duplicate_posts > 0)::INT AS INTEGER) AS n FROM m")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """How many recommendations each archive's measures give cause for."""
    made = quality.recommendations(user_measures(spark, d).withColumn("errors", F.col("n_errors")), ("user_id",))
    return made.select("user_id", F.size("recommendations").alias("n"))


@register(
        "SELECT * FROM (SELECT 'links' AS kind, 'link_url_missing' AS rule, 'error' AS severity, count(*) FILTER (event_id % 9 = 0) AS n FROM events UNION ALL "
        "SELECT 'links', 'scraped_at_missing', 'error', count(*) FILTER (event_type IS NULL) FROM events "
        "UNION ALL SELECT 'links', 'posted_at_no_timestamp', 'warning', count(*) FILTER (event_id % 11 = 0) FROM events UNION ALL SELECT 'links', "
        "'posted_at_invalid', 'error', count(*) FILTER (event_id % 13 = 0) FROM events "
    "UNION ALL SELECT 'posts', 'thread_id_missing', 'error', count(*) FILTER (event_id % 17 = 0) FROM events) WHERE n > 0"
)
def record_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules for links and posts, each broken by some records."""
    e, i = read(spark, d, "events"), F.col("event_id")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    links = e.select(
        F.when(i % 9 != 0, "https://x/").alias("link_url"),
        F.col("event_type").alias("scraped_at"),
        F.when(i % 11 == 0, "yesterday").otherwise(when).alias("posted_at"),
        F.when(i % 13 == 0, "2024-13-40").otherwise(when).alias("posted_at_iso"),
    )
    posts = e.select(F.when(i % 17 != 0, "t").alias("thread_id"))
    made = quality.issues(links, "links", quality.record_rules("links", links.columns, ""))
    return made.unionByName(quality.issues(posts, "posts", quality.record_rules("posts", posts.columns, "")))


@register(
        "SELECT 'comment' AS kind, 'score_negative' AS rule, 'error' AS severity, count(*) AS n FROM events WHERE value < 10 UNION ALL SELECT 'entity', "
        "'name_empty', 'error', count(*) FROM events WHERE event_type = '' HAVING count(*) > 0 "
    "UNION ALL SELECT 'entity', 'count_below_one', 'error', count(*) FROM events WHERE event_id % 3 = 0 HAVING count(*) > 0"
)
def model_rules(spark: SparkSession, d: str) -> DataFrame:
    rules, e = quality.model_rules(), read(spark, d, "events")
    comments = e.select((F.col("value") - 10).alias("score"))
    entities = e.select(F.col("event_type").alias("name"), (F.col("event_id") % 3).alias("count"))
    return quality.issues(comments, "comment", rules["comment"]).unionByName(quality.issues(entities, "entity", rules["entity"]))


# ---- texts


@register(
    r"SELECT conv_id, turn, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS spaced, regexp_replace(role || '/' || turn, "
    r"'[^A-Za-z0-9_]', '_', 'g') AS file FROM conversations"
)
def spaced_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    name = T.file_name(F.concat_ws("/", "role", F.col("turn").cast("string")))
    return rows.select("conv_id", "turn", F.sha2(T.spaced(F.coalesce("text", F.lit(""))), 256).alias("spaced"), F.when(F.col("role").isNotNull(), name).alias("file"))


@register("SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS stamp FROM events")
def stamps(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", reports.stamp(F.col("ts")).alias("stamp"))


@register(
    r"""SELECT CAST(doc_id AS VARCHAR) AS post_id, CAST(length(coalesce(text, '')) AS BIGINT) AS body_text_length, len(w) AS word_count, len(list_distinct(w)) AS unique_word_count, len(regexp_extract_all(coalesce(text, ''), '[.!?]+(\s|$)')) AS sentence_count,
CAST(n_chars % 3 AS BIGINT) AS quote_count, CAST(0 AS BIGINT) AS attachment_count, CAST(doc_id % 2 AS BIGINT) AS link_count, CAST(n_chars % 5 AS BIGINT) AS reaction_count, n_chars % 5 > 0 AS has_reactions, length(trim(coalesce(text, ''))) = 0 AS empty_body,
doc_id % 3 = 0 AS edited, false AS deleted, 'src-' || source AS source_url, '7' AS forum_id FROM (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents)"""
)
def feature_index(spark: SparkSession, d: str) -> DataFrame:
    """The further columns of the feature index, from posts that have most fields."""
    n, i = F.col("n_chars"), F.col("doc_id")
    posts = read(spark, d, "documents").select(
        i.alias("id"),
        F.col("text").alias("body_text"),
        F.struct(F.lit("https://b.example/forums/f.7/").alias("url")).alias("forum"),
        (n % 3).alias("quote_count"),
        F.when(i % 2 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("links"),
        (n % 5).alias("reactions_count"),
        (n % 5 > 0).alias("has_reactions"),
        (i % 3 == 0).alias("edited"),
        F.concat(F.lit("src-"), "source").alias("source_url"),
    )
    names = (
        "post_id body_text_length word_count unique_word_count sentence_count quote_count attachment_count link_count reaction_count has_reactions empty_body "
        "edited deleted source_url forum_id"
    )
    return aggregate.post_features(posts).select(*names.split())


@register("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN substr(sha256('pepper' || CAST(user_id AS VARCHAR)), 1, 16) ELSE '' END AS author FROM events")
def salted_authors(spark: SparkSession, d: str) -> DataFrame:
    """Pseudonyms with a salt; an empty name stays empty."""
    name = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("")
    return read(spark, d, "events").select("event_id", privacy.short_hash(name, "pepper").alias("author"))
