"""The registered queries over the driver's tables, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy, urls
from ..functions import text as T
from ..operators import aggregate, dedup, network, quality, stats
from ..streaming import deltas

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A lexicon of words that the tables' invented languages have, besides the fixed ones.
LEXICONS = {**T.LEXICONS, "function_words": ["that", "this", "les", "des", "die", "der", "los", "para", "with", "from"]}
HEDGES = ["may", "might", "perhaps", "possibly", "or", "seems", "peut", "vielleicht"]
SITE = "https://"

# The same patterns in the oracle's dialect, in which a quote is doubled.
TERMS_SQL = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_''’-]+'), lambda t: lower(t))"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
CONTENT_SQL = f"list_filter({TERMS_SQL}, lambda t: length(t) >= 3 AND t NOT IN ({STOP_SQL}))"
COUNTS_SQL = f"counts AS (SELECT term, count(*) AS n FROM (SELECT unnest({CONTENT_SQL}) AS term FROM documents) GROUP BY term)"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def posts(spark: SparkSession, d: str) -> DataFrame:
    """documents in the shape of posts."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body_text"), F.col("source").alias("forum_title"), "lang", F.col("n_chars").alias("body_text_length"))


# ---- lexical baseline


@register(f"WITH {COUNTS_SQL} SELECT term, n FROM counts ORDER BY n DESC, term LIMIT 100")
def lexical_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.term_counts(read(spark, d, "documents")).orderBy(F.desc("n"), "term").limit(100)


@register(
    f"WITH {COUNTS_SQL} SELECT count(*) AS vocabulary, CAST(sum(n) AS BIGINT) AS tokens, round(-sum(n / t * log2(n / t)), 6) AS entropy_bits FROM counts, "
    f"(SELECT sum(n)::DOUBLE AS t FROM counts)"
)
def lexical_entropy(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.lexical_baseline(aggregate.term_counts(read(spark, d, "documents"))).withColumn("entropy_bits", F.round("entropy_bits", 6))


@register(
    "WITH lexicons(lexicon, word) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in LEXICONS.items() for w in ws) + f"), t AS (SELECT source, unnest({CONTENT_SQL}) AS term FROM documents),"
    " hit AS (SELECT source, lexicon, count(*) AS n FROM t JOIN lexicons ON term = word GROUP BY ALL)"
        " SELECT s.source, l.lexicon, coalesce(n, 0) AS hits FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lexicon "
        "FROM lexicons) l LEFT JOIN hit h ON h.source = s.source AND h.lexicon = l.lexicon"
)
def lexicon_hits_by_source(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.lexicon_totals(read(spark, d, "documents"), LEXICONS, ["source"])


# ---- per-row features


@register(
    f"SELECT doc_id AS id, len({TERMS_SQL}) AS tokens, len(list_distinct({CONTENT_SQL})) AS unique_tokens, coalesce(nullif(n_chars, 0), "
    f"length(text)) AS body_chars, 0::BIGINT AS quote_count, 0::BIGINT AS attachment_count, 0::BIGINT AS link_count FROM documents"
)
def doc_features(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.document_features(posts(spark, d)).drop("thread_id")


FEATURES_SQL = r"""SELECT {id} AS post_id, {thread} AS thread_id, len(w) AS word_count, len(list_distinct(w)) AS unique_word_count,
len(regexp_extract_all(text, '[.!?]+(\s|$)')) AS sentence_count, length(text) - length(replace(text, '?', '')) AS question_count, length(text) - length(replace(text, '!', '')) AS exclamation_count,
len(regexp_extract_all(text, '(?i)https?://|www\.')) AS url_count, length(trim(text)) = 0 AS empty_body FROM (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {table})"""
FEATURES = ["post_id", "thread_id", "word_count", "unique_word_count", "sentence_count", "question_count", "exclamation_count", "url_count", "empty_body"]


@register(FEATURES_SQL.format(id="CAST(doc_id AS VARCHAR)", thread="source", table="documents"))
def post_features(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.post_features(posts(spark, d).withColumnRenamed("forum_title", "thread_id")).select(*FEATURES)


@register(FEATURES_SQL.format(id="concat(conv_id, '-', turn)", thread="CAST(conv_id AS VARCHAR)", table="conversations"))
def turn_features(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("thread_id"), F.col("text").alias("body_text"))
    return aggregate.post_features(turns).select(*FEATURES)


# ---- descriptive report


@register(
    "SELECT (list_sort(l))[1] AS min_length, (list_sort(l))[len(l) // 2 + 1] AS upper_median, (list_sort(l))[CAST(floor((len(l) - 1) * 0.5) AS BIGINT) + "
    "1] AS median, (list_sort(l))[CAST(floor((len(l) - 1) * 0.9) AS BIGINT) + 1] AS p90, (list_sort(l))[len(l)] AS max_length "
    "FROM (SELECT list(n_chars) AS l FROM documents WHERE n_chars IS NOT NULL)"
)
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.length_stats(read(spark, d, "documents"), "n_chars")


@register("SELECT coalesce(source, '') AS forum, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, forum LIMIT 20")
def posts_per_source_top20(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.top(read(spark, d, "documents"), F.coalesce("source", F.lit("")), "forum", 20)


@register("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def events_per_month(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.per_month(read(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@register(
    "WITH m AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT unnest(generate_series(min(day), max(day), "
    "INTERVAL 1 DAY)) AS day FROM m) SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM s LEFT JOIN m ON s.day = m.day"
)
def day_spine(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "events").where("ts IS NOT NULL").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL").select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    return spine.join(days, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


DOMAIN_SQL = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"


@register(f"SELECT {DOMAIN_SQL} AS domain, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 30")
def domain_top_authority(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.top(read(spark, d, "pages").where("url IS NOT NULL"), urls.authority(F.col("url")), "domain", 30)


@register(f"SELECT {DOMAIN_SQL} AS domain, count(*) AS n FROM pages WHERE {DOMAIN_SQL} <> '' GROUP BY 1 ORDER BY n DESC, domain LIMIT 50")
def domain_top_host(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.top(read(spark, d, "pages").where(urls.host(F.col("url")).isNotNull()), urls.host(F.col("url")), "domain", 50)


CANONICAL_SQL = r"""SELECT page_id, head || CASE WHEN suffix(path, '/') THEN path ELSE path || '/' END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical FROM (
SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '(?i)/unread/?$', '/'), '(?i)/post-[0-9]+/?$', '/') AS path,
list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:sid|_xftoken|fbclid|utm_[^=]*)(?:=|$)')) AS q FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))"""


@register(CANONICAL_SQL)
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@register(
    r"SELECT page_id, CASE WHEN contains(url, '/threads/') THEN 'thread' WHEN contains(url, '/forums/') THEN 'forum' WHEN contains(url, "
    r"'/members/') THEN 'member' WHEN regexp_matches(url, '^https?://[^/?#]*/?(?:$|[?#])') OR regexp_matches(url, "
    r"'/forums/?$') THEN 'index' ELSE 'other' END AS page_type FROM pages"
)
def url_page_type(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", urls.page_type(F.col("url")).alias("page_type"))


LINKS_SQL = r"""links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS link_url FROM pages)"""


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("link_url"))


@register(f"WITH {LINKS_SQL} SELECT page_id, link_url, count(*) AS n FROM links GROUP BY ALL")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return page_links(spark, d).groupBy("page_id", "link_url").agg(F.count("*").alias("n"))


CLASS_SQL = r"""CASE WHEN lower(regexp_extract(p, '(?i)\.([a-z0-9]{2,8})$', 1)) = 'pdf' AND regexp_matches(p, 'pdf$') OR regexp_matches(v, '\bpdf\b') THEN 'pdf'
WHEN regexp_matches(p, '\.(doc|docx|odt|rtf|txt|xls|xlsx|ppt|pptx)$') THEN 'document' WHEN regexp_matches(v, '\b(ebook|e-book|book|novel|grimoire|manual)\b') OR regexp_matches(p, '\.(epub|mobi|azw|azw3|fb2)$') THEN 'ebook'
WHEN regexp_matches(p, '\.(zip|rar|7z|tar|gz|iso)$') THEN 'archive' WHEN regexp_matches(v, '\b(download|attachment|file|upload)\b') THEN 'download' END"""


@register(
    f"WITH {LINKS_SQL}, all_ AS (SELECT page_id, link_url FROM links UNION ALL SELECT page_id, url || '/f.' || e FROM pages, (VALUES ('pdf'), ('DOCX'), "
    f"('epub'), ('zip')) x(e)) SELECT coalesce({CLASS_SQL}, 'unclassified') AS resource_type, count(*) AS n FROM (SELECT regexp_extract(link_url, "
    f"'^([^?#]*)', 1) AS p, lower(link_url || ' ') AS v FROM all_) GROUP BY 1"
)
def resource_class(spark: SparkSession, d: str) -> DataFrame:
    made = read(spark, d, "pages").select("page_id", F.explode(F.array(*(F.concat("url", F.lit(f"/f.{e}")) for e in ("pdf", "DOCX", "epub", "zip")))).alias("link_url"))
    kind = F.coalesce(urls.resource_type(F.col("link_url"), F.lit("")), F.lit("unclassified")).alias("resource_type")
    return page_links(spark, d).unionByName(made).groupBy(kind).agg(F.count("*").alias("n"))


@register(
    f"WITH {LINKS_SQL} SELECT link_url AS url, {DOMAIN_SQL.replace('url', 'l.link_url')} AS domain, count(*) AS link_count, min(page_id) AS first_page, "
    f"max(page_id) AS last_page FROM links l GROUP BY ALL"
)
def resource_inventory(spark: SparkSession, d: str) -> DataFrame:
    return page_links(spark, d).groupBy(F.col("link_url").alias("url")).agg(F.count("*").alias("link_count"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")).withColumn("domain", F.coalesce(urls.host(F.col("url")), F.lit("")))


# ---- privacy


@register("SELECT event_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS author_hash FROM events")
def hash_author_16(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", privacy.short_hash(F.col("user_id").cast("string")).alias("author_hash"))


@register(
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN sha256(role) ELSE sha256(sha256(role) || '') END AS author_hash FROM conversations "
    "WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, sha256(role) FROM conversations WHERE turn % 2 <> 0"
)
def hash_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """Odd turns come as upper-case digests already, and pass in lower case."""
    given = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.upper(F.sha2("role", 256)))
    return read(spark, d, "conversations").select("conv_id", "turn", privacy.full_hash(given).alias("author_hash"))


@register(
    f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[email]', 'g'), '{T.PHONE.replace(chr(92) + '+?', '[+]?')}', '[phone]', "
    f"'g')) AS redacted, len(regexp_extract_all(text, '{T.EMAIL}')) AS emails FROM documents"
)
def pii_redacted(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.sha2(T.without_personal_data(text), 256).alias("redacted"), F.regexp_count(text, F.lit(T.EMAIL)).cast("long").alias("emails"))


# ---- duplicates


@register("SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dup_exact(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("SELECT count(*) - count(DISTINCT text) AS duplicate_risk FROM documents")
def dup_risk(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_risk(read(spark, d, "documents"), F.sha2("text", 256))


@register("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def keep_first_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("key"))
    return dedup.keep_first(docs, [F.col("key")], [F.col("doc_id")]).drop("key")


@register("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_resume(spark: SparkSession, d: str) -> DataFrame:
    return dedup.not_yet(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@register(
    "SELECT count(*) AS labels, count(d.doc_id) AS resolved, count(*) - count(d.doc_id) AS dangling FROM labels l LEFT JOIN (SELECT DISTINCT doc_id "
    "FROM documents) d ON l.doc_id = d.doc_id"
)
def referential_check(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "documents").select("doc_id").distinct().withColumn("there", F.lit(1))
    return read(spark, d, "labels").join(ids, "doc_id", "left").agg(F.count("*").alias("labels"), F.count("there").alias("resolved")).withColumn("dangling", F.col("labels") - F.col("resolved"))


# ---- request log, gates and rules


@register("SELECT coalesce(event_type, 'network_error') AS status, count(*) AS n FROM events GROUP BY 1")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.status_histogram(read(spark, d, "events"), "event_type")


@register("SELECT round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) AS error_rate, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS empty_rate FROM events")
def error_rate(spark: SparkSession, d: str) -> DataFrame:
    made = aggregate.rates(read(spark, d, "events"), error_rate=F.col("event_type") == "error", empty_rate=F.col("value").isNull())
    return made.select(*(F.round(c, 9).alias(c) for c in made.columns))


@register("""WITH m AS (SELECT (SELECT count(*) FROM documents) AS posts, (SELECT avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FROM events) AS e, (SELECT count(*) - count(DISTINCT text) FROM documents) AS dup)
SELECT seq, gate, status FROM m, LATERAL (VALUES (0, 'archive_integrity', 'PASS'), (1, 'post_availability', CASE WHEN posts > 0 THEN 'PASS' ELSE 'BLOCK' END), (2, 'coverage_completion', 'PASS'), (3, 'request_error_rate', CASE WHEN e < 0.1 THEN 'PASS' ELSE 'REVIEW' END), (4, 'identity_deduplication', CASE WHEN dup = 0 THEN 'PASS' ELSE 'REVIEW' END), (5, 'privacy_and_quote_risk', 'REVIEW'), (6, 'construct_validity', 'REVIEW')) g(seq, gate, status)""")
def coverage_gates(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "documents").agg(F.count("*").alias("posts"))
    risk = dedup.duplicate_risk(read(spark, d, "documents"), F.sha2("text", 256)).withColumnRenamed("duplicate_risk", "duplicate_posts")
    rate = aggregate.rates(read(spark, d, "events"), error_rate=F.col("event_type") == "error")
    measures = n.join(F.broadcast(risk)).join(F.broadcast(rate)).select("*", F.lit(True).alias("integrity_ok"), F.lit(False).alias("stopped"), F.lit(0).cast("long").alias("queue_remaining"))
    return quality.gates(measures).select("seq", "gate", "status")


@register(
    "SELECT kind, rule, severity, n FROM (SELECT 'posts' AS kind, 'foreign_source_url' AS rule, 'warning' AS severity, count(*) AS n FROM pages "
    "WHERE url <> '' AND NOT starts_with(url, 'https://')) WHERE n > 0"
)
def issue_rules(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select(F.col("url").alias("source_url"), F.col("page_id").alias("thread_id"), F.lit("2024-01-01T00:00:00Z").alias("scraped_at"))
    return quality.issues(pages, "posts", quality.record_rules("posts", pages.columns, SITE))


# ---- networks


@register(
    "SELECT role AS source, before AS target, count(*) AS weight FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before "
    "FROM conversations) WHERE before IS NOT NULL GROUP BY ALL"
)
def reply_edges(spark: SparkSession, d: str) -> DataFrame:
    return network.reply_edges(read(spark, d, "conversations"), "conv_id", "turn", "role")


@register(
    "WITH a AS (SELECT DISTINCT conv_id, role FROM conversations WHERE role IS NOT NULL) SELECT x.role AS source, y.role AS target, count(*) AS weight "
    "FROM a x JOIN a y ON x.conv_id = y.conv_id AND x.role < y.role GROUP BY ALL"
)
def thread_participation_edges(spark: SparkSession, d: str) -> DataFrame:
    return network.participation_edges(read(spark, d, "conversations"), "conv_id", "role")


DEGREES_SQL = (
    "e AS (SELECT role AS source, before AS target, count(*) AS weight FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before "
    "FROM conversations) WHERE before IS NOT NULL GROUP BY ALL)"
)


@register(
    f"WITH {DEGREES_SQL}, n AS (SELECT source AS node, 0 AS i, 1 AS o, weight AS w FROM e UNION ALL SELECT target, 1, 0, weight FROM e) SELECT node, "
    f"CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i * w) AS BIGINT) AS weighted_in, "
    f"CAST(sum(o * w) AS BIGINT) AS weighted_out FROM n GROUP BY node"
)
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return network.degrees(reply_edges(spark, d))


@register("""WITH once AS (SELECT DISTINCT user_id, event_type || '-' || CAST(CAST(floor(value) AS BIGINT) % 20 AS VARCHAR) AS item FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL), s AS (SELECT item, count(*) AS n FROM once GROUP BY item HAVING count(*) >= 3),
b AS (SELECT x.item AS source, y.item AS target, count(*) AS n_both FROM once x JOIN once y ON x.user_id = y.user_id AND x.item < y.item GROUP BY ALL)
SELECT source, target, n_both AS "both", round(n_both / (p.n + q.n - n_both), 6) AS jaccard FROM b JOIN s p ON p.item = source JOIN s q ON q.item = target WHERE n_both / (p.n + q.n - n_both) >= 0.05""")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "events").where("value IS NOT NULL AND event_type IS NOT NULL").select("user_id", F.concat_ws("-", "event_type", (F.floor("value") % 20).cast("string")).alias("item"))
    return network.cooccurrence(items, "user_id", "item").withColumn("jaccard", F.round("jaccard", 6))


# ---- statistics

BY_LANG_SQL = (
    f"counts AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({CONTENT_SQL}) AS term FROM documents) GROUP BY ALL), two AS (SELECT term, "
    f"CAST(sum(CASE WHEN lang = 'en' THEN n ELSE 0 END) AS DOUBLE) AS x, CAST(sum(CASE WHEN lang = 'fr' THEN n ELSE 0 END) AS DOUBLE) AS y FROM counts "
    f"WHERE lang IN ('en', 'fr') GROUP BY term), s AS (SELECT sum(x) AS tx, sum(y) AS ty, count(*) AS v FROM two)"
)


def en_fr(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("lang", F.explode(T.content_terms(F.col("text"))).alias("term"))
    return stats.side_by_side(docs.groupBy("lang", "term").agg(F.count("*").alias("n")), "term", "lang", "n", "en", "fr")


@register(f"WITH {BY_LANG_SQL} SELECT round(sum((x + 1) / (tx + v) * log2(((x + 1) / (tx + v)) / ((y + 1) / (ty + v)))), 6) AS kl_bits FROM two, s")
def kl_divergence(spark: SparkSession, d: str) -> DataFrame:
    return stats.kl_divergence(en_fr(spark, d)).select(F.round("kl_bits", 6).alias("kl_bits"))


@register(
    f"WITH {BY_LANG_SQL} SELECT term, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(ln((x + 1) / (tx + v - x - 1)) - ln((y + 1) / (ty + v - y - "
    f"1)), 6) AS log_odds FROM two, s ORDER BY round(ln((x + 1) / (tx + v - x - 1)) - ln((y + 1) / (ty + v - y - 1)), 6) DESC, term LIMIT 50"
)
def log_odds(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_odds(en_fr(spark, d)).withColumn("log_odds", F.round("log_odds", 6)).orderBy(F.desc("log_odds"), "term").limit(50)


@register("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS t, count(*)::DOUBLE AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), p AS (SELECT day, t, n / sum(n) OVER (PARTITION BY day) AS p FROM c), days AS (SELECT day, lead(day) OVER (ORDER BY day) AS next FROM (SELECT DISTINCT day FROM p)),
k AS (SELECT d.day, d.next, t.t FROM days d CROSS JOIN (SELECT DISTINCT t FROM p) t WHERE d.next IS NOT NULL), j AS (SELECT k.day, coalesce(a.p, 0) AS a, coalesce(b.p, 0) AS b FROM k LEFT JOIN p a ON a.day = k.day AND a.t = k.t LEFT JOIN p b ON b.day = k.next AND b.t = k.t)
SELECT day, round(sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2, 6) AS js_bits FROM j GROUP BY day""")
def js_consecutive_days(spark: SparkSession, d: str) -> DataFrame:
    """Each day's divergence from the next day that has events. A day's kinds of events are a map in its row."""
    counts = read(spark, d, "events").where("event_type IS NOT NULL").groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("t")).agg(F.count("*").alias("n"))
    days = counts.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("a"), F.sum("n").alias("na"))
    w = Window.orderBy("day")
    both = days.withColumn("b", F.lead("a").over(w)).withColumn("nb", F.lead("na").over(w)).where("b IS NOT NULL")
    p = lambda m, n, k: F.coalesce(F.try_element_at(m, k), F.lit(0)) / n
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.transform(F.array_union(F.map_keys("a"), F.map_keys("b")), lambda k: part(p(F.col("a"), F.col("na"), k), p(F.col("b"), F.col("nb"), k)) + part(p(F.col("b"), F.col("nb"), k), p(F.col("a"), F.col("na"), k)))
    return both.select("day", F.round(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2, 6).alias("js_bits"))


@register(
    "WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), "
    "t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c), m AS (SELECT sum(x.n * y.n) AS xy FROM (SELECT a, sum(n) AS n "
    "FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON a = b) SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS observed, "
    "round(xy / n / n, 6) AS expected, round((same / n - xy / n / n) / (1 - xy / n / n), 6) AS kappa FROM t, m"
)
def kappa_quality_toxic(spark: SparkSession, d: str) -> DataFrame:
    made = stats.kappa(read(spark, d, "labels"), "quality", "toxic")
    return made.select("n", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


@register(
    "WITH r AS (SELECT n_chars, lang, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM documents "
    "WHERE lang IN ('en', 'fr') AND n_chars IS NOT NULL) SELECT count(*) FILTER (lang = 'en') AS n_a, count(*) FILTER (lang = 'fr') AS n_b, "
    "CAST(sum(rk) FILTER (lang = 'en') - count(*) FILTER (lang = 'en') * (count(*) FILTER (lang = 'en') + 1) / 2 AS DOUBLE) AS u FROM r"
)
def mannwhitney_u(spark: SparkSession, d: str) -> DataFrame:
    return stats.mann_whitney(read(spark, d, "documents"), "n_chars", "lang", "en", "fr")


@register(
    f"WITH {COUNTS_SQL}, h AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank FROM counts) SELECT count(*) AS terms, "
    f"round(regr_slope(ln(n), ln(rank)), 6) AS slope, round(regr_r2(ln(n), ln(rank)), 6) AS r2 FROM h WHERE rank <= 1000"
)
def zipf_slope(spark: SparkSession, d: str) -> DataFrame:
    made = stats.zipf(aggregate.term_counts(read(spark, d, "documents")), "term", "n")
    return made.select("terms", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


GAPS_SQL = "g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)"


@register(
    f"WITH {GAPS_SQL} SELECT user_id, count(gap) AS gaps, round(avg(gap), 4) AS mean_gap, round((stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + "
    f"avg(gap)), 6) AS burstiness FROM g WHERE gap IS NOT NULL GROUP BY user_id"
)
def inter_event_burstiness(spark: SparkSession, d: str) -> DataFrame:
    made = stats.burstiness(read(spark, d, "events"), "user_id", "ts", "event_id")
    return made.select("user_id", "gaps", F.round("mean_gap", 4).alias("mean_gap"), F.round("burstiness", 6).alias("burstiness"))


@register(
    f"WITH {GAPS_SQL}, s AS (SELECT *, sum(CASE WHEN gap <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, "
    f"event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS started, "
    f"max(ts) AS ended FROM s GROUP BY ALL"
)
def session_gap_windows(spark: SparkSession, d: str) -> DataFrame:
    return stats.sessions(read(spark, d, "events"), "user_id", "ts", "event_id")


@register(
    "WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn "
    "FROM documents) SELECT doc_id, lang, source FROM r WHERE rn <= 3"
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three documents of each language and source, by the hash of their id."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    return dedup.numbered(docs, ["lang", "source"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]).where("rn <= 3").drop("rn")


@register(
    f"SELECT source, CAST(sum(len(t)) AS BIGINT) AS tokens, round(avg(len(list_distinct(t)) / len(t)), 6) AS mean_ttr, "
    f"round(1000.0 * sum(len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in HEDGES)})))) / sum(len(t)), 6) AS hedges_per_1000 "
    f"FROM (SELECT source, {TERMS_SQL} AS t FROM documents) WHERE len(t) > 0 GROUP BY source"
)
def ttr_and_hedging(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("source", T.terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    n, hedges = F.size("t"), F.size(F.filter("t", lambda x: x.isin(HEDGES)))
    return docs.groupBy("source").agg(F.sum(n).alias("tokens"), F.round(F.avg(F.size(F.array_distinct("t")) / n), 6).alias("mean_ttr"), F.round(1000.0 * F.sum(hedges) / F.sum(n), 6).alias("hedges_per_1000"))


C_TF_SQL = (
    "SELECT lang, term, n, round(n / sum(n) OVER (PARTITION BY lang) * ln(1 + (SELECT sum(n) / count(DISTINCT lang) "
    "FROM counts) / sum(n) OVER (PARTITION BY term)), 9) AS score FROM counts"
)


@register(
    f"WITH {BY_LANG_SQL.split(', two AS')[0]}, scored AS ({C_TF_SQL}) SELECT lang, term, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang "
    f"ORDER BY score DESC, term) AS rn FROM scored) WHERE rn <= 10"
)
def c_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    """The ten terms of each language with the highest class-based TF-IDF."""
    docs = read(spark, d, "documents").select("lang", F.explode(T.content_terms(F.col("text"))).alias("term"))
    counts = docs.groupBy("lang", "term").agg(F.count("*").alias("n"))
    total = counts.agg((F.sum("n") / F.count_distinct("lang")).alias("mean"))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("per_lang"))
    spread = counts.groupBy("term").agg(F.sum("n").alias("per_term"))
    scored = counts.join(spread, "term").join(sums, "lang").join(F.broadcast(total))
    scored = scored.withColumn("score", F.round(F.col("n") / F.col("per_lang") * F.log(1 + F.col("mean") / F.col("per_term")), 9))
    return dedup.numbered(scored, ["lang"], [F.desc("score"), F.col("term")]).where("rn <= 10").select("lang", "term", "n", "score")


@register(
    "WITH t AS (SELECT corr(n_chars, quality) AS r, count(*) AS n FROM documents JOIN labels USING (doc_id) "
    "WHERE quality IS NOT NULL AND n_chars IS NOT NULL) SELECT n, round(r, 6) AS r FROM t"
)
def engagement_correlation(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id").where("quality IS NOT NULL AND n_chars IS NOT NULL")
    return both.agg(F.count("*").alias("n"), F.round(F.corr("n_chars", "quality"), 6).alias("r"))


@register(
    "SELECT lang, round(avg(CASE WHEN length(text) < 20 THEN 1.0 ELSE 0.0 END), 9) AS short_rate, round(avg(CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END), "
    "9) AS foreign_rate FROM documents GROUP BY lang"
)
def quality_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return read(spark, d, "documents").groupBy("lang").agg(rate(F.length("text") < 20).alias("short_rate"), rate(F.col("lang") != "en").alias("foreign_rate"))


@register(
    "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey "
    "JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)"
)
def forum_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals over a hierarchy of groups; orders are summed by customer before they meet the small tables."""
    per = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    whole = per.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("orders").alias("orders"), F.sum("total").alias("total"))
    named = whole.join(read(spark, d, "nation"), "n_nationkey").join(read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return named.rollup("r_name", "n_name").agg(F.sum("orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"))


# ---- streams


@register("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT DISTINCT event_id FROM events)")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The events read as a stream of files, without repeated ids."""
    return deltas.drained(deltas.without_repeats(deltas.event_stream(spark, f"{d}/events.parquet"), "event_id")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@register(
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS events, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 "
    "END), 9) AS error_rate FROM events GROUP BY 1"
)
def stream_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Events and errors by hour, from the stream."""
    made = deltas.drained(deltas.dashboard(deltas.event_stream(spark, f"{d}/events.parquet")), mode="complete")
    return made.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "events", F.round("error_rate", 9).alias("error_rate"))
