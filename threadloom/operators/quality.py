"""Record rules as issue tables, and gates as decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PASS, REVIEW, BLOCK = "PASS", "REVIEW", "BLOCK"
SEVERITY = {PASS: 0, REVIEW: 1, BLOCK: 2}


def issues(df: DataFrame, kind: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """kind, rule, severity and n for each rule (severity, condition) that some row breaks; one pass over df."""
    hits = df.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, (_, bad) in rules.items()))
    long = hits.unpivot([], list(rules), "rule", "n")
    severity = F.create_map(*[x for name, (level, _) in rules.items() for x in (F.lit(name), F.lit(level))])
    return long.where("n > 0").select(F.lit(kind).alias("kind"), "rule", severity[F.col("rule")].alias("severity"), "n")


def record_rules(kind: str, columns: list[str], origin: str, strict: bool = True) -> dict[str, tuple[str, Column]]:
    """The rules for a kind of records, as far as their columns are there."""
    c, out = F.col, {}
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit("")) == ""
    if "scraped_at" in columns:
        out["scraped_at_missing"] = ("error", blank("scraped_at"))
    if "source_url" in columns:
        out["foreign_source_url"] = ("warning", ~blank("source_url") & ~c("source_url").startswith(origin))
    if kind == "posts" and strict and "thread_id" in columns:
        out["thread_id_missing"] = ("error", blank("thread_id"))
    if kind in ("links", "resources") and "link_url" in columns:
        out["link_url_missing"] = ("error", blank("link_url"))
    if "posted_at" in columns:
        out["posted_at_no_timestamp"] = ("warning", ~blank("posted_at") & F.try_to_timestamp(c("posted_at")).isNull())
    if "posted_at_iso" in columns:
        out["posted_at_invalid"] = ("error", ~blank("posted_at_iso") & F.try_to_timestamp(c("posted_at_iso")).isNull())
    return out


def model_rules() -> dict[str, dict[str, tuple[str, Column]]]:
    """Constraints of the entity models by model."""
    c = F.col
    error = lambda bad: ("error", bad)
    return {
        "post": {"score_negative": error(c("score") < 0)},
        "comment": {"score_negative": error(c("score") < 0)},
        "entity": {"name_empty": error(F.length("name") < 1), "count_below_one": error(c("count") < 1)},
        "topic": {"id_negative": error(c("id") < 0), "words_empty": error(F.size("words") < 1), "weights_differ": error(F.size("words") != F.size("weights")), "document_count_negative": error(c("document_count") < 0)},
        "edge": {"weight_negative": error(c("weight") < 0)},
    }


def gates(measures: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys, seq, gate, status, reason and action for each row of measures: integrity_ok, posts, stopped, queue_remaining, error_rate, duplicate_posts.

    A column errors (an array of messages), if there is one, gives the first five as the reason of a broken archive. The last
    two gates always ask for review, so the whole can pass only by human decision.
    """
    c = F.col
    status = lambda ok, other: F.when(ok, PASS).otherwise(other)
    sound = F.coalesce(c("integrity_ok"), F.lit(False))
    has_posts = F.coalesce(c("posts"), F.lit(0)) > 0
    complete = ~F.coalesce(c("stopped"), F.lit(False)) & (F.coalesce(c("queue_remaining"), F.lit(0)) == 0)
    few_errors = F.coalesce(c("error_rate") < 0.10, F.lit(False))
    unique = F.coalesce(c("duplicate_posts"), F.lit(0)) == 0
    broken = F.array_join(F.slice(F.coalesce("errors", F.array().cast("array<string>")), 1, 5), "; ") if "errors" in measures.columns else F.lit("record checks failed")
    as_text = lambda x: F.coalesce(x.cast("string"), F.lit("unknown"))
    rows = [
        ("archive_integrity", status(sound, BLOCK), F.when(sound, "record checks hold").otherwise(broken), F.when(sound, "proceed to coverage").otherwise("repair the archive")),
        ("post_availability", status(has_posts, BLOCK), F.concat(as_text(c("posts")), F.lit(" posts")), F.when(has_posts, "proceed").otherwise("collect posts first")),
        (
            "coverage_completion",
            status(complete, REVIEW),
            F.concat(F.lit("stopped: "), as_text(c("stopped")), F.lit(", queued: "), as_text(c("queue_remaining"))),
            F.when(complete, "inspect exclusions").otherwise("report coverage with every summary"),
        ),
        (
            "request_error_rate",
            status(few_errors, REVIEW),
            F.when(c("error_rate").isNull(), "no request log").otherwise("share of failed requests"),
            F.when(c("error_rate").isNull(), "count failed requests").when(few_errors, "continue").otherwise("report what is missing by page kind"),
        ),
        ("identity_deduplication", status(unique, REVIEW), F.concat(F.coalesce("duplicate_posts", F.lit(0)).cast("string"), F.lit(" repeated identities")), F.when(unique, "join by id").otherwise("resolve identities first")),
        ("privacy_and_quote_risk", F.lit(REVIEW), F.lit("public text can identify its author"), F.lit("pseudonymise and do not quote verbatim")),
        ("construct_validity", F.lit(REVIEW), F.lit("labels are categories, not evidence"), F.lit("code by hand and report doubt")),
    ]
    made = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(g).alias("gate"), s.alias("status"), r.alias("reason"), a.alias("action")) for i, (g, s, r, a) in enumerate(rows)))
    return measures.select(*keys, F.inline(made))


def archive_gates(measures: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys, name, pass and action of an archive's own three gates, from posts_wanted, posts, error_rate (null for no requests) and duplicate_posts."""
    c = F.col
    rows = [
        ("posts_present", ~F.coalesce(c("posts_wanted"), F.lit(True)) | (c("posts") > 0), "read no results about posts"),
        ("request_error_rate", c("error_rate").isNull() | (c("error_rate") < 0.1), "review errors and coverage first"),
        ("duplicate_keys", c("duplicate_posts") == 0, "resolve identities before networks are made"),
    ]
    return measures.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), ok.alias("pass"), F.lit(a).alias("action")) for n, ok, a in rows))))


def recommendations(measures: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys and a list of what measures (posts, errors, duplicate_posts) give cause for; an empty list for nothing."""
    rules = [
        (F.col("posts") == 0, "collect posts before topics are made"),
        (F.col("errors") > 0, "read the errors before coverage is judged"),
        (F.col("duplicate_posts") > 0, "look into repeated keys before networks and topics"),
    ]
    return measures.select(*keys, F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in rules))).alias("recommendations"))


def smoke(issues_: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: pass, errors and warnings (messages in order) of an archive, from its issues and its record counts (kind, n). No posts are a warning; any error fails the archive."""
    message = F.concat_ws(" ", "kind", "rule", F.col("n").cast("string"))
    found = issues_.select("severity", message.alias("message"))
    none = counts.agg(F.coalesce(F.sum(F.when(F.col("kind") == "posts", F.col("n"))), F.lit(0)).alias("posts")).where("posts = 0")
    every = found.unionAll(none.select(F.lit("warning").alias("severity"), F.lit("posts none 0").alias("message")))
    pick = lambda level: F.array_sort(F.collect_list(F.when(F.col("severity") == level, F.col("message"))))
    made = every.agg(pick("error").alias("errors"), pick("warning").alias("warnings"))
    return made.select((F.size("errors") == 0).alias("pass"), "errors", "warnings")


def overall(decisions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The worst status of all gates, by the keys."""
    rank = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    name = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(v), F.lit(k))])
    return decisions.groupBy(*keys).agg(F.max(rank[F.col("status")]).alias("worst")).select(*keys, name[F.coalesce("worst", F.lit(0))].alias("overall"))


def next_actions(decisions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return decisions.where(F.col("status") != PASS).select(*keys, "seq", "gate", "action").orderBy(*keys, "seq")


def markdown(decisions: DataFrame) -> DataFrame:
    """One row of Markdown: a table of the gates, which are seven. Bars in texts become slashes."""
    plain = lambda x: F.replace(F.col(x), F.lit("|"), F.lit("/"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(plain(x) for x in ("gate", "status", "reason", "action"))), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return decisions.agg(F.array_join(F.concat(F.array(F.lit("| gate | status | reason | action |"), F.lit("|-|-|-|-|")), lines), "\n").alias("markdown"))


def measures_of(spark: SparkSession, **values: object) -> DataFrame:
    kinds = {"integrity_ok": "boolean", "posts": "long", "stopped": "boolean", "queue_remaining": "long", "error_rate": "double", "duplicate_posts": "long"}
    return spark.range(1).select(*(F.lit(values.get(k)).cast(t).alias(k) for k, t in kinds.items()))
