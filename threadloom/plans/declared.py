"""Queries of the declared analytics: registers, similarity, networks, trajectories, controls, topics, classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, lexical, network, similarity, stats, topics
from ..storage import stored
from .catalogue import CONTENT_SQL, HEDGES, TERMS_SQL, read, register


def phrase_sql(pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"len(regexp_extract_all(lower(coalesce(text, '')), '\\b(?:{pattern})\\b'))"


def strongest_sql(classes: dict[str, str]) -> str:
    names = list(classes)
    return f"CASE WHEN greatest({', '.join(names)}) = 0 THEN 'other' " + " ".join(f"WHEN {k} = greatest({', '.join(names)}) THEN '{k}'" for k in names) + " END"


COUNTED_MODES_SQL = ", ".join(f"{phrase_sql(p)} AS {k}" for k, p in {**lexical.DISCOURSE, **lexical.KNOWLEDGE}.items())


@register("SELECT doc_id, " + ", ".join(f"{phrase_sql(p)} AS {k}" for k, p in lexical.CONTENT_TYPES.items()) + " FROM documents")
def content_type_markers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", lexical.markers(F.col("text"), lexical.CONTENT_TYPES).alias("m")).select("doc_id", "m.*")


@register(f"SELECT {strongest_sql(lexical.DISCOURSE)} AS mode, {strongest_sql(lexical.KNOWLEDGE)} AS level, count(*) AS n FROM (SELECT {COUNTED_MODES_SQL} FROM conversations) GROUP BY ALL")
def discourse_modes(spark: SparkSession, d: str) -> DataFrame:
    """Turns by their strongest discourse mode and knowledge level."""
    found = read(spark, d, "conversations").select(lexical.markers(F.col("text"), lexical.DISCOURSE).alias("m"), lexical.markers(F.col("text"), lexical.KNOWLEDGE).alias("k"))
    return found.groupBy(lexical.strongest(F.col("m"), lexical.DISCOURSE).alias("mode"), lexical.strongest(F.col("k"), lexical.KNOWLEDGE).alias("level")).agg(F.count("*").alias("n"))


@register(
    r"SELECT doc_id, len(regexp_extract_all(lower(text), '\b(?:first|next|then|finally|step [0-9]+)\b')) AS step_markers, len(regexp_extract_all(text, "
    r"'(?m)^\s*[0-9]+[.)]')) AS numbered_lines, len(regexp_extract_all(lower(text), '\b(?:you|your|yours)\b')) AS second_person, "
    r"len(regexp_extract_all(lower(text), '\b(?:19|20)[0-9]{2}\b|\bpp?\.\s?[0-9]+|\bet al\b|\bibid\b')) AS citations FROM documents"
)
def register_features(spark: SparkSession, d: str) -> DataFrame:
    return lexical.register_features(read(spark, d, "documents")).select("doc_id", "step_markers", "numbered_lines", "second_person", "citations")


@register(
    f"SELECT doc_id, round(len(list_distinct(t)) / len(t), 6) AS ttr, round(1000.0 * len(list_filter(t, "
    f"lambda x: x IN ({', '.join(repr(w) for w in HEDGES)}))) / len(t), 6) AS hedging FROM (SELECT doc_id, {TERMS_SQL} AS t FROM documents) WHERE len(t) > 0"
)
def expertise_features(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return docs.select("doc_id", F.round(lexical.ttr(F.col("t")), 6).alias("ttr"), F.round(lexical.density(F.col("t"), HEDGES), 6).alias("hedging"))


@register()
def mtld_by_turn(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", lexical.mtld_forward(T.terms(F.col("text"))).alias("mtld"))


@register(
    r"SELECT doc_id, round(4.71 * len(regexp_extract_all(text, '[\p{L}\p{N}]')) / len(w) + 0.5 * len(w) / greatest(len(regexp_extract_all(text, "
    r"'[.!?]+(\s|$)')), 1) - 21.43, 6) AS ari FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) "
    r"WHERE len(w) > 0"
)
def readability(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.round(lexical.ari(F.col("text")), 6).alias("ari")).where("ari IS NOT NULL")


SHINGLE_SQL = r"""once AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text), w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM once),
s AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM w), n AS (SELECT id, count(*) AS n FROM s GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.id < y.id GROUP BY ALL)"""


@register(f"WITH {SHINGLE_SQL} SELECT a, b, round(k / (p.n + q.n - k), 6) AS jaccard FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.8")
def near_dup_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return similarity.jaccard_pairs(read(spark, d, "documents"), "doc_id", "text").withColumn("jaccard", F.round("jaccard", 6))


def user_edges(spark: SparkSession, d: str) -> DataFrame:
    """Users joined to the kinds of their events on each day: a graph with hubs."""
    e = read(spark, d, "events").where("event_type IS NOT NULL")
    day = F.concat_ws("/", "event_type", F.date_format("ts", "dd"))
    first = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("source"), day.alias("target"))
    return first.unionAll(e.select(F.col("event_type").alias("source"), day.alias("target"))).unionAll(e.select(F.concat(F.lit("u"), F.col("user_id")).alias("source"), F.col("event_type").alias("target")))


GRAPH_SQL = """e AS (SELECT 'u' || user_id AS s, event_type || '/' || strftime(ts, '%d') AS t FROM events WHERE event_type IS NOT NULL UNION ALL SELECT event_type, event_type || '/' || strftime(ts, '%d') FROM events WHERE event_type IS NOT NULL UNION ALL SELECT 'u' || user_id, event_type FROM events WHERE event_type IS NOT NULL),
p AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM e WHERE s <> t), x AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), deg AS (SELECT a AS node, count(*) AS degree FROM x GROUP BY a)"""


@register(
    f"WITH {GRAPH_SQL}, tri AS (SELECT x.a AS node, count(*) / 2 AS triangles FROM x JOIN x y ON x.b = y.a JOIN x z ON y.b = z.a AND z.b = x.a "
    f"GROUP BY x.a) SELECT d.node, degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, "
    f"0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM deg d LEFT JOIN tri USING (node)"
)
def clustering_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return network.clustering(user_edges(spark, d)).withColumn("clustering", F.round("clustering", 6))


@register(f"WITH {GRAPH_SQL} SELECT CAST(count(*) / 2 AS BIGINT) AS edges, round(corr(p.degree, q.degree), 6) AS assortativity FROM x JOIN deg p ON p.node = a JOIN deg q ON q.node = b")
def degree_assortativity(spark: SparkSession, d: str) -> DataFrame:
    return network.assortativity(user_edges(spark, d)).withColumn("assortativity", F.round("assortativity", 6))


@register("SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) m ON c.conv_id = m.conv_id AND c.turn = m.turn")
def unanswered_turns(spark: SparkSession, d: str) -> DataFrame:
    return network.unanswered(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@register(
    "WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, "
    "rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS b FROM documents JOIN labels USING (doc_id) "
    "WHERE n_chars IS NOT NULL AND quality IS NOT NULL) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r"
)
def spearman_length_quality(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return stats.spearman(both, "n_chars", "quality").select("n", F.round("rho", 6).alias("rho"))


@register(
    "WITH s AS (SELECT count(n_chars) FILTER (lang = 'en') AS na, count(n_chars) FILTER (lang = 'fr') AS nb, avg(n_chars) FILTER (lang = 'en') AS ma, "
    "avg(n_chars) FILTER (lang = 'fr') AS mb, var_samp(n_chars) FILTER (lang = 'en') AS va, var_samp(n_chars) FILTER (lang = 'fr') AS vb FROM documents) "
    "SELECT na AS n_a, nb AS n_b, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM s"
)
def effect_size(spark: SparkSession, d: str) -> DataFrame:
    return stats.cohens_d(read(spark, d, "documents"), "n_chars", "lang", "en", "fr").withColumn("d", F.round("d", 6))


@register(
    "WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), z AS (SELECT *, "
    "(n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0) AS z FROM c WINDOW w AS (PARTITION BY event_type)) SELECT event_type, strftime(day, "
    "'%Y-%m-%d') AS day, n, round(z, 6) AS z FROM z WHERE z >= 2"
)
def activity_bursts(spark: SparkSession, d: str) -> DataFrame:
    daily = read(spark, d, "events").where("event_type IS NOT NULL").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return stats.bursts(daily, "event_type", "day", "n").select("event_type", F.col("day").cast("string").alias("day"), "n", F.round("z", 6).alias("z"))


@register(
    "WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), e AS (SELECT DISTINCT day FROM c WHERE extract('dow' FROM day) = 0) "
    "SELECT strftime(e.day, '%Y-%m-%d') AS event, round(coalesce(sum(n), 0) / 7.0, 6) AS before, coalesce(sum(n), 0) / 7.0 >= 1.3 * (SELECT avg(n) "
    "FROM c) AS spike FROM e LEFT JOIN c ON c.day BETWEEN e.day - 7 AND e.day - 1 GROUP BY e.day"
)
def calendar_spikes(spark: SparkSession, d: str) -> DataFrame:
    daily = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    found = stats.before_events(daily, daily.where(F.dayofweek("day") == 1).select("day"))
    return found.select(F.col("event").cast("string").alias("event"), F.round("before", 6).alias("before"), "spike")


@register(
    "WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS born FROM events), w AS (SELECT user_id, CAST(date_diff('day', CAST(born AS DATE), "
    "CAST(ts AS DATE)) // 7 AS BIGINT) AS week, event_type FROM f) SELECT week, count(DISTINCT user_id) AS users, count(*) AS events, "
    "round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM w GROUP BY week"
)
def newcomer_trajectory(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    born = e.groupBy("user_id").agg(F.min("ts").alias("born"))
    week = F.floor(F.datediff(F.to_date("ts"), F.to_date("born")) / 7).cast("long")
    return e.join(born, "user_id").groupBy(week.alias("week")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("events"), F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("error_rate"))


@register(
    "WITH r AS (SELECT doc_id, lang, n_chars // 500 AS k, row_number() OVER (PARTITION BY n_chars // 500, lang "
    "ORDER BY md5(CAST(doc_id AS VARCHAR))) AS rn FROM documents WHERE lang IN ('en', 'fr')), m AS (SELECT k, least(count(*) FILTER (lang = 'en'), "
    "count(*) FILTER (lang = 'fr')) AS n FROM r GROUP BY k) SELECT doc_id, lang FROM r JOIN m USING (k) WHERE rn <= n"
)
def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return stats.matched(docs, "lang", "en", "fr", F.floor(F.col("n_chars") / 500), F.md5(F.col("doc_id").cast("string"))).select("doc_id", "lang")


NPMI_SQL = (
    f"t AS (SELECT DISTINCT doc_id, unnest({CONTENT_SQL}) AS term FROM documents), f AS (SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, "
    f"term LIMIT 50), u AS (SELECT doc_id, term FROM t WHERE term IN (SELECT term FROM f))"
)


@register(
    f"WITH {NPMI_SQL}, p AS (SELECT x.term AS source, y.term AS target, count(*)::DOUBLE AS k FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.term < y.term "
    f"GROUP BY ALL), g AS (SELECT count(*)::DOUBLE AS g FROM documents) SELECT source, target, CAST(k AS BIGINT) AS n_both, "
    f"round(CASE WHEN k < g THEN ln((k / g) / ((a.n / g) * (b.n / g))) / -ln(k / g) ELSE 1 END, 6) AS npmi FROM p JOIN f a ON a.term = source "
    f"JOIN f b ON b.term = target, g"
)
def npmi_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the fifty terms that most documents have."""
    docs = read(spark, d, "documents")
    once = docs.select("doc_id", F.explode(F.array_distinct(T.content_terms(F.col("text")))).alias("term"))
    head = once.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)
    sets = once.join(F.broadcast(head.select("term")), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("who"))
    both = network.pairs_of(sets, F.col("who")).groupBy("source", "target").agg(F.count("*").alias("n_both"))
    named = lambda s: head.select(F.col("term").alias(s), F.col("n").alias(f"n_{s}"))
    made = both.join(named("source"), "source").join(named("target"), "target").join(F.broadcast(docs.agg(F.count("*").alias("g"))))
    return made.select("source", "target", "n_both", F.round(stats.npmi(made, "n_both", "n_source", "n_target", F.col("g")), 6).alias("npmi"))


@register()
def lda_topic_terms(spark: SparkSession, d: str) -> DataFrame:
    return topics.lda_topics(read(spark, d, "documents"), k=4, rounds=5)


@register()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return topics.kmeans_topics(read(spark, d, "documents"), "doc_id", k=4).groupBy("cluster").agg(F.count("*").alias("n"))


def classifier_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with features (length, diversity, sentences, bars), their quality where it is known, and a fold by the hash of the id; written once, as every fit reads them."""
    text = F.col("text")
    rows = read(spark, d, "documents").select(
        "doc_id",
        F.log1p(F.length(F.coalesce(text, F.lit("")))).alias("length"),
        F.coalesce(lexical.ttr(T.terms(text)), F.lit(0.0)).alias("ttr"),
        T.sentence_count(text).cast("double").alias("sentences"),
        T.char_count(text, "|").cast("double").alias("bars"),
    )
    labels = read(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label"))
    made = VectorAssembler(inputCols=["length", "ttr", "sentences", "bars"], outputCol="features").transform(rows).select("doc_id", "features")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).alias("fold")
    return stored(made.join(labels, "doc_id", "left").select("doc_id", "features", "label", fold), "features")


#: Folds of the cross-validation.
FOLDS = 5


def out_of_fold(rows: DataFrame) -> DataFrame:
    """Labelled rows with the prediction of a logistic regression that was learnt from the other folds."""
    labelled = rows.where("label IS NOT NULL")
    fits = (LogisticRegression(maxIter=20).fit(labelled.where(F.col("fold") != k)).transform(labelled.where(F.col("fold") == k)) for k in range(FOLDS))
    return reduce(DataFrame.unionByName, fits)


@register()
def quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Predicted quality of each document: of labelled ones by a model that did not see them, of the others by one of all labels."""
    rows = classifier_rows(spark, d)
    whole = LogisticRegression(maxIter=20).fit(rows.where("label IS NOT NULL"))
    made = out_of_fold(rows).unionByName(whole.transform(rows.where("label IS NULL")))
    return made.select("doc_id", F.col("prediction").cast("int").alias("quality"), vector_to_array("probability")[1].alias("score"))


@register()
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """fold, n, precision, recall, F1 and AUC of each fold's predictions. AUC is the rank sum of the positive ones."""
    made = out_of_fold(classifier_rows(spark, d)).select("fold", "label", "prediction", vector_to_array("probability")[1].alias("score"))
    made = stored(made, "predictions")
    hit = F.count_if((F.col("label") == 1) & (F.col("prediction") == 1))
    counts = made.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("prediction") == 1).alias("found"), hit.alias("hits"))
    scores = made.groupBy("fold", "score").agg(F.count("*").alias("c"), F.count_if(F.col("label") == 1).alias("p"))
    upto = F.sum("c").over(Window.partitionBy("fold").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranks = scores.withColumn("rank", upto - (F.col("c") - 1) / 2).groupBy("fold").agg(F.sum(F.col("p") * F.col("rank")).alias("r"))
    c = F.col
    auc = F.when((c("positive") > 0) & (c("positive") < c("n")), (c("r") - c("positive") * (c("positive") + 1) / 2) / (c("positive") * (c("n") - c("positive"))))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = share(2 * c("hits"), c("positive") + c("found"))
    return counts.join(ranks, "fold").select("fold", "n", share(c("hits"), c("found")).alias("precision"), share(c("hits"), c("positive")).alias("recall"), f1.alias("f1"), auc.alias("auc"))


@register("SELECT source, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS removed_share, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def removed_share(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    return both.groupBy("source").agg(F.round(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)), 6).alias("removed_share"), F.count("*").alias("n"))


@register("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE length(text) >= 50) WHERE rn = 1")
def study_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a study keeps: long enough, and the first of their copies."""
    long_ = read(spark, d, "documents").where(F.length("text") >= 50).select("doc_id", "n_chars", F.sha2("text", 256).alias("key"))
    return dedup.keep_first(long_, [F.col("key")], [F.col("doc_id")]).drop("key")
