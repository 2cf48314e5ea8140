"""Comparative statistics over counts: divergences, log odds, NPMI, kappa, rank tests, rank-frequency slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def side_by_side(counts: DataFrame, term: str, group: str, n: str, a: str, b: str) -> DataFrame:
    """term, x and y: the counts of two groups, 0 where one lacks the term; tx, ty and v: both totals and the number of terms."""
    both = counts.where(F.col(group).isin(a, b)).groupBy(term).agg(*(F.coalesce(F.sum(F.when(F.col(group) == g, F.col(n))), F.lit(0)).alias(c) for g, c in ((a, "x"), (b, "y"))))
    sums = both.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"), F.count("*").alias("v"))
    return both.join(F.broadcast(sums))


def kl_divergence(both: DataFrame, smooth: float = 1.0) -> DataFrame:
    """One row: sum p log2(p / q) of add-`smooth` frequencies."""
    p = (F.col("x") + smooth) / (F.col("tx") + smooth * F.col("v"))
    q = (F.col("y") + smooth) / (F.col("ty") + smooth * F.col("v"))
    return both.agg(F.sum(p * F.log2(p / q)).alias("kl_bits"))


def js_divergence(both: DataFrame) -> DataFrame:
    """One row: the Jensen-Shannon divergence in bits, of plain frequencies."""
    p, q = F.col("x") / F.col("tx"), F.col("y") / F.col("ty")
    part = lambda a: F.when(a > 0, a * F.log2(a * 2 / (p + q))).otherwise(0.0)
    return both.agg(F.sum((part(p) + part(q)) / 2).alias("js_bits"))


def log_odds(both: DataFrame, smooth: float = 1.0) -> DataFrame:
    """term columns and log_odds: the log of the odds ratio of add-`smooth` counts."""
    odds = lambda n, t: F.log((F.col(n) + smooth) / (F.col(t) + smooth * F.col("v") - F.col(n) - smooth))
    return both.withColumn("log_odds", odds("x", "tx") - odds("y", "ty")).drop("tx", "ty", "v")


def npmi(pairs: DataFrame, both: str, a: str, b: str, total: Column) -> Column:
    """Normalised pointwise mutual information from document counts."""
    pab = F.col(both) / total
    return F.when(pab < 1, F.log(pab / ((F.col(a) / total) * (F.col(b) / total))) / -F.log(pab)).otherwise(1.0)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed and expected agreement, and Cohen's kappa of two codings; rows with a null in either do not count."""
    table = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ends = table.select(F.inline(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))))
    chance = ends.groupBy("label").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    seen = table.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    n = F.col("n")
    return seen.join(F.broadcast(chance)).select("n", (F.col("same") / n).alias("observed"), (F.col("xy") / (n * n)).alias("expected")).withColumn("kappa", (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """One row: n_a, n_b and U of group a, with mean ranks for ties. Values are counted before they are ranked, by ranges."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == a).alias("x"), F.count_if(F.col(group) == b).alias("y"))
    ranked = running(counts, ["v"], F.col("x") + F.col("y")).withColumn("rank", F.col("upto") - (F.col("x") + F.col("y") - 1) / 2)
    sums = ranked.agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), F.sum(F.col("x") * F.col("rank")).alias("r"))
    return sums.select("n_a", "n_b", (F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2).alias("u"))


def zipf(counts: DataFrame, key: str, n: str, most: int = 1000) -> DataFrame:
    """One row: terms, and slope and fit of log count over log rank of the `most` commonest."""
    head = counts.orderBy(F.desc(n), key).limit(most)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(n), key)))
    return ranked.agg(F.count("*").alias("terms"), F.regr_slope(F.log(n), F.log("rank")).alias("slope"), F.regr_r2(F.log(n), F.log("rank")).alias("r2"))


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with q: p values adjusted for the false discovery rate. The tests of one study are a small table."""
    every = Window.partitionBy()
    ranked = tests.withColumn("__rank", F.rank().over(Window.orderBy(p))).withColumn("__n", F.count("*").over(every))
    ranked = ranked.withColumn("__rank", F.max("__rank").over(Window.partitionBy(p)) + F.count("*").over(Window.partitionBy(p)) - 1)
    raw = F.col(p) * F.col("__n") / F.col("__rank")
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(raw).over(Window.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)))).drop("__rank", "__n")


def burstiness(events: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """by, gaps, mean_gap and burstiness (s - m) / (s + m) of the seconds between a key's events."""
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(by).orderBy(ts, tie))) / 1e6
    stats = events.select(by, gap.alias("gap")).where("gap IS NOT NULL").groupBy(by).agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("s"))
    return stats.select(by, "gaps", "mean_gap", F.when(F.col("s") + F.col("mean_gap") > 0, (F.col("s") - F.col("mean_gap")) / (F.col("s") + F.col("mean_gap"))).alias("burstiness"))


def sessions(events: DataFrame, by: str, ts: str, tie: str, gap_s: int = 1800) -> DataFrame:
    """by, session (from 1), events, started and ended: runs of a key's events with no gap of more than gap_s seconds."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(seconds - F.lag(seconds).over(w) <= gap_s * 1_000_000, 0).otherwise(1)
    marked = events.select(by, ts, tie, new.alias("new")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "session").agg(F.count("*").alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the correlation of mean ranks. Values are counted before they are ranked."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("c"))
        return running(counts, [c], F.col("c")).select(c, (F.col("upto") - (F.col("c") - 1) / 2).alias(f"r{c}"))

    return rows.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def cohens_d(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """One row: both sizes and the difference of means in pooled standard deviations."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.agg(*(f(pick(g)).alias(f"{n}_{s}") for g, s in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return s.select("n_a", "n_b", F.when(pooled > 0, (F.col("m_a") - F.col("m_b")) / pooled).alias("d"))


def bursts(counts: DataFrame, by: str, order: str, n: str, least: float = 2.0) -> DataFrame:
    """counts with z, where a period's count stands `least` standard deviations or more above its key's mean."""
    w = Window.partitionBy(by)
    scored = counts.withColumn("z", (F.col(n) - F.avg(n).over(w)) / F.nullif(F.stddev_pop(n).over(w), F.lit(0.0)))
    return scored.where(F.col("z") >= least)


def before_events(daily: DataFrame, days: DataFrame, window: int = 7, rise: float = 0.3) -> DataFrame:
    """event, before, mean and spike: the mean daily count in the days before each event (day) against that of all days. Each event is spread over its days, so the join is on equality."""
    near = days.select(F.col("day").alias("event"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: F.date_sub("day", i))).alias("day"))
    overall = daily.agg(F.avg("n").alias("mean"))
    found = near.join(daily, "day", "left").groupBy("event").agg((F.coalesce(F.sum("n"), F.lit(0)) / window).alias("before"))
    return found.join(F.broadcast(overall)).withColumn("spike", F.col("before") >= (1 + rise) * F.col("mean"))


def matched(df: DataFrame, group: str, a: str, b: str, bucket: Column, order: Column) -> DataFrame:
    """Rows of two groups, as many of each in every bucket as the smaller has there, the first by `order`."""
    rows = df.where(F.col(group).isin(a, b)).withColumn("__bucket", bucket)
    least = rows.groupBy("__bucket").agg(F.least(F.count_if(F.col(group) == a), F.count_if(F.col(group) == b)).alias("__k"))
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__bucket", group).orderBy(order)))
    return ranked.join(least, "__bucket").where(F.col("__rn") <= F.col("__k")).drop("__bucket", "__k", "__rn")


def bonferroni(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with q: p values times their number, 1 at most."""
    return tests.join(F.broadcast(tests.agg(F.count(p).alias("__n")))).withColumn("q", F.least(F.lit(1.0), F.col(p) * F.col("__n"))).drop("__n")


def chi_square(both: DataFrame) -> DataFrame:
    """both (from side_by_side) with chi2 of each term's table: two groups by the term or another one."""
    x, y, tx, ty = (F.col(c).cast("double") for c in ("x", "y", "tx", "ty"))
    cross = x * (ty - y) - y * (tx - x)
    return both.withColumn("chi2", (tx + ty) * cross * cross / (tx * ty * (x + y) * (tx + ty - x - y)))


def vocabulary_jaccard(both: DataFrame) -> DataFrame:
    """One row: the share of terms that both groups have among those that either has."""
    return both.agg((F.count_if((F.col("x") > 0) & (F.col("y") > 0)) / F.count_if((F.col("x") > 0) | (F.col("y") > 0))).alias("jaccard"))


def changepoints(series: DataFrame, by: str, order: str, value: str, gain: float = 10.0) -> DataFrame:
    """by, change (where the second part begins) and delta_bic of each key whose series is explained better by two levels than by one.

    The cut leaves the least squared error; its gain is that of the Bayesian information criterion. Sums of a key's series give the
    error of every cut in one window over it.
    """
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    v = F.col(value).cast("double")
    rows = series.select(
        by,
        order,
        F.count("*").over(upto).cast("double").alias("k"),
        F.coalesce(F.sum(v).over(upto), F.lit(0.0)).alias("s"),
        F.count("*").over(whole).cast("double").alias("n"),
        F.sum(v).over(whole).alias("t"),
        F.sum(v * v).over(whole).alias("q"),
    )
    error = F.col("q") - F.col("s") * F.col("s") / F.col("k") - (F.col("t") - F.col("s")) * (F.col("t") - F.col("s")) / (F.col("n") - F.col("k"))
    cuts = rows.where("k > 0").select(by, order, "n", (F.col("q") - F.col("t") * F.col("t") / F.col("n")).alias("one"), F.round(error, 6).alias("two"))
    best = cuts.groupBy(by).agg(F.min(F.struct("two", order, "n", "one")).alias("b")).select(by, "b.*")
    scored = best.withColumn("delta_bic", F.col("n") * F.log(F.col("one") / F.col("two")) - 2 * F.log("n")).where("one > 0 AND two > 0")
    return scored.where(F.col("delta_bic") > gain).select(by, F.col(order).alias("change"), "delta_bic")


def permutation_test(df: DataFrame, id_col: str, value: str, group: str, a: str, b: str, rounds: int = 200, seed: str = "null") -> DataFrame:
    """One row: the difference of means of two groups, and p: how many random assignments to groups differ as much.

    In each round a row joins the first group with that group's share of rows, by the hash of seed, round and id, so reruns
    agree. Rows are multiplied by the rounds within a task, and summed there before the shuffle.
    """
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"), (F.col(group) == a).alias("first"))
    share = rows.agg(F.avg(F.col("first").cast("int")).alias("share"), (F.avg(F.when(F.col("first"), F.col("v"))) - F.avg(F.when(~F.col("first"), F.col("v")))).alias("difference"))
    tried = rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).join(F.broadcast(share))
    key = F.concat_ws(":", F.lit(seed), F.col("round").cast("string"), F.col("id").cast("string"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    null = tried.withColumn("in", u < F.col("share")).groupBy("round").agg((mean(F.col("in")) - mean(~F.col("in"))).alias("d"))
    both = null.join(F.broadcast(share))
    extreme = F.count_if(F.abs(F.round("d", 9)) >= F.abs(F.round("difference", 9)))
    return both.agg(F.first("difference").alias("difference"), F.count("*").alias("rounds"), ((extreme + 1) / (F.count("*") + 1)).alias("p"))
