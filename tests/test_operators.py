import datetime
import itertools
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from threadloom.operators import aggregate, dedup, forum_html, frontier, network, ordered, quality, robots, stats
from threadloom.sources import archive, sinks
from threadloom.streaming import deltas


def test_keep_first_over_checkpoints(spark):
    rows = [("1", "new", "cp-0002", 1), ("1", "old", "cp-0001", 3), (None, "x", "cp-0001", 1), (None, "x", "cp-0002", 2), (None, "y", "cp-0002", 3)]
    df = spark.createDataFrame(rows, "id string, body string, checkpoint string, line_no int")
    kept = dedup.merge_snapshots(df, "posts", ["checkpoint", "line_no"])
    assert sorted((r["id"] or "", r["body"]) for r in kept.collect()) == [("", "x"), ("", "y"), ("1", "old")]


def test_duplicate_measures(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "id string")
    assert dedup.duplicate_ids(df, "id").first()[0] == 1
    assert dedup.duplicate_risk(df, F.col("id")).first()[0] == 3


def test_frontier_order(spark):
    q = spark.createDataFrame([("forum", 1), ("thread", 2), ("index", 3), ("thread", 1), ("other", 0)], "kind string, seq int")
    assert [tuple(r) for r in dedup.priority(q).collect()] == [("index", 3), ("thread", 1), ("thread", 2), ("forum", 1), ("other", 0)]


def test_gates(spark):
    bad = quality.gates(quality.measures_of(spark, integrity_ok=True, posts=0, stopped=True, queue_remaining=38))
    assert quality.overall(bad).first()[0] == "BLOCK"
    good = quality.gates(quality.measures_of(spark, integrity_ok=True, posts=5, error_rate=0.01))
    assert quality.overall(good).first()[0] == "REVIEW"
    assert {r["gate"] for r in quality.next_actions(good).collect()} == {"privacy_and_quote_risk", "construct_validity"}
    assert quality.markdown(good).first()[0].count("\n") == 8


def test_rules(spark):
    df = spark.createDataFrame([(None, "https://x/", "", "2024-01-01"), ("t", "https://y/", "1", "nonsense")], "scraped_at string, source_url string, thread_id string, posted_at_iso string")
    found = {r["rule"]: (r["severity"], r["n"]) for r in quality.issues(df, "posts", quality.record_rules("posts", df.columns, "https://x/")).collect()}
    assert found == {"scraped_at_missing": ("error", 1), "foreign_source_url": ("warning", 1), "thread_id_missing": ("error", 1), "posted_at_invalid": ("error", 1)}
    entities = spark.createDataFrame([("", 0)], "name string, count int")
    assert quality.issues(entities, "entity", quality.model_rules()["entity"]).count() == 2


def test_robots(spark):
    body = "Allow: /early\nuser-agent: crawler9\ndisallow: /shop\nUser-Agent: *\nDISALLOW: /mill/ # dust\nDisallow:\nallow: /mill/wheel\ndisallow: /*?print\nCrawl-Delay: 7\nsitemap: https://m.example/a.xml\nSitemap: https://m.example/b.xml\nContent-signal: AI-Train=No , search = yes"
    files = spark.createDataFrame([("mill", body), ("told", "User-agent: *\n# see Directive (EU) 2019/790"), ("plain", "User-agent: *\nDisallow: /x"), ("none", None), ("odd", "?: y\nDisallow /z")], "site string, body string")
    rows = {r["site"]: r for r in robots.summary(files).collect()}
    mill = rows["mill"]
    assert (mill["disallow"], mill["allow"], mill["crawl_delay"]) == (["/mill/", "/*?print"], ["/mill/wheel"], 7.0)
    assert mill["sitemaps"] == ["https://m.example/a.xml", "https://m.example/b.xml"] and mill["signals"] == {"ai-train": "no", "search": "yes"}
    assert {s: r["restricts_ai_tdm"] for s, r in rows.items()} == {"mill": True, "told": True, "plain": False, "none": False, "odd": False}
    rules = [("mill", "disallow", "/mill/"), ("mill", "allow", "/mill/wheel"), ("mill", "disallow", "/*.zip"), ("mill", "allow", "/same"), ("mill", "disallow", "/same"), ("mill", "disallow", "/a b"), ("other", "disallow", "/")]
    expected = {("mill", "/mill/x"): False, ("mill", "/mill/wheel/3"): True, ("mill", "/q.zip"): False, ("mill", "/same/1"): True, ("mill", "/a%20b"): False, ("mill", "/a+b%"): True, ("other", "/mill/wheel"): False, ("third", "/mill/x"): True}
    made = robots.allowed(spark.createDataFrame(list(expected), "site string, path string"), spark.createDataFrame(rules, "site string, kind string, pattern string"))
    assert {(r["site"], r["path"]): r["allowed"] for r in made.collect()} == expected


THREAD = """<html><h1 class="p-title-value">T</h1><nav class="pageNav"><ul><li class="pageNav-page"><a href="/threads/a.42/">1</a></li><li class="pageNav-page pageNav-page--current"><a href="/threads/a.42/page-2">2</a></li></ul></nav>
<article class="message message--post" data-author="Ann" data-content="post-100"><time datetime="2024-01-01T00:00:00Z" data-time="1704067200">Jan</time><div class="bbWrapper">Hello<blockquote class="bbCodeBlock--quote" data-quote="Bob" data-source="post: 99"><div class="bbCodeBlock-content">old</div></blockquote><script>x()</script><div class="message-signature">sig</div></div>
<div class="message-attachments"><a href="/attachments/a.pdf">a.pdf</a></div><a class="reactionsBar-link">A and 3 others</a><div class="message-lastEdit">edited</div></article>
<article class="message message--post message--deleted" data-content="post-101"><div class="bbWrapper">Bye</div></article></html>"""


def test_thread_page(spark):
    pages = spark.createDataFrame([("https://b.example/threads/a.42/page-2", THREAD), ("https://b.example/", None)], "url string, html string")
    parsed = forum_html.parsed(pages)
    posts = sorted(forum_html.posts(parsed).collect(), key=lambda r: r["id"])
    a, b = posts
    assert "Hello" in a["body_text"] and "sig" not in a["body_text"] and "x()" not in a["body_text"]
    assert (a["id"], a["author"], a["quotes"][0]["source_post"], a["quotes"][0]["author"], a["attachments"][0]["url"], a["reactions_count"], a["edited"]) == ("100", "Ann", "99", "Bob", "https://b.example/attachments/a.pdf", 3, True)
    assert b["deleted"] and not a["deleted"]
    nav = parsed.where("navigation.current > 1").first()["navigation"]
    assert (nav["current"], nav["last"]) == (2, 2)


def test_forum_page_and_walls():
    page = forum_html.page('<div class="structItem" data-author="x"><i class="structItem-status--sticky"></i><i class="structItem-status--locked"></i><a href="/threads/t.11/">T</a><dl><dt>Replies</dt><dd>1.2K</dd></dl><dl><dt>Views</dt><dd>3M</dd></dl></div><div class="structItem structItem--redirect"><a href="/threads/u.12/">U</a></div><a href="mailto:x">m</a>', "https://b.example/forums/x.9/")
    a, b = page["threads"]
    assert (a["id"], a["reply_count"], a["view_count"], a["sticky"], a["locked"], a["redirect"], b["redirect"]) == ("11", 1200, 3000000, True, True, False, True)
    assert [x["url"] for x in page["links"]] == ["https://b.example/threads/t.11/", "https://b.example/threads/u.12/"]
    wall = lambda html: forum_html.page(html, "")["login_wall"]
    assert wall("<p>You must be <b>logged in</b></p>") and wall("Registered to view all posts") and wall("you do not have permission to view this page") and not wall("please log in")
    assert not wall('You must be logged in<div class="message-body">x</div>') and wall('You must be logged in<div class="bbWrapper">x</div>')
    state = lambda html: forum_html.page(html, "")["logged_in"]
    assert state('<a href="/x/logout/?t=1">out</a><a href="/login/">in</a>') and state('<html class="a is-logged-in">') and not state('<html class="is-logged-in"><i class="p-navgroup--guest"></i>') and not state("")


def test_times_and_links():
    time = lambda html: forum_html.time_of(forum_html.tree(html).one(lambda n: n.tag == "time"))
    assert time('<time datetime="2024-03-01T12:00:00+02:00" title="x">y</time>') == {"iso": "2024-03-01T12:00:00+02:00", "epoch": 1709287200, "text": "x"}
    assert time('<time datetime="1970-01-01T00:00:00Z">y</time>')["epoch"] is None and time('<time data-time="5" datetime="bad">y</time>')["epoch"] == 5 and time("<time>y</time>")["epoch"] is None
    links = forum_html.page('<a href="/a/Guide.epub">g</a><a href="https://o.example/x" download="f">get the PDF</a><area href="//b.example/n"><a href="TEL:1">t</a>', "https://b.example/")["links"]
    assert [(x["url"], x["external"], x["resource_type"]) for x in links] == [("https://b.example/a/Guide.epub", False, "ebook"), ("https://o.example/x", True, "pdf"), ("https://b.example/n", False, None)]


def test_zip_archives(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("README.txt", "x")
        z.writestr("data/posts.jsonl", '{"id":"1"}\n\n{"id":"2"}\n')
    (tmp_path / "b.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for name in ("one", "two", "three"):
            z.writestr(name, name * 9)
    broken = bytearray((tmp_path / "c.zip").read_bytes())
    for name in (b"oneone", b"threethree"):
        broken[broken.index(name)] ^= 1
    (tmp_path / "c.zip").write_bytes(broken)
    of = lambda name: archive.zip_entries(archive.containers(spark, str(tmp_path / name)))
    assert {r["entry"]: r["crc_ok"] for r in of("c.zip").collect()} == {"one": False, "two": True, "three": False}
    entries = of("[ab].zip")
    assert entries.where("crc_ok").count() == 2 and entries.where("entry IS NULL").count() == 1
    lines = archive.zip_lines(archive.containers(spark, str(path)), "data/posts.jsonl")
    assert [(r["line_no"], json.loads(r["raw"])["id"]) for r in lines.collect()] == [(1, "1"), (3, "2")]
    assert archive.zip_lines(archive.containers(spark, str(path)), "data/none.jsonl").count() == 0
    assert "data/links.jsonl" in {r["entry"] for r in archive.missing_entries(entries.where("entry IS NOT NULL")).collect()}


def test_lines_and_quarantine(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"1","forum":{"title":"a"}}\n\n{broken\n{"id":"2","forum":"b"}\n')
    good, bad = archive.parsed(archive.lines(spark, str(tmp_path / "x.jsonl")), "id string, forum string")
    assert [(r["line_no"], r["id"], r["forum"]) for r in good.orderBy("line_no").collect()] == [(1, "1", '{"title":"a"}'), (4, "2", "b")]
    assert [r["line_no"] for r in bad.collect()] == [3]
    assert {r["type"]: r["n"] for r in archive.type_counts(archive.typed_records(archive.lines(spark, str(tmp_path / "x.jsonl")))).collect()} == {"unknown": 3}


def test_checkpoint_folders(spark, tmp_path):
    for cp, text in (("cp-0001", '{"id":"1","body":"old"}'), ("cp-0002", '{"id":"1","body":"new"}\n{"id":"2","body":"x"}')):
        (tmp_path / cp / "data").mkdir(parents=True)
        (tmp_path / cp / "data" / "posts.jsonl").write_text(text)
    df = archive.checkpoints(spark, str(tmp_path), "posts", "id string, body string")
    kept = dedup.merge_snapshots(df, "posts", ["checkpoint", "line_no"])
    assert sorted(tuple(r) for r in kept.select("id", "body").collect()) == [("1", "old"), ("2", "x")]
    deltas.merge_deltas(spark, f"{tmp_path}/cp-*/data", "id string, body string", "id", f"{tmp_path}/merged")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/merged").select("id", "body").collect()) == [("1", "old"), ("2", "x")]


def test_captured_listings(spark):
    page = json.dumps({"data": {"children": [{"kind": "t3", "data": {"id": "a", "title": "T"}}, {"kind": "more", "data": {"id": "m"}}]}})
    posts = archive.listing_posts(spark.createDataFrame([(page,)], "raw string")).collect()
    assert [(r["id"], r["author"], r["score"]) for r in posts] == [("a", "[deleted]", 0)]
    leaf = lambda i, replies="": {"kind": "t1", "data": {"id": i, "body": i, "replies": replies}}
    level = lambda *xs: {"data": {"children": list(xs)}}
    tree = level(leaf("1", level(leaf("2", level(leaf("3"))), leaf("4"))), leaf("5"))
    found = archive.comment_tree(spark, spark.createDataFrame([("p", json.dumps(tree))], "post string, raw string"))
    assert [r["id"] for r in found.orderBy("path").collect()] == ["1", "2", "3", "4", "5"]
    assert [r["id"] for r in archive.capped_comments(found, 2).orderBy("path").collect()] == ["1", "2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"', None, ("x",)), ("2", "", 3, ("y",))], "id string, body string, n int, forum struct<title:string>")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    back = archive.index_table(spark, str(tmp_path / "c")).orderBy("id").collect()
    assert back[0]["body"] == 'a "q"' and json.loads(back[0]["forum"]) == {"title": "x"}
    assert sinks.index_rows(df, "posts").columns == sinks.INDEX["posts"]


def test_parts(spark):
    sizes = [50, 50, 3000, 7900, 10, 4000, 4100, 10] * 40
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "id long, text string")
    made = sinks.split_parts(df, ["id"], 8000)
    parts = made.groupBy("part").agg(F.sum(sinks.line_bytes(df)).alias("b"), F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).orderBy("part").collect()
    assert max(r["b"] for r in parts) <= 8000 and all(x["z"] + 1 == y["a"] for x, y in zip(parts, parts[1:], strict=False)) and sum(r["n"] for r in parts) == len(sizes)
    again = sinks.split_parts(df.repartition(7), ["id"], 8000)
    assert made.exceptAll(again).count() == 0
    with pytest.raises(PySparkException):
        sinks.split_parts(df, ["id"], 7900).collect()
    manifest = sinks.part_manifest(made, sinks.line_bytes(df)).collect()
    assert sum(r["entry_count"] for r in manifest) == len(sizes) == manifest[0]["logical_entry_count"]
    entries = spark.createDataFrame([("a", i, f"e{i}", n) for i, n in enumerate((400, 400, 400, 100))], "archive string, seq int, name string, bytes long")
    assert [r["bin"] for r in sinks.packed(entries, 1100).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_networks(spark):
    turns = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "c"), (2, 2, None)], "t int, n int, who string")
    assert {(r["source"], r["target"]): r["weight"] for r in network.reply_edges(turns.where("who IS NOT NULL"), "t", "n", "who").collect()} == {("b", "a"): 1, ("a", "b"): 1}
    assert [tuple(r) for r in network.participation_edges(turns, "t", "who").collect()] == [("a", "b", 1)]
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 1)], "source string, target string, weight long")
    ranks = {r["node"]: r["rank"] for r in network.pagerank(edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["a"] > ranks["d"]
    assert network.pagerank(edges.limit(0)).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "v int, g string")
    assert stats.mann_whitney(df, "v", "g", "a", "b").first()["u"] == 0.5
    codes = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y"), (None, "y")], "a string, b string")
    assert round(stats.kappa(codes, "a", "b").first()["kappa"], 6) == 0.5
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    assert [round(r["q"], 4) for r in stats.benjamini_hochberg(tests).orderBy("p").collect()] == [0.04, 0.0533, 0.0533, 0.5]
    counts = spark.createDataFrame([("x", "a", 1), ("x", "b", 1)], "term string, g string, n long")
    assert stats.js_divergence(stats.side_by_side(counts, "term", "g", "n", "a", "b")).first()[0] == 0.0


def test_histograms_and_rates(spark):
    log = spark.createDataFrame([("200", True), (None, False), ("current-document", None)], "status string, ok boolean")
    assert {r["status"]: r["n"] for r in aggregate.status_histogram(log).collect()} == {"200": 1, "network_error": 1, "current-document": 1}
    assert aggregate.rates(log, error=~F.col("ok")).first()[0] == pytest.approx(1 / 3)
    assert aggregate.rates(log.limit(0), error=~F.col("ok")).first()[0] == 0.0


def test_running_sums(spark):
    rows = [(i, i % 7) for i in range(500)]
    made = ordered.running(spark.createDataFrame(rows, "k int, v int").repartition(9), ["k"], F.col("v")).orderBy("k").collect()
    assert [r["upto"] for r in made] == list(itertools.accumulate(v for _, v in rows))
    assert ordered.running(spark.createDataFrame([], "k int, v int"), ["k"], F.col("v")).count() == 0


def test_pairs_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK", 4)
    rows = [("a", i) for i in range(23)] + [("b", 1), ("c", 5), ("c", 9)]
    made = network.pairs_within(spark.createDataFrame(rows, "k string, v int"), "k", "v").collect()
    assert sorted(tuple(r) for r in made) == sorted([("a", i, j) for i in range(23) for j in range(i + 1, 23)] + [("c", 5, 9)])


def test_components_of_words(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "source string, target string")
    assert sorted(tuple(r) for r in network.components(edges).collect()) == [("a", 3, 2), ("x", 2, 1)]


def test_components_of_structs(spark):
    rows = [((1, "b"), (1, "a")), ((1, "c"), (1, "b")), ((2, "b"), (2, "c")), ((2, None), (2, "c")), ((2, "a"), (3, "a")), ((4, "z"), (4, "z"))]
    edges = spark.createDataFrame(rows, "source struct<k: int, v: string>, target struct<k: int, v: string>")
    expected = {((1, "a"), 3, 2), ((2, None), 3, 2), ((2, "a"), 2, 1)}
    for parts in (1, 3):
        assert {(tuple(r["component"]), r["nodes"], r["edges"]) for r in network.components(edges.repartition(parts)).collect()} == expected


def test_frontier(spark):
    rows = [(1, "https://s.example/a#x", "thread"), (2, "https://s.example/a/", "thread"), (3, "https://o.example/", "thread"), (4, "x", "thread"), (5, "https://s.example/forums/hello.5/", "forum"), (6, "https://s.example/old", "thread"), (7, "https://s.example/no", "thread")]
    found = spark.createDataFrame(rows, "seq int, url string, kind string")
    visited = spark.createDataFrame([("https://s.example/old/",), ("https://s.example/old/",)], "url string")
    made = frontier.decided(found, visited, "https://s.example", ["5"], ~F.col("url").endswith("/no"))
    assert [r["decision"] for r in made.orderBy("seq").collect()] == ["queued", "queued_before", "other_origin", "no_url", "excluded_forum", "visited", "robots"]
    status = spark.createDataFrame([(s,) for s in (200, 403, 404, 408, 425, 429, 499, 500, None)], "s int")
    assert [r[0] for r in status.select(frontier.retryable(F.col("s"))).collect()] == [False, True, False, True, True, True, False, True, False]
    assert archive.listing_request("top", "week") == {"sort": "top", "limit": 100, "t": "week"} and "t" not in archive.listing_request("new", "week", 5)
    for bad in (("best", None), ("top", "decade")):
        with pytest.raises(ValueError):
            archive.listing_request(*bad)


def test_listing_defaults_and_nulls(spark):
    raw = '{"data":{"children":[{"kind":"t3","data":{"id":"q","author":null,"title":null}},{"kind":"t1","data":{"id":"c"}}]}}'
    assert [(r["id"], r["author"], r["title"], r["score"]) for r in archive.listing_posts(spark.createDataFrame([(raw,), (None,)], "raw string")).collect()] == [("q", None, None, 0)]


def test_missing_files(spark, tmp_path):
    assert archive.lines(spark, str(tmp_path / "no.jsonl")).count() == 0 and archive.metadata(spark, str(tmp_path / "no.json")) == {}
    (tmp_path / "m.json").write_text('{"a": [1]}')
    assert archive.metadata(spark, str(tmp_path / "m.json")) == {"a": [1]}
    assert archive.settings({"x": {"b": 2}, "y": None}, {"x": {"a": 1}, "y": 3}) == {"x": {"b": 2}, "y": 3}
    empty = spark.createDataFrame([], "id string")
    assert archive.index_warnings(empty, "posts").count() == 1 and archive.index_warnings(spark.createDataFrame([("1",)], "id string"), "posts").count() == 0


def test_smoke_of_an_archive(spark):
    kinds = "kind string, rule string, severity string, n long"
    counts = spark.createDataFrame([("posts", 0), ("threads", 2)], "kind string, n long")
    bad = quality.smoke(spark.createDataFrame([("links", "r", "error", 3), ("posts", "w", "warning", 1)], kinds), counts).first()
    assert (bad["pass"], bad["errors"], bad["warnings"]) == (False, ["links r 3"], ["posts none 0", "posts w 1"])
    good = quality.smoke(spark.createDataFrame([], kinds), counts.where("n > 0").unionAll(spark.createDataFrame([("posts", 5)], "kind string, n long"))).first()
    assert (good["pass"], good["errors"], good["warnings"]) == (True, [], [])


def test_late_events(spark, tmp_path):
    """A repeat within the watermark goes, and an hour behind it is closed: what comes for it later does not count. A batch passes until a watermark holds for late rows."""
    kind = "event_id long, ts timestamp, event_type string, user_id long"
    when = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    for i, rows in enumerate([[(1, when(0), "x", 1), (1, when(0, 5), "x", 1)], [(2, when(9), "error", 2)], [(4, when(9, 5), "x", 2)], [(1, when(0, 10), "x", 1), (3, when(9, 30), "x", 2)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e*")
    hours = deltas.drained(deltas.dashboard(stream), mode="append").collect()
    assert [(r["hour"].hour, r["events"]) for r in hours] == [(0, 2)]
    kept = deltas.drained(deltas.without_repeats(spark.readStream.schema(kind).parquet(f"{tmp_path}/e[01]"), "event_id", late="1 hour"))
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2]
