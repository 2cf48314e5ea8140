"""Reading archives: JSON lines with places, ZIP containers, index tables, checkpoints, captured listings."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("forums", "threads", "posts", "links", "resources", "pages")
#: Entries that an archive must and may have.
REQUIRED = ("README.txt", "metadata/crawl.json", "metadata/schema.json", *(f"data/{k}.jsonl" for k in KINDS[:5]), *(f"index/{k}.csv" for k in ("forums", "threads", "posts", "links")))
OPTIONAL = ("data/all.ndjson", "data/pages.jsonl", "index/post_features.csv", "index/resources.csv", "metadata/requests.jsonl", "analysis/profile.json")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and raw of each non-blank line; a path that is not there has none. Lines are numbered by file; a file is one split, so numbers are those of the file."""
    try:
        read = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, line_no long, raw string")
    text = read.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw"))
    return text.select("file", (F.col("line_no") + 1).cast("long").alias("line_no"), "raw").where(F.trim("raw") != "")


def parsed(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records with file and line_no, and the quarantine (file, line_no, raw) of lines that are no JSON objects."""
    whole = raw.withColumn("r", F.from_json("raw", f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}))
    broken = F.col("r").isNull() | F.col("r.__broken").isNotNull()
    return whole.where(~broken).select("file", "line_no", "r.*").drop("__broken"), whole.where(broken).select("file", "line_no", "raw")


def containers(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sound(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> bool:
    """Whether an entry can be read and has the checksum that it says."""
    try:
        with archive.open(entry) as f:
            while f.read(1 << 20):
                pass
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
        return False
    return True


def zip_entries(files: DataFrame) -> DataFrame:
    """archive, entry, bytes and crc_ok of each entry of each ZIP file (path, content). An archive is read by one task; a file that is no archive has one row with a null entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(name, x.filename, x.file_size, sound(z, x)) for x in z.infolist()]
                except zipfile.BadZipFile:
                    rows.append((name, None, None, False))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["archive", "entry", "bytes", "crc_ok"])

    return files.select("path", "content").mapInArrow(run, "archive string, entry string, bytes long, crc_ok boolean")


def zip_lines(files: DataFrame, entry: str) -> DataFrame:
    """file (the archive), line_no and raw of an entry's non-blank lines; archives without the entry have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if entry not in z.namelist():
                        continue
                    with z.open(entry) as f:
                        held: list[tuple[int, str]] = []
                        for i, line in enumerate(io.TextIOWrapper(f, "utf-8"), 1):
                            if line.strip():
                                held.append((i, line.rstrip("\r\n")))
                            if len(held) >= 4096:
                                yield out(name, held)
                                held = []
                        yield out(name, held)

    def out(name: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
        columns = [pa.array([name] * len(held), pa.string()), pa.array([i for i, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "line_no", "raw"])

    return files.select("path", "content").mapInArrow(run, "file string, line_no long, raw string")


def missing_entries(entries: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """archive and entry of what each archive lacks."""
    wanted = entries.select("archive").distinct().select("archive", F.explode(F.array(*map(F.lit, required))).alias("entry"))
    return wanted.join(entries.select("archive", "entry"), ["archive", "entry"], "left_anti")


def optional_entries(entries: DataFrame, optional: tuple[str, ...] = OPTIONAL) -> DataFrame:
    return entries.where(F.col("entry").isin(*optional)).select("archive", "entry").orderBy("archive", "entry")


def index_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV index with a header, all columns as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def index_warnings(table: DataFrame, name: str) -> DataFrame:
    """A row of severity and message where an index has no rows, else none."""
    return table.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("warning").alias("severity"), F.lit(f"{name} has no rows").alias("message"))


def metadata(spark: SparkSession, path: str) -> dict:
    """A small JSON file as a dict; an empty one where there is no file."""
    try:
        whole = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return json.loads(whole[0]) if whole and whole[0].strip() else {}


def settings(given: dict, defaults: dict) -> dict:
    """Settings over their defaults, one level deep: a given section replaces the default one."""
    return defaults | {k: v for k, v in given.items() if v is not None}


def checkpoints(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The records of a kind in all checkpoint folders `cp-N`, with checkpoint and line_no."""
    raw = lines(spark, f"{path}/cp-*/data/{kind}.jsonl").withColumn("checkpoint", F.regexp_extract("file", r"/(cp-[^/]+)/", 1))
    return raw.withColumn("r", F.from_json("raw", schema)).select("checkpoint", "line_no", "r.*")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """A dataset that was split into `.part-NNN` files, in the order of parts and lines."""
    return lines(spark, path).withColumn("part", F.regexp_extract("file", r"\.part-([0-9]+)", 1)).orderBy("part", "line_no")


def typed_records(raw: DataFrame) -> DataFrame:
    """Lines of a mixed file with their `type`; 'unknown' where there is none."""
    kind = F.coalesce(F.nullif(F.get_json_object("raw", "$.type"), F.lit("")), F.lit("unknown"))
    return raw.withColumn("type", kind)


def type_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count("*").alias("n"))


#: Sorts of a listing, and the spans of time that only `top` has (fixed values).
SORTS = ("hot", "new", "top", "rising")
SPANS = ("hour", "day", "week", "month", "year", "all")


def listing_request(sort: str = "hot", span: str | None = None, most: int = 100) -> dict:
    """The parameters of a listing's page; unknown sorts and spans raise ValueError, and a span counts for `top` alone."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    if span is not None and span not in SPANS:
        raise ValueError(f"span must be one of {', '.join(SPANS)}")
    return {"sort": sort, "limit": min(most, 100)} | ({"t": span} if sort == "top" and span else {})


def listing_posts(raw: DataFrame) -> DataFrame:
    """The posts (kind t3) of captured listings. Missing fields take their defaults; a field that is null stays null."""
    child = F.explode(F.from_json("raw", "data struct<children array<variant>>")["data"]["children"]).alias("c")
    rows = raw.select(child).where(F.try_variant_get("c", "$.kind", "string") == "t3")
    field = lambda name, kind: F.try_variant_get("c", f"$.data.{name}", kind)

    def filled(name: str, kind: str, default: object) -> Column:
        missing = F.try_variant_get("c", f"$.data.{name}", "variant").isNull()
        return F.when(missing, F.lit(default).cast(kind)).otherwise(field(name, kind)).alias(name)

    defaults = {"id": "", "title": "", "selftext": "", "author": "[deleted]", "score": 0, "num_comments": 0, "upvote_ratio": 0.0, "permalink": "", "created_utc": 0.0}
    kinds = {"score": "bigint", "num_comments": "bigint", "upvote_ratio": "double", "created_utc": "double"}
    return rows.select(*(filled(k, kinds.get(k, "string"), v) for k, v in defaults.items()), field("subreddit", "string").alias("subreddit"), field("url", "string").alias("url"))


def comment_tree(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """post, path, depth, id, parent_id, author, score and body of captured comment pages (post, raw: the second listing), depth first by path.

    A recursive query goes down one level at a time, to 200 at most (more is an error); replies that are no object end a branch.
    """
    view = f"comment_pages_{uuid.uuid4().hex}"
    raw.select("post", F.try_parse_json("raw").alias("v")).createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH RECURSIVE tree (post, path, depth, v) MAX RECURSION LEVEL 200 AS (
          SELECT post, lpad(CAST(c.pos AS STRING), 6, '0'), 0, c.value
          FROM {view}, LATERAL variant_explode(variant_get(v, '$.data.children', 'variant')) c
          UNION ALL
          SELECT t.post, concat(t.path, '/', lpad(CAST(c.pos AS STRING), 6, '0')), t.depth + 1, c.value
          FROM tree t, LATERAL variant_explode(try_variant_get(t.v, '$.data.replies.data.children', 'variant')) c)
        SELECT post, path, depth, variant_get(v, '$.data.id', 'string') AS id, try_variant_get(v, '$.data.parent_id', 'string') AS parent_id,
          coalesce(try_variant_get(v, '$.data.author', 'string'), '[deleted]') AS author,
          coalesce(try_variant_get(v, '$.data.score', 'bigint'), 0) AS score, coalesce(try_variant_get(v, '$.data.body', 'string'), '') AS body
        FROM tree WHERE variant_get(v, '$.kind', 'string') = 't1'""")


def capped_comments(comments: DataFrame, most: int) -> DataFrame:
    """The first comments of each post in depth-first order."""
    return comments.withColumn("rn", F.row_number().over(Window.partitionBy("post").orderBy("path"))).where(F.col("rn") <= most).drop("rn")
