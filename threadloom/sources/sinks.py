"""Writing archives: JSON lines, CSV, index columns, parts of bounded size, manifests."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import post_features
from ..operators.ordered import running
from ..operators.reports import every_kind

#: The columns of the indexes.
INDEX = {
    "forums": "id slug url title description threads_count messages_count sub_forums source_url scraped_at".split(),
    "threads": "id url title slug prefix author author_id author_url forum created reply_count view_count last_post sticky locked redirect source_url scraped_at".split(),
    "posts": "id thread_id thread_title forum author author_id post_number posted_at body_text_length body_html_length quote_count attachment_count reactions_count has_reactions edited deleted ignored source_url scraped_at".split(),
    "post_features": (
        "post_id thread_id thread_title forum_id author posted_at body_text_length body_html_length word_count unique_word_count sentence_count question_count exclamation_count url_count "
        "quote_count attachment_count link_count reaction_count has_reactions empty_body edited deleted ignored source_url"
    ).split(),
    "links": "link_url link_text link_title rel download_name external resource_type thread_id post_id thread_title post_number page_kind source_url scraped_at".split(),
    "resources": "link_url link_text resource_type download_name external thread_id post_id thread_title post_number source_url scraped_at".split(),
}
PART_BYTES = 28_000_000


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts."""
    nested = {c for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))


def write_csv(df: DataFrame, path: str, quote_all: bool = True) -> None:
    """A header and a line per row; nested columns are JSON, and texts keep their blanks. With quote_all, null is an empty quoted text."""
    options = {"header": True, "quoteAll": quote_all, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat(df).write.mode("overwrite").options(**options, emptyValue='""' if quote_all else "").csv(path)


def index_rows(df: DataFrame, kind: str) -> DataFrame:
    """The index columns of a kind; missing ones are null."""
    have = set(df.columns)
    return df.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in INDEX[kind]))


def line_bytes(df: DataFrame) -> Column:
    """A row's size as a line of JSON."""
    return (F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})) + 1).cast("long")


def split_parts(df: DataFrame, order: list[str], most: int = PART_BYTES) -> DataFrame:
    """df with part: rows in order, filled into parts of at most `most` bytes of JSON lines; a larger row is an error.

    The running size is cut into slices of half a part, and a row belongs to the slice in which it begins. Rows of up to
    half a part that begin in one slice fit a part; a larger one is the last of its slice and has a part to itself. So parts
    follow from the data alone, keep their order, and take no pass over all rows in one task. Numbers may have gaps.
    """
    size, half = line_bytes(df), most // 2
    checked = F.when(size > most, F.raise_error(F.lit("a record is larger than a part"))).otherwise(size)
    summed = running(df.withColumn("__bytes", checked), list(order), F.col("__bytes"), "__upto")
    slice_ = F.floor((F.col("__upto") - F.col("__bytes")) / half).cast("long")
    return summed.withColumn("part", 2 * slice_ + (F.col("__bytes") > half).cast("long")).drop("__bytes", "__upto")


def part_manifest(parts: DataFrame, size: Column) -> DataFrame:
    """part, name, entry_count and bytes of each part, and logical_entry_count, the records of all parts."""
    counted = parts.groupBy("part").agg(F.count("*").alias("entry_count"), F.sum(size).alias("bytes"))
    total = counted.agg(F.coalesce(F.sum("entry_count"), F.lit(0)).alias("logical_entry_count"))
    name = F.concat(F.lit(".part-"), F.lpad(F.col("part").cast("string"), 6, "0"))
    return counted.join(F.broadcast(total)).select("part", name.alias("name"), "entry_count", "bytes", "logical_entry_count")


def packed(manifest: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """archive, name, bytes and bin: entries of each archive filled into bins in order (seq), a new one when the next does not fit. An entry takes its bytes, its name's and 80 more; a bin 22. A manifest is small."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        used, bin_, out = 22, 0, []
        for r in rows:
            need = r["bytes"] + len(r["name"].encode()) + 80
            if need + 22 > most:
                raise ValueError(f"{r['name']} is larger than a part")
            if used + need > most:
                bin_, used = bin_ + 1, 22
            used += need
            out.append(r | {"bin": bin_})
        return pa.Table.from_pylist(out, pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("name", pa.string()), ("bytes", pa.int64()), ("bin", pa.int32())]))

    frame = manifest.select("archive", F.col("seq").cast("long").alias("seq"), "name", F.col("bytes").cast("long").alias("bytes"))
    return frame.groupBy("archive").applyInArrow(run, "archive string, seq long, name string, bytes long, bin int")


def manifest(files: DataFrame) -> DataFrame:
    """file, bytes, sha256: what a folder holds, from a binaryFile read."""
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def zipped(entries: DataFrame) -> DataFrame:
    """archive and content (a ZIP file) from rows of archive, entry and text. An archive is made by one task; parts bound its size."""

    def run(table: pa.Table) -> pa.Table:
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for row in sorted(table.to_pylist(), key=lambda r: r["entry"]):
                z.writestr(zipfile.ZipInfo(row["entry"]), row["text"] or "")
        return pa.table({"path": [table.column("archive")[0].as_py()], "content": pa.array([made.getvalue()], pa.binary())})

    return entries.select("archive", "entry", "text").groupBy("archive").applyInArrow(run, "path string, content binary")


#: The entries of an archive in their order.
SNAPSHOT = (
    "README.txt metadata/crawl.json metadata/robots.json metadata/requests.jsonl metadata/errors.json metadata/schema.json analysis/profile.json analysis/data_dictionary.json analysis/quality_gates.json "
    "metadata/checkpoints.json data/forums.jsonl data/threads.jsonl data/posts.jsonl data/links.jsonl data/resources.jsonl data/pages.jsonl data/all.ndjson "
    "index/forums.csv index/threads.csv index/posts.csv index/post_features.csv index/links.csv index/resources.csv"
).split()


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as a JSON file; nulls stay."""
    write_json_lines(report.coalesce(1), path)


def write_snapshot(to: str, records: dict[str, DataFrame], reports: dict[str, DataFrame], readme: str) -> None:
    """All entries of an archive under the folder `to`, each a folder of files. What exists is overwritten.

    records: forums, threads, posts, links, resources and pages (a kind that is not there is an empty file), and requests. reports: one-row
    tables by entry name; a report that is not there is an empty object.
    """
    spark = next(iter(records.values())).sparkSession
    none = spark.createDataFrame([], "id string")
    for entry in SNAPSHOT:
        place, name = entry.split("/") if "/" in entry else ("", entry)
        kind, ending = name.rsplit(".", 1)
        path = f"{to}/{entry}"
        if ending == "txt":
            spark.createDataFrame([(readme,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        elif ending == "json":
            write_report(reports[entry] if entry in reports else spark.range(1).select(F.lit("{}").alias("empty")), path)
        elif ending == "ndjson":
            write_json_lines(every_kind({k: v for k, v in records.items() if k != "requests"}), path)
        elif ending == "jsonl":
            write_json_lines(records.get(kind, none), path)
        else:
            rows = post_features(records["posts"]) if kind == "post_features" else records.get(kind, none)
            write_csv(index_rows(rows, kind), path)


def snapshot_entries(spark: SparkSession, to: str) -> DataFrame:
    """entry and records of a written archive: its lines, without the headers of CSV files."""
    lines = spark.read.text(f"{to}/*/*").select(F.col("_metadata.file_path").alias("file"))
    entry = F.regexp_extract("file", r"((?:metadata|analysis|data|index)/[^/]+|README\.txt)/[^/]+$", 1)
    counted = lines.groupBy(entry.alias("entry")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    every = spark.createDataFrame([(x,) for x in SNAPSHOT], "entry string")
    n = F.when(F.col("entry").endswith(".csv"), F.col("n") - F.col("files")).otherwise(F.col("n"))
    return every.join(counted, "entry", "left").select("entry", F.coalesce(n, F.lit(0)).alias("records"))
