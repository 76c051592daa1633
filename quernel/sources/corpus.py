"""Views of the tables as the engine's files, lines, symbols, calls, events and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import hits_of as _hits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path = source/lang/doc_id.txt, language, size in bytes, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path = host and path of the URL with the page's id, content = html."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.regexp_replace("url", r"^[a-z]+://|[?#].*$|/$", ""), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("language"), F.octet_length("html").cast("long").alias("size"), F.col("html").alias("content"), "page_id")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.format_string("conv/%d", "conv_id").alias("path"), F.col("turn").alias("line"), "role", F.col("text").alias("content"))


#: Event types as changes of files; a third of the purchases are whole renames, the others the first half of one.
CHANGE = {"signup": "create", "view": "modify", "click": "touch", "error": "remove"}


def change_events(events: DataFrame) -> DataFrame:
    """seq, ts, path, kind, previous_path from the events table, batch or stream."""
    kind = F.create_map(*(F.lit(x) for kv in CHANGE.items() for x in kv))
    path = F.format_string("u/%d", "user_id")
    moved = F.col("event_type") == "purchase"
    kind = F.when(moved, F.when(F.col("event_id") % 3 == 0, "rename").otherwise("rename_from")).otherwise(F.try_element_at(kind, F.col("event_type")))
    return events.select(F.col("event_id").alias("seq"), "ts", path.alias("path"), kind.alias("kind"), F.when(kind == "rename", F.concat(path, F.lit(".old"))).alias("previous_path"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus (path, size, mtime, hash): b lacks every seventh document, alters every fifth, and has a new one for every eleventh."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    row = lambda text: (F.octet_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.sha2(text, 256).alias("hash"))
    a = d.select("path", *row(F.col("text")))
    new = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    b = d.where("doc_id % 7 <> 0").select("path", *row(new)).unionByName(d.where("doc_id % 11 = 0").select(F.concat("path", F.lit(".new")).alias("path"), *row(F.col("text"))))
    return a, b


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at scale: a supplier calls a part at the site (order, line)."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.format_string("supplier#%d", "l_suppkey").alias("caller"), F.format_string("part#%d", "l_partkey").alias("callee"), F.format_string("o/%d", "l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("line"), F.lit(1).cast("long").alias("column"), F.when(F.col("l_returnflag") == "N", "precise").otherwise("parser").alias("source"))


def page_headings(pages: DataFrame) -> DataFrame:
    """Definitions in pages: headings with the code point offsets of their start and of the page's end as their body's."""
    return _tags(pages, r"<h[1-6][^>]*>([^<]*)</h[1-6]>", "name")


def page_links(pages: DataFrame) -> DataFrame:
    return _tags(pages, r"<a [^>]*href=\"([^\"]*)\"", "target")


def _tags(pages: DataFrame, regex: str, name: str) -> DataFrame:
    each = pages.select("page_id", F.posexplode(_hits(F.col("html"), regex)).alias("ordinal", "hit"))
    return each.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), F.regexp_extract("hit.hit", regex, 1).alias(name), F.col("hit.at").cast("long").alias("pos"), F.length("hit.hit").cast("long").alias("width"))
