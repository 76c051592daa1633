"""Catalog, proofs, index tables, freshness, overlays and diffs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BINARY_PREFIX, gram_part_col, is_binary, language_of, line_offsets, parent_dir, skipped_dir, trigrams


def scan(files: DataFrame, scope=None, no_ignore: bool = False, binary_prefix: int | None = BINARY_PREFIX) -> DataFrame:
    """Raw files (path, content binary or string, ...) with language, and skip_reason where one is left out: generated, ignored (by rules that were joined before), unreadable,
    binary (a zero byte among the first bytes, or anywhere for None) or scope."""
    body = F.col("content").cast("binary")
    ignored = F.col("ignored") if "ignored" in files.columns and not no_ignore else F.lit(False)
    reason = F.when(skipped_dir(F.col("path"), no_ignore), "generated").when(ignored, "ignored").when(body.isNull(), "unreadable").when(is_binary(body, binary_prefix), "binary")
    if scope is not None:
        reason = F.coalesce(reason, F.when(~scope.predicate(F.col("path"), language_of(F.col("path"))), "scope"))
    out = files if "language" in files.columns else files.withColumn("language", language_of(F.col("path")))
    return out.withColumn("skip_reason", reason)


def included(scanned: DataFrame) -> DataFrame:
    return scanned.where("skip_reason is null").drop("skip_reason").dropDuplicates(["path"])


def skipped_log(scanned: DataFrame) -> DataFrame:
    return scanned.where("skip_reason is not null").select("path", F.lit("scan").alias("stage"), F.col("skip_reason").alias("reason"))


def summary(scanned: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    r = F.col("skip_reason")
    return scanned.agg(F.count("*").alias("seen"), n(r.isNull(), "included"), n(r == "generated", "skipped_generated"), n(r == "binary", "skipped_binary"), n(r == "unreadable", "skipped_unreadable"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """A directory tree as files with paths relative to it; size, mtime in ms. Any store that Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.substring_index("path", top + "/", -1), "^/+", "")
    return raw.select(rel.alias("path"), F.col("length").cast("long").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")


def proofs(files: DataFrame) -> DataFrame:
    """path, hash, line_offsets for text files."""
    text = F.col("content").cast("string")
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), line_offsets(text).alias("line_offsets"))


def gram_index(files: DataFrame) -> DataFrame:
    """(gram, path), long form: a common gram is many rows, never one list."""
    return files.select("path", F.explode(trigrams(F.col("content").cast("string"))).alias("gram")).select("gram", "path")


def with_proofs(catalog: DataFrame, proof: DataFrame) -> DataFrame:
    return catalog.join(proof.select("path", "hash"), "path", "left").withColumn("hash", F.coalesce("hash", F.lit("missing_proof")))


def with_ignored(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """files with `ignored`: whether the last matching line of the ignore files in the directories above says so. Lines are rules of their directory; ! takes back, a slash anchors, a
    slash at the end means directories, whose files all go with them. Files meet the rules of their ancestors by equality."""
    own = files.where((F.col("path") == name) | F.col("path").endswith("/" + name))
    line = own.select(parent_dir(F.col("path")).alias("base"), F.posexplode(F.split(F.regexp_replace(F.col("content").cast("string"), "\r", ""), "\n")).alias("n", "rule"))
    line = line.withColumn("rule", F.regexp_replace("rule", r"\s+$", "")).where("rule <> '' and not startswith(rule, '#')")
    body = F.regexp_replace("rule", "^!", "")
    anchored = F.regexp_replace(body, "/$", "").contains("/")
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "^/", ""), "/$", ""), r"([.+^$()|{}\\])", r"\\$1")
    for a, b in ((r"\*\*/", "\u0001"), (r"\*\*", "\u0002"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".*")):
        glob = F.regexp_replace(glob, a, b)
    regex = F.concat(F.when(anchored, "^").otherwise("(?:^|/)"), glob, F.when(body.endswith("/"), "/").otherwise("(?:/|$)"))
    rules = line.select("base", "n", F.col("rule").startswith("!").alias("back"), regex.alias("regex"))
    parts = F.split("path", "/")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("base"), F.array_join(F.slice(parts, k + 1, F.size(parts)), "/").alias("rest"))))
    hits = files.select("path", up.alias("u")).select("path", "u.*").join(rules, "base").where(F.expr("rlike(rest, regex)"))
    verdict = hits.groupBy("path").agg(F.max_by("back", F.struct(F.length("base"), "n")).alias("back"))
    return files.join(verdict, "path", "left").withColumn("ignored", ~F.coalesce("back", F.lit(True))).drop("back")


def snapshot_key(snapshot: str) -> str:
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in snapshot)


def write_snapshot(tables: dict[str, DataFrame], folder: str, snapshot: str, **facts: str) -> None:
    """Replace a snapshot's rows in each table; the manifest comes last, so a reader never sees half of one. Grams are dealt into parts and sorted, for searches to read few."""
    key, spark = snapshot_key(snapshot), None
    for name, df in tables.items():
        own, by = df.withColumn("snapshot", F.lit(snapshot)).withColumn("snapshot_key", F.lit(key)), ["snapshot_key"]
        if name == "grams":
            own, by = own.withColumn("gram_part", gram_part_col(F.col("gram"))).repartition("gram_part").sortWithinPartitions("gram_part", "gram"), ["snapshot_key", "gram_part"]
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/{name}")
        spark = df.sparkSession
    if spark is not None:
        row = spark.createDataFrame([(snapshot, ",".join(sorted(tables)), json.dumps(facts, sort_keys=True))], "snapshot string, tables string, facts string").withColumn("created_at", F.current_timestamp()).withColumn("snapshot_key", F.lit(key))
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_key").parquet(f"{folder}/manifest")


def read_snapshot(spark: SparkSession, folder: str, name: str, snapshot: str, schema: str | None = None) -> DataFrame:
    """A table's rows of a snapshot; with a schema a table without any is empty."""
    if schema is not None and not exists(spark, f"{folder}/{name}/snapshot_key={snapshot_key(snapshot)}"):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{folder}/{name}").where(F.col("snapshot_key") == snapshot_key(snapshot)).drop("snapshot", "snapshot_key")


def exists(spark: SparkSession, path: str) -> bool:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder; whether there was one."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def manifest(spark: SparkSession, folder: str, snapshot: str) -> dict | None:
    """The newest manifest of a snapshot, None if the snapshot isn't whole."""
    if not exists(spark, f"{folder}/manifest"):
        return None
    rows = spark.read.parquet(f"{folder}/manifest").where(F.col("snapshot_key") == snapshot_key(snapshot))
    found = latest(rows.withColumnRenamed("snapshot", "snapshot_id")).first()
    return None if found is None else {"snapshot": found["snapshot_id"], "tables": found["tables"].split(","), "facts": json.loads(found["facts"])}


def drop_snapshot(spark: SparkSession, folder: str, snapshot: str, tables: tuple[str, ...] = ("manifest", "catalog", "proofs", "grams")) -> None:
    """Delete a snapshot's rows, its manifest first, so no reader takes the rest for whole."""
    for name in tables:
        remove(spark, f"{folder}/{name}/snapshot_key={snapshot_key(snapshot)}")


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest row of each snapshot."""
    own = [c for c in snapshots.columns if c != "snapshot_id"]
    return snapshots.groupBy("snapshot_id").agg(F.max_by(F.struct(*own), F.struct("created_at")).alias("r")).select("snapshot_id", "r.*")


def freshness(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """path, state, reason for each indexed file: fresh if size and time agree, or else the hash does; missing if it is gone."""
    a, b = indexed.select("path", *(F.col(c).alias(f"i_{c}") for c in ("size", "mtime", "hash"))), current.select("path", "size", "mtime", "hash", F.lit(True).alias("there"))
    same = (F.col("size") == F.col("i_size")) & (F.col("mtime") == F.col("i_mtime")) & (F.col("hash") == F.col("i_hash"))
    state = F.when(F.col("there").isNull(), "missing").when(same, "fresh").when(F.col("hash") == F.col("i_hash"), "fresh").otherwise("stale")
    reason = F.when(F.col("there").isNull(), "missing").when(state == "fresh", "match").otherwise("hash_mismatch")
    return a.join(b, "path", "left").select("path", state.alias("state"), reason.alias("reason"))


def reconcile(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """path, change (dirty, added, deleted) of files that differ."""
    a, b = indexed.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "dirty")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def overlay(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed rows that are still fresh, and live rows for stale and new paths, with the source in source_reason."""
    changed = reconcile(indexed, current)
    stay = indexed.join(changed, "path", "left_anti").withColumn("source_reason", F.lit("index"))
    live = current.join(changed.where("change <> 'deleted'"), "path", "left_semi").withColumn("source_reason", F.lit("live_overlay"))
    return stay.unionByName(live)


def added(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Current files that no indexed path names."""
    return current.join(indexed.select("path"), "path", "left_anti")


def set_digest(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """digest and n of each group's values, in any order and with repeats: the sums of eight 32-bit parts of their SHA-256 digests modulo 2^61, so values are never gathered and tasks
    add up what they hold."""
    parts = [F.conv(F.substring(F.col("v_digest"), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    each = rows.withColumn("v_digest", F.sha2(value, 256))
    sums = each.groupBy(*by).agg(*(F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)), F.count("*").alias("n"))
    lane = lambda k: F.lpad(F.lower(F.hex((F.col(f"s{k}") % (1 << 61)).cast("long"))), 16, "0")
    return sums.select(*by, F.concat(*(lane(k) for k in range(8))).alias("digest"), "n")
