"""Snapshots packed for other machines: tables with a table of checksums, unpacked beside the local ones and never over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import exists, latest, manifest, read_snapshot, snapshot_key, write_snapshot

#: The layout that pack() writes and unpack() takes.
VERSION = 2
TABLES = ("catalog", "proofs", "grams")


class ArchiveError(ValueError):
    """An archive that is damaged, of another layout, or already there."""


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256) of the data files below a folder, relative to it, read by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    top = folder.rstrip("/").rsplit("/", 1)[-1]
    return raw.select(F.substring_index("path", f"/{top}/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def pack(spark: SparkSession, folder: str, snapshot: str, out: str, scan: dict | None = None) -> DataFrame:
    """Write a snapshot's tables, their checksums and a manifest below `out`; returns the checksums."""
    if manifest(spark, folder, snapshot) is None:
        raise ArchiveError(f"no whole snapshot {snapshot} in {folder}")
    for name in TABLES:
        read_snapshot(spark, folder, name, snapshot).write.parquet(f"{out}/data/{name}")
    checksums(spark, f"{out}/data").write.parquet(f"{out}/checksums")
    about = {"schemaVersion": VERSION, "snapshot_id": snapshot, "scanOptions": scan or {}, "fileCount": read_snapshot(spark, folder, "catalog", snapshot).count()}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{out}/manifest")
    return spark.read.parquet(f"{out}/checksums")


def unpack(spark: SparkSession, archive: str, folder: str) -> str:
    """Check an archive and write its tables as a remote snapshot below `folder`; returns the snapshot. Every file's checksum is compared before anything is written."""
    about = json.loads("".join(r["value"] for r in spark.read.text(f"{archive}/manifest").collect()))  # one small file
    if about.get("schemaVersion") != VERSION:
        raise ArchiveError(f"schema version mismatch: archive has {about.get('schemaVersion')}, expected {VERSION}")
    expected = spark.read.parquet(f"{archive}/checksums").withColumnRenamed("sha256", "expected")
    wrong = checksums(spark, f"{archive}/data").join(expected, "file", "full_outer").where("sha256 is null or expected is null or sha256 <> expected").limit(1).collect()
    if wrong:
        raise ArchiveError(f"archive missing entry: {wrong[0]['file']}" if wrong[0]["sha256"] is None else f"checksum mismatch for {wrong[0]['file']}")
    snapshot = about["snapshot_id"]
    if exists(spark, f"{folder}/remote/manifest/snapshot_key={snapshot_key(snapshot)}"):
        raise ArchiveError(f"remote snapshot {snapshot} already exists")
    tables = {name: spark.read.parquet(f"{archive}/data/{name}").drop("gram_part") for name in TABLES}
    write_snapshot(tables, f"{folder}/remote", snapshot, source="remote_unpacked", archive=archive, scan=json.dumps(about["scanOptions"], sort_keys=True))
    return snapshot


def remote_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """snapshot_id, scan of the unpacked snapshots below a folder."""
    if not exists(spark, f"{folder}/remote/manifest"):
        return spark.createDataFrame([], "snapshot_id string, scan string")
    rows = latest(spark.read.parquet(f"{folder}/remote/manifest").withColumnRenamed("snapshot", "snapshot_id"))
    return rows.select("snapshot_id", F.from_json("facts", "source string, scan string").alias("f")).where("f.source = 'remote_unpacked'").select("snapshot_id", "f.scan")


def fallback(spark: SparkSession, folder: str, snapshot: str, name: str, scan: dict | None = None) -> DataFrame | None:
    """A table of the local snapshot, or of the first remote one with equal scan options; None if there is neither. source tells which; remote rows are fresh only as far as verified."""
    if manifest(spark, folder, snapshot) is not None:
        return read_snapshot(spark, folder, name, snapshot).withColumn("source", F.lit("local"))
    found = remote_snapshots(spark, folder).where(F.col("scan") == json.dumps(scan or {}, sort_keys=True)).orderBy("snapshot_id").limit(1).collect()
    return read_snapshot(spark, f"{folder}/remote", name, found[0]["snapshot_id"]).withColumn("source", F.lit("remote_unverified")) if found else None
