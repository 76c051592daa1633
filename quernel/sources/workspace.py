"""A git workspace: status, staged files, snapshots and saved queries."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_binary


def git(root: str, *args: str, binary: bool = False):
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, check=True).stdout
    return out if binary else out.decode()


def parse_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """path, index_status, worktree_status, change_kind of porcelain lines `XY path`; a rename keeps the new path."""
    x, y, rest = F.substring(column, 1, 1), F.substring(column, 2, 1), F.substring(column, 4, 1 << 30)
    path = F.when(rest.contains(" -> "), F.substring_index(rest, " -> ", -1)).otherwise(rest)
    untracked, staged, unstaged = (x == "?") & (y == "?"), ~x.isin(" ", "?"), ~y.isin(" ", "?")
    kind = F.when(untracked, "untracked").when(staged & unstaged, "staged_and_unstaged").when(staged, "staged").when(unstaged, "unstaged")
    return lines.where(F.length(column) > 3).select(path.alias("path"), x.alias("index_status"), y.alias("worktree_status"), kind.alias("change_kind")).where("change_kind is not null")


def changed_summary(status: DataFrame) -> DataFrame:
    k = F.col("change_kind")
    return status.agg(F.count_if(k.isin("staged", "staged_and_unstaged")).alias("staged"), F.count_if(k.isin("unstaged", "staged_and_unstaged")).alias("unstaged"), F.count_if(k == "untracked").alias("untracked"), F.count("*").alias("total"))


def git_status(spark: SparkSession, root: str) -> DataFrame:
    lines = git(root, "-c", "core.quotepath=off", "status", "--porcelain=v1").splitlines()
    return parse_status(spark.createDataFrame([(x,) for x in lines], "value string"))


def staged_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the index's blobs without binary ones (a zero byte early). One git process for each batch reads its blobs."""
    paths = [p for p in git(root, "ls-files", "-z").split("\0") if p]

    def run(batches):
        import pandas as pd

        for b in batches:
            asked = "".join(f":{p}\n" for p in b["path"]).encode()
            raw, at, rows = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked, capture_output=True, check=True).stdout, 0, []
            for p in b["path"]:
                head, _, _ = raw[at:].partition(b"\n")
                at += len(head) + 1
                if head.endswith(b"missing"):
                    continue
                size = int(head.split(b" ")[2])
                rows.append((p, raw[at : at + size]))
                at += size + 1
            yield pd.DataFrame(rows, columns=["path", "content"])

    found = spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, "path string, content binary")
    return found.where(~is_binary(F.col("content")))


@dataclass(frozen=True)
class Workspace:
    root: str
    head: str | None
    dirty: bool

    @classmethod
    def open(cls, root: str) -> Workspace:
        try:
            head = git(root, "rev-parse", "HEAD").strip()
            return cls(root, head, bool(git(root, "status", "--porcelain").strip()))
        except (subprocess.CalledProcessError, FileNotFoundError):
            return cls(root, None, True)

    def snapshot_id(self, files: DataFrame | None = None) -> str:
        """commit:<head> if clean; else worktree:<head or non-git>, with a digest of the files' hashes, so that a second edit is another snapshot."""
        if not self.dirty and self.head:
            return f"commit:{self.head[:12]}"
        base = f"worktree:{self.head[:12] if self.head else 'non-git'}"
        if files is None:
            return base
        row = files.agg(F.sum(F.xxhash64("path", "hash").cast("decimal(38,0)")), F.count("*")).first()
        return f"{base}:{format((int(row[0] or 0) + row[1]) % 16**12, '012x')}"


def save_query(folder: str, name: str, verb: str, args: dict, snapshot: str) -> None:
    """Replay data only, never results."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / f"{name}.json").write_text(json.dumps({"kind": "saved_query", "name": name, "verb": verb, "args": args, "snapshot": snapshot}, sort_keys=True))


def load_query(folder: str, name: str) -> dict:
    found = json.loads((Path(folder) / f"{name}.json").read_text())
    if found.get("kind") != "saved_query":
        raise ValueError(f"{name} is no saved query")
    return found


def list_queries(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.json")) if Path(folder).is_dir() else []
