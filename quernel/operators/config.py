"""Facts in configuration files: keys, values, entry points and instructions with masked previews."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MASK, PREVIEW, SECRET_TERMS
from . import project

#: Bytes of a file that are looked at unless more are asked for. Longer files carry the caveat `large_file_truncated`.
MOST_BYTES = 256 << 10
FACTS = "path string, kind string, key_path string, name string, line int, preview string, masked boolean, caveats array<string>"


def is_secret(value: str) -> bool:
    low = value.lower()
    bare = re.sub("[^a-z0-9]", "", low)
    return any(t in low or t.replace("_", "") in bare for t in SECRET_TERMS)


def preview(context: str, value: str) -> tuple[str, bool]:
    """(what is shown of a value, whether it is masked)."""
    if is_secret(context) or is_secret(value):
        return MASK, True
    bare = value.strip().strip('"').strip("'")
    return bare[:PREVIEW] + "..." * (len(bare) > PREVIEW), False


def flatten(value, path: str = "") -> Iterator[tuple[str, object]]:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flatten(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list) and value:
        for k, v in enumerate(value):
            yield from flatten(v, f"{path}[{k}]")
    else:
        yield path, value


def _line_of(lines: list[str], key: str, start: int = 0) -> int:
    last = re.split(r"[.\[]", key.rstrip("]"))
    names = [x for x in last if x and not x.isdigit()]
    for k in range(start, len(lines)):
        if names and names[-1] in lines[k]:
            return k
    return 0


def _indented(lines: list[str]) -> Iterator[tuple[str, str, int]]:
    """Key paths of a YAML file from its indentation: (path, scalar, line). List items get []."""
    stack: list[tuple[int, str]] = []
    for n, raw in enumerate(lines):
        m = re.match(r"(\s*)((?:- +)*)([\"']?)([\w./$-]+)\3\s*:(?:\s+(.*))?$", raw.split(" #", 1)[0].rstrip())
        if not m or raw.lstrip().startswith("#"):
            continue
        level = len(m[1]) + len(m[2])
        while stack and stack[-1][0] >= level:
            stack.pop()
        key = ("[]." if m[2] and stack else "") + m[4]
        path = ".".join([k for _, k in stack] + [key]).replace(".[]", "[]")
        stack.append((level, key))
        if m[5] and m[5] not in ("|", ">", "|-", ">-"):
            yield path, m[5].strip("\"'"), n


def facts_of(path: str, text: str) -> Iterator[tuple]:
    """(kind, key_path, name, line, value) of a file; a file that can't be parsed is one source_fallback fact."""
    name, lines = path.rsplit("/", 1)[-1], text.split("\n")
    if name == "Dockerfile" or name.startswith("Dockerfile."):
        for n, x in enumerate(lines):
            if m := re.match(r"\s*([A-Za-z]+)\s+(.+)", x):
                if m[1].isupper():
                    yield "container_instruction", m[1], m[1], n, m[2]
    elif name in ("Makefile", "makefile") or name.endswith(".mk"):
        target = None
        for n, x in enumerate(lines):
            if m := re.match(r"([A-Za-z0-9_.-]+)\s*:(?!=)", x):
                target = m[1]
                yield "make_target", target, target, n, x
            elif x.startswith("\t") and target:
                yield "make_recipe", target, target, n, x.strip()
    elif name.endswith((".sh", ".bash")):
        for n, x in enumerate(lines):
            if n == 0 and x.startswith("#!"):
                yield "entrypoint", "shebang", x[2:].strip(), n, x
            elif m := re.match(r"\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)", x):
                yield "shell_function", m[1], m[1], n, x
            elif m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)=(.*)", x):
                yield "env_var", m[1], m[1], n, m[2]
            elif m := re.match(r"\s*([A-Za-z][\w./-]*)\s", x + " "):
                if m[1] not in ("if", "then", "fi", "do", "done", "else", "for", "while", "case", "esac"):
                    yield "shell_command", m[1], m[1], n, x.strip()
    elif name.endswith((".ini", ".properties", ".cfg")) or name.startswith(".env"):
        section = ""
        for n, x in enumerate(lines):
            if m := re.match(r"\s*\[([^\]]+)\]", x):
                section = m[1].strip()
            elif (m := re.match(r"\s*(?:export\s+)?([^=:#;\s][^=:]*?)\s*[=:]\s*(.*)", x)) and not x.lstrip().startswith(("#", ";")):
                yield "key_value", f"{section}.{m[1]}" if section else m[1], m[1], n, m[2]
    elif name.endswith((".json", ".toml")):
        try:
            tree = json.loads(text) if name.endswith(".json") else tomllib.loads(text)
        except ValueError:
            yield "source_fallback", None, name, 0, text[:PREVIEW]
            return
        for key, value in flatten(tree):
            yield "key_value", key, re.split(r"[.\[]", key)[-1].rstrip("]"), _line_of(lines, key), json.dumps(value) if not isinstance(value, str) else value
    elif name.endswith((".yml", ".yaml")):
        found = list(_indented(lines))
        kind = "key_value"
        if "/workflows/" in path:
            kind = "workflow"
        elif "compose" in name:
            kind = "compose"
        elif any(k == "apiVersion" for k, _, _ in found):
            kind = "kubernetes"
        for key, value, n in found:
            yield kind, key, key.rsplit(".", 1)[-1], n, value
        if not found:
            yield "source_fallback", None, name, 0, text[:PREVIEW]


def extract(files: DataFrame, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """Facts of each file; lines are 0-based, values of secret keys or secret-like values are masked. Files of other kinds give none. most_bytes None looks at whole files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["content"], strict=True):
                raw = (text or "").encode()
                long = most_bytes is not None and len(raw) > most_bytes
                cut = raw[:most_bytes].decode(errors="ignore") if long else text or ""
                for kind, key, name, line, value in facts_of(path, cut):
                    shown, secret = preview(".".join(x for x in (key, name) if x), str(value))
                    caveats = ["large_file_truncated"] * long + ["secret_masked"] * secret + ["parse_failure"] * (kind == "source_fallback")
                    out.append((path, kind, key, name, line, shown, secret, caveats))
            yield pd.DataFrame(out, columns=["path", "kind", "key_path", "name", "line", "preview", "masked", "caveats"])

    return files.select("path", F.col("content").cast("string").alias("content")).mapInPandas(run, FACTS)


def workspace_facts(files: DataFrame, roots: DataFrame, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """Facts of the configuration and environment files of a workspace, with what they concern."""
    edges = project.config_edges(files, roots)
    every = edges.select("path", "affected", "all_roots", "unresolved").unionByName(project.environment_edges(files, roots).select("path", F.array().cast("array<string>").alias("affected"), "all_roots", "unresolved"))
    own = files.join(every.select("path").distinct(), "path", "left_semi")
    return with_edges(extract(own, most_bytes), every)


def with_edges(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """facts with affected (union of the edges' roots), all_roots (any edge concerns all) and unresolved (any edge is)."""
    by_path = edges.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("affected")))).alias("affected"), F.bool_or("all_roots").alias("all_roots"), F.bool_or("unresolved").alias("unresolved"))  # two edges a file at most
    return facts.join(by_path, "path", "left")


def key_matches(key: Column, query: str) -> Column:
    """Equal to the trimmed query, a dotted tail of the key, or a part of it; case counts."""
    q = query.strip()
    return (key == q) | key.endswith("." + q) | key.contains(q)


def json_leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, key_path, value) of the scalar leaves of JSON objects of one level, by Spark's own JSON functions."""
    return rows.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("key_path", "value"))
