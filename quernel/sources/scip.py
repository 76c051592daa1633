"""Precise indexes in the public protobuf format, read and written by its wire rules, and the store of their occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.catalog import manifest, read_snapshot, write_snapshot

#: Field numbers of the format. An index has documents; a document its path, occurrences, symbols and language; an occurrence its range, symbol and roles; a symbol its
#: text, kind and display name.
DOCUMENTS, PATH, OCCURRENCES, SYMBOLS, LANGUAGE, RANGE, SYMBOL, ROLES, KIND, DISPLAY = 2, 1, 2, 3, 4, 1, 2, 3, 5, 6
#: Bits of an occurrence's roles.
ROLE_BITS = {"definition": 1, "import": 2, "write": 4, "read": 8, "reference": 0}
SCHEMA = "relativePath string, language string, occurrences array<struct<range: array<bigint>, symbol: string, symbolRoles: bigint>>, symbols array<struct<symbol: string, displayName: string, kind: string>>"


class ScipError(ValueError):
    """Bytes that are no index, or facts that make none."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ScipError("failed to decode index: bad number")
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, number or bytes) of a message, in order."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ScipError("failed to decode index: cut short")
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ScipError(f"failed to decode index: wire type {wire}")
        yield tag >> 3, value


def _numbers(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x)
    return out


def decode(data: bytes) -> Iterator[tuple]:
    """(path, language, occurrences, symbols) of each document of an index."""
    for number, value in fields(data):
        if number != DOCUMENTS:
            continue
        path = language = ""
        occurrences, symbols = [], []
        for k, x in fields(value):
            if k == PATH:
                path = x.decode()
            elif k == LANGUAGE:
                language = x.decode()
            elif k == OCCURRENCES:
                own = {"range": [], "symbol": "", "symbolRoles": 0}
                for f, y in fields(x):
                    if f == RANGE:
                        own["range"] += _numbers(y)
                    elif f == SYMBOL:
                        own["symbol"] = y.decode()
                    elif f == ROLES:
                        own["symbolRoles"] = y
                occurrences.append(own)
            elif k == SYMBOLS:
                own = {"symbol": "", "displayName": "", "kind": "0"}
                for f, y in fields(x):
                    if f == 1:
                        own["symbol"] = y.decode()
                    elif f == KIND:
                        own["kind"] = str(y)
                    elif f == DISPLAY:
                        own["displayName"] = y.decode()
                symbols.append(own)
        yield path, language, occurrences, symbols


def _put(number: int, value: int | str | bytes) -> bytes:
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def encode(path: str, language: str, occurrences: list[dict], symbols: list[dict]) -> bytes:
    """A document as a field of an index; indexes are joined by joining their bytes."""
    body = _put(PATH, path)
    for o in occurrences:
        packed = b"".join(_put(0, x)[1:] for x in o["range"])
        body += _put(OCCURRENCES, _put(RANGE, packed) + _put(SYMBOL, o["symbol"]) + (_put(ROLES, o["symbolRoles"]) if o["symbolRoles"] else b""))
    for s in symbols:
        body += _put(SYMBOLS, _put(1, s["symbol"]) + (_put(KIND, int(s["kind"])) if int(s["kind"]) else b"") + _put(DISPLAY, s["displayName"]))
    return _put(DOCUMENTS, body + _put(LANGUAGE, language))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the index files below a path; a file is decoded by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = list(decode(bytes(data)))
                for k in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[k : k + 256], columns=["relativePath", "language", "occurrences", "symbols"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    return graph.occurrences(read_documents(spark, path))


def index_rows(facts: DataFrame) -> DataFrame:
    """(path, document): the encoded document of each path, from facts (path, language, start_line, start_column, end_line, end_column, symbol, display_name, kind, role, reliability),
    0-based. Only provider-confirmed ones are written, each (range, symbol, role) once and in order; a path with two languages or a range that ends before it starts is an error."""
    own = facts.where("reliability = 'provider_confirmed'")
    start, end = F.struct("start_line", "start_column"), F.struct(F.col("end_line").alias("start_line"), F.col("end_column").alias("start_column"))
    bad = F.when(end < start, F.raise_error(F.concat(F.lit("semantic range end precedes start in "), F.col("path"))).cast("boolean")).otherwise(F.lit(False))
    kinds = F.create_map(*(F.lit(x) for k, v in graph.KINDS.items() for x in (v, str(k))))
    bits = F.create_map(*(F.lit(x) for k, v in ROLE_BITS.items() for x in (k, v)))
    spots = own.where(~bad).select("path", "language", "start_line", "start_column", "end_line", "end_column", "display_name", "symbol", F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("0")).alias("kind"), F.try_element_at(bits, F.col("role")).alias("bits"))
    each = spots.dropDuplicates(["path", "language", "start_line", "start_column", "end_line", "end_column", "symbol", "bits"])
    row = F.struct("start_line", "start_column", "end_line", "end_column", "display_name", "symbol", "kind", "bits")
    by_path = each.groupBy("path").agg(F.collect_set("language").alias("languages"), F.array_sort(F.collect_list(row)).alias("rows"))  # a file's occurrences

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, languages, rows in zip(b["path"], b["languages"], b["rows"], strict=True):
                if len(languages) > 1:
                    raise ScipError(f"document {path} has mixed languages: {', '.join(sorted(languages))}")
                symbols: dict[str, dict] = {}
                for r in rows:
                    symbols.setdefault(r["symbol"], {"symbol": r["symbol"], "kind": r["kind"], "displayName": r["display_name"] or ""})
                span = lambda r: [r["start_line"], r["start_column"], *([r["end_line"]] if r["end_line"] != r["start_line"] else []), r["end_column"]]
                out.append((path, encode(path, languages[0], [{"range": span(r), "symbol": r["symbol"], "symbolRoles": r["bits"]} for r in rows], [symbols[s] for s in sorted(symbols)])))
            yield pd.DataFrame(out, columns=["path", "document"])

    return by_path.mapInPandas(run, "path string, document binary")


def write_scip(facts: DataFrame, folder: str) -> DataFrame:
    """Index files below a folder, one for each task; returns their names and how many documents each has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        import pyarrow.fs as pafs

        out, n, path = None, 0, None
        for b in batches:
            for document in b["document"]:
                if out is None:
                    store, top = pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
                    store.create_dir(top, recursive=True)
                    path = f"{top}/{uuid.uuid4().hex}.scip"
                    out = store.open_output_stream(path)
                out.write(bytes(document))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [path], "documents": [n]})

    made = index_rows(facts).mapInPandas(run, "file string, documents long")
    return facts.sparkSession.createDataFrame(made.collect(), "file string, documents long")  # a row for each file


STORE = ("occurrences", "symbols", "file_hashes")


def build_store(occ: DataFrame, files: DataFrame, folder: str, snapshot: str) -> None:
    """The occurrence store of a snapshot: occurrences, their symbols, and the hashes of the files they lie in; the manifest comes last."""
    symbols = occ.groupBy("symbol_key").agg(F.min("symbol").alias("symbol"), F.min("name").alias("name"), F.min("kind").alias("kind"), F.min("language").alias("language"))
    hashes = occ.select("path").distinct().join(files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash")), "path", "left").withColumn("hash", F.coalesce("hash", F.lit("")))
    write_snapshot({"occurrences": occ.drop("name", "kind"), "symbols": symbols, "file_hashes": hashes}, folder, snapshot)


def read_store(spark: SparkSession, folder: str, snapshot: str, current: DataFrame | None = None) -> DataFrame | None:
    """Occurrences of a store with their symbols' names and kinds; None if the store isn't whole or, where files are given, any of its files has changed."""
    found = manifest(spark, folder, snapshot)
    if found is None or not set(STORE) <= set(found["tables"]):
        return None
    if current is not None and not graph.occurrences_fresh(read_snapshot(spark, folder, "file_hashes", snapshot), current).first()["usable"]:
        return None
    return graph.joined_symbols(read_snapshot(spark, folder, "occurrences", snapshot), read_snapshot(spark, folder, "symbols", snapshot))


def read_lsp(spark: SparkSession, path: str) -> DataFrame:
    """Definitions from generated language-server answers, one JSON object a line: path, language, symbols (name, kind, range, selectionRange, children). Children are followed to any depth;
    positions become 1-based, and a child's symbol names those around it."""
    raw = spark.read.text(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            out = []
            for line in b["value"]:
                d = json.loads(line)
                open_ = [(s, "") for s in reversed(d.get("symbols") or [])]
                while open_:
                    s, above = open_.pop()
                    r = s.get("selectionRange") or s["range"]
                    symbol = f"{above}{s['name']}"
                    out.append((f"lsp {d['path']}/{symbol}#", f"lsp {d['path']}/{symbol}#", d["path"], d.get("language", "text"), "definition", r["start"]["line"] + 1, r["start"]["character"] + 1, r["end"]["line"] + 1, r["end"]["character"] + 1, s["name"], str(s.get("kind", 0))))
                    open_ += [(c, f"{symbol}.") for c in reversed(s.get("children") or [])]
            yield pd.DataFrame(out, columns=["symbol_key", "symbol", "path", "language", "role", "line", "column", "end_line", "end_column", "name", "kind"])

    rows = raw.where("trim(value) <> ''").mapInPandas(run, "symbol_key string, symbol string, path string, language string, role string, line long, column long, end_line long, end_column long, name string, kind string")
    names = F.create_map(*(F.lit(x) for k, v in LSP_KINDS.items() for x in (str(k), v)))
    return rows.withColumn("kind", F.coalesce(F.try_element_at(names, F.col("kind")), F.lit("symbol")))


#: Symbol kinds of the language-server protocol that have names here.
LSP_KINDS = {2: "module", 3: "namespace", 4: "package", 5: "class", 6: "method", 7: "property", 8: "field", 9: "constructor", 10: "enum", 11: "interface", 12: "function", 13: "variable", 14: "constant", 22: "enummember", 23: "struct"}
