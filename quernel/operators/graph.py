"""Occurrences, symbols and the call graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import BASE_SQL, LAST_SQL, display_name, like_method, match_variant, method_base_col, symbol_key, upsert_symbols, variant_sql, variants
from ..functions.text import any_of

#: Symbol kinds of the interchange format that have names.
KINDS = {3: "array", 7: "class", 8: "constant", 9: "constructor", 11: "enum", 12: "enummember", 15: "field", 17: "function", 21: "interface", 26: "method", 29: "module", 30: "namespace", 33: "object", 35: "package", 41: "property", 49: "struct", 54: "type", 61: "variable"}


SCIP_JSON = "documents array<struct<relativePath: string, language: string, occurrences: array<struct<range: array<bigint>, symbol: string, symbolRoles: bigint>>, symbols: array<struct<symbol: string, displayName: string, kind: string>>>>"


def read_scip_json(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences from an index in JSON: documents with occurrences (range of 3 or 4 numbers, 0-based) and symbols; rows are 1-based, ends exclusive."""
    return occurrences(spark.read.schema(SCIP_JSON).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.*"))


def kind_name(kind: Column) -> Column:
    """A kind as its lower-cased name, or by its number; symbol for others."""
    names = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (str(k), v)))
    return F.coalesce(F.try_element_at(names, kind), F.when(~kind.rlike("^[0-9]*$"), F.lower(kind)), F.lit("symbol"))


def occurrences(documents: DataFrame) -> DataFrame:
    """Occurrences with the merged names and kinds of their symbols, from documents (relativePath, language, occurrences, symbols). Occurrences without a symbol or with another
    number of positions are left out."""
    occ = documents.select(F.col("relativePath").alias("path"), "language", F.explode("occurrences").alias("o")).where("o.symbol <> ''")
    sym = documents.select(F.col("relativePath").alias("path"), "language", F.posexplode("symbols").alias("k", "s"))
    sym = sym.select(symbol_key(F.col("path"), F.col("s.symbol")).alias("symbol_key"), F.col("s.displayName").alias("name"), kind_name(F.col("s.kind")).alias("kind"), "language", F.struct("path", "k").alias("seq"))
    r = F.col("o.range")
    four = F.size(r) == 4
    rows = occ.where(F.size("o.range").isin(3, 4)).select(
        symbol_key(F.col("path"), F.col("o.symbol")).alias("symbol_key"), F.col("o.symbol").alias("symbol"), "path", "language",
        F.when(F.coalesce(F.col("o.symbolRoles"), F.lit(0)).bitwiseAND(1) == 1, "definition").otherwise("reference").alias("role"),
        (r[0] + 1).alias("line"), (r[1] + 1).alias("column"), (F.when(four, r[2]).otherwise(r[0]) + 1).alias("end_line"), (F.when(four, F.try_element_at(r, F.lit(4))).otherwise(r[2]) + 1).alias("end_column"),
    )
    named = upsert_symbols(sym).select("symbol_key", "name", "kind")
    return rows.join(named, "symbol_key", "left").withColumn("name", F.coalesce(F.when(F.col("name") != "", F.col("name")), display_name(F.col("symbol")))).withColumn("kind", F.coalesce("kind", F.lit("symbol")))


def occurrences_of(occ: DataFrame, identifier: str, role: str) -> DataFrame:
    """Occurrences of a role whose name, symbol or key is the identifier, or whose name is it with any signature; each once."""
    hit = (F.col("name") == identifier) | (F.col("symbol") == identifier) | (F.col("symbol_key") == identifier)
    if (like := like_method(identifier)) is not None:
        hit = hit | F.col("name").like(like)
    return occ.where((F.col("role") == role) & hit).dropDuplicates(["path", "line", "column", "end_line", "end_column", "symbol_key", "role"])


def precise(occ: DataFrame, text: str, role: str, contains: bool = False) -> DataFrame:
    """Occurrences of a role that a variant of the input matches by name, else symbol, else key."""
    m = F.coalesce(*(match_variant(c, text, contains=contains) for c in ("name", "symbol", "symbol_key")))
    return occ.where(F.col("role") == role).withColumn("variant", m).where("variant is not null").select("*", F.col("variant.kind").alias("matched_by")).drop("variant").dropDuplicates()


def occurrences_fresh(occ_files: DataFrame, current: DataFrame) -> DataFrame:
    """One row `usable`: every file of the store has its hash still, and there is one at least."""
    joined = occ_files.select("path", "hash").join(current.select("path", F.col("hash").alias("now")), "path", "left")
    return joined.agg((F.coalesce(F.bool_and(F.coalesce(F.col("hash") == F.col("now"), F.lit(False))), F.lit(False)) & (F.count("*") > 0)).alias("usable"))


def joined_symbols(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """Occurrences (symbol_key, ...) with the name and kind of their symbols (symbol_key, name, kind): an inner join, so occurrences of unknown symbols go."""
    return occ.drop("name", "kind").join(symbols.select("symbol_key", "name", "kind"), "symbol_key")


def in_scope(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose path is among the files that a scope lets through."""
    return rows.join(files.select("path").distinct(), "path", "left_semi")


def enclosing(refs: DataFrame, defs: DataFrame, key: str = "path") -> DataFrame:
    """refs (key, pos) with the innermost definition (key, name, pos, until) around them; without one, the latest that starts before; or null. Equal references are one row.

    Definitions and positions of a key go through one sorted pass with a stack of the bodies that are open, so what a task holds is how many bodies lie over one place.
    """
    own = [F.col("pos").alias("at"), F.lit(0).alias("sort"), F.col("until").cast("long").alias("until"), F.col("name").alias("name")]
    spots = refs.select(key, "pos").distinct()
    asked = spots.select(F.col(key).alias("k"), F.col("pos").alias("at"), F.lit(1).alias("sort"), F.lit(None).cast("long").alias("until"), F.lit(None).cast("string").alias("name"))
    # Of bodies that start together the longest comes first, so the innermost is on top.
    swept = defs.select(F.col(key).alias("k"), *own).unionByName(asked).repartition("k").sortWithinPartitions("k", "at", "sort", F.col("until").desc(), "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stack, last = None, [], None
        for b in batches:
            out = []
            for k, at, sort, until, name in zip(b["k"], b["at"], b["sort"], b["until"], b["name"], strict=True):
                if k != now:
                    now, stack, last = k, [], None
                while stack and stack[-1][0] < at:
                    stack.pop()
                if sort:
                    out.append((k, int(at), stack[-1][1] if stack else last))
                else:
                    stack.append((int(until), name))
                    last = name
            yield pd.DataFrame(out, columns=[key, "pos", "enclosing"])

    found = swept.mapInPandas(run, f"{key} {refs.schema[key].dataType.simpleString()}, pos long, enclosing string")
    return refs.distinct().join(found, [key, "pos"]).select(*refs.columns, "enclosing")


def edges_of(sites: DataFrame) -> DataFrame:
    """Sites once each by (caller, callee, path, line, column), the precise source first."""
    return sites.groupBy("caller", "callee", "path", "line", "column").agg(F.max("source").alias("source"))


def degrees(edges: DataFrame) -> DataFrame:
    """Node ids with their in- and out-degree."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("caller").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("callee").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def nodes(rows: DataFrame) -> DataFrame:
    """One row for each id of nodes (id, display_name, kind, path, source): the first, precise sources before others."""
    order = [(F.col("source") != "precise"), F.col("path"), F.col("kind"), F.col("display_name")]
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("n = 1").drop("n")


def from_occurrences(occ: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a precise store: a node for each defined symbol, an edge from the definition around a reference to what it refers to. Bodies end where definitions' ranges
    do; references outside all go to the latest definition before them. A place is line and column in one number."""
    place = lambda line, column: F.col(line) * (1 << 20) + F.least(F.col(column), F.lit((1 << 20) - 1))
    defs = occ.where("role = 'definition'")
    spots = defs.select("path", F.col("symbol_key").alias("name"), place("line", "column").alias("pos"), place("end_line", "end_column").alias("until")).distinct()
    refs = occ.where("role = 'reference'").select("path", "line", "column", F.col("symbol_key").alias("callee"), place("line", "column").alias("pos"))
    around = enclosing(refs, spots).where("enclosing is not null")
    known = defs.select(F.col("symbol_key").alias("callee")).distinct()
    edges = edges_of(around.join(known, "callee", "left_semi").select(F.col("enclosing").alias("caller"), "callee", "path", "line", "column", F.lit("precise").alias("source")))
    made = defs.select(F.col("symbol_key").alias("id"), F.col("name").alias("display_name"), "kind", "path", F.lit("precise").alias("source"))
    return nodes(made), edges


def resolved(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes; dangling ones go."""
    ids = nodes_.select("id")
    return edges.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")


def calls_of(edges: DataFrame, text: str, nodes_: DataFrame | None = None, case_sensitive: bool = False) -> DataFrame:
    """Outgoing edges of nodes that a variant of the input matches."""
    return _near(edges, "caller", text, nodes_, case_sensitive)


def callers_of(edges: DataFrame, text: str, nodes_: DataFrame | None = None, case_sensitive: bool = False) -> DataFrame:
    return _near(edges, "callee", text, nodes_, case_sensitive)


def matched_nodes(ids: DataFrame, text: str, case_sensitive: bool = False) -> DataFrame:
    """(id, matched_by) of the nodes (id, display_name) that a variant of the input matches by id, display name, their last identifiers, or those before a signature."""
    forms = ["id", "display_name", *(f.format(c) for f in (LAST_SQL, BASE_SQL) for c in ("id", "display_name"))]
    hit = F.expr(f"coalesce({', '.join(variant_sql(f, text, case_sensitive=case_sensitive) for f in forms)})")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    wanted = sorted({re.sub("[^a-z0-9]", "", v.lower()) for v, _ in variants(text)})
    # Whatever form of a name a variant matches, the name without its marks holds the variant without its: one cheap test before the many.
    possible = any_of([bare(F.col("id")).contains(w) | bare(F.col("display_name")).contains(w) for w in wanted]) if all(wanted) else F.lit(True)
    counted = F.col("n") > 0 if "n" in ids.columns else F.lit(True)
    return ids.withColumn("hit", F.when(counted & possible, hit)).where("hit is not null").select("id", F.col("hit.kind").alias("matched_by"))


def _near(edges: DataFrame, end: str, text: str, nodes_: DataFrame | None, case_sensitive: bool) -> DataFrame:
    """Nodes are matched once each, then joined with their edges. Their count goes into the condition, so it can't be moved below the aggregate, where it would run for each edge."""
    ids = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    ids = ids.withColumn("display_name", F.col("id")) if nodes_ is None else ids.join(nodes_.select("id", "display_name"), "id", "left").withColumn("display_name", F.coalesce(F.when(F.col("display_name") != "", F.col("display_name")), F.col("id")))
    found = matched_nodes(ids, text, case_sensitive)
    return edges.join(found.withColumnRenamed("id", end), end).select(*edges.columns, "matched_by")


def prefer_precise(candidates: DataFrame, site: list[str] | None = None, source: str = "source") -> DataFrame:
    """Without the parser's rows at sites that also have a precise one. A site is the path, the line and the last identifiers of both ends before their signatures, or the columns named."""
    keys = [F.col(c) for c in site] if site else [F.col("path"), F.col("line"), method_base_col(F.col("caller")), method_base_col(F.col("callee"))]
    w = Window.partitionBy(*keys)
    return candidates.withColumn("any_precise", F.max((F.col(source) == "precise").cast("int")).over(w)).where((F.col(source) == "precise") | (F.col("any_precise") == 0)).drop("any_precise")


def budget(candidates: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group: a feature of queries that list candidates, with the group's total beside them."""
    w = Window.partitionBy(by)
    return candidates.withColumn("total", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy(*order)).cast("long")).where(F.col("n") <= most)
