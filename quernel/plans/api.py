"""The verbs: fixed plans over operators, each returning a lazy page with caveats and facets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import needs_expansion
from ..functions.patterns import Pattern, broad_reason
from ..functions.text import depth, is_binary, lines, query_trigrams
from ..operators import catalog, extract, graph, paging, search
from ..operators.diffs import BatchQuery, batch_order
from ..operators.paging import Page
from ..operators.search import Scope

#: Reliability levels and whether they are exact.
RELIABILITY = {"source_fact": True, "precise_fact": True, "parser_fact": False, "inferred_candidate": False, "freshness": False, "remote_verified": False, "remote_unverified": False}
#: Bytes of a file that a read without a range returns.
READ_BYTES = 64 << 10


class RangeError(ValueError):
    """A target that names no readable range."""


def parse_target(target: str) -> tuple[str, int | None, int | None]:
    """path, path:n or path:a-b, lines from 1; a path outside the root is refused."""
    m = re.fullmatch(r"(.+?)(?::(\d+)(?:-(\d+))?)?", target)
    path, a, b = m[1], m[2] and int(m[2]), m[3] and int(m[3])
    if path.startswith("/") or ".." in path.split("/"):
        raise RangeError(f"{path} is outside the root")
    if a is not None and (a == 0 or b is not None and b < a):
        raise RangeError(f"bad range in {target}")
    return path, a, (b if b is not None else a)


def labelled(df: DataFrame, reliability: str, producer: str) -> DataFrame:
    return df.withColumns({"reliability": F.lit(reliability), "exact": F.lit(RELIABILITY[reliability]), "producer": F.lit(producer)})


@dataclass
class Engine:
    """files (path, language, size, content) with what was derived from them: grams (gram, path) and the indexed state (path, hash) they are of, occurrences, candidates, nodes and
    edges, and the workspace's changed paths; any may be None."""

    files: DataFrame
    grams: DataFrame | None = None
    occurrences: DataFrame | None = None
    candidates: DataFrame | None = None
    edges: DataFrame | None = None
    snapshot: str = "worktree:non-git"
    indexed: DataFrame | None = None
    limit: int = 100
    nodes: DataFrame | None = None
    changed_paths: DataFrame | None = None

    @classmethod
    def open(cls, files: DataFrame, folder: str, snapshot: str, **more) -> Engine:
        """An engine over a stored snapshot's index; files that differ from it are searched as they are. Without a whole snapshot there is no index."""
        spark = files.sparkSession
        if catalog.manifest(spark, folder, snapshot) is None:
            return cls(files, snapshot=snapshot, **more)
        return cls(files, grams=catalog.read_snapshot(spark, folder, "grams", snapshot), indexed=catalog.read_snapshot(spark, folder, "proofs", snapshot).select("path", "hash"), snapshot=snapshot, **more)

    def _page(self, kind: str, args: dict, rows: DataFrame, given: str | None, limit: int | None, guard: str | None = None, allow_broad: bool = False) -> Page:
        scope = {"kind": kind, "args": {k: str(v) for k, v in args.items()}, "snapshot": self.snapshot}
        return paging.paginate(rows, scope, self.limit if limit is None else limit, given, guard, allow_broad)

    def _scoped(self, scope: Scope) -> DataFrame:
        return scope.apply(self.files, self.changed_paths)

    def _in_scope(self, rows: DataFrame, scope: Scope) -> DataFrame:
        """Rows that come from no scan, if the scope restricts paths joined with one."""
        return graph.in_scope(rows, self._scoped(scope).drop("content")) if scope.restricts_paths else rows

    def overlaid(self, files: DataFrame, pattern: Pattern | None = None) -> DataFrame:
        """files with source_reason: index for those that the index still describes, less those whose trigrams rule a literal out; live_overlay for changed and new ones."""
        if self.grams is None:
            return files.withColumn("source_reason", F.lit("scan"))
        wanted = query_trigrams(pattern.text) if pattern is not None and pattern.mode == "literal" else []
        hash_ = F.col("hash") if "hash" in files.columns else F.sha2(F.col("content").cast("binary"), 256)
        if self.indexed is None:
            fresh, own = F.lit(True), files
        else:
            own = files.join(self.indexed.select("path", F.col("hash").alias("indexed_hash")), "path", "left")
            fresh = F.coalesce(F.col("indexed_hash") == hash_, F.lit(False))
        own = own.withColumn("source_reason", F.when(fresh, "index").otherwise("live_overlay"))
        if wanted:
            own = own.join(search.candidates(self.grams, wanted).withColumn("possible", F.lit(True)), "path", "left").where((F.col("source_reason") == "live_overlay") | F.col("possible"))
        return own.drop("possible", "indexed_hash")

    def find(self, text: str, mode: str = "literal", case_sensitive: bool = False, scope: Scope = Scope(), context: int = 0, cursor: str | None = None, limit: int | None = None, allow_broad: bool = False) -> Page:
        p = Pattern(text, mode, case_sensitive)
        rows = labelled(search.find(self.overlaid(self._scoped(scope), p), p, context=context), "source_fact", "text_search")
        return self._page("find", {"text": text, "mode": mode, "case": case_sensitive, "scope": scope, "context": context}, rows, cursor, limit, broad_reason("find", text, mode), allow_broad)

    def grep(self, text: str, **how) -> Page:
        return self.find(text, "regex", **how)

    def files_matching(self, text: str, mode: str = "literal", scope: Scope = Scope(), cursor: str | None = None, limit: int | None = None, allow_broad: bool = False) -> Page:
        rows = labelled(search.find_paths(self._scoped(scope), Pattern(text, mode, False, "path")), "source_fact", "path_search")
        return self._page("files", {"text": text, "mode": mode, "scope": scope}, rows, cursor, limit, broad_reason("files", text, mode), allow_broad)

    def glob(self, text: str, **how) -> Page:
        return self.files_matching(text, "glob", **how)

    def list(self, base: str = "", recursive: bool = False, limit: int = 0) -> DataFrame:
        return first_paths(browse(self.files, base, None if recursive else 1), limit)

    def tree(self, base: str = "", levels: int | None = None, limit: int = 0) -> DataFrame:
        return first_paths(browse(self.files, base, None if levels is None else levels + 1), limit)

    def read(self, target: str, most_bytes: int | None = READ_BYTES) -> DataFrame:
        """path, start, end, content, truncated. A range past the end is cut there; one that starts past it is an error. Without a range no more than most_bytes of a file come, or all
        for None; binary files aren't shown."""
        path, a, b = parse_target(target)
        own = self.files.where(F.col("path") == path)
        if a is not None:
            return read_lines(own, a, b)
        whole = F.lit(True) if most_bytes is None else F.octet_length("content") <= most_bytes
        cut = F.decode(F.substring(F.encode("content", "UTF-8"), 1, most_bytes or 0), "UTF-8")
        shown = F.when(is_binary(F.col("content").cast("binary"), None), F.lit(None)).when(whole, F.col("content")).otherwise(cut)
        n = F.size(lines(F.regexp_replace("content", r"\n\z", "")))
        return own.select("path", F.lit(1).alias("start"), n.alias("end"), shown.alias("content"), (~whole).alias("truncated"))

    def _parser(self) -> DataFrame:
        return self.candidates if self.candidates is not None else extract.candidates(self.files)

    def _symbols(self, text: str, contains: bool) -> DataFrame:
        m = graph.match_variant("name", text, contains=contains)
        found = extract.symbols(self._parser()).withColumn("variant", m).where("variant is not null")
        return labelled(found.withColumn("matched_by", F.col("variant.kind")).drop("variant"), "parser_fact", "parser")

    def defs(self, name: str, scope: Scope = Scope(), cursor: str | None = None, limit: int | None = None) -> Page:
        """Precise definitions; the parser's if there are none and the input isn't a plain identifier, or if there is no precise store."""
        args = {"name": name, "scope": scope}
        if self.occurrences is not None:
            rows = labelled(self._in_scope(graph.precise(self.occurrences, name, "definition"), scope), "precise_fact", "scip")
            if not needs_expansion(name) or not rows.isEmpty():
                return self._page("defs", args, rows, cursor, limit)
        out = self._page("defs", args, self._in_scope(self._symbols(name, False), scope), cursor, limit)
        out.caveats.append("parser_fact")
        return out

    def refs(self, name: str, scope: Scope = Scope(), cursor: str | None = None, limit: int | None = None, allow_broad: bool = False) -> Page:
        """Precise references, else whole-word hits in contents with the definitions among them marked."""
        args = {"name": name, "scope": scope}
        if self.occurrences is not None:
            rows = labelled(self._in_scope(graph.precise(self.occurrences, name, "reference"), scope), "precise_fact", "scip")
            if not needs_expansion(name) or not rows.isEmpty():
                return self._page("refs", args, rows, cursor, limit)
        p = Pattern(name.strip())
        hits = search.find(self.overlaid(self._scoped(scope), p), p, boundary=True)
        own = extract.symbols(self._parser()).where(F.lower("name") == name.strip().lower())
        spots = own.select("path", F.col("line").cast("long"), F.lit(1).cast("long").alias("column"), F.col("line").cast("long").alias("end_line"), F.lit(1 << 30).cast("long").alias("end_column"))
        rows = labelled(search.with_roles(hits, spots).withColumns({"name": F.lit(name), "kind": F.lit("unknown")}), "source_fact", "text_search")
        return self._page("refs", args, rows, cursor, limit, broad_reason("refs", name), allow_broad)

    def symbols(self, text: str, scope: Scope = Scope(), cursor: str | None = None, limit: int | None = None) -> Page:
        args = {"text": text, "scope": scope}
        if self.occurrences is not None:
            rows = labelled(self._in_scope(graph.precise(self.occurrences, text, "definition", contains=True), scope), "precise_fact", "scip")
            if not needs_expansion(text) or not rows.isEmpty():
                return self._page("symbols", args, rows, cursor, limit)
        return self._page("symbols", args, self._in_scope(self._symbols(text, True), scope), cursor, limit)

    def _edges(self) -> DataFrame:
        return self.edges if self.edges is not None else graph.edges_of(extract.call_edges(self._parser()))

    def calls(self, name: str, scope: Scope = Scope(), cursor: str | None = None, limit: int | None = None) -> Page:
        rows = graph.prefer_precise(self._in_scope(graph.calls_of(self._edges(), name, self.nodes), scope))
        return self._page("calls", {"name": name, "scope": scope}, labelled(rows, "inferred_candidate", "graph"), cursor, limit)

    def callers(self, name: str, scope: Scope = Scope(), cursor: str | None = None, limit: int | None = None) -> Page:
        rows = graph.prefer_precise(self._in_scope(graph.callers_of(self._edges(), name, self.nodes), scope))
        return self._page("callers", {"name": name, "scope": scope}, labelled(rows, "inferred_candidate", "graph"), cursor, limit)

    def _included(self) -> DataFrame:
        return catalog.included(catalog.scan(self.files))

    def build(self, folder: str) -> None:
        """The index: catalog, proofs and grams of the snapshot, replaced as one, and the log of what was skipped."""
        scanned = catalog.scan(self.files)
        text = catalog.included(scanned)
        catalog.write_snapshot({"skipped": catalog.skipped_log(scanned), "catalog": text.select("path", "language", "size"), "proofs": catalog.proofs(text), "grams": catalog.gram_index(text)}, folder, self.snapshot)

    def skipped(self, folder: str) -> DataFrame:
        return catalog.read_snapshot(self.files.sparkSession, folder, "skipped", self.snapshot, "path string, stage string, reason string")

    def reconciled(self, folder: str) -> DataFrame:
        """path, change of files that the stored snapshot doesn't describe any more: what watching once reports."""
        current = catalog.proofs(self._included()).select("path", "hash")
        return catalog.reconcile(catalog.read_snapshot(self.files.sparkSession, folder, "proofs", self.snapshot).select("path", "hash"), current)

    def verify(self, folder: str) -> tuple[DataFrame, int]:
        """Differences of the stored snapshot from the files, and 6 if there are any, else 0."""
        diff = self.reconciled(folder)
        return diff, 0 if diff.isEmpty() else 6

    def index_status(self, folder: str) -> dict:
        """Whether there is a whole index, whether it is fresh, and how many files are fresh, stale, gone and new."""
        found = catalog.manifest(self.files.sparkSession, folder, self.snapshot)
        if found is None:
            return {"exists": False, "fresh": False, "reason": "index_missing"}
        n = {r["change"]: r["count"] for r in self.reconciled(folder).groupBy("change").count().collect()}
        total = catalog.read_snapshot(self.files.sparkSession, folder, "proofs", self.snapshot).count()
        return {"exists": True, "fresh": not n, "manifest": found, "freshCount": total - n.get("dirty", 0) - n.get("deleted", 0), "staleFiles": n.get("dirty", 0), "missingFiles": n.get("deleted", 0), "addedFiles": n.get("added", 0)}

    def update(self, folder: str) -> dict:
        """Build the index unless it is fresh."""
        status = self.index_status(folder)
        if status["fresh"]:
            return {"updated": False, "reason": "index_fresh", "status": status}
        self.build(folder)
        return {"updated": True, "reason": status.get("reason", "index_stale"), "status": self.index_status(folder)}

    def clean(self, folder: str) -> bool:
        """Delete the whole index folder; whether there was one."""
        return catalog.remove(self.files.sparkSession, folder)

    def status(self) -> DataFrame:
        """One row about the workspace: snapshot, files, bytes, changed paths."""
        n = F.lit(0).cast("long") if self.changed_paths is None else F.lit(self.changed_paths.select("path").distinct().count())
        return self.files.agg(F.lit(self.snapshot).alias("snapshot"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("changed", n)

    def replay(self, saved: dict, strict: bool = False) -> Page | DataFrame:
        """Run a saved query again. Against another snapshot its cursor means nothing: it is dropped and a caveat says so, or with `strict` that is an error."""
        args, moved = dict(saved["args"]), saved["snapshot"] != self.snapshot
        if moved and strict:
            raise ReplayError(f"{saved['name']} was saved at {saved['snapshot']}, this is {self.snapshot}")
        if moved:
            args.pop("cursor", None)
        if "scope" in args:
            args["scope"] = Scope(**{k: tuple(v) if isinstance(v, list) else v for k, v in args["scope"].items()})
        out = getattr(self, VERBS[saved["verb"]])(**args)
        if moved and isinstance(out, Page):
            out.caveats.append("replay_snapshot_mismatch")
        return out

    def batch(self, queries: list[BatchQuery]) -> dict[str, Page | DataFrame]:
        """The answers of a batch by name, each query after those it names, all over one snapshot."""
        return {q.name: getattr(self, VERBS[q.kind])(**q.args) for q in batch_order(queries)}


#: Verbs as saved queries and batches name them.
VERBS = {"find": "find", "grep": "grep", "files": "files_matching", "glob": "glob", "list": "list", "tree": "tree", "read": "read", "defs": "defs", "refs": "refs", "symbols": "symbols", "calls": "calls", "callers": "callers", "status": "status"}


class ReplayError(ValueError):
    """A saved query of another snapshot."""


def read_lines(files: DataFrame, a: int, b: int) -> DataFrame:
    """path, start, end, content, truncated of lines a to b of each file; b past the end is cut there, a past it is an error."""
    own = files.withColumn("all_lines", lines(F.regexp_replace("content", r"\n\z", "")))
    stop = F.raise_error(F.concat(F.lit("range starts past the end of "), F.col("path")))
    end = F.when(F.size("all_lines") < a, stop.cast("int")).otherwise(F.least(F.lit(b), F.size("all_lines")))
    return own.select("path", F.lit(a).alias("start"), end.alias("end"), F.array_join(F.slice("all_lines", F.lit(a), end - a + 1), "\n").alias("content"), F.lit(False).alias("truncated"))


def first_paths(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows by path, all for 0."""
    return rows.orderBy("path", "kind").limit(limit) if limit else rows


def browse(files: DataFrame, base: str = "", most_depth: int | None = None) -> DataFrame:
    """path, kind (file or dir), depth below base; directories come from the files' paths."""
    base = base.strip("/")
    own = files.where(F.col("path").startswith(base + "/")) if base else files
    parts = F.split("path", "/")
    each = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), F.when(k == F.size(parts), "file").otherwise("dir").alias("kind")))).alias("e"))
    at = len(base.split("/")) if base else 0
    out = each.select("e.path", "e.kind").distinct().withColumn("depth", (depth(F.col("path")) + 1 - at).cast("long")).where("depth > 0")
    return out if most_depth is None else out.where(F.col("depth") <= most_depth)
