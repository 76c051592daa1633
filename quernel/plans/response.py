"""What a verb's answer looks like outside: envelope, warnings, caveats, summary, follow-ups."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.paging import Page

VERSION = 1
#: Columns that only the engine needs.
INTERNAL = ("fileHash", "readCommand", "readCommandArgv", "producer", "sourceReason", "indexFresh", "reliability", "exact", "knownBlindSpots", "fallbackReason", "previewTruncatedReason")
#: Beginnings of messages whose code isn't their slug.
CODES = {
    "failed to read ": "read_failed", "invalid line range: ": "invalid_line_range", "path escapes workspace root: ": "path_escapes_workspace_root", "no_match: ": "no_match",
    "precise_scip_index_unavailable": "precise_scip_index_unavailable", "failed to parse native SCIP index ": "failed_to_parse_native_scip_index", "failed to resolve path ": "workspace_path_resolve_failed",
    "partial parse with syntax errors: ": "partial_parse_syntax_errors", "unsupported search mode: ": "unsupported_search_mode", "query_input_expanded:": "query_input_expanded",
    "refs is identifier-boundary text search unless a precise occurrence index": "refs_identifier_boundary_text_search_unless_a_precise_occurrence_index_is_available",
}
#: Codes that only inform, and codes of errors; any other is a warning about risk.
INFO = ("precise_scip_index_unavailable", "parser_fact", "refs_identifier_boundary_text_search_unless_a_precise_occurrence_index_is_available", "query_input_expanded", "inferred_candidate")
ERRORS = ("unknown_tool", "invalid_mcp_argument", "unsupported_mcp_scope", "cli_usage_error")


def stable_code(message: str) -> str:
    """The code of a message: by its beginning, else the slug of what stands before the first colon."""
    for start, code in CODES.items():
        if message.startswith(start):
            return code
    return re.sub("[^a-z0-9]+", "_", message.split(":", 1)[0].lower()).strip("_")


def stable_code_col(message: Column) -> Column:
    out = slug(F.substring_index(message, ":", 1))
    for start, code in reversed(CODES.items()):
        out = F.when(message.startswith(start), code).otherwise(out)
    return out


@dataclass(frozen=True)
class Caveat:
    code: str
    message: str

    @property
    def severity(self) -> str:
        return "info" if self.code in INFO else "error" if self.code in ERRORS else "warning"

    @property
    def category(self) -> str:
        return {"info": "capability", "error": "error"}.get(self.severity, "risk")


def caveat_columns(code: Column) -> dict[str, Column]:
    severity = F.when(code.isin(*INFO), "info").when(code.isin(*ERRORS), "error").otherwise("warning")
    return {"severity": severity, "category": F.when(severity == "info", "capability").when(severity == "error", "error").otherwise("risk")}


def distinct_caveats(rows: DataFrame) -> DataFrame:
    """code, message, severity, category of caveats (seq, code, message): each code once, with its first message."""
    return rows.groupBy("code").agg(F.min_by("message", F.struct("seq", "message")).alias("message")).withColumns(caveat_columns(F.col("code")))


def registry(caveats: list[Caveat]) -> list[dict]:
    """Each code once, the first message wins."""
    seen: dict[str, Caveat] = {}
    for c in caveats:
        seen.setdefault(c.code, c)
    return [{"code": c.code, "message": c.message, "severity": c.severity, "category": c.category} for c in seen.values()]


def public_caveats(warnings: list[str], reliability: str, page: Page, clipped: int = 0) -> list[dict]:
    """Warnings, then what the reliability implies, then cut output, then the guard."""
    codes = {stable_code(w) for w in warnings}
    out = [Caveat(stable_code(w), w) for w in warnings if not (page.guard and stable_code(w) == "broad_query_guard_triggered")]
    if reliability == "parser_fact" and "precise_scip_index_unavailable" not in codes:
        out.append(Caveat("parser_fact", "parser fallback result; not semantic reference resolution"))
    elif reliability == "inferred_candidate":
        out.append(Caveat("inferred_candidate", "call graph result is an inferred candidate"))
    elif reliability not in ("parser_fact", "source_fact", "precise_fact", "freshness"):
        out.append(Caveat(reliability, "result reliability is not exact"))
    if output_truncated(page, clipped):
        out.append(Caveat("truncated_output", "output was truncated; narrow the query or increase limit/context"))
    if page.guard:
        hidden = max(0, page.total - 5)
        more = f"; showing sample results and suppressing {hidden}" if hidden else ""
        out.append(Caveat("broad_query_guard", f"broad query guard triggered: {page.guard}{more}; narrow the query or rerun with allow_broad and an explicit limit"))
    return registry(out)


def output_truncated(page: Page, clipped: int) -> bool:
    return clipped > 0 or page.truncated and page.next_cursor is None and page.guard is None


def page_truncated(page: Page, clipped: int, over_budget: bool = False) -> bool:
    """Whether anything is missing: the parser's budget, cut rows, a cut page without a cursor, or rows that the guard holds back."""
    return over_budget or output_truncated(page, clipped) or page.guard is not None and page.total > 5


def summary(results: DataFrame, warnings: DataFrame | None = None, scan_skipped: int = 0) -> DataFrame:
    """One row: results, cut results, and files that were skipped by the scan or by a warning (code)."""
    cut = F.lit(False)
    for c in ("truncated", "preview_truncated"):
        cut = cut | F.coalesce(F.col(c), F.lit(False)) if c in results.columns else cut
    own = results.agg(F.count("*").alias("result_count"), F.count_if(cut).alias("truncated_count"))
    if warnings is None:
        return own.withColumn("skipped_count", F.lit(scan_skipped).cast("long"))
    n = warnings.agg((F.count_if(F.col("code").isin("binary_file_not_displayed", "unreadable_file_skipped")) + scan_skipped).cast("long").alias("skipped_count"))
    return own.crossJoin(n)  # one row each


def with_read_target(results: DataFrame) -> DataFrame:
    """results with read_target, what read() takes to show a row: the path with its lines, or null for directories, binary and deleted files, and paths that aren't plain relative ones."""
    kind = F.coalesce(F.col("kind"), F.lit("")) if "kind" in results.columns else F.lit("")
    readable = ~kind.isin("dir", "binary", "deleted") & ~F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|[\x00\n]|^$")
    lines = F.lit("")
    if "line" in results.columns:
        end = F.coalesce(F.col("end_line"), F.col("line")) if "end_line" in results.columns else F.col("line")
        lines = F.when(F.col("line").isNull(), "").when(end > F.col("line"), F.concat(F.lit(":"), F.col("line").cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.concat(F.lit(":"), F.col("line").cast("string")))
    return results.withColumn("read_target", F.when(readable, F.concat(F.col("path"), lines)))


def public(results: DataFrame) -> DataFrame:
    """One column `result`: each row as JSON without the engine's own columns and without nulls."""
    internal = {c.lower() for c in INTERNAL}
    own = [c for c in results.columns if c.replace("_", "").lower() not in internal]
    return results.select(F.to_json(F.struct(*own)).alias("result"))


def envelope(command: str, query: dict, snapshot: str, reliability: str, page: Page, warnings: list[str] | None = None) -> dict:
    """A verb's answer as one object. The page's rows are collected, as many as its limit, and nothing else."""
    rows = [r.asDict(recursive=True) for r in with_read_target(page.results).collect()]
    warnings = [*(warnings or []), *(["no_match: query returned zero results; absence is not proven"] if not rows else [])]
    clipped = sum(bool(r.get("truncated") or r.get("preview_truncated")) for r in rows)
    out = {
        "schemaVersion": VERSION, "ok": True, "command": command, "query": query, "snapshot_id": snapshot, "reliability": reliability, "truncated": page_truncated(page, clipped), "nextCursor": page.next_cursor,
        "summary": {"resultCount": len(rows), "truncatedCount": clipped, "total": page.total}, "results": [prune(r) for r in rows], "suggestedReads": list(dict.fromkeys(r["read_target"] for r in rows if r.get("read_target")))[:5],
        "warnings": [{"code": stable_code(w), "message": w} for w in warnings], "caveats": public_caveats(warnings, reliability, page, clipped), "nextActions": [],
    }
    if not rows:
        out["nextActions"] = no_match_actions(command, query)
    elif command in ("defs", "symbols"):
        term = query.get("name") or query.get("text")
        same = [r for r in rows if r.get("name") == term]
        if len(same) > 1:
            out["ambiguity"] = {"candidateCount": len(same), "groups": groups(rows)}
            out["warnings"].append({"code": "ambiguous_results", "message": "multiple symbol candidates matched; narrow by path, language or kind"})
            out["nextActions"].append({"action": "narrow_scope", "include": rows[0]["path"].rpartition("/")[0], "term": term})
    return out


def groups(rows: list[dict]) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for r in rows:
        values = {c: r.get(c) for c in ("language", "kind", "container")} | {"topDir": r["path"].split("/")[0] if "/" in r["path"] else "."}
        for dim, value in values.items():
            if value is not None:
                own = out.setdefault(dim, {})
                own[value] = own.get(value, 0) + 1
    return out


def prune(value):
    """Without the engine's own fields, nulls and empty lists or objects, at every depth."""
    if isinstance(value, dict):
        internal = {c.lower() for c in INTERNAL}
        own = {k: prune(v) for k, v in value.items() if k.replace("_", "").lower() not in internal}
        return {k: v for k, v in own.items() if v is not None and v != [] and v != {}}
    return [prune(v) for v in value] if isinstance(value, list) else value


def no_match_actions(command: str, query: dict) -> list[dict]:
    """What to try when nothing was found: another spelling for names, text for symbols, a wider scope for all."""
    term = query.get("name") or query.get("text") or ""
    out = [{"action": "search_text", "verb": "find", "text": term}] if command in ("defs", "refs", "symbols", "calls", "callers") else []
    out += [{"action": "search_symbols", "verb": "symbols", "text": term}] if command in ("defs", "refs", "calls", "callers") else []
    return [*out, {"action": "widen_scope", "verb": command, "text": term}]
