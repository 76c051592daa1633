"""Content and path search: matches with positions, previews, context and definition roles."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, prefix_sums
from ..functions.patterns import Pattern, PatternError
from ..functions.text import any_of, clip, extension, gram_part, lines, query_trigrams, skipped_dir

IDENT = r"[A-Za-z0-9_]"


class ScopeError(ValueError):
    """A scope that leaves the root or can't be evaluated."""


@dataclass(frozen=True)
class Scope:
    """Which files a query sees. dirs are OR-ed; include and exclude are case-sensitive substrings, exclude wins; languages and extensions ignore case."""

    dirs: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    file_patterns: tuple[str, ...] = ()
    file_mode: str = "wildcard"
    hidden: bool = True
    no_ignore: bool = True
    changed: bool = False

    def __post_init__(self) -> None:
        for d in self.dirs:
            if d.startswith("/") or ".." in d.split("/"):
                raise ScopeError(f"{d} is outside the root")

    @property
    def restricts_paths(self) -> bool:
        """Whether results that come from no scan must be joined with one."""
        return self.changed or any((self.dirs, self.extensions, self.languages, self.include, self.exclude, self.file_patterns))

    def predicate(self, path: Column, language: Column | None = None) -> Column:
        out = F.lit(True)
        if self.dirs:
            out &= any_of([path.startswith(d.strip("/") + "/") if d.strip("/") not in ("", ".") else F.lit(True) for d in self.dirs])
        if self.extensions:
            out &= F.lower(extension(path)).isin([e.lstrip(".").lower() for e in self.extensions])
        if self.languages and language is not None:
            out &= F.lower(language).isin([x.lower() for x in self.languages])
        if self.file_patterns:
            out &= any_of([Pattern(p, self.file_mode, True, "path").matches(path) for p in self.file_patterns])
        for x in self.exclude:
            out &= ~path.contains(x)
        if self.include:
            out &= any_of([path.contains(x) for x in self.include])
        if not self.hidden:
            out &= ~path.rlike(r"(^|/)\.[^/]")
        return out & ~skipped_dir(path, self.no_ignore) if not self.no_ignore else out

    def apply(self, files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
        """files in the scope; with `changed` set, those of the table of changed paths."""
        own = files.where(self.predicate(F.col("path"), F.col("language") if "language" in files.columns else None))
        if not self.changed:
            return own
        if changed is None:
            raise ScopeError("the workspace's changes aren't known")
        return own.join(changed.select("path").distinct(), "path", "left_semi")


def hits_of(text: Column, regex: str) -> Column:
    """Matches of a text as (hit, at): at counts the code points before, from the pieces between matches. A text without a match is only searched once."""

    def placed(found: Column) -> Column:
        def at(parts: Column) -> Column:
            widths = F.transform(found, lambda x, k: (F.length(x) + F.length(F.get(parts, k))).cast("int"))
            return let(prefix_sums(widths), lambda before: F.transform(found, lambda x, k: F.struct(x.alias("hit"), (F.get(before, k) + F.length(F.get(parts, k))).cast("int").alias("at"))))

        none = F.array().cast("array<struct<hit: string, at: int>>")
        return F.when(F.size(found) > 0, let(F.split(text, regex, -1), at)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(regex), 0), placed)


def find(files: DataFrame, pattern: Pattern, *, boundary: bool = False, preview: int = 240, context: int = 0) -> DataFrame:
    """A row for each match: path, line and column (1-based, code points), end_line, end_column (exclusive), match_text, preview; before and after if context.

    Files are cut into lines and lines without a match dropped before anything is computed, unless a match could hold a line break. boundary keeps
    matches that no identifier character touches. Patterns that match the empty string are searched by a vectorised Python function, as Java's split
    drops empty pieces. Null content has no matches.
    """
    if pattern.target != "content":
        raise PatternError("contents are searched with content patterns")
    regex = f"(?<!{IDENT})(?:{pattern.body})(?!{IDENT})" if boundary else pattern.body
    regex = regex if pattern.case_sensitive else f"(?iu){regex}"
    extra = [c for c in ("language", "source_reason") if c in files.columns]
    known = files.where(F.col("content").isNotNull())
    if pattern.may_be_empty or not pattern.within_lines:
        hits = _find_whole(known, regex, extra, pattern.may_be_empty)
    else:
        # Literals drop files and lines by containment; other patterns drop files by the regex, and lines as they are searched.
        some = pattern.may_match(F.col("content")) if pattern.mode == "literal" else F.col("content").rlike(regex)
        each = known.where(some).select("path", *extra, F.posexplode(lines(F.col("content"))).alias("n", "text")).where(pattern.may_match(F.col("text")))
        found = each.select("path", *extra, (F.col("n") + 1).cast("long").alias("line"), "text", F.explode(hits_of(F.col("text"), regex)).alias("m"))
        hits = found.select("path", *extra, "line", (F.col("m.at") + 1).cast("long").alias("column"), F.col("line").alias("end_line"), (F.col("m.at") + 1 + F.length("m.hit")).cast("long").alias("end_column"), F.col("m.hit").alias("match_text"), "text")
    out = hits.withColumn("preview", clip(F.col("text"), preview)).drop("text")
    return with_context(out, files, context, preview) if context else out


def _find_whole(files: DataFrame, regex: str, extra: list[str], python: bool) -> DataFrame:
    if python:
        compiled = regex.replace("(?iu)", "(?i)")

        @F.pandas_udf("array<struct<hit: string, at: int>>")
        def search(texts: pd.Series) -> pd.Series:
            r = re.compile(compiled)
            return pd.Series([[{"hit": m.group(), "at": m.start()} for m in r.finditer(t)] for t in texts])

        hits = search(F.col("content"))
    else:
        hits = hits_of(F.col("content"), regex)
    each = files.select("path", *extra, "content", F.explode(hits).alias("m"))
    before = F.substring(F.col("content"), F.lit(1), F.col("m.at"))
    last = lambda t: F.substring_index(t, "\n", -1)
    upto = F.concat(before, F.col("m.hit"))
    rest = F.substring_index(F.substring(F.col("content"), F.col("m.at") + 1, F.length("content")), "\n", 1)
    count = lambda t: (F.size(F.split(t, "\n", -1))).cast("long")
    return each.select(
        "path", *extra, count(before).alias("line"), (F.length(last(before)) + 1).cast("long").alias("column"), count(upto).alias("end_line"),
        (F.length(last(upto)) + 1).cast("long").alias("end_column"), F.col("m.hit").alias("match_text"), F.concat(last(before), rest).alias("text"),
    )


def with_context(hits: DataFrame, files: DataFrame, around: int, most: int = 240) -> DataFrame:
    """hits with arrays `before` and `after` of up to `around` clipped lines."""
    own = files.select("path", lines(F.col("content")).alias("all_lines"))
    at = F.col("line").cast("int")
    cut = lambda x: clip(x, most)
    before = F.transform(F.slice("all_lines", F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around))), cut)
    return hits.join(own, "path").withColumn("before", before).withColumn("after", F.transform(F.slice("all_lines", at + 1, F.lit(around)), cut)).drop("all_lines")


def find_paths(files: DataFrame, pattern: Pattern) -> DataFrame:
    """Files whose path matches; contents are never read."""
    return files.drop("content").where(pattern.matches(F.col("path")))


def prefiltered(files: DataFrame, grams: DataFrame, pattern: Pattern) -> DataFrame:
    """Files that hold every trigram of a literal, by an index (gram, path); any other pattern keeps all. Grams are of lower-cased text, so no case is lost."""
    wanted = query_trigrams(pattern.text) if pattern.mode == "literal" else []
    if not wanted:
        return files
    return files.join(candidates(grams, wanted), "path", "left_semi")


def candidates(grams: DataFrame, wanted: list[str]) -> DataFrame:
    """Paths that hold all wanted grams. An index with gram_part is read in the parts of these grams only."""
    own = grams.where(F.col("gram_part").isin(sorted({gram_part(g) for g in wanted}))) if "gram_part" in grams.columns else grams
    return own.where(F.col("gram").isin(wanted)).groupBy("path").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(set(wanted))).select("path")


def with_roles(hits: DataFrame, definitions: DataFrame) -> DataFrame:
    """hits with role definition if a definition's name range of the same path contains them, else reference_candidate. The hits are searched for once: the join marks those inside."""
    d = definitions.select(F.col("path").alias("d_path"), F.struct("line", "column").alias("d_start"), F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column")).alias("d_end"))
    by_path = d.groupBy("d_path").agg(F.collect_set(F.struct("d_start", "d_end")).alias("spots"))  # a file's definitions, as many as it has at most
    here, end = F.struct("line", "column"), F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column"))
    inside = F.exists(F.col("spots"), lambda s: (s["d_start"] <= here) & (end <= s["d_end"]))
    role = F.when(F.coalesce(inside, F.lit(False)), "definition").otherwise("reference_candidate")
    return hits.join(by_path, F.col("path") == F.col("d_path"), "left").withColumn("role", role).drop("d_path", "spots")
