"""Patterns: literal, regex, wildcard and glob, for contents and for paths, as java.util.regex."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of

MODES = ("literal", "regex", "wildcard", "glob")
TARGETS = ("content", "path")


class PatternError(ValueError):
    """A pattern that can't be compiled or would leave linear time."""


def quote(literal: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


def wildcard_regex(pattern: str, target: str) -> str:
    """Unanchored: * is any run (within a line in contents), ? is one character of it, the rest is literal."""
    any_char = r"[^\n]" if target == "content" else "(?s:.)"
    return "".join(f"{any_char}*" if c == "*" else any_char if c == "?" else quote(c) for c in pattern)


def glob_regex(pattern: str) -> str:
    """Anchored at both ends; * crosses directories, as ** does; ? is any one character; [..], [!..] and {a,b} as usual."""
    out, k, depth = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
            continue
        if c == "*":
            while pattern.startswith("*", k + 1):
                k += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            k = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(quote(pattern[k]))
        else:
            out.append(quote(c))
        k += 1
    if depth:
        raise PatternError(f"unclosed brace in {pattern!r}")
    return f"^(?s:{''.join(out)})$"


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern. regex is for Spark's rlike and regexp functions."""

    text: str
    mode: str = "literal"
    case_sensitive: bool = False
    target: str = "content"

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.target not in TARGETS:
            raise PatternError(f"unknown mode or target: {self.mode}, {self.target}")
        if self.mode == "regex":
            if re.search(r"\(\?<?[=!]|(?<!\\)(?:\\\\)*\\[1-9]|\(\?P?[=>]", self.text):
                raise PatternError("look-around and back-references would leave linear time")
            try:
                re.compile(self.text)
            except re.error as e:
                raise PatternError(f"invalid regex: {e}") from e
        self.body  # noqa: B018  compiles a glob

    @property
    def body(self) -> str:
        if self.mode == "regex":
            return self.text
        if self.mode == "wildcard":
            return wildcard_regex(self.text, self.target)
        if self.mode == "glob":
            return glob_regex(self.text)
        return quote(self.text)

    @property
    def regex(self) -> str:
        return self.body if self.case_sensitive else f"(?iu){self.body}"

    def may_match(self, value: Column) -> Column:
        """True wherever a content pattern could match, without a regex: literals by containment in lower-cased text. Four characters outside ASCII fold to ASCII letters although their
        lower case differs, so values that hold one stay."""
        if self.mode != "literal" or self.target != "content" or not self.text.isascii():
            return F.lit(True)
        if self.case_sensitive:
            return value.contains(self.text)
        return any_of([F.lower(value).contains(self.text.lower()), *(value.contains(c) for c in "\u017f\u212a\u0130\u0131")])

    @property
    def within_lines(self) -> bool:
        """Whether no match can hold a line break, so that lines can be searched one by one."""
        if self.mode == "literal":
            return "\n" not in self.text
        if self.mode == "wildcard":
            return "\n" not in self.text
        return self.mode == "regex" and not re.search(r"\\[nsWDSRvxup0-9]|\[\^|\(\?[a-z]*s|\n|\^|\$|\\[AzZbB]", self.text)

    @property
    def may_be_empty(self) -> bool:
        return re.compile(self.body if self.mode != "glob" else self.body).match("") is not None

    def matches(self, value: Column) -> Column:
        """Whether the value has a match: paths in literal mode compare whole lower-cased strings, the rest is the regex."""
        if self.target == "path" and self.mode == "literal":
            return value.contains(self.text) if self.case_sensitive else F.lower(value).contains(self.text.lower())
        return value.rlike(self.regex)


#: Literals, path patterns and regexes that are too common to list all hits of without being asked to.
BROAD_LITERALS = ("", "*", "public", "private", "protected", "class", "function", "fn", "let", "const", "var", "if", "for", "while", "return", "import", "export")
BROAD_PATHS = ("", "*", "**", "**/*", ".*")
BROAD_REGEXES = (".*", ".+", "^.*$", "^.+$")


def broad_reason(kind: str, pattern: str, mode: str | None = None) -> str | None:
    """Why a query of a kind (files, glob, find, refs, ...) is broad, or None. Literals are compared as they are, case included; one character is always broad."""
    text = pattern.strip()
    if kind in ("files", "glob") and text in BROAD_PATHS:
        return "broad_path_pattern"
    if mode == "regex" and text in BROAD_REGEXES:
        return "broad_regex_pattern"
    if kind in ("find", "refs") and (text in BROAD_LITERALS or len(text) <= 1):
        return "broad_literal_pattern"
    return None
