"""Symbols, imports and calls from source text, by Python's own parser or a tokeniser for languages with braces."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates of one file, at most; the last one then carries the blind spot `budget`.
PER_FILE = 2000
CANDIDATES = "path string, language string, candidate_kind string, kind string, name string, target string, line int, column int, end_line int, enclosing_symbol string, body_hash string, ordinal int, blind_spots array<string>"
#: Languages and what the extractor can't see in them.
BLIND_SPOTS = {"python": ["dynamic_dispatch", "decorators"], "rust": ["macros", "trait_dispatch"], "go": ["interface_dispatch"], "java": ["reflection", "overloads"], "typescript": ["dynamic_property"], "javascript": ["dynamic_property"]}
#: What opens a definition, by language: (regex with the name in its last group, kind).
DEFINITIONS = {
    "rust": ((r"\bfn\s+([A-Za-z_]\w*)", "function"), (r"\bstruct\s+([A-Za-z_]\w*)", "struct"), (r"\benum\s+([A-Za-z_]\w*)", "enum"), (r"\btrait\s+([A-Za-z_]\w*)", "trait"), (r"\bmod\s+([A-Za-z_]\w*)", "module")),
    "go": ((r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "function"), (r"\btype\s+([A-Za-z_]\w*)\s+struct", "struct"), (r"\btype\s+([A-Za-z_]\w*)\s+interface", "interface")),
    "java": ((r"\bclass\s+([A-Za-z_]\w*)", "class"), (r"(?<!@)\binterface\s+([A-Za-z_]\w*)", "interface"), (r"\benum\s+([A-Za-z_]\w*)", "enum"), (r"\brecord\s+([A-Za-z_]\w*)\s*\(", "record"), (r"@interface\s+([A-Za-z_]\w*)", "annotation"), (r"(?:[\w<>\[\],?]+\s+)+([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:throws [\w, .]+)?\{", "function"), (r"(?:public|protected|private)\s+([A-Z]\w*)\s*\([^;{}()]*\)\s*\{", "constructor")),
    "typescript": ((r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)", "function"), (r"\bclass\s+([A-Za-z_$][\w$]*)", "class"), (r"\binterface\s+([A-Za-z_$][\w$]*)", "interface"), (r"\benum\s+([A-Za-z_$][\w$]*)", "enum"), (r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=", "variable"), (r"^\s+(?:async\s+|static\s+|public\s+|private\s+)*(?!if|for|while|switch|catch|return|function)([A-Za-z_$][\w$]*)\s*\([^;{}()]*\)\s*(?::[^{;]+)?\{", "method")),
}
DEFINITIONS["javascript"] = DEFINITIONS["typescript"]
IMPORTS = {"rust": r"^\s*use\s+([^;]+);", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$", "java": r"^\s*import\s+(?:static\s+)?([\w.*]+);", "typescript": r"^\s*import\s+(?:.*?from\s+)?[\"']([^\"']+)[\"']"}
IMPORTS["javascript"] = IMPORTS["typescript"]
_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*(?:\.|::))*[A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return match fn func function def class new else do loop in and or not await assert super this self throw sizeof synchronized".split())


def _digest(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()[:16]


def python_candidates(text: str) -> Iterator[tuple]:
    """(candidate_kind, kind, name, target, line, column, end_line, enclosing, body_hash). A syntax error gives nothing."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    raw = text.encode()  # the parser's columns count its bytes
    starts = [0] + [m.end() for m in re.finditer(rb"\r\n|\n|\r", raw)]
    source = lambda n: raw[starts[n.lineno - 1] + n.col_offset : starts[n.end_lineno - 1] + n.end_col_offset]

    def visit(node: ast.AST, around: str | None, in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                yield ("class" if is_class else "method" if in_class else "definition", "class" if is_class else "function", child.name, None, child.lineno, child.col_offset + 1, child.end_lineno, around, _digest(source(child)))
                yield from visit(child, child.name, is_class)
                continue
            if isinstance(child, ast.Import | ast.ImportFrom):
                for a in child.names:
                    name = f"{child.module or ''}.{a.name}" if isinstance(child, ast.ImportFrom) else a.name
                    yield "import", "import", a.asname or a.name, name, child.lineno, child.col_offset + 1, child.end_lineno, around, None
            elif isinstance(child, ast.Call):
                target = ast.unparse(child.func)
                yield "call", "call", re.findall(r"\w+", target)[-1] if re.findall(r"\w+", target) else target, target, child.lineno, child.col_offset + 1, child.end_lineno, around, None
            yield from visit(child, around, in_class and not isinstance(child, ast.Call))

    yield from visit(tree, None, False)


def blanked(text: str) -> str:
    """text with comments and string contents replaced by blanks, line breaks kept."""
    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`[^`]*`", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.DOTALL)


def brace_candidates(text: str, language: str) -> Iterator[tuple]:
    """The same for languages with braces; bodies are found by matching them."""
    code = blanked(text)
    starts = [0] + [m.end() for m in re.finditer("\n", code)]
    import bisect

    at = lambda p: (bisect.bisect_right(starts, p), p - starts[bisect.bisect_right(starts, p) - 1] + 1)

    def body_end(p: int) -> int:
        depth, k = 0, p
        while k < len(code):
            if code[k] == "{":
                depth += 1
            elif code[k] == "}":
                depth -= 1
                if depth == 0:
                    return k + 1
            elif code[k] == ";" and depth == 0:
                return k + 1
            k += 1
        return len(code)

    found, named = [], set()
    for regex, kind in DEFINITIONS.get(language, ()):
        for m in re.finditer(regex, code, re.MULTILINE):
            name, p = m.group(m.lastindex), m.start(m.lastindex)
            if p in named or name in _NOT_CALLS:
                continue
            named.add(p)
            found.append((p, body_end(m.end() - 1 if m.group().endswith("{") else m.end()), name, kind))
    impls = [(m.start(), body_end(m.end())) for m in re.finditer(r"\bimpl\b", code)] if language == "rust" else []
    found.sort()

    def around(p: int, kinds: tuple[str, ...]) -> str | None:
        own = [(a, n) for a, b, n, k in found if a < p < b and k in kinds]
        return max(own)[1] if own else None

    out = []
    callable_kinds = ("function", "method", "constructor")
    for a, b, name, kind in found:
        in_type = around(a, ("class", "interface", "enum", "record")) is not None or any(x < a < y for x, y in impls)
        sort = "method" if kind in ("method", "constructor") or kind == "function" and in_type else "class" if kind == "class" else "type" if kind in ("struct", "enum", "trait", "interface", "record", "annotation") else "definition"
        out.append((a, (sort, kind, name, None, *at(a), at(max(a, b - 1))[0], around(a, callable_kinds + ("class",)), _digest(text[a:b].encode()))))
    if language in IMPORTS:
        for m in re.finditer(IMPORTS[language], text, re.MULTILINE):
            target = m.group(1).strip()
            out.append((m.start(1), ("import", "import", re.findall(r"[\w*$]+", target)[-1] if re.findall(r"[\w*$]+", target) else target, target, *at(m.start(1)), at(m.end(1))[0], None, None)))
    for m in _CALL.finditer(code):
        target = m.group(1)
        last = re.findall(r"[\w$]+", target)[-1]
        if last not in _NOT_CALLS and m.start(1) + len(target) - len(last) not in named:
            out.append((m.start(1), ("call", "call", last, target, *at(m.start(1)), at(m.start(1))[0], around(m.start(1), callable_kinds), None)))
    for _, row in sorted(out, key=lambda x: x[0]):
        yield row


def candidates(files: DataFrame, most: int | None = PER_FILE) -> DataFrame:
    """Candidates of each source file in order of appearance, `most` of a file, or all for None; other languages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, language, text in zip(b["path"], b["language"], b["content"], strict=True):
                if text is None or language not in BLIND_SPOTS:
                    continue
                rows = python_candidates(text) if language == "python" else brace_candidates(text, language)
                for k, row in enumerate(rows):
                    if k == most:
                        break
                    out.append((path, language, *row, k, BLIND_SPOTS[language] + ["budget"] * (most is not None and k == most - 1)))
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in CANDIDATES.split(", ")])

    return files.select("path", "language", F.col("content").cast("string").alias("content")).mapInPandas(run, CANDIDATES)


def symbols(found: DataFrame) -> DataFrame:
    return found.where(~F.col("candidate_kind").isin("call", "import"))


def calls(found: DataFrame) -> DataFrame:
    return found.where("candidate_kind = 'call'")


def call_edges(found: DataFrame) -> DataFrame:
    """Edges of calls whose enclosing function is known."""
    return calls(found).where("enclosing_symbol is not null").select(F.col("enclosing_symbol").alias("caller"), F.col("target").alias("callee"), "path", F.col("line").cast("long"), F.col("column").cast("long"), F.lit("parser").alias("source"))
