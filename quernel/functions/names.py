"""Names: variants of an identifier as users type it, style keys, symbol names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Variants of one input, at most.
MOST_VARIANTS = 16


def style_key(value: str) -> str:
    """camelCase, kebab-case and the like as snake_case: a word ends where an ASCII capital follows a lower-case letter or digit, and at anything but ASCII letters and digits."""
    return re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", value)).strip("_").lower()


def style_key_col(value: Column) -> Column:
    x = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def without_signature(value: str) -> str:
    return value.split("(", 1)[0].strip() if "(" in value else value


def qualified_tail(value: str) -> str:
    """After the last of . : # $."""
    return re.split(r"[.:#$]", value.strip())[-1].strip()


def last_identifier(value: str) -> str:
    found = re.findall(r"[A-Za-z0-9_]+", value)
    return found[-1] if found else value


def last_identifier_col(value: Column) -> Column:
    found = F.regexp_extract(value, r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)
    return F.when(found == "", value).otherwise(found)


def method_base_col(value: Column) -> Column:
    """The last identifier before a signature."""
    return last_identifier_col(F.split_part(value, F.lit("("), F.lit(1)))


def variants(text: str) -> list[tuple[str, str]]:
    """(value, kind) in the order in which they are tried, each pair once: as typed, trimmed, without signature, tail, tail without signature, style keys, folded."""
    trimmed = text.strip()
    base, tail = without_signature(trimmed), qualified_tail(trimmed)
    sources = (trimmed, base, tail, without_signature(tail))
    every = [(text, "raw"), (trimmed, "trimmed"), (base, "signature_base"), (tail, "qualified_tail"), (sources[3], "signature_tail")]
    every += [(style_key(v), "style_key") for v in sources] + [(v.lower(), "case_fold") for v in sources]
    return list(dict.fromkeys(v for v in every if v[0]))[:MOST_VARIANTS]


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    """text as a SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: SQL of the last identifier of a name, and of the one before its signature.
LAST_SQL = "coalesce(nullif(regexp_extract({0}, '([A-Za-z0-9_]+)[^A-Za-z0-9_]*$', 1), ''), {0})"
BASE_SQL = LAST_SQL.format("split_part({0}, '(', 1)")
STYLE_SQL = "lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '$1_$2'), '[^A-Za-z0-9]+', '_'), '^_+|_+$', ''))"


def variant_sql(name: str, text: str, *, contains: bool = False, case_sensitive: bool = False) -> str:
    """SQL for the first variant of text that a name, itself SQL, matches, as a struct (ordinal, value, kind), or null. The name and its folded forms are computed once."""
    fold = str.maketrans(ASCII_UPPER, ASCII_LOWER)
    cases = []
    for k, (value, kind) in enumerate(variants(text)):
        if kind == "case_fold" and case_sensitive:
            continue
        form, wanted = ("s", value) if kind == "style_key" else ("l", value) if kind == "case_fold" else ("n", value) if case_sensitive else ("l", value.lower()) if contains else ("a", value.translate(fold))
        hit = f"contains(b.{form}, {quoted(wanted)})" if contains else f"b.{form} = {quoted(wanted)}"
        cases.append(f"when {hit} then named_struct('ordinal', {k}, 'value', {quoted(value)}, 'kind', '{kind}')")
    if not cases:
        return "cast(null as struct<ordinal: int, value: string, kind: string>)"
    forms = f"named_struct('n', {name}, 'a', translate({name}, '{ASCII_UPPER}', '{ASCII_LOWER}'), 'l', lower({name}), 's', {STYLE_SQL.format(name)})"
    return f"transform(array({forms}), b -> case {' '.join(cases)} end)[0]"


def match_variant(name: str, text: str, *, contains: bool = False, case_sensitive: bool = False) -> Column:
    """The first variant of text that a name (a column, or SQL) matches, as a struct (ordinal, value, kind), or null. Exact matches fold ASCII case only, others all case; folded variants
    only count where case doesn't."""
    return F.expr(variant_sql(name, text, contains=contains, case_sensitive=case_sensitive))


def needs_expansion(text: str) -> bool:
    """Whether an empty precise answer may fall back to the parser's: the input has blanks around it, a signature, a qualifier, an underscore or a dash."""
    trimmed = text.strip()
    return trimmed != text or without_signature(trimmed) != trimmed or qualified_tail(trimmed) != trimmed or "_" in trimmed or "-" in trimmed


def like_method(identifier: str) -> str | None:
    """A LIKE pattern, escaped by a backslash, for a method's name with any signature."""
    return None if "(" in identifier else re.sub(r"([\\%_])", r"\\\1", identifier) + "(%"


def symbol_key(path: Column, symbol: Column) -> Column:
    return F.when(symbol.startswith("local "), F.concat(path, F.lit("::"), symbol)).otherwise(symbol)


def display_name(symbol: Column) -> Column:
    """The last non-empty part of a symbol between / # . and blanks, without a trailing ()."""
    parts = F.filter(F.split(F.regexp_replace(symbol, r"(\(\))?\.?$", ""), r"[/#.\s]+"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), symbol)


@dataclass(frozen=True)
class Descriptor:
    """One part of a precise symbol. kind: namespace, type, term, method, parameter."""

    name: str
    kind: str
    disambiguator: str = ""


#: What closes a descriptor of each kind.
SUFFIX = {"namespace": "/", "type": "#", "term": ".", "parameter": ")"}


def scip_symbol(scheme: str, manager: str, package: str, version: str, descriptors: list[Descriptor]) -> str:
    """The text of a global symbol; names that aren't plain go in backticks, blanks in package parts are doubled."""
    if not scheme or not descriptors:
        raise ValueError("a symbol needs a scheme and a descriptor")
    plain = lambda n: n if re.fullmatch(r"[A-Za-z0-9_+$-]+", n) else "`" + n.replace("`", "``") + "`"
    parts = []
    for d in descriptors:
        if not d.name:
            raise ValueError("a descriptor needs a name")
        if d.kind == "method":
            parts.append(f"{plain(d.name)}({d.disambiguator}).")
        elif d.kind == "parameter":
            parts.append(f"({plain(d.name)})")
        elif d.kind in SUFFIX:
            parts.append(plain(d.name) + SUFFIX[d.kind])
        else:
            raise ValueError(f"unknown descriptor kind {d.kind}")
    return " ".join(x.replace(" ", "  ") or "." for x in (scheme, manager, package, version)) + " " + "".join(parts)


def upsert_symbols(symbols: DataFrame) -> DataFrame:
    """One row for each symbol_key: the first name, kind and language in order of seq that isn't empty or a default."""
    first = lambda c, default: F.min_by(F.col(c), F.struct((F.coalesce(F.col(c), F.lit("")).isin("", default)).alias("d"), F.col("seq")))
    return symbols.groupBy("symbol_key").agg(first("name", "").alias("name"), first("kind", "symbol").alias("kind"), first("language", "text").alias("language"))
