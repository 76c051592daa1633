"""Columns over contents and paths: languages, lines, offsets, positions, previews, secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import prefix_sums

#: Extension (case-sensitive) to language; any other is text.
LANGUAGES = {
    "go": "go", "rs": "rust", "py": "python", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "md": "markdown", "markdown": "markdown", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "html": "html", "htm": "html", "css": "css",
}
#: Directories that hold generated files, and those that are never read.
GENERATED = ("target", "node_modules", "dist", ".next")
NEVER = (".git", ".quernel")
#: Terms that mark a key or value as secret.
SECRET_TERMS = ("secret", "token", "password", "passwd", "api_key", "apikey", "private_key", "privatekey", "client_secret", "access_key", "auth_key", "credential")
#: What stands for a masked value; characters of a preview.
MASK, PREVIEW = "***", 160
BINARY_PREFIX = 8192


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language_of(path: Column) -> Column:
    by_ext = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(by_ext, extension(path)), F.lit("text"))


def top_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def depth(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("long")


def skipped_dir(path: Column, no_ignore: bool = False) -> Column:
    names = NEVER if no_ignore else NEVER + GENERATED
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in names)))


def is_binary(content: Column, prefix: int | None = BINARY_PREFIX) -> Column:
    """A zero byte among the first `prefix` bytes of binary content, or anywhere for None."""
    return F.position(F.lit(b"\x00"), content if prefix is None else F.substring(content, 1, prefix)) > 0


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_offsets(text: Column) -> Column:
    """Byte offset of each line's start; a last line break starts no line."""
    own = F.when(text.endswith("\n"), F.slice(lines(text), 1, F.size(lines(text)) - 1)).otherwise(lines(text))
    return F.when(F.length(text) > 0, prefix_sums(F.transform(own, lambda x: F.octet_length(x) + 1))).otherwise(F.array().cast("array<bigint>"))


def trigrams(text: Column) -> Column:
    """Sorted distinct windows of three bytes of the lower-cased text, as hex: a superset filter for literals in any case."""
    raw = F.lower(F.hex(F.encode(F.lower(text), "UTF-8")))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit("(?=(.{6})).."), 1)))  # one pass: a look ahead of three bytes at each byte


def query_trigrams(pattern: str) -> list[str]:
    """Trigrams that every file with the literal has; none if it has less than three bytes."""
    raw = pattern.lower().encode()
    return sorted({raw[k : k + 3].hex() for k in range(len(raw) - 2)})


#: Parts that a stored index of trigrams is dealt into, so that a search reads a few of them.
GRAM_PARTS = 64


def gram_part(gram: str) -> int:
    return int(gram, 16) * 40503 % 65536 % GRAM_PARTS


def gram_part_col(gram: Column) -> Column:
    return (F.conv(gram, 16, 10).cast("long") * 40503 % 65536 % GRAM_PARTS).cast("int")


def clip(line: Column, most: int) -> Column:
    right = F.regexp_replace(line, r"\s+$", "")
    return F.when(F.length(right) > most, F.concat(F.substring(right, 1, most), F.lit("..."))).otherwise(right)


def is_secret(value: Column) -> Column:
    """A secret term in the lower-cased value, or, both without anything but letters and digits, in that."""
    low, bare = F.lower(value), F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    return any_of([low.contains(t) | bare.contains(t.replace("_", "")) for t in SECRET_TERMS])


def any_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def masked_preview(context: Column, value: Column, most: int = PREVIEW) -> Column:
    """The mask if the context or the value is secret-like, else the value without blanks and quotes around it, cut to `most` characters with ... after them."""
    bare = F.regexp_replace(F.trim(value), "^\"+|\"+$", "")
    bare = F.regexp_replace(bare, "^'+|'+$", "")
    cut = F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("..."))).otherwise(bare)
    return F.when(is_secret(context) | is_secret(value), F.lit(MASK)).otherwise(cut)


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf16_to_chars(line: Column, units: Column) -> Column:
    """Code points before an offset in UTF-16 units; null if the offset splits a pair or lies outside the line."""
    return _to_chars(line, units, lambda c: F.when(F.octet_length(c) > 3, 2).otherwise(1))


def bytes_to_chars(line: Column, at: Column) -> Column:
    """Code points before an offset in UTF-8 bytes; null if the offset is no boundary or lies outside the line."""
    return _to_chars(line, at, F.octet_length)


def _to_chars(line: Column, at: Column, width) -> Column:
    """The place of `at` among the offsets at which characters start, or the line ends."""
    ends = prefix_sums(F.transform(F.concat(F.filter(F.split(line, ""), lambda c: c != ""), F.array(F.lit("x"))), lambda c: width(c).cast("int")))
    found = F.array_position(ends, at.cast("long"))
    return F.when(found > 0, found - 1)


def slug(message: Column) -> Column:
    """Lower-cased letters and digits with one underscore for what lies between."""
    return F.regexp_replace(F.regexp_replace(F.lower(message), "[^a-z0-9]+", "_"), "^_+|_+$", "")
