"""Document fingerprints: a homomorphic multiset hash of paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Lanes of the hash, each modulo 2^64; counters that estimate likeness, shown modulo 2^32; slots that they project.
LANES, COUNTERS, SLOTS = 16, 96, 4096
#: Documents to a range in the pass that finds each document's successor, ranges at most, and ids that are drawn for each range to place its bounds.
PER_RANGE, RANGES, DRAWN = 1000, 100_000, 20

_signs: np.ndarray | None = None


def _projection() -> np.ndarray:
    """COUNTERS columns of +1 and -1 over the slots."""
    global _signs
    if _signs is None:
        _signs = (np.random.Generator(np.random.PCG64(8)).integers(0, 2, (SLOTS, COUNTERS), dtype=np.int8) * 2 - 1).astype(np.float64)
    return _signs


def state(text: str) -> np.ndarray:
    """The sum of the vectors of a text's paragraphs, modulo 2^64: equal for equal multisets of paragraphs in any order.

    A paragraph's vector is LANES numbers of its SHAKE-256, then COUNTERS sums of signs over its pieces of four bytes, none of which crosses a line break. Both parts are sums over
    paragraphs, so insert() and delete() keep a whole fingerprint up to date.
    """
    raw = text.encode("utf-8", "surrogatepass")
    total = np.zeros(LANES, np.uint64)
    for p in raw.split(b"\n"):
        total += np.frombuffer(hashlib.shake_256(p).digest(8 * LANES), "<u8")
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.concatenate([total, np.zeros(COUNTERS, np.uint64)])
    grams = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    breaks = np.cumsum(data == 10)
    whole = (breaks[3:] == breaks[:-3]) & (data[:-3] != 10)
    counts = np.bincount((grams[whole] * np.uint32(2654435761)) >> np.uint32(20), minlength=SLOTS)
    return np.concatenate([total, (counts @ _projection()).astype(np.int64).view(np.uint64)])


def insert(own: np.ndarray, paragraph: str) -> np.ndarray:
    return own + state(paragraph)


def delete(own: np.ndarray, paragraph: str) -> np.ndarray:
    return own - state(paragraph)


def digest(own: np.ndarray) -> str:
    """A state as hex: the lanes, then the counters."""
    return own[:LANES].astype("<u8").tobytes().hex() + own[LANES:].astype("<u4").tobytes().hex()


def fingerprint(text: str) -> str:
    """Equal texts have equal fingerprints; so have texts of the same paragraphs in another order."""
    return digest(state(text))


def near(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two states, 0 to 1: 1 for equal multisets, else the cosine of the counters, below 1."""
    if (a[:LANES] == b[:LANES]).all():
        return 1.0
    x, y = (v[LANES:].astype("<u4").view("<i4").astype(np.float64) for v in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / size, 0.0, np.nextafter(1.0, 0.0))) if size else 0.0


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return near(*(np.concatenate([np.frombuffer(bytes.fromhex(x[: 16 * LANES]), "<u8"), np.frombuffer(bytes.fromhex(x[16 * LANES :]), "<u4").astype(np.uint64)]) for x in (a, b)))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, follow: each document and the text of the next by ascending doc_id (null first, ties by text); after the last comes the first.

    Rows are dealt out by id ranges of about PER_RANGE documents, RANGES at most, whose bounds are quantiles of a bounded draw of ids, so a few ids far from the others change nothing. A
    range's rows give all successors but its last row's, which is the first row of the next range that has any. Which range that is, a table of one number for each range tells; the texts
    of first rows are joined, never gathered. Rows that share an id lie in one range.
    """
    slim = text_of(docs)
    n = slim.count()
    ranges = min(RANGES, -(-n // PER_RANGE))
    drawn = slim.where("doc_id is not null").select("doc_id").sample(min(1.0, DRAWN * ranges / max(n, 1)), 1) if ranges > 1 else None
    bounds = np.sort([r[0] for r in drawn.collect()]) if drawn is not None else np.zeros(0, np.int64)  # DRAWN x RANGES ids at most, or about so
    bounds = np.unique(bounds[:: max(1, len(bounds) // max(ranges, 1))])

    @F.arrow_udf("long")
    def place(ids: pa.Array) -> pa.Array:
        own = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, np.searchsorted(bounds, own, "right")), pa.int64())

    ranged = slim.withColumn("range", place(F.col("doc_id")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    inside = Window.partitionBy("range").orderBy(*order)
    rows = ranged.withColumn("follow", F.lead("text").over(inside))
    across = Window.orderBy("range")
    after = slim.select(place(F.col("doc_id")).alias("range")).distinct()
    after = after.withColumn("next_range", F.coalesce(F.lead("range").over(across), F.min("range").over(Window.partitionBy())))
    heads = ranged.groupBy("range").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "text")).alias("head"))
    firsts = after.join(heads.select(F.col("range").alias("next_range"), F.col("head")["text"].alias("after")), "next_range")
    return rows.join(firsts.select("range", "after"), "range").select("doc_id", "text", F.coalesce("follow", "after").alias("follow"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    Null text is empty; the fingerprint of no text is that of one empty paragraph. Repeated rows are documents of their own. A null id
    comes first; ids may lie anywhere in the range of 64 bits. One document is its own successor. An empty table gives an empty result.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                out = []
                part = batch.slice(k, 128)
                for doc, text, follow in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "follow")), strict=True):
                    new = edited(text, follow)
                    own = kept[text] if text in kept else state(text)
                    then = own if follow == text else state(follow)
                    kept = {text: own, follow: then}
                    of_new = state(new)
                    out.append((doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), digest(own), digest(of_new), near(own, of_new), near(own, then)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return with_next(docs).select("doc_id", "text", "follow").mapInArrow(run, RESULT)
