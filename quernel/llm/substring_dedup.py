"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into maximal removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, text_of
from .hashing import BASE_WINDOW, merge_runs, mix, prefix, sliding_min, windows, word_identities, word_windows, words_in

#: Words in a window; words in the piece of a window that stands for it in the first count.
WINDOW, PIECE = 13, 5


class Chunk:
    """Words of several texts at once. word_doc is each word's text, window_doc each window's; a window lies in one text."""

    def __init__(self, texts: list[bytes], size: int):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        begins = np.cumsum([0] + [len(x) + 1 for x in texts])
        starts, ends = words_in(data)
        self.size, self.words = size, word_identities(data, starts, ends)
        self.first = np.searchsorted(starts, begins)  # of each text its first word; one more for the end
        self.n_words = np.diff(self.first)
        at = np.arange(max(0, len(starts) - size + 1))
        doc = np.repeat(np.arange(len(texts)), self.n_words)[: len(at)]
        inside = at + size <= self.first[doc + 1]
        self.at, self.doc = at[inside], doc[inside]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each window: two Rabin-Karp hashes over independent halves of its words' identities."""
        one, two = word_windows(self.words, self.size)
        return one[self.at].view(np.int64), two[self.at].view(np.int64)

    def anchors(self, piece: int) -> np.ndarray:
        """For each window the hash of its least piece, the leftmost of equals. Equal windows have equal pieces, so a window can only
        repeat where its anchor does; neighbouring windows mostly share theirs."""
        own = mix(windows(prefix(self.words[0], BASE_WINDOW), piece, BASE_WINDOW))
        order = own >> np.uint64(32) << np.uint64(32) | np.arange(len(own), dtype=np.uint64)
        least = sliding_min(order, self.size - piece + 1) & np.uint64(0xFFFFFFFF)
        return own[least[self.at].astype(np.int64)].view(np.int64)


def _distinct(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places that hold each (doc, value) once; doc is sorted."""
    if not len(doc):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))
    at = at[np.lexsort((value[at], doc[at]))]
    first = np.concatenate([[True], (value[at[1:]] != value[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])])
    return at[first]


def _rows(ids: pa.Array, doc: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *(pa.array(v, pa.int64()) for v in values.values())], names=["doc_id", *values])


def repeated_in_smaller(pairs: DataFrame, *key: str) -> DataFrame:
    """Rows of (doc_id, key) whose key also has another doc_id, and in `loses` whether that is a smaller one. One exchange by key serves the count and the join."""
    dealt = pairs.where(" and ".join(f"{k} is not null" for k in ("doc_id", *key))).repartition(*key)
    seen = dealt.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    return dealt.join(seen, list(key)).select("doc_id", *key, (F.col("doc_id") > F.col("low")).alias("loses"))


def dedup(docs: DataFrame, size: int = WINDOW, piece: int = PIECE, *, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal removed runs of words, end exclusive), kept_sha256, and kept (the remaining words, one space between) if with_text.

    A word goes if it lies in a window of `size` words whose sequence also starts in a document with a smaller doc_id; windows are those of the input.
    Null text has no words. Rows with the same id don't count as each other's smaller document; each loses what the smaller ids hold. A null id
    takes no part: its row keeps all words. An empty table gives an empty result.
    Windows are equal if 128 bits over their words' identities are; words of up to 15 bytes are told apart exactly, longer ones by 128 bits of xxh3.
    First each document's distinct anchors are counted, an eighth or so of its windows; only windows whose anchor is in several documents are hashed whole and counted.
    """
    texts = text_of(docs).withColumn("row_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).repartition("row_id")  # one exchange for both joins: no null, no filter of its own
    known = text_of(docs).where("doc_id is not null")

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in byte_chunks(batch):
                c = Chunk(raw, size)
                own = c.anchors(piece)
                once = _distinct(c.doc, own)
                yield _rows(part.column("doc_id"), c.doc[once], anchor=own[once])

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in byte_chunks(batch):
                c = Chunk(raw, size)
                wanted = part.column("anchors")
                here = np.zeros(len(c.at), bool)
                own = c.anchors(piece)
                for k in range(len(raw)):
                    a, b = np.searchsorted(c.doc, [k, k + 1])
                    here[a:b] = np.isin(own[a:b], wanted[k].values.to_numpy(zero_copy_only=False))
                if here.any():
                    doc, (one, two) = c.doc[here], (x[here] for x in c.hashes())
                    once = _distinct(doc, one)
                    yield _rows(part.column("doc_id"), doc[once], one=one[once], two=two[once])

    anchors = repeated_in_smaller(known.mapInArrow(anchor_rows, "doc_id long, anchor long"), "anchor")
    wanted = anchors.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))  # as long as its document at most
    found = texts.join(wanted.withColumnRenamed("doc_id", "d").hint("shuffle_hash"), F.col("row_id") == F.col("d")).select("doc_id", "text", "anchors").mapInArrow(window_rows, "doc_id long, one long, two long")
    gone = repeated_in_smaller(found, "one", "two").where("loses").groupBy("doc_id").agg(F.collect_list("one").alias("gone"))  # a document's own windows: half of the bits tell them apart

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in byte_chunks(batch):
                rows = []
                for text, lost in zip(raw, part.column("gone"), strict=True):
                    words = text.split()
                    spans: list[dict] = []
                    if lost.is_valid:
                        c = Chunk([text], size)
                        at = c.at[np.isin(c.hashes()[0], lost.values.to_numpy(zero_copy_only=False))]
                        a, b = merge_runs(at, at + size)
                        stay = np.ones(len(words), bool)
                        for x, y in zip(a.tolist(), b.tolist(), strict=True):
                            stay[x:y] = False
                            spans.append({"start": x, "end": y})
                        left = b" ".join(compress(words, stay.tolist()))
                        rows.append((len(words), int(len(words) - stay.sum()), spans, hashlib.sha256(left).hexdigest(), left))
                    else:
                        left = b" ".join(words)
                        rows.append((len(words), 0, spans, hashlib.sha256(left).hexdigest(), left))
                n, lost_n, spans_n, digests, left_n = zip(*rows, strict=True) if rows else ((),) * 5
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost_n, pa.int64()), pa.array(spans_n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(left_n, pa.binary()).cast(pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string" + ", kept string" * with_text
    return texts.join(gone.withColumnRenamed("doc_id", "d").hint("shuffle_hash"), F.col("row_id") == F.col("d"), "left").select("doc_id", "text", "gone").mapInArrow(kept_rows, out)
