"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else are removed, by external induced sorting of the shards that can hold repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, release, shared_dir, stage, text_of, unstage
from .hashing import BASE_BYTE, BYTE_VALUES, merge_runs, mix, prefix, sliding_min, spans, windows
from .records import qualified
from .suffix_sort import repeated_starts

#: Bytes of a string that counts; bytes of the piece of it that stands for it when shards are dealt out.
LENGTH, PIECE = 400, 64
#: Bytes from which a shard is sorted, and bytes of contents that are narrowed at once before; both hold whole anchors.
SHARD, GROUP = 1 << 22, 1 << 20
#: Different contents from which an anchor's shard is split by the bytes around the anchor, and the widths of the classes it is split into, one after the other.
MANY, WIDTHS = 4096, (42, 6, 1)
RUN = "array<struct<start: int, end: int>>"
_NONE = np.iinfo(np.int64).max
_RUN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def segments(texts: list[bytes], length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, anchor, how far the anchor's piece lies behind the first start) of each run of strings that share an anchor.

    A string's anchor is its least piece by hash, the leftmost of equals. Equal strings have equal anchors at the same place, so all that are equal to a
    string start in segments of its anchor: anchors deal the corpus out into shards that no repeat crosses.
    """
    data = np.frombuffer(b"\0".join(texts), np.uint8)
    begins = np.cumsum([0] + [len(x) + 1 for x in texts])
    own = mix(windows(prefix(BYTE_VALUES[data], BASE_BYTE), piece, BASE_BYTE))
    order = own >> np.uint64(32) << np.uint64(32) | np.arange(len(own), dtype=np.uint64)
    least = (sliding_min(order, length - piece + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.arange(len(least))
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))[: len(at)]
    inside = at + length < begins[doc + 1]
    at, doc, least = at[inside], doc[inside], least[inside]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    return doc[first], start - begins[doc[first]], n, own[least[first]].view(np.int64), least[first] - start


def contents(texts: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """128 bits of xxh3 over the bytes of each segment, two numbers each."""
    digest = xxhash.xxh3_128_digest
    found = b"".join(digest(texts[d][a : a + k + length - 1]) for d, a, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True))
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def classes(body: bytes, width: int, length: int, piece: int) -> Iterator[tuple[int, int, bytes]]:
    """(first start, number of starts, key) of the classes of a segment's starts, by how far before the anchor they lie, in steps of `width`. Equal strings lie equally far before
    it, and all strings of a class hold the bytes that make its key."""
    n = len(body) - length + 1
    offset = int(segments([body[:length]], length, piece)[4][0])
    for j in range(max(0, offset - n + 1) // width, offset // width + 1):
        near, far = j * width, (j + 1) * width - 1
        low, high = max(0, offset - far), min(n - 1, offset - near)
        if low <= high:
            yield low, high - low + 1, j.to_bytes(4, "little") + body[max(0, offset - near) : offset - far + length]


def narrowed(seen: dict[tuple, bytes], length: int, piece: int) -> Iterator[tuple[tuple, int, bytes]]:
    """(key, first start, bytes) of the part of each content, keyed (anchor, ...), whose strings may start in another content of its anchor; contents without such a part are left out.

    The starts of a content fall into classes as in classes(). Strings that are equal lie equally far before their anchor, so they are of one class and share the bytes that all strings of the class
    hold: a class whose bytes, by hash, are in no other content of the anchor has no string that repeats. Hashes that collide keep a class that could go, no more.
    """
    bodies = list(seen.values())
    sizes = np.array([len(x) for x in bodies], np.int64)
    offset, n, width = segments([x[:length] for x in bodies], length, piece)[4], sizes - length + 1, (length - piece) // 8 + 1
    first = np.maximum(0, offset - n + 1) // width
    m = offset // width - first + 1
    of = np.repeat(np.arange(len(bodies)), m)
    j = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
    low, high = np.maximum(0, offset[of] - (j + 1) * width + 1), np.minimum(n[of] - 1, offset[of] - j * width)
    at = (np.cumsum(sizes) - sizes + offset)[of] - j * width
    held = spans(prefix(BYTE_VALUES[np.frombuffer(b"".join(bodies), np.uint8)], BASE_BYTE), at, at + length - width + 1, BASE_BYTE)
    anchor = np.array([k[0] for k in seen], np.int64).view(np.uint64)[of]
    _, place, count = np.unique(mix(held ^ mix(anchor + j.astype(np.uint64))), return_inverse=True, return_counts=True)
    live = count[place] > 1
    begin, end = np.full(len(bodies), _NONE), np.zeros(len(bodies), np.int64)
    np.minimum.at(begin, of[live], low[live])
    np.maximum.at(end, of[live], high[live] + length)
    for key, body, a, b in zip(seen, bodies, begin.tolist(), end.tolist(), strict=True):
        if a < b:
            yield key, a, body[a:b]


def sorted_runs(bodies: DataFrame, length: int, piece: int, folder: str) -> DataFrame:
    """(anchor, one, two, runs): of each content of each anchor the runs of starts whose strings start elsewhere in the anchor's contents too, if there are any. A task takes its anchors in order,
    narrows their contents to what may repeat, and suffix-sorts a shard of whole anchors at a time."""

    def sort_one(parts: list[tuple[tuple, int, bytes]]) -> Iterator[pa.RecordBatch]:
        keys, out = [], []
        for (key, low, _), starts in zip(parts, repeated_starts([x for *_, x in parts], length, folder), strict=True):
            if len(starts):
                a, b = merge_runs(starts + low, starts + low + 1)
                keys.append(key)
                out.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        for k in range(0, len(keys), 4096):
            columns = [pa.array(x, pa.int64()) for x in zip(*keys[k : k + 4096], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[k : k + 4096], _RUN)], names=["anchor", "one", "two", "runs"])

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, bytes] = {}
        parts: list[tuple[tuple, int, bytes]] = []
        size, now = 0, None
        for batch in batches:
            for part, raw in byte_chunks(batch, column="body"):
                for *key, body in zip(*(part.column(c).to_pylist() for c in ("anchor", "one", "two")), raw, strict=True):
                    if key[0] != now and size >= GROUP:
                        parts += narrowed(seen, length, piece)
                        seen, size = {}, 0
                        if sum(len(x) for *_, x in parts) >= SHARD:
                            yield from sort_one(parts)
                            parts = []
                    now = key[0]
                    if tuple(key) not in seen:
                        seen[tuple(key)] = body
                        size += len(body)
        if seen:
            parts += narrowed(seen, length, piece)
        yield from sort_one(parts)
        release()

    return bodies.select("anchor", "one", "two", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort_shards, f"anchor long, one long, two long, runs {RUN}")


def split_runs(bodies: DataFrame, length: int, piece: int, folder: str, widths: tuple[int, ...]) -> DataFrame:
    """The same for anchors with very many contents. Their starts are dealt out again by classes, so contents that differ only far from a start meet as one; equal contents of a class are
    counted, and a class with many contents is split further. Classes of one start are their strings themselves, so counting ends it."""
    width, ids = widths[0], ["anchor", "one", "two"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in byte_chunks(batch, column="body"):
                for row, body in zip(range(len(raw)), raw, strict=True):
                    low, n, key = zip(*classes(body, width, length, piece), strict=True)
                    m = len(low)
                    anchor = part.column("anchor")[row].as_py()
                    of = np.frombuffer(b"".join(xxhash.xxh3_64_digest(k, anchor & (1 << 64) - 1) for k in key), "<i8")
                    own = contents([body] * m, np.arange(m), np.array(low), np.array(n), length)
                    again = [pa.array([part.column(c)[row].as_py()] * m, pa.int64()) for c in ids]
                    bodies = [body[a : a + k + length - 1] for a, k in zip(low, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([*again, pa.array(low, pa.int32()), pa.array(n, pa.int32()), pa.array(of), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(bodies, pa.binary())], names=["a", "b", "c", "low", "n", *ids, "body"])

    parts = stage(bodies.mapInArrow(cut, "a long, b long, c long, low int, n int, anchor long, one long, two long, body binary"), "suffix-classes")
    kinds = stage(parts.groupBy(*ids).agg(F.count("*").alias("copies"), F.first("n").alias("n")), "suffix-class-kinds")
    runs = runs_of(kinds, parts.select(*ids, "body"), length, piece, folder, widths[1:])
    found = parts.join(runs, ids).select(F.col("a").alias("anchor"), F.col("b").alias("one"), F.col("c").alias("two"), F.transform("runs", lambda r: F.struct((r["start"] + F.col("low")).alias("start"), (r["end"] + F.col("low")).alias("end"))).alias("runs"))
    return found.groupBy(*ids).agg(F.flatten(F.collect_list("runs")).alias("runs"))  # a segment's classes: 336 at most


def runs_of(kinds: DataFrame, bodies: DataFrame, length: int, piece: int, folder: str, widths: tuple[int, ...]) -> DataFrame:
    """(anchor, one, two, runs) for kinds (anchor, one, two, copies, n): contents that occur twice repeat throughout; the others are looked for in their anchor's other contents, by sorting, or
    first split where there are many. bodies holds the bytes of each content at least once, and is read more than once."""
    ids = ["anchor", "one", "two"]
    per = stage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-mixed")
    whole = kinds.where("copies > 1").select(*ids, F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))).alias("runs"))
    if per.isEmpty():
        return whole
    hot = F.col("kinds") > MANY if widths else F.lit(False)
    mixed = bodies.join(per.hint("merge"), "anchor")
    found = sorted_runs(mixed.where(~hot), length, piece, folder)
    if widths and not per.where(hot).isEmpty():
        once = mixed.where(hot).groupBy(*ids).agg(F.first("body").alias("body"))
        found = found.unionByName(split_runs(once, length, piece, folder, widths))
    return whole.unionByName(stage(found, "suffix-runs").join(kinds.where("copies = 1").select(*ids).hint("merge"), ids, "left_semi"))


def dedup(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, *, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (maximal removed runs of UTF-8 bytes, end exclusive), kept_sha256, and kept (binary) if with_text.

    A byte goes if it lies in a string of `length` bytes that also starts anywhere else, in its own text included; strings never cross texts and are those of the input.
    So all copies go, the first too. Null text has no bytes. Repeated rows, also under one id or a null id, are texts of their own, and go. An empty table gives an empty result.

    Shards hold the segments of the anchors that occur twice. Equal segments (128 bits over their bytes) are counted first: all their strings repeat, and one of them stands for all.
    Where an anchor has different segments, those are narrowed to what may repeat and suffix-sorted by external induction, and strings repeat where common prefixes reach `length` bytes; queues go to the shared
    folder once they outgrow memory. An anchor with more than MANY contents is split by the bytes around it first. Sides of joins that grow with the corpus are merged at every size, so hot
    anchors are split by the adaptive join and a small run costs in proportion to a large one.
    """
    folder = f"{qualified(docs.sparkSession, shared_dir(docs.sparkSession))}/suffix-queues"
    rows = text_of(docs).withColumn("row_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("tag", F.xxhash64("text"))
    texts = rows.repartition("row_id")

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in byte_chunks(batch):
                found, n = np.unique(segments(raw, length, piece)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["anchor", "n"])

    def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in byte_chunks(batch):
                doc, start, n, anchor, _ = segments(raw, length, piece)
                own, of = contents(raw, doc, start, n, length), pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id").take(of), part.column("tag").take(of), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(anchor, pa.int64()), pa.array(own[:, 0]), pa.array(own[:, 1])],
                    names=["row_id", "tag", "start", "n", "anchor", "one", "two"],
                )

    ids = ["anchor", "one", "two"]
    counted = rows.select("text").mapInArrow(anchor_rows, "anchor long, n long")
    twice = stage(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "suffix-anchors")
    every = rows.select("row_id", "tag", "text").mapInArrow(segment_rows, "row_id long, tag long, start long, n int, anchor long, one long, two long")
    shared = stage(every.join(twice.hint("merge"), "anchor"), "suffix-segments")
    kinds = stage(shared.groupBy(*ids).agg(F.count("*").alias("copies"), F.min(F.struct("row_id", "tag", "start", "n")).alias("at")).select(*ids, "copies", "at", F.col("at.n").alias("n")), "suffix-kinds")

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in byte_chunks(batch):
                out: list[tuple] = []
                for text, wanted in zip(raw, part.column("wanted").to_pylist(), strict=True):
                    out += [(w["anchor"], w["one"], w["two"], text[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
                *keys, found = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(found, pa.binary())], names=[*ids, "body"])

    several = kinds.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor")
    places = kinds.join(several.hint("merge"), "anchor").groupBy(F.col("at.row_id").alias("r"), F.col("at.tag").alias("t")).agg(F.collect_list(F.struct(*ids, "at.start", "at.n")).alias("wanted"))  # as long as the text at most
    # Rows that are equal throughout have one body, so a table with repeated rows may give a body several times; one is kept.
    cut = texts.join(places.hint("shuffle_hash"), (F.col("row_id") == F.col("r")) & (F.col("tag") == F.col("t"))).select("text", "wanted").mapInArrow(cut_rows, "anchor long, one long, two long, body binary")
    bodies = stage(cut, "suffix-bodies")  # else an anchor that is split would have the texts dealt out again
    verdict = stage(runs_of(kinds.drop("at"), bodies, length, piece, folder, WIDTHS), "suffix-verdict")
    for done in (twice, kinds, bodies):
        unstage(done)
    hits = shared.join(verdict.hint("merge"), ids)
    gone = hits.groupBy(F.col("row_id").alias("r"), F.col("tag").alias("t")).agg(F.collect_list(F.struct("start", "runs")).alias("gone"))

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in byte_chunks(batch):
                sizes, lost_n, spans_n, digests, left_n = [], [], [], [], []
                for text, lost in zip(raw, part.column("gone").to_pylist(), strict=True):
                    a = np.array([x["start"] + r["start"] for x in lost or () for r in x["runs"]], np.int64)
                    b = np.array([x["start"] + r["end"] - 1 + length for x in lost or () for r in x["runs"]], np.int64)
                    a, b = merge_runs(a, b)
                    at, left = 0, []
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        left.append(text[at:x])
                        at = y
                    left = b"".join([*left, text[at:]]) if len(a) else text
                    sizes.append(len(text))
                    lost_n.append(len(text) - len(left))
                    spans_n.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    digests.append(hashlib.sha256(left).hexdigest())
                    left_n.append(left)
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lost_n, pa.int64()), pa.array([len(x) for x in spans_n], pa.int64()), pa.array(spans_n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digests, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(left_n, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string" + ", kept binary" * with_text
    return texts.join(gone.hint("shuffle_hash"), (F.col("row_id") == F.col("r")) & (F.col("tag") == F.col("t")), "left").select("doc_id", "text", "gone").mapInArrow(kept_rows, out)
