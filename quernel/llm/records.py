"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads."""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PieceCache
from .common import byte_chunks, resident, shared_dir, stage, text_of

#: Fixed values of the frame: length (8 bytes) and its masked checksum (4), the ids, their masked checksum (4); little-endian.
HEAD, TAIL, MASK = struct.Struct("<QI"), struct.Struct("<I"), 0xA282EAD8
#: A file ends at so many bytes, a block (a row of the index, read at once) at so many bytes or records.
FILE, BLOCK, BLOCK_ROWS = 256 << 20, 4 << 20, 1024
#: Pieces of text whose ids a worker keeps during a task. A task of 16 MB of prose has 400,000; with less than twice that many, pieces go and are encoded again.
PIECES = 1_000_000
#: The pre-tokeniser whose cuts PLAIN knows: it takes a space and letters as one, and a sign or a lone line break beside letters for itself. The letters are such in all versions of Unicode.
BYTE_LEVEL, _LETTERS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "[A-Za-zÀ-ÖØ-öø-ƺ]+"
PLAIN = re.compile(f" {_LETTERS}[.,;:!?]?(?:\n{_LETTERS}[.,;:!?]?)*")
#: The characters that byte-level vocabularies write for the 256 bytes; a character that isn't among them marks the cuts.
_SEEN, CUT = [*range(33, 127), *range(161, 173), *range(174, 256)], "\1"
_UNSEEN = [x for x in range(256) if x not in _SEEN]
BYTE_CHARS = "".join(chr(b if b in _SEEN else 256 + _UNSEEN.index(b)) for b in range(256))


def masked(data: bytes) -> int:
    """CRC-32 rotated by 15 bits plus a constant, so that a checksum of data that holds checksums isn't trivial."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(ids: np.ndarray) -> bytes:
    """One record. The first byte of its payload tells the width of an id, 2 or 4 bytes."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = bytes([width]) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(size)) + payload + TAIL.pack(masked(payload))


def unframe(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(ids, where the next record starts); a checksum that differs is an error."""
    n, crc = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise ValueError(f"bad length at {at}")
    payload = data[at + HEAD.size : at + HEAD.size + n]
    end = at + HEAD.size + n
    if len(payload) != n or masked(payload) != TAIL.unpack_from(data, end)[0]:
        raise ValueError(f"bad record at {at}")
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype(np.uint32), end + TAIL.size


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that any executor can write to, and the path in it; the folder's URI names the store."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with its scheme; one without lies in Spark's default file system, not on an executor's own disk."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


class LibraryEncoder:
    """The tokenizers library, as a tokenizer's file sets it up, behind a cache of pieces. A text that holds a string of an added token is encoded whole by the library,
    which looks for such strings in whole texts before it cuts them. Plain pieces are cut into pre-tokens by rule, so the library gets them as its vocabulary writes them, without its pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.words = Tokenizer.from_file(path), None
        rule = self.library.pre_tokenizer and json.loads(self.library.pre_tokenizer.__getstate__())
        if rule and BYTE_LEVEL.items() <= rule.items() and self.library.normalizer is None:
            self.words = Tokenizer.from_file(path)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(CUT, "removed"), pre_tokenizers.Split(BYTE_CHARS[32], "merged_with_next")])
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        spaced = np.zeros(len(sizes), bool)
        for token, k in self.library.get_vocab(with_added_tokens=False).items():
            sizes[k] = len(token)  # the byte-level alphabet has a character for each byte
            spaced[k] = token[0] == BYTE_CHARS[32]
        self.sizes, self.spaced = sizes, spaced
        self.pieces = PieceCache(self._starts, self._pieces, PIECES)

    def _starts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """Ids of plain pieces; each has one space, its first character, so it begins with the token that does."""
        marked = []
        for text in self._joined(pieces):
            x = codecs.charmap_decode(text.encode(), "strict", BYTE_CHARS)[0].replace(BYTE_CHARS[10], CUT + BYTE_CHARS[10] + CUT)
            for sign in ".,;:!?":
                x = x.replace(sign, CUT + sign)
            marked.append(x)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in self.words.encode_batch_fast(marked, add_special_tokens=False))])
        return self._cut(ids, np.append(np.flatnonzero(self.spaced[ids])[1:], len(ids)))

    def _others(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that tokens never cross: cut where the tokens' bytes add up to a piece's end."""
        ids = np.concatenate([np.zeros(0, np.int32), *self._starts(self._joined(pieces))])
        return self._cut(ids, np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in pieces]), "right"))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if self.words is None:
            return self._others(pieces)
        plain = [PLAIN.fullmatch(p) is not None for p in pieces]
        first, rest = list(compress(pieces, plain)), list(compress(pieces, map(not_, plain)))
        found, other = iter(self._plain(first) if first else ()), iter(self._others(rest))
        return [next(found if x else other) for x in plain]

    def _joined(self, pieces: list[str]) -> list[str]:
        return ["".join(pieces[k : k + 256]) for k in range(0, len(pieces), 256)]

    def _cut(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw, to = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *to], to)]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self.pieces.batch(texts)
        own = dict(zip(whole, self._starts([texts[k] for k in whole]), strict=True))
        rest = iter(self.pieces.batch([t for k, t in enumerate(texts) if k not in own]))
        return [own[k] if k in own else next(rest) for k in range(len(texts))]


def library_encoder(path: str) -> LibraryEncoder:
    """One for each worker process."""
    return resident(f"tokenizers:{path}", lambda: LibraryEncoder(path))


INDEX = "shard int, file int, block int, path string, at long, n_bytes long, n_tokens long, offsets array<int>, doc_ids array<long>"
_INDEX = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("offsets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])


def write_records(docs: DataFrame, encoder: Callable[[], LibraryEncoder], end_id: int = 0, folder: str | None = None, most: int = FILE, block_bytes: int = BLOCK) -> DataFrame:
    """Write the ids of every document, with end_id after them, in ascending doc_id order; return the index, a row for each block of records. `encoder` gives a worker's encoder.

    Documents are sorted by ranges of doc_id and a hash of the text (null ids first), so rows that share an id are dealt out too. Each task writes files of its range, of
    about `most` bytes each and under names of their own. The index is a table: shard, file, block, path, where the block lies, and the offset in it and the doc_id of every
    record; a block holds `block_bytes` or BLOCK_ROWS records, or one longer record. A task that is tried again writes other files, and the index names those of the try that
    counted. Null text gives end_id alone; an empty table gives no files.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = text_of(docs).repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, store, top, path, out = TaskContext.get().partitionId(), None, None, None, None
        file, block, size = -1, 0, 0
        own = encoder()
        records: list[bytes] = []
        ids_of: list[int | None] = []
        held = tokens = 0

        def close_block() -> pa.RecordBatch:
            nonlocal store, top, path, out, file, block, size, held, tokens
            if out is None or size >= most:
                if out is not None:
                    out.close()
                if store is None:
                    store, top = open_store(folder)
                    store.create_dir(top, recursive=True)
                file, block, size = file + 1, 0, 0
                path = f"{top}/{shard:06d}-{file:06d}-{uuid.uuid4().hex}.rec"
                out = store.open_output_stream(path)
            offsets = np.cumsum([0] + [len(r) for r in records[:-1]])
            out.write(b"".join(records))
            row = {"shard": shard, "file": file, "block": block, "path": path, "at": size, "n_bytes": held, "n_tokens": tokens, "offsets": offsets.tolist(), "doc_ids": list(ids_of)}
            block, size, held, tokens = block + 1, size + held, 0, 0
            records.clear()
            ids_of.clear()
            return pa.RecordBatch.from_pylist([row], schema=_INDEX)

        for batch in batches:
            for part, raw in byte_chunks(batch):
                for doc, ids in zip(part.column("doc_id").to_pylist(), own.batch([x.decode("utf-8", "surrogatepass") for x in raw]), strict=True):
                    record = frame(np.append(ids, end_id))
                    if records and held + len(record) > block_bytes:
                        yield close_block()
                    records.append(record)
                    ids_of.append(doc)
                    held += len(record)
                    tokens += len(ids) + 1
                    if held >= block_bytes or len(records) >= BLOCK_ROWS:
                        yield close_block()
        if records:
            yield close_block()
        if out is not None:
            out.close()
        own.pieces.forget()

    return stage(ordered.mapInArrow(run, INDEX), "records-index")


class Files:
    """Open files of a store, the latest few."""

    def __init__(self, folder: str, most: int = 64):
        self.store, _ = open_store(folder)
        self.most, self.open = most, {}

    def read(self, path: str, at: int, size: int) -> bytes:
        f = self.open.pop(path, None) or self.store.open_input_file(path)
        self.open[path] = f
        if len(self.open) > self.most:
            self.open.pop(next(iter(self.open))).close()
        return f.read_at(size, at)


def _blocks(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[list[tuple]]:
    """(doc_id, start, ids) of the records of each row of the index."""
    files = None
    for batch in batches:
        for row in batch.to_pylist():
            files = files or Files(folder)
            data, start, out = files.read(row["path"], row["at"], row["n_bytes"]), row["first"], []
            for doc, at in zip(row["doc_ids"], row["offsets"], strict=True):
                ids, _ = unframe(data, at)
                out.append((doc, start, ids))
                start += len(ids)
            yield out


def _placed(index: DataFrame) -> DataFrame:
    """The index with `first`, the number of ids before each block: shards' sums (one row for each task that wrote) pass one window, blocks one for each shard."""
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).select("shard", before(Window.orderBy("shard")).alias("base"))
    inside = index.select("*", before(Window.partitionBy("shard").orderBy("file", "block")).alias("inside"))
    return inside.join(shards, "shard").select("path", "at", "n_bytes", "offsets", "doc_ids", (F.col("base") + F.col("inside")).alias("first"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all records before it), ids, read from the files that the index names, a block at a time."""
    folder = qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, folder):
            doc, start, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return _placed(index).mapInArrow(run, "doc_id long, start long, ids array<int>")


def digest_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""
    folder = qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, folder):
            found = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(index).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(index: DataFrame, folder: str, seed: str) -> DataFrame:
    """Single records in the order of a seeded hash, each fetched by its offset: doc_id, ids."""
    folder = qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for batch in batches:
            files = files or Files(folder)
            ids = [unframe(files.read(r["path"], r["offset"], r["size"]))[0].astype(np.int32) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    each = index.select("path", "at", "n_bytes", "offsets", F.posexplode(F.arrays_zip("doc_ids", "offsets")).alias("k", "r"))
    end = F.coalesce(F.try_element_at(F.col("offsets"), F.col("k") + 2), F.col("n_bytes"))
    rows = each.select("path", F.col("r.doc_ids").alias("doc_id"), (F.col("at") + F.col("r.offsets")).alias("offset"), (end - F.col("r.offsets")).cast("long").alias("size"))
    mixed = F.xxhash64(F.lit(seed), "path", "offset")
    return rows.repartition(mixed).sortWithinPartitions(mixed).mapInArrow(run, "doc_id long, ids array<int>")
