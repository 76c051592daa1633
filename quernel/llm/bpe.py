"""Byte-level BPE: a minimal perfect hash resolves whole pre-tokens, the rest are merged by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, text_udf
from .hashing import mix

#: Pieces of text whose ids a worker keeps during a task; when full, it starts anew.
CACHE = 300_000


class PerfectHash:
    """A minimal perfect hash of n keys: hash and displace. Each key's bucket names a displacement that sends its keys to free slots of n; lookups
    compare the stored key, so a key that isn't in the set is never taken for one."""

    PER_BUCKET = 4

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, -(-n // self.PER_BUCKET))
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        self.shift, free = np.zeros(self.buckets, np.int64), np.ones(n, bool)
        open_slots = n
        slot_of, left = np.empty(n, np.int64), None
        for b in np.argsort(-sizes, kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:  # a lone key takes the next free slot; the shift below 0 names it
                left = iter(np.flatnonzero(free).tolist()) if left is None else left
                slot = next(left)
                self.shift[b], slot_of[own] = -1 - slot, slot
                continue
            tried, tries = 0, int(min(4096, max(32, 2 * (n / open_slots) ** len(own))))
            while True:
                d = np.arange(tried, tried + tries, dtype=np.uint64)[:, None]
                slots = self._place(hashes[own], d)
                good = free[slots].all(axis=1)
                if len(own) > 1 and good.any():
                    ranked = np.sort(slots, axis=1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b], slot_of[own] = tried + k, slots[k]
                    free[slots[k]] = False
                    open_slots -= len(own)
                    break
                tried += tries
                if tried > 1 << 20:
                    raise ValueError("keys with equal hashes")
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        for k, slot in enumerate(slot_of.tolist()):
            self.keys[slot], self.values[slot] = keys[k], values[k]

    def _place(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes ^ (shift + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._place(hashes, np.maximum(shift, 0).astype(np.uint64)))

    def get(self, keys: list[bytes]) -> list[int]:
        """The value of each key, -1 if it isn't in the set."""
        if not keys or not self.n:
            return [-1] * len(keys)
        slots = self.slots(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)).tolist()
        own, values = self.keys, self.values
        return [int(values[s]) if own[s] == k else -1 for k, s in zip(keys, slots, strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: always the lowest-ranked pair of neighbours joins, the leftmost first. Bytes are linked both ways; a heap holds the pairs,
    and a pair whose parts have changed since is passed over. n log n for a piece of n bytes."""
    n = len(piece)
    ends = list(range(1, n + 1))  # where the part that starts at k ends; 0 once it is joined to another
    before = list(range(-1, n - 1))
    heap = [(rank, k, k + 2) for k in range(n - 1) if (rank := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, end = heapq.heappop(heap)
        mid = ends[k]
        if not mid or mid >= n or ends[mid] != end:
            continue
        ends[k], ends[mid] = end, 0
        if end < n:
            before[end] = k
            if (rank := ranks.get(piece[k : ends[end]])) is not None:
                heapq.heappush(heap, (rank, k, ends[end]))
        if (p := before[k]) >= 0 and (rank := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (rank, p, end))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : ends[k]]])
        k = ends[k]
    return out


class PieceCache(dict):
    """Ids of pieces of text, as the bytes of int32 arrays, which join fast, for encoders that never join across a space before a visible character.

    A text is cut before such spaces. Its first piece has no space before it; every other stands for itself with its space. `starts` encodes first pieces;
    `pieces` gets distinct pieces, each with its space, that aren't known yet and gives the bytes of their ids. At half of `most` pieces a new generation begins; those of the last one
    that come again move to it, so frequent pieces stay.
    """

    VISIBLE = "!-~À-ɏ"
    CUT, OTHER = re.compile(f" (?=[{VISIBLE}])"), re.compile(f" (?![{VISIBLE}])")

    def __init__(self, starts: Callable[[list[str]], list[np.ndarray]], pieces: Callable[[list[str]], list[bytes]], most: int = CACHE):
        super().__init__()
        self.starts, self.encode, self.most, self.last = starts, pieces, most, {}

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.CUT.split(t) if self.OTHER.search(t) else t.split(" ") for t in texts]
        firsts = [c.pop(0) for c in cut]
        own = set().union(*cut)
        new = own.difference(self)
        if 2 * (len(self) + len(new)) > self.most:
            self.last = dict(self)
            self.clear()
            new = own
        again = new.intersection(self.last)
        self.update((p, self.last[p]) for p in again)
        fresh = list(new.difference(again) if again else new)
        self.update(zip(fresh, self.encode([" " + p for p in fresh]), strict=True))
        return [np.frombuffer(b"".join([a.tobytes(), *map(self.__getitem__, c)]), np.int32) if c else a for a, c in zip(self.starts(firsts), cut, strict=True)]

    def forget(self) -> None:
        self.clear()
        self.last = {}


class Tokenizer:
    """Byte-level BPE by ranks: `path` names a file of lines `base64 rank`, `pattern` cuts texts into pre-tokens. No special tokens."""

    def __init__(self, path: str, pattern: str, most: int = CACHE):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.decimal = {v: str(v) for v in self.bytes_of}
        self.pieces = PieceCache(self._pieces, lambda pieces: [x.tobytes() for x in self._pieces(pieces)], most)

    def pre_tokens(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token: the perfect hash first, the heap for misses."""
        return [[v] if v >= 0 else merge(t, self.ranks) for t, v in zip(tokens, self.whole.get(tokens), strict=True)]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        cut = [[t.encode("utf-8", "surrogatepass") for t in self.pattern.findall(p)] for p in pieces]
        distinct = list({t for c in cut for t in c})
        ids = dict(zip(distinct, self.pre_tokens(distinct), strict=True))
        return [np.array([x for t in c for x in ids[t]], np.int32) for c in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.pieces.batch(texts)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker process; the vocabulary file and CACHE bound it, and its cache goes at the end of a task."""
    return resident(f"bpe:{path}:{pattern}", lambda: Tokenizer(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with a column of token ids for each whole text; null text gives none. Other columns stay; a column named out_col is replaced."""

    def encode(texts: list[str | None]) -> pa.Array:
        return pa.array(tokenizer(path, pattern).encode([x or "" for x in texts]), pa.list_(pa.int32()))

    return docs.withColumn(out_col, text_udf(encode, "array<int>", after=lambda: tokenizer(path, pattern).pieces.forget())(F.col(text_col).cast("string")))


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes that each row's ids stand for. Null ids give no bytes; an id outside the vocabulary is an error."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            t = tokenizer(path, pattern)
            yield pa.array([t.decode(x.as_py() or ()) for x in ids], pa.binary())

    return encoded.withColumn(out_col, decode(F.col(ids_col)))


ROUND_TRIP = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 (of the bytes that decoding the ids gives); columns of docs with these
    names are replaced, whatever their case. Null text has no tokens. Repeated rows are encoded each; an empty table gives an empty result."""

    def digests(texts: list[str | None]) -> pa.Array:
        t, out = tokenizer(path, pattern), []
        for ids in t.encode([x or "" for x in texts]):
            listed = ids.tolist()
            out.append((len(listed), hashlib.sha256(" ".join(map(t.decimal.__getitem__, listed)).encode()).hexdigest(), hashlib.sha256(t.decode(listed)).hexdigest()))
        n, coded, decoded = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    own = ("n_tokens", "ids_sha256", "decoded_sha256")
    trip = text_udf(digests, ROUND_TRIP, after=lambda: tokenizer(path, pattern).pieces.forget())(F.col(text_col).cast("string"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    return docs.select(*kept, trip.alias("_trip")).select(*kept, *(F.col(f"_trip.{c}") for c in own))
