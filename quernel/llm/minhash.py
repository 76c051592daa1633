"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, release, stage, text_of, unstage
from .components import components
from .hashing import BASE_WINDOW, BASE_WINDOW_2, mix, powers, windows, word_identities, word_sums, words_in

#: Words in a shingle; documents are linked from this many hundredths of similarity.
SHINGLE, PERCENT = 5, 75
#: Bins of the permutation, bands and rows: at similarity 0.75 two documents share no band once in 10^6.
BINS, BANDS, ROWS = 256, 51, 5
#: Up to so many shingles a document is found by its least shingles, which is exact, as few shingles leave bins that vary too much.
SMALL = 64
#: Members that one task confirms against one centre; rounds of other centres before the blocks that are left are compared.
PER_TASK, ROUNDS = 512, 1
#: Members of one bucket and size class that meet the others of the bucket in one task.
BLOCK = 2048
#: A sketch has four bits of each bin. At similarity 0.75 two of 256 bins' sketches differ in 60, give or take 8 at most; beyond this a pair isn't confirmed on full sets.
PLANES, MOST_DIFFER = 4, 100
#: Words of 64 bits in the bitmap of a set's hashes. Each shingle that only one of two sets has turns one bit at most, so bitmaps never rule out a pair that is similar enough.
BITMAP = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, second hash), sorted, each once: the shingles of lower-cased texts, by 128 bits over their words' identities. A text of fewer words is one
    shingle; one without words has none."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    begins = np.cumsum([0] + [len(x) + 1 for x in texts])
    starts, ends = words_in(data)
    sums = word_sums(word_identities(data, starts, ends))
    first = np.searchsorted(starts, begins)
    n = np.diff(first)
    at = np.arange(max(0, len(starts) - size + 1))
    doc = np.repeat(np.arange(len(texts)), n)[: len(at)]
    inside = at + size <= first[doc + 1]
    doc, values = doc[inside], [mix(windows(s, size, base))[inside] for s, base in zip(sums, (BASE_WINDOW, BASE_WINDOW_2), strict=True)]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        a, b, salt = first[short], first[short] + n[short], n[short].astype(np.uint64) << np.uint64(58)
        own = [mix((s[b] - s[a]) * powers(pow(base, -1, 1 << 64), len(s))[a] + salt) for s, base in zip(sums, (BASE_WINDOW, BASE_WINDOW_2), strict=True)]
        doc, values = np.concatenate([doc, short]), [np.concatenate(x) for x in zip(values, own, strict=True)]
    order = np.lexsort((values[0], doc))
    doc, one, two = doc[order], values[0][order], values[1][order]
    once = np.ones(len(doc), bool)
    once[1:] = (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return doc[once], one[once], two[once]


def signature(doc: np.ndarray, value: np.ndarray, n_docs: int, bins: int = BINS) -> np.ndarray:
    """One-permutation signatures, a row for each text: the top bits of a hash name its bin, a bin keeps its least hash. An empty bin copies the bin that a
    hash of its number and of the try names, tries going on until that one is full, so that equal bins stay equally likely to agree."""
    bits = int(bins).bit_length() - 1
    bin_of = (value >> np.uint64(64 - bits)).astype(np.int64)
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (bin_of[1:] != bin_of[:-1])
    out, full = np.zeros((n_docs, bins), np.uint64), np.zeros((n_docs, bins), bool)
    out[doc[first], bin_of[first]] = value[first]
    full[doc[first], bin_of[first]] = True
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    k = 0
    while len(rows):
        k += 1
        source = (mix((cols + bins * k).astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        there = full[rows, source]
        out[rows[there], cols[there]] = out[rows[there], source[there]]
        rows, cols = rows[~there], cols[~there]
    return out


def bands(sig: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket keys, a column for each band."""
    part = sig[:, : count * rows].reshape(len(sig), count, rows)
    acc = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), np.uint64)
    for k in range(rows):
        acc = mix(acc ^ part[:, :, k])
    return acc


@dataclass(frozen=True)
class Near:
    """Parameters of a near-duplicate search."""

    shingle: int = SHINGLE
    percent: int = PERCENT
    bins: int = BINS
    bands: int = BANDS
    rows: int = ROWS
    small: int = SMALL

    def keys(self, doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket key) and for each text a sketch of four bits of each bin, plane by plane, as numbers (-1 for those without bands), then a bitmap of its hashes. Texts of up to small / similarity shingles give their n - ceil(similarity n) + 1 least ones: two linked texts share one of
        those. Texts of more than `small` give their bands."""
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        n = np.diff(first)
        rank = np.arange(len(doc)) - first[doc]
        spare = n - (-(-self.percent * n // 100)) + 1
        few = (n[doc] * self.percent <= 100 * self.small) & (rank < spare[doc])
        big = np.flatnonzero(n > self.small)
        keys, owner = mix(value[few] ^ np.uint64(0x5DEECE66D)), doc[few]
        sketch = np.full((n_docs, PLANES * self.bins // 64), -1, np.int64)
        if len(big):
            place = np.full(n_docs, -1)
            place[big] = np.arange(len(big))
            own = place[doc] >= 0
            sig = signature(place[doc[own]], value[own], len(big), self.bins)
            bits = mix(sig ^ np.arange(self.bins, dtype=np.uint64))
            sketch[big] = np.hstack([np.packbits((bits >> np.uint64(p) & np.uint64(1)).astype(bool), axis=1) for p in range(PLANES)]).view("<i8")
            found = bands(sig, self.bands, self.rows)
            keys, owner = np.concatenate([keys, found.ravel()]), np.concatenate([owner, np.repeat(big, found.shape[1])])
        present = np.zeros((n_docs, 64 * BITMAP), bool)
        present[doc, (value & np.uint64(64 * BITMAP - 1)).astype(np.int64)] = True
        sketch = np.hstack([sketch, np.packbits(present, axis=1).view("<i8")])
        order = np.argsort(owner, kind="stable")
        return owner[order], keys[order], sketch


def profile(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, two sums that identify the set (equal sets have equal ones), the bucket keys and a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in byte_chunks(batch):
                doc, value, second = shingles(raw, how.shingle)
                edges = np.searchsorted(doc, np.arange(len(raw) + 1))
                one, two = (np.concatenate([[np.uint64(0)], np.cumsum(mix(x))]) for x in (value ^ np.uint64(0x243F6A8885A308D3), second))
                owner, keys, sketch = how.keys(doc, value, len(raw))
                cuts = pa.array(np.searchsorted(owner, np.arange(len(raw) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(edges), pa.int64()),
                        pa.array((one[edges[1:]] - one[edges[:-1]]).view(np.int64)),
                        pa.array((two[edges[1:]] - two[edges[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(cuts, pa.array(keys.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * sketch.shape[1], pa.int32()), pa.array(sketch.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "one", "two", "keys", "sketch"],
                )
        release()

    return text_of(docs).mapInArrow(run, "doc_id long, n_shingles long, one long, two long, keys array<long>, sketch array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, how: Near = Near()) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough. A pair brings the text of v to a task that has the text of u once; a u with many
    pairs is dealt out over several tasks."""
    many = pairs.groupBy("u").agg(F.count("*").alias("n")).select("u", F.ceil(F.col("n") / PER_TASK).cast("int").alias("parts"))
    salted = pairs.join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("salt"))
    centres = many.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    none = F.lit(None).cast("long")
    left = centres.join(texts, F.col("u") == F.col("doc_id")).select("u", "salt", none.alias("v"), "text")
    right = salted.join(texts, F.col("v") == F.col("doc_id")).select("u", "salt", "v", "text")
    met = left.unionByName(right).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u_now, own = None, []
        for batch in batches:
            for part, raw in byte_chunks(batch):
                doc, value, second = shingles(raw, how.shingle)
                edges = np.searchsorted(doc, np.arange(len(raw) + 1)).tolist()
                us, vs = [], []
                for k, (u, v) in enumerate(zip(part.column("u").to_pylist(), part.column("v").to_pylist(), strict=True)):
                    mine = value[edges[k] : edges[k + 1]], second[edges[k] : edges[k + 1]]
                    if v is None:
                        own = [*own, mine] if u == u_now else [mine]  # several if rows share an id
                        u_now = u
                        continue
                    for centre in own if u == u_now else []:
                        if linked(centre, mine, how.percent):
                            us.append(u)
                            vs.append(v)
                            break
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return met.select("u", "v", "text").mapInArrow(run, "u long, v long")


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """Whether two sets, each as sorted hashes and the second hashes beside them, share enough; both hashes must agree."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int((a[1][i] == b[1][j]).sum())
    return shared > 0 and 100 * shared >= percent * (len(a[0]) + len(b[0]) - shared)


def possible(pairs: DataFrame, marks: DataFrame, how: Near = Near()) -> DataFrame:
    """Pairs (u, v) that can be similar enough: the smaller set holds enough of the larger, and the sketches, where both have one, don't differ too much."""
    of = lambda c: marks.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    return both.where(close("n_u", "n_v", "s_u", "s_v", how)).select("u", "v").distinct()


def crossing(left: DataFrame, how: Near = Near()) -> DataFrame:
    """Pairs (a, b) of a bucket's members that lie in different components and can be similar enough, each from one bucket.

    left has key, doc_id, comp, n_shingles, sketch and keys (all keys of the document that are still mixed). Members are dealt by bucket and size class, a class spanning a factor
    of 100 / percent, so partners are in the same class or a neighbouring one; within a class they are dealt out in blocks of BLOCK, so no task holds more than a block of one bucket against
    a stream of its possible partners, however large the bucket is.
    """
    classed = left.withColumn("cls", F.floor(F.log("n_shingles") / F.log(F.lit(100 / how.percent)) + 1e-9).cast("int"))
    parts = classed.groupBy("key", "cls").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    names = ("doc_id", "comp", "n_shingles", "sketch", "keys")
    x = classed.join(parts, ["key", "cls"]).select("key", "cls", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), *(F.col(c).alias(f"{c}_a") for c in names))
    y = classed.select("key", F.col("cls").alias("own"), F.explode(F.array("cls", F.col("cls") - 1)).alias("cls"), *(F.col(c).alias(f"{c}_b") for c in names))
    y = y.join(parts, ["key", "cls"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    once = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")  # of the buckets that two documents share, the first gives the pair
    apart = (F.col("comp_a") < F.col("comp_b")) | ((F.col("own") > F.col("cls")) & (F.col("comp_a") != F.col("comp_b")))
    met = x.join(y, ["key", "cls", "part"]).where(apart & close("n_shingles_a", "n_shingles_b", "sketch_a", "sketch_b", how) & once)
    return met.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


def close(n_u: str, n_v: str, s_u: str, s_v: str, how: Near) -> Column:
    """Whether sizes and sketches allow the similarity: the bins that differ in any plane are counted in machine words."""
    words = how.bins // 64
    differ = F.lit(0)
    for q in range(words):
        any_plane = F.lit(0).cast("long")
        for p in range(PLANES):
            any_plane = any_plane.bitwiseOR(F.get(s_u, F.lit(p * words + q)).bitwiseXOR(F.get(s_v, F.lit(p * words + q))))
        differ = differ + F.bit_count(any_plane)
    turned = F.lit(0)
    for q in range(PLANES * words, PLANES * words + BITMAP):
        turned = turned + F.bit_count(F.get(s_u, F.lit(q)).bitwiseXOR(F.get(s_v, F.lit(q))))
    mapped = (100 + how.percent) * turned <= (100 - how.percent) * (F.col(n_u) + F.col(n_v))
    sized = 100 * F.least(n_u, n_v) >= how.percent * F.greatest(n_u, n_v)
    return sized & mapped & ((F.least(n_u, n_v) <= how.small) | (differ <= MOST_DIFFER * how.bins // 256))


def near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (doc_id is that one).

    Documents without words are linked with nothing. Rows that share an id are one document. A null id is linked with nothing: its component is null and it is kept.
    An empty table gives an empty result.

    Equal sets are one node, under their least id. In each bucket every member gets one candidate edge, to the bucket's least member, so edges are as
    many as memberships, however large a bucket is. Confirmed edges give components. Buckets whose members then still lie in several components are the only
    ones where a link can be missing: they get another centre, to which members of other components get an edge. The buckets that are left are cut by size class and into blocks, and
    only members of different components whose sizes and sketches allow a link are confirmed, so no link that a bucket holds is lost.
    """
    seen = stage(profile(docs, how), "minhash-profile")
    some = seen.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("node"))
    nodes = classes.select(F.col("node").alias("doc_id")).distinct()
    members = some.join(nodes, "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key")).repartition("key")
    full = members.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    buckets = stage(members.join(full, "key").distinct(), "minhash-buckets")

    of_rows = some.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch", "one", "two")
    marks = stage(of_rows.dropDuplicates(["doc_id", "n_shingles", "one", "two"]).drop("one", "two"), "minhash-marks")  # rows that share an id have a mark each
    tried = stage(possible(buckets.where("doc_id > least").select(F.col("least").alias("u"), F.col("doc_id").alias("v")).distinct(), marks, how), "minhash-stars")
    texts = stage(text_of(docs).join(marks.select("doc_id"), "doc_id", "left_semi"), "minhash-texts")
    links = stage(confirm(tried, texts, how), "minhash-links")
    done = [buckets, marks, tried, texts, links]
    found = stage(components(links), "minhash-components")

    for k in range(ROUNDS + 1):
        placed = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp")).repartition("key")
        centre = F.min_by(F.struct("doc_id", "comp"), F.xxhash64("doc_id", F.lit(k)))
        split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), centre.alias("centre")).where("low < high").select("key", "centre")
        mixed = placed.join(split, "key")
        if k < ROUNDS:
            pairs = mixed.where("comp <> centre.comp").select(F.col("doc_id").alias("a"), F.col("centre.doc_id").alias("b"))
        else:
            shared = mixed.groupBy("doc_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # a document's bands or least shingles at most
            left = stage(mixed.select("key", "doc_id", "comp").join(marks.join(shared, "doc_id"), "doc_id"), "minhash-mixed")
            done.append(left)
            pairs = crossing(left, how)
        pairs = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        if k < ROUNDS:
            pairs = possible(pairs, marks, how)
        rest = stage(pairs.join(tried, ["u", "v"], "left_anti"), "minhash-pairs")
        done.append(rest)
        if rest.isEmpty():
            continue
        more = stage(confirm(rest, texts, how), "minhash-links")
        done.append(more)
        tried = tried.unionByName(rest)
        if not more.isEmpty():
            links = links.unionByName(more)
            done.append(found)
            found = stage(components(links), "minhash-components")
    for table in done:
        unstage(table)

    placed_class = classes.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("one", "two", "n_shingles", F.coalesce("component", "node").alias("component"))
    linked_rows = some.select("doc_id", "n_shingles", "one", "two").join(placed_class, ["one", "two", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = seen.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
