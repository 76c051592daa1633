"""Substring, suffix-array and near-duplicate operators against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA, WORD, by_id, make_texts

from quernel.llm import components, minhash, quality, substring_dedup, suffix_dedup, suffix_sort

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_substring_dedup(docs, rows):
    out = by_id(substring_dedup.dedup(docs))
    first = {}
    for k, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    assert sum(map(len, out.values())) == len(rows)
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        stay = [True] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                stay[i : i + 13] = [False] * 13
        left = " ".join(a for a, s in zip(w, stay) if s)
        for r in out[k]:
            assert (r.n_words, r.n_removed, r.kept, r.kept_sha256) == (len(w), stay.count(False), left, hashlib.sha256(left.encode()).hexdigest())
            assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_a_null_id_takes_no_part(spark):
    t = " ".join(f"w{k}" for k in range(20))
    out = substring_dedup.dedup(spark.createDataFrame([(None, t), (1, t), (2, t)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in out} == {None: 0, 1: 0, 2: 20}


@pytest.mark.parametrize("length", [400, 70])
def test_suffix_dedup(docs, rows, length):
    out = by_id(suffix_dedup.dedup(docs, length=length))
    raw = [(k, (t or "").encode()) for k, t, *_ in rows]
    seen = Counter(x[i : i + length] for _, x in raw for i in range(len(x) - length + 1))
    for k, x in raw:
        until, gone = 0, bytearray(len(x))
        for i in range(len(x)):
            if i + length <= len(x) and seen[x[i : i + length]] > 1:
                until = i + length
            gone[i] = i < until
        left = bytes(b for b, g in zip(x, gone) if not g)
        runs = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        for r in out[k]:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(x), sum(gone), runs, left)
            assert r.kept_sha256 == hashlib.sha256(left).hexdigest() and len(r.spans) == runs


def common_prefix(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_suffixes_and_common_prefixes_equal_sorting():
    r = random.Random(3)
    for trial in range(300):
        n, a = r.randint(1, 70), r.choice([1, 2, 3, 30, 400])
        base = [r.randint(1, a) for _ in range(r.randint(1, 9))]
        own = [r.randint(1, a) for _ in range(n)] if trial % 3 else (base * 40)[:n]
        text = np.array([*own, *own[: n // 2 if trial % 5 == 0 else 0], 0], np.int16)
        down = sorted(range(len(text)), key=lambda i: text[i:].tolist())[::-1]
        for most in (None, 4, 1000):
            got = np.concatenate(list(suffix_sort.suffixes_down(text, most if a < 250 else None, step=r.choice([1, 2, 7, 1000]))))
            assert got["at"].tolist() == down
            if most and a < 250:
                assert got["lcp"].tolist() == [0] + [min(most, common_prefix(text[x:].tolist(), text[y:].tolist())) for x, y in zip(down, down[1:])]


def test_queues_on_disk_at_every_level_give_the_same(tmp_path, monkeypatch):
    levels, spills = [], Counter()
    made, spill = suffix_sort.Induction.__init__, suffix_sort.BucketQueue._spill

    def counted(self, text, *rest):
        levels.append(len(text))
        made(self, text, *rest)

    def spilled(self):
        spills[len(levels)] += 1
        spill(self)

    monkeypatch.setattr(suffix_sort.Induction, "__init__", counted)
    monkeypatch.setattr(suffix_sort.BucketQueue, "_spill", spilled)
    r, deepest = random.Random(5), 0
    for trial in range(30):
        levels.clear()
        spills.clear()
        # words of words: every level of the recursion still has repeats
        pieces = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 50))) for _ in range(6)]
        pieces += [b"".join(r.choice(pieces[:3]) for _ in range(20)) for _ in range(3)]
        spilled_out = suffix_sort.repeated_starts(pieces, 6, str(tmp_path), 24, step=5)
        assert all(spills[k + 1] for k, n in enumerate(levels) if n > 8)
        deepest = max(deepest, len(levels))
        kept = suffix_sort.repeated_starts(pieces, 6)
        seen = Counter(p[i : i + 6] for p in pieces for i in range(len(p) - 5))
        assert [x.tolist() for x in kept] == [x.tolist() for x in spilled_out] == [[i for i in range(len(p) - 5) if seen[p[i : i + 6]] > 1] for p in pieces]
    assert not list(tmp_path.iterdir()) and deepest >= 4


def test_anchors_with_many_contents_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, texts = letters(150), []
    for k in range(25):
        a, b = r.randint(0, 60), r.randint(90, 150)
        texts.append(letters(r.randint(0, 90)) + passage[a:b] + letters(r.randint(0, 90)))
    texts += [texts[0] + texts[1], texts[2][:100], texts[3]]
    out = {x.doc_id: x for x in suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=70, piece=12).collect()}
    seen = Counter(t[i : i + 70] for t in texts for i in range(len(t) - 69))
    for k, t in enumerate(texts):
        gone = set().union(*(range(i, i + 70) for i in range(len(t) - 69) if seen[t[i : i + 70]] > 1), ())
        assert bytes(out[k].kept).decode() == "".join(c for i, c in enumerate(t) if i not in gone)


def test_contents_are_narrowed_to_what_may_repeat():
    """No repeat is lost, and contents that share little more than their anchor aren't sorted."""
    r = random.Random(14)
    noise = lambda n: bytes(r.choice(b"abcdefgh \xc3\xa9") for _ in range(n))
    for length, piece in ((400, 64), (70, 12), (30, 20)):
        passages, texts = [noise(3 * length) for _ in range(4)], []
        for k in range(120):
            a = r.randrange(2 * length)
            texts.append(noise(r.randrange(length)) + r.choice(passages)[a : a + r.randint(piece, length + piece)] + noise(r.randrange(length)))
        doc, start, n, anchor, _ = suffix_dedup.segments(texts, length, piece)
        seen = {(q, k): texts[d][a : a + m + length - 1] for k, (d, a, m, q) in enumerate(zip(doc.tolist(), start.tolist(), n.tolist(), anchor.tolist()))}
        seen = {k: v for v, k in {v: k for k, v in seen.items()}.items()}
        counts = Counter(v[i : i + length] for v in seen.values() for i in range(len(v) - length + 1))
        own = {k: (a, v) for k, a, v in suffix_dedup.narrowed(seen, length, piece)}
        for k, v in seen.items():
            again = [i for i in range(len(v) - length + 1) if counts[v[i : i + length]] > 1]
            a, part = own.get(k, (0, b""))
            assert v[a : a + len(part)] == part and all(a <= i and i + length <= a + len(part) for i in again)
        assert counts.most_common(1)[0][1] > 1 and sum(len(v) for _, v in own.values()) < 0.5 * sum(map(len, seen.values()))


def test_splitting_an_anchor_reads_no_text_again(spark, monkeypatch):
    """What is sorted and what is split come from one table of contents; the texts are dealt out once for it."""
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    plans, staged = {}, suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().toString()), staged(df, name))[1])
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = letters(150)
    texts = [letters(r.randint(0, 90)) + passage[r.randint(0, 60) : r.randint(90, 150)] + letters(r.randint(0, 90)) for _ in range(25)]
    suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=70, piece=12).collect()
    assert {"suffix-classes", "suffix-runs"} <= set(plans) and not [k for k in ("suffix-classes", "suffix-runs") if "wanted" in plans[k]]


def shingle_set(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(sets: dict) -> dict:
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_near_duplicates(docs, rows):
    out = by_id(minhash.near_duplicates(docs))
    sets = {k: shingle_set(t) for k, t, *_ in rows}
    expected = linked(sets)
    assert sum(map(len, out.values())) == len(rows)
    for k, own in out.items():
        for r in own:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[k]), expected[k], expected[k] == k)


def test_links_between_members_that_miss_the_centre(spark):
    """Chains of edits: most neighbours are linked, many of a bucket's members aren't linked to its least one."""
    r = random.Random(11)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(40):
        texts.append(" ".join(words))
        for _ in range(r.choice([1, 2, 5, 40])):
            words[r.randrange(200)] = f"n{r.randrange(10**6)}"
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = {k: shingle_set(t) for k, t in enumerate(texts)}
    expected = linked(sets)
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == expected
    assert any(100 * len(sets[k] & sets[c]) < 75 * len(sets[k] | sets[c]) for k, c in expected.items()) and 1 < len(set(expected.values())) < 40


def test_a_bucket_of_many_unlike_texts_loses_no_link(spark, monkeypatch):
    """Short texts around one common line: one bucket holds most of them, links are between few."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r, texts = random.Random(4), []
    line = " ".join(f"c{k}" for k in range(30))
    for k in range(90):
        t = f"{line} " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(15, 30)))
        texts += [t] if k % 3 else [t, t + " more", t[: t.rindex(" ")]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == linked({k: shingle_set(t) for k, t in enumerate(texts)})


def test_rows_that_share_an_id_lose_no_link(spark):
    r = random.Random(6)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b, c = prose(120), prose(150), prose(90)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(c)), (7, " ".join([*b, "x"])), (8, " ".join([*c, "y"])), (9, " ".join(["z", *a])), (3, " ".join(prose(100)))]
    out = {(x.doc_id, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(5, 5), (7, 5), (8, 5), (9, 5), (3, 3)}


def test_pairs_at_the_threshold_are_found(spark):
    """Recall against brute force: pairs of long texts just above and below the similarity."""
    r, rows, expected = random.Random(12), [], {}
    for k in range(0, 600, 2):
        n = r.randint(70, 400)
        one = [f"p{k}x{j}" for j in range(n)]
        cut = int(n * r.uniform(0.18, 0.32))
        rows += [(k, " ".join(one)), (k + 1, " ".join(one[cut:]))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        expected |= {k: k, k + 1: k if 100 * len(a & b) >= 75 * len(a | b) else k + 1}
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and 50 < sum(k != c for k, c in expected.items()) < 250


def test_short_texts_are_found_exactly(spark):
    r, texts = random.Random(2), []
    for k in range(60):
        w = [f"v{r.randrange(500)}" for _ in range(r.randint(4, 60))]
        texts += [" ".join(w), " ".join(w[: max(1, len(w) - r.randint(0, 3))]), " ".join([*w, "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == linked({k: shingle_set(t) for k, t in enumerate(texts)})


def test_densified_bins_agree_as_often_as_sets_do():
    r = np.random.default_rng(1)
    for shared, own in ((60, 10), (20, 20)):
        rate = []
        for _ in range(60):
            both = r.integers(1, 1 << 63, shared, dtype=np.uint64) * np.uint64(2)
            a, b = (np.sort(np.concatenate([both, r.integers(1, 1 << 63, own, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2))
            x, y = (minhash.signature(np.zeros(len(v), int), v, 1)[0] for v in (a, b))
            rate.append((x == y).mean())
        assert abs(np.mean(rate) - shared / (shared + 2 * own)) < 0.04


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 600)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_empty_tables(no_docs):
    assert substring_dedup.dedup(no_docs).collect() == [] and suffix_dedup.dedup(no_docs).collect() == [] and minhash.near_duplicates(no_docs).collect() == []


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (None, None)], "doc_id long, text string")
    assert sorted(((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(df).collect()), key=str) == [(1, 1, True), (None, None, True), (None, None, True)]


def test_many_tables(spark):
    for seed in (21, 22):
        rows = [(k * 7 % 61, t, "x", "y", 1) for k, t in enumerate(make_texts(seed, 61))]
        out = by_id(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
        assert {k: v[0].component_id for k, v in out.items()} == linked({k: shingle_set(t) for k, t, *_ in rows})


def thue_morse(n: int, letters: str) -> str:
    """The word whose sums to any base modulo 2^64 equal its complement's, from 1024 letters on."""
    return "".join(letters[k.bit_count() & 1] for k in range(n))


def test_words_and_strings_that_collide_modulo_a_power_of_two(spark):
    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    tail = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} x"), (4, f"{two} x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(df).collect()} == dict.fromkeys(range(1, 5), 0)
    short = spark.createDataFrame([(1, one), (2, two), (3, f"{one} a b c"), (4, f"{two} a b c")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(short).collect()} == {k: k for k in range(1, 5)}
    assert quality.text_stats(f"{one} a b c d {two} a b c d")[4] == 0
    for n in (512, 1024):
        parts = [thue_morse(n, "ab"), thue_morse(n, "ba")]
        texts = dict(enumerate([parts[0] + "1", parts[1] + "2", "q" + parts[0], "zz" + parts[1] + parts[0]]))
        out = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        seen = Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
        for k, t in texts.items():
            gone = set().union(*(range(i, i + 400) for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1), ())
            assert bytes(out[k].kept).decode() == "".join(c for i, c in enumerate(t) if i not in gone)
