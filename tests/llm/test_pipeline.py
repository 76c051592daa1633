import hashlib
import random

import duckdb
import pytest
from conftest import WORD
from test_dedup import linked, shingle_set
from test_text_ops import LIBRARY, plain_stats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as cp
    from quernel.llm import mixing, pii, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = cp.keep_good(spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    fine = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert good.columns == docs.columns and len(fine - kept) <= 0.05 * len(fine)
    rules = quality.fit(docs, labels)
    assert kept == {r.doc_id for r in quality.judge(docs, rules).where("judged.kept").collect()}
    once = cp.keep_one_of_each(spark, good.union(good.limit(1)), SF).cache()
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} <= kept
    assert once.count() == once.select("doc_id").distinct().count()
    clean = cp.without_personal_data(spark, once, SF).cache()
    model = pii.fit(once)
    before = {r.doc_id: r.text for r in once.collect()}
    for r in clean.collect():
        assert r.text == pii.redact_text(before[r.doc_id], pii.spans_of(before[r.doc_id], model)) and r.n_chars == len(r.text)
    mix = cp.mix(spark, clean, SF).cache()
    taken = {r.doc_id: r.taken for r in mixing.mix(clean, labels).collect()}
    assert {r.doc_id for r in mix.collect()} == {k for k, n in taken.items() if n} and mix.columns == docs.columns
    coded = cp.encode(spark, mix, SF).collect()
    assert len(coded) == mix.count() and {r.decoded_sha256 for r in coded} == {hashlib.sha256(r.text.encode()).hexdigest() for r in mix.collect()}


def plain_run(rows: list[tuple], labels: list[tuple], rules, model) -> list[tuple]:
    """(doc_id, tokens' digest, text's digest) of the whole pipeline by brute force: each stage on plain lists. Rules and model are the stages' learned parts."""
    import math

    import numpy as np

    from quernel.llm import pii, quality

    good = []
    for r in rows:
        n, chars, symbols, _, repeated = plain_stats(r[1] or "")
        s = dict(zip(quality.NAMES, quality.text_stats(r[1] or ""), strict=True))
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_repeat_words"]) == (n, chars, symbols, repeated)
        x = {k: np.array([eval(f, {"greatest": max, **s})], float) for k, f in quality.FEATURES.items()}
        if n >= 10 and 100 * repeated <= 20 * n and not rules.rejects(x)[0]:
            good.append(r)
    component = linked({r[0]: shingle_set(r[1]) for r in good})
    once = [r for r in good if component[r[0]] == r[0]]
    clean = [(r[0], pii.redact_text(r[1], pii.spans_of(r[1], model)), r[2], r[3]) for r in once]
    size = {r[0]: len(WORD.findall(r[1])) for r in clean}
    by = sorted({r[3] for r in clean}, key=lambda s: (s is None, s))
    total = {s: sum(size[r[0]] for r in clean if r[3] == s) for s in by}
    weight, cap, open_, left, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(by)}, {s: 2 * total[s] for s in by}, set(by), 1.5 * sum(total.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: cap[s] for s in full}
        left, open_ = left - sum(cap[s] for s in full), open_ - full
    rated = {}
    for k, q, _ in labels:
        if k is not None and q is not None:
            rated.setdefault(k, []).append(q)
    out = []
    for s in by:
        own = [r for r in clean if r[3] == s]
        rounds = int(target[s] // total[s]) if total[s] else 0
        rest = round(target[s] - rounds * total[s])
        draw = lambda k: (int(hashlib.sha256(f"mix:{k}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        key = lambda k: -math.log(draw(k)) / (0.5 + 1.5 * sum(rated[k]) / len(rated[k]) if k in rated else 1.0)
        for r in sorted(own, key=lambda r: key(r[0])):
            more = max(0, min(size[r[0]], rest))
            rest -= more
            words = list(WORD.finditer(r[1]))
            out += [(r[0], r[1])] * (rounds + (more == size[r[0]])) + ([(r[0], r[1][: words[more - 1].end()])] if 0 < more < size[r[0]] else [])
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return sorted((k, digest(" ".join(map(str, LIBRARY.encode_ordinary(t))).encode()), digest(t.encode())) for k, t in out)


def tables(spark, top, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, judged string, rows_of_id string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_run_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as cp
    from quernel.llm import pii, quality

    r = random.Random(3)
    word = lambda: "".join(r.choice(["ba", "ne", "ti", "ór", "lu"]) for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(r.randint(5, 90))) for _ in range(60)]
    texts += [texts[3], texts[4] + " end", "write a.b@mail.example.com now " + texts[5], texts[6] + ' token = "0401e44b4045d5b7fc925af2d5b1396433e9ee50"', None, "", " \n ", "one"]
    rows = [(k, t, "en", (None, "s1", "s2", "s10")[k % 4], len(t or ""), "own", None) for k, t in enumerate(texts)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(0, 60, 2)] + [(None, 1, 0), (4, None, None)]
    top = tables(spark, tmp_path, rows, labels)
    docs, given = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet")
    good = cp.keep_good(spark, docs, top)
    assert good.columns == docs.columns and {x.judged for x in good.collect()} == {"own"}
    model = pii.fit(cp.keep_one_of_each(spark, good, top))
    got = sorted((x.doc_id, x.ids_sha256, x.decoded_sha256) for x in cp.run(spark, top).collect())
    assert got == plain_run(rows, labels, quality.fit(docs, given), model) and len(got) > 40


def test_run_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    assert cp.run(spark, tables(spark, tmp_path, [], [])).collect() == [] and 4 <= len(cp.STAGES) <= 5


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_substring_dedup", "op6_minhash_dedup"])
def test_sql(spark, name):
    from quernel.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    own, sql = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(sql.columns)
    assert cols == sorted(own.columns)
    assert (own[cols].sort_values("doc_id").reset_index(drop=True) == sql[cols].sort_values("doc_id").reset_index(drop=True)).all().all()
