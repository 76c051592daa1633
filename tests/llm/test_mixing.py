import pytest
from conftest import WORD, by_id  # noqa: F401  tests/llm/conftest.py
from pyspark.sql import functions as F

from quernel.llm import mixing


def reshared(sizes: list[int], weights: list[int], share=1.5, most=2.0) -> list[float]:
    """Targets by resharing the excess again and again."""
    budget, target, full = share * sum(sizes), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        open_ = [k for k in range(len(sizes)) if not full[k]]
        rest = budget - sum(target[k] for k in range(len(sizes)) if full[k])
        total = sum(weights[k] for k in open_)
        for k in open_:
            target[k] = rest * weights[k] / total
        over = [k for k in open_ if target[k] > most * sizes[k]]
        if not over:
            return target
        for k in over:
            target[k], full[k] = most * sizes[k], True


def test_targets_equal_iterative_resharing(spark):
    import random

    r = random.Random(4)
    for trial in range(6):
        n = r.randint(1, 12)
        sizes = [r.choice([0, 1, 5, 100, 10_000, 333]) for _ in range(n)]
        names = sorted(f"s{r.randint(0, 999)}x{k}" for k in range(n))
        got = {x.source: x for x in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        expected = reshared(sizes, [(5, 2, 1)[k % 3] for k in range(n)])
        for name, size, t in zip(names, sizes, expected):
            assert got[name].target == pytest.approx(t, rel=1e-9, abs=1e-6) and got[name].target <= 2 * size


def test_mix(docs, labels, rows):
    out = mixing.mix(docs, labels)
    found = [r.asDict() for r in out.collect()]
    assert len(found) == len(rows)
    again = sorted((str(r) for r in mixing.mix(docs.repartition(7), labels).collect()))
    assert again == sorted(str(r) for r in out.collect())
    sizes = {k: len(WORD.findall(t or "")) for k, t, *_ in rows}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in found)
    source = {k: s for k, _, _, s, _ in rows}
    for s in set(source.values()):
        own = [r for r in found if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5001
        assert sum(r["size"] for r in own) == own[0]["source_size"]


def test_higher_quality_comes_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rate = {r.q: r.t for r in mixing.mix(df, labels, weights=(1, 3), share=0.4).groupBy((F.col("doc_id") % 2).alias("q")).agg(F.avg("taken").alias("t")).collect()}
    assert rate[1] > 2 * rate[0] > 0


def test_empty_and_mixed(no_docs, docs, labels, rows):
    assert mixing.mix(no_docs, labels).collect() == []
    plan, out = by_id(mixing.mix(docs, labels)), by_id(mixing.mixed(docs, labels))
    for k, own in plan.items():
        assert sum(len(WORD.findall(r.text)) for r in out.get(k, [])) == sum(r.taken for r in own)
    assert mixing.mixed(docs, labels).columns == docs.columns
