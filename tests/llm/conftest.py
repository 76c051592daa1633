"""Small tables with every awkward case, and brute-force versions to test against."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with names that the operators use inside.
CLASH = "key long, range int, size long, anchor long, row_id long, tag long, u long, v long, judged string, keys string, quality double, taken long, ids string, component_id long, text_ string"


def make_texts(seed: int, n: int = 60) -> list[str]:
    """Random prose with near copies, shared passages and repeats of its own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ne", "ti", "ór", "lu", "Xa"]) for _ in range(r.randint(1, 3)))
    prose = lambda k: " ".join(word() + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(k))
    passage, out = prose(120), []
    for k in range(n):
        t = prose(r.choice([1, 3, 8, 40, 150, 300]))
        kind = r.randint(0, 7)
        if kind == 0 and out:
            t = r.choice(out)
        elif kind == 1 and out:
            w = r.choice(out).split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = f"{t} {passage} {prose(20)}"
        elif kind == 3:
            t = t + "\n" + t[: len(t) // 2] + "\t" + t
        out.append(t)
    return out


@pytest.fixture(scope="session")
def rows():
    texts = [None, "", " \n\t ", "one", "One two\x0bthree four   five", *make_texts(1), "lorem " * 3000, "x" * 20000, "né|" * 500, "a b\n" * 40]
    out = [(k, t, "en", (None, "s1", "s2", "s10", "")[k % 5], len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[9], out[9]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASH.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(0, 50, 3)] + [(None, 1, 0), (3, None, None), (6, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")


def by_id(df) -> dict:
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out
