import hashlib
import re
import time

from conftest import by_id
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text: str) -> dict:
    digits = lambda x: re.sub("[^0-9]", "", x)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15],
    }


@settings(max_examples=600, deadline=None)
@given(st.text("ab1.@-_%+ 45(0)é\n", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "0919255729746466", "1.2.3.4", "300.1.2.3", "+1 (524) 555-5024", "a.b@c.de", "x@y", " ", ".", "-", "7"]), max_size=8).map("".join))
def test_base_spans_equal_the_patterns_on_joined_pieces(text):
    assert pii.base_spans(text) == plain(text)


def test_long_texts_take_linear_time():
    mixed = "a.b@c.de 4111 1111 1111 1111 9876543210123 " * 4000
    began = time.time()
    assert len(pii.candidates(mixed, pii.base_spans(mixed))) == 4000 and time.time() - began < 10
    for t in ("a" * 200_000, "1" * 200_000, "@" * 100_000, "+1" + "(" * 100_000, "1." * 50_000, "a@" * 50_000):
        pii.spans_of(t, pii.train([]))


def test_em_prefers_the_reliable_labelers():
    good, bad = (1, 1, 1, 1, 1, 1), (0, 0, -1, -1, 0, -1)
    model = pii.train([("secret", good, 900), ("secret", (1, -1, 1, 1, 1, -1), 60), ("number", bad, 2000), ("number", (0, 0, -1, 0, 1, 0), 500)])
    assert model.accepts("secret", good) and not model.accepts("number", bad)
    assert all(0 < a < 1 and 0 < b < 1 for a, b in model.reliability)


def test_find_and_redact(spark):
    texts = [None, "", "write a.b@mail.example.com or +1 (524) 555-5024", 'token = "0401e44b4045d5b7fc925af2d5b1396433e9ee50" 1.2.3.4', "é 0919255729746466 x 4111 1111 1111 1111", "no data here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(df)
    out = by_id(df.select("doc_id", pii.find(F.col("text"), model).alias("f"), pii.redact(F.col("text"), model).alias("clean")))
    for k, t in enumerate(texts):
        f, base = out[k][0].f, plain(t or "")
        listed = ",".join(f"{kind}:{a}:{b}" for kind in pii.BASE for a, b in base[kind])
        assert (f.n_email, f.n_ip, f.n_card, f.n_phone) == tuple(len(base[kind]) for kind in pii.BASE)
        assert f.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(f.spans.split(","))
    assert "secret:9:49" in out[3][0].f.spans and out[3][0].clean == 'token = "<SECRET>" <IP>'
    assert out[4][0].clean == "é <NUMBER> x <CARD>" and out[2][0].clean == "write <EMAIL> or <PHONE>"
    assert out[0][0].clean is None and out[5][0].clean == "no data here"


def test_no_length_is_too_long():
    kinds = lambda t: [(k, b - a) for k, a, b, _ in pii.candidates(t, pii.base_spans(t))]
    assert kinds("x 1" + "a1" * 200) == [("secret", 401)]
    assert kinds("mr " + "Z" * 90) == [("name", 90)] and kinds("7" * 60) == [("number", 60)]


def test_numbers_and_secrets_are_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = docs.select(pii.find(F.col("text"), pii.fit(docs)).alias("f")).select("f.*").toPandas()
    spans = out["spans"].str.split(",").explode()
    assert (out["n_spans"] == out["spans"].map(lambda s: len(s.split(",")) if s else 0)).all()
    assert spans.str.startswith("secret:").sum() > 5 and spans.str.startswith("number:").sum() > 5


def test_empty(no_docs):
    model = pii.fit(no_docs)
    assert no_docs.select(pii.find(F.col("text"), model)).collect() == []
