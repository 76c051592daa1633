"""Personal data by weak supervision: labelers vote on candidate spans, EM estimates how reliable each is, a span classifier is trained on the result."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_udf

#: The kinds in the order of the results. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "number", "name")
BASE = KINDS[:4]
#: What stands near personal data, by kind. A small gazetteer in the corpus's languages.
GAZETTEER = {
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "auth", "bearer", "credential"),
    "number": ("account", "konto", "cuenta", "compte", "iban", "ssn", "passport", "pasaporte", "passeport", "card", "karte", "tarjeta", "carte", "customer"),
    "name": ("mr", "mrs", "ms", "dr", "herr", "frau", "monsieur", "madame", "mme", "señor", "señora", "sr", "sra", "prof"),
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HEX = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{20,}+")
_TITLE = re.compile(r"\b(?:" + "|".join(sorted((re.escape(t) for t in GAZETTEER["name"]), key=len, reverse=True)) + r")\.?[ ]+([^\W\d_]{2,}+(?:[ ]+[^\W\d_]{2,}+)?)", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: a match's local part is the whole run before it, so time is linear in any text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL_CHARS:
            low -= 1
        nxt = at + 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((low, m.end()))
            done = nxt = m.end()
        else:
            done = at + 1
        at = text.find("@", nxt)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]


def runs(text: str) -> list[tuple[int, int, str]]:
    """Digit runs with single spaces or dashes between digits, two digits at least, and their digits."""
    return [(m.start(), m.end(), m.group().replace(" ", "").replace("-", "")) for m in _CARD.finditer(text)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The four base kinds by their patterns; each is leftmost and non-overlapping of its own, failing matches are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGITS.search(text):
        out["ip"] = ips(text) if text.count(".") > 2 else []
        out["card"] = [(a, b) for a, b, d in runs(text) if 13 <= len(d) <= 19 and luhn(d)]
        out["phone"] = phones(text) if "+" in text else []
    return out


#: Labelers: each says 1 (personal), 0 (not) or -1 (abstains) on a candidate.
LABELERS = ("pattern", "gazetteer", "context", "entropy", "length", "neighbour")


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) for spans beside the base ones: secrets, long numbers and names, of any length. Spans that overlap a base span are left to it."""
    starts, ends = _disjoint(sorted(s for own in base.values() for s in own))
    free = lambda a, b: (k := bisect_left(ends, a + 1)) == len(ends) or starts[k] >= b  # noqa: E731  the first taken span that ends after a
    found = []
    if _DIGITS.search(text):
        for m in _HEX.finditer(text):
            if free(*m.span()) and any(c.isdigit() for c in m.group()) and any(c.isalpha() for c in m.group()):
                found.append(("secret", *m.span()))
        for a, b, d in runs(text):
            if len(d) >= 9 and free(a, b) and (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()):
                found.append(("number", a, b))
    if _TITLE.search(text):
        found += [("name", m.start(1), m.end(1)) for m in _TITLE.finditer(text) if m.group(1)[0].isupper() and free(*m.span(1))]
    out = []
    for kind, a, b in found:
        lowered = text[max(0, a - 32) : a].lower()
        body = text[a:b]
        distinct = len(set(body))
        digits = sum(map(str.isdigit, body))
        near = re.findall(r"[^\W\d]+", lowered)
        votes = (
            1 if kind == "name" or kind == "secret" and re.fullmatch(r"[0-9A-Fa-f]{32,}", body) or kind == "number" and 13 <= digits <= 19 else -1 if kind == "secret" else 0,
            1 if any(w in GAZETTEER[kind] for w in near) else -1,
            1 if re.search(r"[=:]\s*[\"']?\Z", lowered) else 0 if kind == "secret" else -1,
            (1 if distinct >= 10 else 0) if kind == "secret" else (0 if distinct <= 2 else 1 if kind == "number" and distinct >= 5 else -1),
            1 if (len(body) >= 32 if kind == "secret" else digits >= 13 if kind == "number" else len(body) <= 40) else 0,
            1 if text[b : b + 1] in "\"'" and b < len(text) else -1 if kind != "number" else 0 if near and near[-1] in ("version", "page", "no") else -1,
        )
        out.append((kind, a, b, votes))
    return out


def _disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs that sorted spans cover."""
    starts, ends = [], []
    for a, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


@dataclass(frozen=True)
class Model:
    """reliability: for each labeler, P(says 1 | personal) and P(says 1 | not); weights: of the span classifier over the kind and the votes."""

    prior: float
    reliability: tuple[tuple[float, float], ...]
    weights: tuple[float, ...]

    def accepts(self, kind: str, votes: tuple[int, ...]) -> bool:
        return float(np.dot(self.weights, design([kind], np.array([votes]))[0])) > 0


def design(kinds: list[str], votes: np.ndarray) -> np.ndarray:
    """Features of the span classifier: a constant, the kind, and for each labeler whether it says 1 and whether it says 0."""
    one_hot = np.array([[k == x for x in KINDS[4:]] for k in kinds], float).reshape(len(kinds), -1)
    return np.hstack([np.ones((len(kinds), 1)), one_hot, votes == 1, votes == 0]).astype(float)


def train(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> Model:
    """EM on (kind, votes, how often): posteriors from the labelers' reliabilities, reliabilities from posteriors, with smoothing; then logistic regression
    on the posteriors. The input is one row for each kind and vote pattern, 3 x 3^6 at most, and stands for every candidate of the corpus."""
    if not patterns:
        return Model(0.5, tuple((0.5, 0.5) for _ in LABELERS), (-1.0,) + (0.0,) * (len(KINDS) - 4 + 2 * len(LABELERS)))
    kinds = [k for k, _, _ in patterns]
    votes, times = np.array([v for _, v, _ in patterns]), np.array([n for _, _, n in patterns], float)
    said, yes = votes >= 0, votes == 1
    post = (yes.sum(1) + 1) / (said.sum(1) + 2)
    for _ in range(rounds):
        w = np.stack([post, 1 - post]) * times
        prior = float(np.clip((w[0].sum() + 1) / (times.sum() + 2), 0.02, 0.98))
        rate = np.stack([((w[c][:, None] * yes).sum(0) + (2.0, 1.0)[c]) / ((w[c][:, None] * said).sum(0) + 3.0) for c in (0, 1)])
        rate = np.clip(rate, 0.02, 0.98)
        logs = [np.log(p) + (np.where(yes, np.log(rate[c]), np.log(1 - rate[c])) * said).sum(1) for c, p in ((0, prior), (1, 1 - prior))]
        post = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    x, weights = design(kinds, votes), None
    weights = np.zeros(x.shape[1])
    scale = times / times.sum()
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grad = x.T @ (scale * (p - post)) + 1e-3 * weights
        weights -= np.linalg.solve(x.T @ (x * (scale * p * (1 - p))[:, None]) + 1e-3 * np.eye(x.shape[1]), grad)
    return Model(prior, tuple((float(rate[0][k]), float(rate[1][k])) for k in range(len(LABELERS))), tuple(weights))


def fit(docs: DataFrame) -> Model:
    """A model from the votes on every candidate of every document, counted by pattern in each text and then in Spark. Repeated rows count each; null texts and empty tables give
    no candidates, and a model without any accepts none."""

    def voted(texts: list[str | None]) -> pa.Array:
        seen = [Counter(f"{k}:{','.join(map(str, v))}" for k, _, _, v in candidates(x, base_spans(x))) if x else {} for x in texts]
        cuts = np.cumsum([0, *map(len, seen)])
        pairs = pa.StructArray.from_arrays([pa.array([p for c in seen for p in c], pa.string()), pa.array([n for c in seen for n in c.values()], pa.int64())], names=["p", "n"])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)

    some = docs.where(F.col("text").rlike("[0-9]") | F.col("text").rlike(_TITLE_SQL))
    votes = text_udf(voted, "array<struct<p: string, n: long>>")(F.col("text").cast("string"))
    found = []
    for row in some.select(F.inline(votes)).groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():  # at most 3 x 3^6 rows
        kind, own = row["p"].split(":")
        found.append((kind, tuple(int(v) for v in own.split(",")), row["n"]))
    return train(found)


_TITLE_SQL = "(?iu)(" + "|".join(GAZETTEER["name"]) + r")\.? +\p{L}"


def spans_of(text: str, model: Model) -> dict[str, list[tuple[int, int]]]:
    """Every span by kind: the base ones as they are, and the candidates that the classifier accepts."""
    out = base_spans(text)
    for k in KINDS[4:]:
        out[k] = []
    for kind, a, b, votes in candidates(text, out):
        if model.accepts(kind, votes):
            out[kind].append((a, b))
    return {k: sorted(v) for k, v in out.items()}


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans.get(k, ()))


FOUND = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_spans: long>"


def find(text: Column, model: Model) -> Column:
    """A struct of base counts, the digest of the base spans, all spans as kind:start:end (code points, end exclusive), and their number. Null text has none."""

    def found(texts: list[str | None]) -> pa.Array:
        out = []
        for x in texts:
            s = spans_of(x or "", model)
            out.append((*(len(s[k]) for k in BASE), hashlib.sha256(listed(s, BASE).encode()).hexdigest(), listed(s, KINDS), sum(map(len, s.values()))))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return text_udf(found, FOUND)(text.cast("string"))


def redact_text(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """text with each span replaced by its kind in angle brackets; spans that overlap are one, under the kind listed first."""
    flat = sorted((a, KINDS.index(k), b) for k, own in spans.items() for a, b in own)
    parts, at, k = [], 0, 0
    while k < len(flat):
        a, kind, b = flat[k]
        k += 1
        while k < len(flat) and flat[k][0] < b:
            kind, b, k = min(kind, flat[k][1]), max(b, flat[k][2]), k + 1
        parts += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join([*parts, text[at:]])


def redact(text: Column, model: Model) -> Column:
    """The text without its personal data; null stays null."""

    def clean(texts: list[str | None]) -> pa.Array:
        return pa.array([None if x is None else redact_text(x, spans_of(x, model)) for x in texts], pa.string())

    return text_udf(clean, "string")(text.cast("string"))
