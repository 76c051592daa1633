"""Quality rules: a decision list learned by sequential covering over text statistics, applied as ordered Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_udf
from .hashing import word_identities, word_windows, words_in

#: Words in a window of the repetition statistic.
WINDOW = 5
#: Labelled rows that the list is fitted on, at most; they are those with the least hash of their id.
FIT_ROWS = 20_000
STATS = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, n_lines: long, n_upper: long, n_lower: long, n_digits: long, n_marks: long, n_same_words: long>"
#: Share of base rejections; contract of the base rule.
LEAST_WORDS, MOST_REPEATED = 10, 20

_SYMBOL, _UPPER, _LOWER, _DIGIT, _MARK, _START = (np.zeros(256, bool) for _ in range(6))
for _table, _bytes in ((_SYMBOL, b"#*$%&|<>"), (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, b"abcdefghijklmnopqrstuvwxyz"), (_DIGIT, b"0123456789"), (_MARK, b"!?")):
    _table[list(_bytes)] = True
_START[:128] = _START[192:] = True
_CLASS = np.zeros(256, np.uint8)
for _bit, _table in enumerate((_SYMBOL, _UPPER, _LOWER, _DIGIT, _MARK, _START)):
    _CLASS[_table] |= 1 << _bit


def text_stats(text: str) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = words_in(data)
    n = len(starts)
    by_class = np.bincount(_CLASS[data], minlength=64)
    count = lambda bit: int(by_class[(np.arange(64) >> bit & 1) == 1].sum())
    spaces = len(data) - int((ends - starts).sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeated = same = 0
    if n > 1:
        words = word_identities(data, starts, ends)
        same = int((words[:, 1:] == words[:, :-1]).all(axis=0).sum())
        if n > WINDOW:
            one, two = word_windows(words, WINDOW)
            order = np.argsort(one, kind="stable")
            equal = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
            twice = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
            if len(twice):
                edge = np.zeros(n + 1, np.int32)
                edge[twice] += 1
                edge[twice + WINDOW] -= 1
                repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return (n, count(5) - spaces, count(0), len(lines) - len(set(lines)), repeated, len(lines), count(1), count(2), count(3), count(4), same)


NAMES = [x.split(":")[0].strip() for x in STATS[7:-1].split(",")]


def stats(text: Column) -> Column:
    """A struct of the statistics of a text; null text is one without words."""

    def of(texts: list[str | None]) -> pa.Array:
        rows = [text_stats(x or "") for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(NAMES))], names=NAMES)

    return text_udf(of, STATS)(text.cast("string"))


#: Features that rules may bound, as SQL over the statistics. Ratios of nothing are 0.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_upper + n_lower, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "same": "n_same_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '>=' or '<=', threshold) that rejects; precision and covered are over the rows it was pruned on."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float = 0.0
    covered: int = 0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, bound in self.terms:
            out &= x[name] >= bound if sign == ">=" else x[name] <= bound
        return out

    def column(self, stat: str = "") -> Column:
        cond = F.lit(True)
        for name, sign, bound in self.terms:
            value = feature(name, stat)
            cond = cond & ((value >= F.lit(bound)) if sign == ">=" else (value <= F.lit(bound)))
        return cond


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self, stat: str = "") -> Column:
        """True to keep: the first rule that holds rejects, else the row stays. One conditional expression, in the rules' order."""
        out = None
        for r in self.rules:
            out = F.when(r.column(stat), F.lit(False)) if out is None else out.when(r.column(stat), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for r in self.rules:
            out |= r.holds(x)
        return out


def feature(name: str, stat: str = "") -> Column:
    import re

    sql = FEATURES[name]
    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"{stat}.\1", sql) if stat else sql).cast("double")


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained for each rejected row that stays covered."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[tuple[str, str, float]]:
    terms: list[tuple[str, str, float]] = []
    live = np.ones(len(bad), bool)
    while len(terms) < most and (p0 := int((live & bad).sum())) and (n0 := int((live & ~bad).sum())):
        best = (1e-9, None)
        for name, bounds in cuts.items():
            at = np.searchsorted(bounds, x[name][live], "right")  # how many bounds are <= x
            below = np.searchsorted(bounds, x[name][live], "left")  # how many are < x
            kinds = bad[live]
            for sign, index in ((">=", at), ("<=", below)):
                pos, neg = (np.bincount(index[k], minlength=len(bounds) + 1) for k in (kinds, ~kinds))
                if sign == ">=":
                    p, n = p0 - np.cumsum(pos)[:-1], n0 - np.cumsum(neg)[:-1]
                else:
                    p, n = np.cumsum(pos)[:-1], np.cumsum(neg)[:-1]
                gains = _gain(p, n, p0, n0)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (float(gains[k]), (name, sign, float(bounds[k])))
        if best[1] is None:
            break
        terms.append(best[1])
        live &= Rule((best[1],)).holds(x)
    return terms


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, least_precision: float = 0.95, least_covered: int = 5, most_terms: int = 4, most_rules: int = 16, seed: int = 9) -> DecisionList:
    """Sequential covering: grow a conjunction by information gain on two thirds of the rows, drop its last terms while (p - n) / (p + n) on the other
    third doesn't fall, keep it if it is precise there and over all rows, remove what it covers, go on. An empty list keeps everything."""
    found: list[Rule] = []
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 101))) for k, v in x.items()} if len(bad) else {}
    grow = np.random.Generator(np.random.PCG64(seed)).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    while len(found) < most_rules and (left & grow & bad).sum() >= least_covered:
        a, b = left & grow, left & ~grow
        terms = _grow({k: v[a] for k, v in x.items()}, bad[a], cuts, most_terms)
        if not terms:
            break
        xb, worth = {k: v[b] for k, v in x.items()}, []
        for m in range(1, len(terms) + 1):
            held = Rule(tuple(terms[:m])).holds(xb)
            p, n = int((held & bad[b]).sum()), int((held & ~bad[b]).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, -m))
        m = -max(worth)[1]
        rule = Rule(tuple(terms[:m]))
        held = rule.holds(x) & left
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        if max(worth)[0] < 2 * least_precision - 1 or p + n < least_covered or p < least_precision * (p + n):
            break
        found.append(Rule(rule.terms, p / (p + n), p + n))
        left &= ~held
    return DecisionList(found)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **how) -> DecisionList:
    """A list fitted on at most `rows` labelled documents. Labels without an id or quality don't count, repeated ones are averaged (0.5 is good); no labels or no documents give an
    empty list. Of rows that share an id the one with the least text counts. Rows that the base rule rejects anyway teach nothing and are left out."""
    rated = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.avg("quality") < 0.5).alias("bad"))
    sample = rated.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)  # at most `rows` rows: a proven bound for the broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "label_id")
    once = own.groupBy("label_id", "bad").agg(F.min("text").alias("text"))
    seen = once.select("bad", stats(F.col("text")).alias("s")).where(~base_failed("s")).select("bad", *(feature(k, "s").alias(k) for k in FEATURES)).toPandas()
    return learn({k: seen[k].to_numpy(np.float64) for k in FEATURES}, seen["bad"].to_numpy(bool), **how)


def base_failed(stat: str = "") -> Column:
    at = f"{stat}." if stat else ""
    return F.expr(f"{at}n_words < {LEAST_WORDS} or 100 * {at}n_repeat_words > {MOST_REPEATED} * {at}n_words")


def judge(docs: DataFrame, rules: DecisionList, name: str = "judged") -> DataFrame:
    """docs with the columns of STATS, base_failed and kept added in a struct called `name`; null text has no words, so it fails the base rule. Repeated rows are judged each, and an
    empty table gives an empty result. Other columns stay, a column of that name is replaced."""
    seen = docs.withColumn(name, stats(F.col("text")))
    return seen.withColumn(name, F.struct(f"{name}.*", base_failed(name).alias("base_failed"), (~base_failed(name) & rules.verdict(name)).alias("kept")))
