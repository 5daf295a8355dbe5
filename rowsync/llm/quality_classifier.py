"""Quality classifier: a sparse rule ensemble, learned on the driver from a bounded sample and compiled to columns.

Statistics of a text are DataFrame expressions. Small boosted trees over a sample of labelled rows give rules, the
conjunctions along their paths; logistic regression with an L1 penalty weighs them; rules with a weight become one
column expression that scores every text without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, table, text_or_empty

#: Labelled rows that are learned from at most: those with the least hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 40, 3, 32, 0.3, 10
#: Penalty on a rule's weight, per row.
PENALTY = 0.002
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; none of them reads anything but the text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words, rows = F.split(text, r"[ \n]", -1), F.split(text, "\n", -1)
    upper, symbols, digits, stops = without(UPPER), without("#*$%&|<>"), without("0123456789"), without(".,!?")
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "upper": upper / n,
        "symbols": symbols / n,
        "digits": digits / n,
        "stops": stops / n,
        "bangs": without("!") / n,
        "bars": without("|") / n,
        "word_chars": n / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "line_words": F.size(words) / F.size(rows),
        "distinct_lines": F.size(F.array_distinct(rows)) / F.size(rows),
    }


@dataclass
class Rule:
    """A conjunction of (statistic, "<=" or ">", threshold) and its weight."""

    terms: tuple[tuple[str, str, float], ...]
    weight: float = 0.0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = True
        for name, op, t in self.terms:
            out = out & (x[name] <= t if op == "<=" else x[name] > t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, t in self.terms:
            c = F.col(f"__stat.{name}")
            out = out & (c <= t if op == "<=" else c > t)
        return out


def _grow(bins: np.ndarray, edges: list[np.ndarray], names: list[str], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: np.ndarray, rules: set) -> None:
    """Grow one tree on the rows; write its leaf values to ``out`` and every node's path to ``rules``."""
    if path:
        rules.add(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best, base = None, g * g / (h + 1)
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(edges[f]) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - base
            gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
            k = int(np.argmax(gain))
            if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k)
    if best is None:
        out[rows] = -g / (h + 1)
        return
    _, f, k = best
    left = bins[rows, f] <= k
    for side, op in ((rows[left], "<="), (rows[~left], ">")):
        _grow(bins, edges, names, grad, hess, side, depth - 1, (*path, (names[f], op, float(edges[f][k]))), out, rules)


def learn(x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, list[Rule]]:
    """(intercept, rules with a weight) from statistics and labels 0 or 1; no rules where labels don't differ."""
    names, y = sorted(x), y.astype(float)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return start, []
    edges = [np.unique(np.quantile(x[n], np.linspace(0, 1, BINS + 1)[1:-1])) for n in names]
    bins = np.array([np.searchsorted(e, x[n], side="left") for e, n in zip(edges, names, strict=True)]).T
    f, rules, rows = np.full(len(y), start), set(), np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        _grow(bins, edges, names, p - y, p * (1 - p), rows, DEPTH, (), step, rules)
        f += RATE * step
    ordered = [Rule(r) for r in sorted(rules)]
    z = np.array([r.holds(x) for r in ordered], float).T
    mean = z.mean(0)
    z -= mean
    w, b = _lasso(z, y, start)
    kept = [Rule(r.terms, float(v)) for r, v in zip(ordered, w, strict=True) if v]
    return b - float(w @ mean), kept


def _lasso(z: np.ndarray, y: np.ndarray, start: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient steps."""
    n, m = z.shape
    v = np.ones(m)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= max(1e-12, np.linalg.norm(v))
    rate = 1 / max(0.25 * np.linalg.norm(z @ v) ** 2 / n + 0.25, 1e-6)
    w, b, pw, pb, t = np.zeros(m), start, np.zeros(m), start, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ pw + pb)))
        nw = pw - rate * (z.T @ (p - y) / n)
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - rate * PENALTY)
        nb = pb - rate * float((p - y).mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def compiled(intercept: float, rules: list[Rule]) -> Column:
    """The score, 0 to 1, over a struct column ``__stat`` of statistics."""
    total = F.lit(intercept)
    for r in rules:
        total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _with_statistics(df: DataFrame, keep: list[Column]) -> DataFrame:
    return df.select(*keep, F.struct(*[c.alias(n) for n, c in statistics(F.col("text")).items()]).alias("__stat"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[float, list[Rule]]:
    """Learn from at most ``sample_rows`` labelled ids that aren't held out.

    Null labels and ids are left out. An id that is labelled several times has its greatest label, one that several
    documents have counts once, with the least of their statistics. Without labelled documents, or with labels that
    don't differ, there are no rules and every score is the share of label 1 (a half without any).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y"))
    chosen = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__id2"), text_or_empty("text").alias("text")).join(F.broadcast(chosen), F.col("__id") == F.col("__id2"))
    each = _with_statistics(rows, [F.col("__id"), F.col("__y")]).groupBy("__id", "__y").agg(F.min("__stat").alias("__stat"))
    got = each.select("__id", "__y", "__stat.*").toPandas().sort_values("__id", kind="stable")
    names = list(statistics(F.lit("")))
    return learn({n: got[n].to_numpy(float) for n in names}, got["__y"].to_numpy())


def score(docs: DataFrame, intercept: float, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row for each input row, repeated ones too; other columns are not read, whatever their names.

    Null text counts as empty, whose statistics are zeros and ones. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return _with_statistics(rows, [F.col("id")]).select("id", compiled(intercept, rules).alias("score"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, *model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
