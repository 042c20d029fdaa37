"""Quality scores by a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import id_in, id_out, text_in
from siftline.session import materialize

SAMPLE = 30_000
FOLDS = 5
CUT = 0.3


def _share_gone(text: Column, pattern: str) -> Column:
    n = F.char_length(text)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text; 0 for an empty one."""
    n = F.char_length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    count = F.size(words)
    per = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    # The characters of words that equal the word before them, with the gap between; a looping regex would recurse.
    gaps = F.split(text, r"\S+")
    again = F.zip_with(words, F.slice(words, 2, count), lambda w, after: F.when(w == after, F.char_length(after)))
    again = F.zip_with(again, F.slice(gaps, 2, F.size(gaps)), lambda c, gap: F.coalesce(c + F.char_length(gap), F.lit(0)))
    repeated = F.aggregate(again, F.lit(0), lambda x, y: x + y)
    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_length": per(F.char_length(F.array_join(words, "")), count),
        "distinct_words": per(F.size(F.array_distinct(words)), count),
        "repeats": per(repeated, n),
        "capitals": _share_gone(text, r"\p{Lu}+"),
        "digits": _share_gone(text, r"\p{Nd}+"),
        "signs": _share_gone(text, r"[^\p{L}\p{Nd}\s.,;:'\"()?-]+"),
        "points": _share_gone(text, r"[.?]+"),
        "commas": _share_gone(text, r"[,;:]+"),
        "blanks": _share_gone(text, r"\s+"),
        "lines": per(F.char_length(F.regexp_replace(text, r"[^\n]+", "")), count),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds (statistic, above or not, bound)."""

    bounds: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, bound in self.bounds:
            out &= (x[:, i] > bound) == above
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for i, above, bound in self.bounds:
            out = out & ((F.col(names[i]) > bound) if above else (F.col(names[i]) <= bound))
        return out


def _tree(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on ``residual``: the paths to all its nodes, and its predictions."""
    rules, fitted = [], np.zeros(len(x))

    def grow(rows: np.ndarray, bounds: tuple) -> None:
        fitted[rows] = residual[rows].mean()
        if bounds:
            rules.append(Rule(bounds))
        if len(bounds) == depth or len(rows) < 2 * least:
            return
        best, total = (1e-9, None), residual[rows].sum()
        for i, edges in enumerate(cuts):
            if not len(edges):
                continue
            place = np.searchsorted(edges, x[rows, i])
            n = np.cumsum(np.bincount(place, minlength=len(edges) + 1))[:-1]
            s = np.cumsum(np.bincount(place, residual[rows], len(edges) + 1))[:-1]
            fine = (n >= least) & (len(rows) - n >= least)
            gain = np.where(fine, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), -np.inf)
            gain -= total**2 / len(rows)
            if gain.max() > best[0]:
                best = (gain.max(), (i, float(edges[gain.argmax()])))
        if best[1]:
            i, bound = best[1]
            above = x[rows, i] > bound
            grow(rows[~above], (*bounds, (i, False, bound)))
            grow(rows[above], (*bounds, (i, True, bound)))

    grow(np.arange(len(x)), ())
    return rules, fitted


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 500) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    full = np.hstack([np.ones((len(x), 1)), x])
    rate = 4.0 * len(x) / max(1e-9, np.linalg.norm(full, 2) ** 2)
    w = np.zeros(full.shape[1])
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        step = ahead - rate * (full.T @ (_sigmoid(full @ ahead) - y)) / len(y)
        step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = step + (before - 1) / t * (step - w), step
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleModel:
    names: list[str]
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def score(self) -> Column:
        """The score as an expression over the statistics' columns."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            z = z + F.when(rule.column(self.names), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, penalty: float = 1e-3) -> RuleModel:
    """Boost small trees, take every path as a rule, and keep the rules that the lasso gives weight.

    Without rows, or with one label only, the score is a constant.
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(names, float(np.log(share / (1 - share))), [], [])
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 99))) for c in x.T]
    z, rules, least = np.zeros(len(y)), [], max(1, len(y) // 200)
    for _ in range(trees):
        paths, fitted = _tree(x, cuts, y - _sigmoid(z), depth, least)
        z += 2.0 * fitted
        rules += paths
    rules = list(dict.fromkeys(rules))
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso_logistic(held, y, penalty)
    chosen = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel(names, intercept, [rules[i] for i in chosen], [float(weights[i]) for i in chosen])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Statistics are Column functions of the whole text and are written once.
    Rules are fitted on at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of their id, and
    compiled to one expression that scores every row. Null and empty texts have
    statistics 0 and a score like any other; null ids and labels teach nothing, and a
    null id comes back as null, held out if the hash of "" says so; of several labels
    of a document the smallest counts; repeated rows are scored each; an empty
    table gives an empty one, and without labels the score is a constant.
    """
    names = list(statistics(F.lit("")))
    rows = docs.select(id_in("doc_id").alias("doc_id"), text_in().alias("text"))
    rows = materialize(rows.select("doc_id", *[c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()]), "statistics")
    taught = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    taught = taught.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = rows.dropDuplicates(["doc_id"]).join(taught, "doc_id").select("quality", "doc_id", *names)
    # Few more than the sample pass the hash, so the final cut does not gather a sample from every task.
    share = min(1.0, 1.1 * sample / max(1, taught.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).drop("doc_id").collect()
    data = np.array([tuple(r) for r in some], float).reshape(len(some), len(names) + 1)
    model = fit_rules(data[:, 1:], data[:, 0], names)
    scored = rows.select("doc_id", model.score().alias("score"))
    own = F.coalesce(F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")).cast("string"), F.lit(""))
    return scored.select(
        id_out("doc_id"), held_out(own).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
