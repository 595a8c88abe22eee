"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text are grown into small boosted trees; every path from a root to a node becomes a
conjunctive rule over the statistics; a lasso logistic fit leaves few rules with a weight; and those are
compiled into one Spark column expression, so scoring stays in generated code.

The fit takes at most ``MAX_FIT_ROWS`` labelled rows (those of the least id hashes, so reruns agree); scoring
covers every row. Labels, language, source and id are not statistics.

Defined results: null and empty texts have statistics of zero and a score like any other; rows with a null
label or id are not learnt from, of several labels of one id the largest counts, and of several texts of one id the
least; with labels of one class (or none) every score is that class's share (one half); very long texts are read whole;
rows repeated score alike; an empty table gives an empty one; input columns named like a new one are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash60, map_texts
from .quality_rules import SYMBOLS, repeated_window_words

#: Bound of the sample that the classifier is fitted on.
MAX_FIT_ROWS = 20_000
FOLDS = 5
TREES, DEPTH, RATE, MIN_LEAF = 40, 3, 0.3, 20
BINS = 48
LASSO = 1e-3
STEPS = 400

STATISTICS = (
    "log_words", "word_length", "symbols", "pipes", "dup_lines", "repeats", "upper", "digits", "points", "distinct_words",
    "top_word", "log_lines", "words_a_line", "longest_word", "beyond_ascii", "short_lines", "worst_window",
)

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_POINTS = b".,;:!?\"'()-"
_HIGH = bytes(range(128, 256))
#: Words of a window of which the least varied counts.
STRETCH = 50


def statistics_of(text: bytes | None) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    words = (text or b"").split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, size = len(words), len(text)
    letters = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda chars: (size - len(text.translate(None, chars))) / letters
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    stretches = [len(set(words[k : k + STRETCH])) / len(words[k : k + STRETCH]) for k in range(0, max(1, n - STRETCH // 2), STRETCH)]
    return (
        math.log1p(n), letters / n, share(SYMBOLS.encode()) * letters / n, text.count(b"|") / n, 1 - len(set(lines)) / len(lines),
        repeated_window_words(words) / n, share(_UPPER), share(_DIGITS), share(_POINTS), len(counts) / n,
        max(counts.values()) / n, math.log1p(len(lines)), n / len(lines), float(max(map(len, words))), share(_HIGH),
        sum(len(x) < 20 for x in lines) / len(lines), min(stretches),
    )


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics of each whole text."""

    def make():
        return lambda texts: [np.array(v).tolist() for v in zip(*map(statistics_of, texts))] if texts else [[] for _ in STATISTICS]

    return map_texts(docs, {n: T.DoubleType() for n in STATISTICS}, make, text, keep)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, bound): ``statistic > bound`` if above, else ``<= bound``."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def sql(self) -> str:
        return " and ".join(f"`{s}` {'>' if above else '<='} {bound!r}D" for s, above, bound in self.terms)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        total = " + ".join([f"({self.intercept!r}D)", *(f"(case when {r.sql()} then {r.weight!r}D else 0D end)" for r in self.rules)])
        return F.expr(f"1D / (1D + exp(-({total})))")


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple | float:
    """A node: (feature, bin, left, right), rows with a bin of up to ``bin`` to the left; a leaf: its value."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = float(-total_g / (total_h + 1.0))
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return leaf
    best, at = 1e-6, None
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        left_g = np.cumsum(np.bincount(b, g[rows], BINS + 1))[:-1]
        left_h = np.cumsum(np.bincount(b, h[rows], BINS + 1))[:-1]
        left_n = np.cumsum(np.bincount(b, minlength=BINS + 1))[:-1]
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
        gain[(left_n < MIN_LEAF) | (len(rows) - left_n < MIN_LEAF)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, at = gain[k], (f, k)
    if at is None:
        return leaf
    goes_left = binned[rows, at[0]] <= at[1]
    return (*at, _grow(binned, g, h, rows[goes_left], depth - 1), _grow(binned, g, h, rows[~goes_left], depth - 1))


def _values(tree, binned: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(binned), tree)
    f, k, left, right = tree
    return np.where(binned[:, f] <= k, _values(left, binned), _values(right, binned))


def _paths(tree, so_far: tuple = ()):
    if isinstance(tree, tuple):
        f, k, left, right = tree
        for above, child in ((False, left), (True, right)):
            path = (*so_far, (f, above, k))
            yield path
            yield from _paths(child, path)


def _holds(path: tuple, binned: np.ndarray) -> np.ndarray:
    out = np.ones(len(binned), bool)
    for f, above, k in path:
        out &= (binned[:, f] > k) if above else (binned[:, f] <= k)
    return out


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute penalty, by accelerated proximal gradient steps; the intercept is free."""
    n, m = x.shape
    bound = 0.25 * float(np.linalg.norm(np.c_[x, np.ones(n, np.float32)].T @ np.c_[x, np.ones(n, np.float32)] / n, 2))
    step = 1 / bound
    w, b = np.zeros(m), math.log(y.mean() / (1 - y.mean()))
    v, c, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(x @ v + c))) - y
        moved = v - step * (x.T @ r) / n
        w_new, b_new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), c - step * r.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """An ensemble for rows of ``STATISTICS`` and labels of 0 and 1."""
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1 or len(y) < 4 * MIN_LEAF:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble(math.log(share / (1 - share)), ())
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], axis=1)
    margin, rows = np.full(len(y), math.log(share / (1 - share))), np.arange(len(y))
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, p - y, p * (1 - p), rows, DEPTH)
        margin += RATE * _values(tree, binned)
        paths |= dict.fromkeys(_paths(tree))
    by_rows: dict[bytes, tuple] = {}
    for path in sorted(paths, key=len):  # of rules that hold for the same rows the shortest stays
        holds = _holds(path, binned)
        if all(k < len(bounds[f]) for f, _, k in path) and MIN_LEAF <= holds.sum() <= len(y) - MIN_LEAF:
            by_rows.setdefault(np.packbits(holds).tobytes(), path)
    if not by_rows:
        return Ensemble(math.log(share / (1 - share)), ())
    held = np.stack([_holds(p, binned) for p in by_rows.values()], axis=1).astype(np.float32)
    intercept, weights = _lasso(held, y.astype(np.float64), LASSO)
    rules = [
        Rule(tuple((STATISTICS[f], above, float(bounds[f][k])) for f, above, k in path), float(w))
        for path, w in zip(by_rows.values(), weights)
        if abs(w) > 1e-4
    ]
    return Ensemble(intercept, tuple(rules))


def fold(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo ``FOLDS``; fold 0 is held out (a null id is not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(1))


def labelled_sample(labels: DataFrame, label: str, rows: int, per_class: bool = False) -> DataFrame:
    """At most ``rows`` (doc_id, label) outside the held-out fold (of each class if asked), those of least id hashes."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max(label).alias("label"))
    pick = lambda part: part.orderBy(hash60(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    return pick(usable.where("label = 0")).unionByName(pick(usable.where("label = 1"))) if per_class else pick(usable)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Ensemble:
    """Fit on the statistics of at most ``max_rows`` labelled documents; only those reach the driver."""
    sample = F.broadcast(labelled_sample(labels, label, max_rows))  # bounded by max_rows
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(sample, "doc_id")
    rows = statistics(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), keep=["doc_id", "label"])
    got = rows.orderBy("doc_id").select("label", *STATISTICS).toArrow()
    x = np.stack([got.column(n).to_numpy() for n in STATISTICS], axis=1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, got.column("label").to_numpy().astype(np.float64))


def classify(docs: DataFrame, model: Ensemble, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; the statistics are dropped again."""
    scored = statistics(docs, text, keep).withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*STATISTICS)
