"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of its lower-cased characters (runs of white space are one blank), each
present or not, named by a 32-bit hash. On labelled text the ratio of a feature is the logarithm of its smoothed share
among toxic documents over that among the others. Every n-gram whose shares differ by ``EVIDENCE`` standard errors is
kept, however many there are, and a logistic fit to a gradient of ``TOLERANCE`` weighs presence times ratio. A score needs
one table of weights, so scoring is one pass over the texts.

The fit takes at most ``MAX_CLASS_ROWS`` labelled rows of each class (those of the least id hashes, so reruns
agree), which also bounds the n-grams; scoring covers every row. Labels, language, source and id are not features.

Defined results: null, empty and very short texts have no n-grams and the score of the intercept; very long texts are
read whole; rows with a null label or id are not learnt from, of several labels of one id the largest counts, and of several
texts of one id the least; with labels of one class (or none) every score is 0 (or 1, if all are toxic); rows repeated
score alike; an empty table gives an empty one; input columns named like a new one are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_importable, give_back, map_texts, write_table
from .rule_ensemble import labelled_sample

#: Bound of the fit: labelled rows of a class.
MAX_CLASS_ROWS = 6_000
SIZES = (3, 4, 5)
EVIDENCE = 4.0
SMOOTHING = 1.0
RIDGE = 0.003
TOLERANCE = 1e-4
MAX_STEPS = 200
#: Hashes are looked up by their leading bits first.
TABLE_BITS = 20
#: Hashes that a task counts at once.
COUNTED = 2_000_000
#: Tasks that count the sample's n-grams.
COUNT_TASKS = 8
_MULTIPLIER = np.uint32(0x9E3779B1)
_BLANKS = re.compile(r"\s+")


def ngrams(text: str, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """Hashes of a text's character n-grams, an array per size; with repeats."""
    chars = np.frombuffer(_BLANKS.sub(" ", f" {text.lower()} ").encode("utf-32-le", "replace"), np.uint32)
    if not text:
        return
    for n in sizes:
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n, np.uint32)
            for k in range(n):
                h *= _MULTIPLIER
                h += chars[k : len(chars) - n + 1 + k]
            h ^= h >> np.uint32(15)
            h *= _MULTIPLIER
            yield h


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _distinct(text: str) -> np.ndarray:
    found = list(ngrams(text))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Classifier:
    """Intercept, and the weight (logistic weight times ratio) of each kept n-gram, by ascending hashes."""

    intercept: float
    hashes: tuple[int, ...]
    weights: tuple[float, ...]


class Scorer:
    def __init__(self, model: Classifier):
        self.intercept = model.intercept
        self.hashes = np.array(model.hashes, np.uint32)
        self.weights = np.array(model.weights, np.float64)
        self.shift = np.uint32(32 - TABLE_BITS)
        self.likely = np.zeros(1 << TABLE_BITS, bool)
        self.likely[self.hashes >> self.shift] = True

    def present(self, text: str) -> np.ndarray:
        """Places of the kept n-grams that a text has."""
        found = [h[self.likely[h >> self.shift]] for h in ngrams(text)]
        if not found or not len(self.hashes):
            return np.zeros(0, np.int64)
        asked = np.unique(np.concatenate(found))
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        return at[self.hashes[at] == asked]

    def margin(self, text: str) -> float:
        return float(self.intercept + self.weights[self.present(text)].sum())


def _counts(sample: DataFrame) -> DataFrame:
    """(hash, others, toxic): documents of each class with the n-gram."""
    ensure_importable(sample.sparkSession)

    def counted(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        both = [np.unique(np.concatenate(f), return_counts=True) if f else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for f in found]
        hashes = np.union1d(both[0][0], both[1][0])
        counts = np.zeros((2, len(hashes)), np.int64)
        for k, (h, n) in enumerate(both):
            counts[k][np.searchsorted(hashes, h)] = n
        return pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(counts[0]), pa.array(counts[1])], names=["hash", "others", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [[], []], 0
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = _distinct(text or "")
                found[int(label)].append(h)
                size += len(h)
                if size > COUNTED:
                    yield counted(found)
                    found, size = [[], []], 0
        yield counted(found)
        del found
        give_back()

    rows = sample.select("text", F.col("label").cast("int")).repartition(COUNT_TASKS)
    return rows.mapInArrow(run, "hash long, others long, toxic long").groupBy("hash").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))


def _ratio(others: float, toxic: float) -> str:
    """SQL for the smoothed log-count ratio of an n-gram."""
    return f"ln((toxic + {SMOOTHING}D) / ({toxic + 2 * SMOOTHING}D)) - ln((others + {SMOOTHING}D) / ({others + 2 * SMOOTHING}D))"


def _standard_errors(others: float, toxic: float) -> str:
    """SQL for the difference of an n-gram's shares, in standard errors of a common share."""
    share = f"((toxic + others + {SMOOTHING}D) / {others + toxic + 2 * SMOOTHING}D)"
    return f"abs(toxic / {float(toxic)}D - others / {float(others)}D) / sqrt({share} * (1 - {share}) * {1 / others + 1 / toxic!r}D)"


def _minimum(value_and_gradient, x: np.ndarray, memory: int = 8) -> np.ndarray:
    """The minimum of a smooth convex function, by limited-memory quasi-Newton steps with halving."""
    f, g = value_and_gradient(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MAX_STEPS):
        if np.abs(g).max() <= TOLERANCE:
            break
        q, scales = g.copy(), []
        for s, y in reversed(pairs):
            scales.append((s @ q) / (s @ y))
            q -= scales[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(pairs, reversed(scales)):
            q += (a - (y @ q) / (s @ y)) * s
        size, slope = 1.0, -(q @ g)
        while True:
            after, g_after = value_and_gradient(x - size * q)
            if after <= f + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, y = -size * q, g_after - g
        x, f, g = x + s, after, g_after
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        if size < 1e-8:
            break
    return x


def _logistic(starts: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights with a squared penalty for rows that hold ``scale[c]`` at their ``columns``; both classes weigh alike."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts))
    values = scale[columns]

    def value_and_gradient(x: np.ndarray) -> tuple[float, np.ndarray]:
        b, w = x[0], x[1:]
        margin = np.bincount(rows, values * w[columns], len(y)) + b
        r = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) * weight
        loss = (weight * np.logaddexp(0, np.where(y == 1, -margin, margin))).sum() + RIDGE / 2 * (w @ w)
        return float(loss), np.concatenate([[r.sum()], np.bincount(columns, values * r[rows], len(scale)) + RIDGE * w])

    found = _minimum(value_and_gradient, np.zeros(len(scale) + 1))
    return float(found[0]), found[1:]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_CLASS_ROWS) -> Classifier:
    """Fit on at most ``max_rows`` labelled documents of each class; kept n-grams and where they are present reach the driver."""
    picked = F.broadcast(labelled_sample(labels, label, max_rows, per_class=True))  # bounded by 2 * max_rows
    joined = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(picked, "doc_id")
    sample = joined.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = write_table(sample, "toxicity-sample")  # read three times below
    sizes = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    others, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not others or not toxic:
        return Classifier(30.0 if toxic else -30.0, (), ())
    kept = _counts(sample).where(F.expr(_standard_errors(others, toxic)) >= EVIDENCE).select("hash", F.expr(_ratio(others, toxic)).alias("ratio")).orderBy("hash").toArrow()
    hashes, ratios = kept.column("hash").to_numpy(), kept.column("ratio").to_numpy()
    shipped = docs.sparkSession.sparkContext.broadcast(Classifier(0.0, tuple(hashes.tolist()), (1.0,) * len(hashes)))

    def make():
        scorer = Scorer(shipped.value)
        return lambda texts: [[scorer.present(_text(t)).tolist() for t in texts]]

    rows = map_texts(sample, {"present": T.ArrayType(T.IntegerType())}, make, keep=["doc_id", "label"]).orderBy("doc_id").select("label", "present").toArrow()
    present = rows.column("present").combine_chunks()
    starts = present.offsets.to_numpy().astype(np.int64)
    columns = present.values.to_numpy()[starts[0] : starts[-1]]
    b, w = _logistic(starts - starts[0], columns, ratios, rows.column("label").to_numpy().astype(np.float64))
    return Classifier(float(b), tuple(hashes.tolist()), tuple((w * ratios).tolist()))


def classify(docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shipped.value)
        return lambda texts: [[1 / (1 + math.exp(-max(-700.0, min(700.0, scorer.margin(_text(t)))))) for t in texts]]

    return map_texts(docs, {"score": T.DoubleType()}, make, text, keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
