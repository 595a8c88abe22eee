"""Quality rules with adaptive thresholds.

Every document is measured over its whole text. The measures of a (language, source) group go into mergeable
quantile sketches: logarithmic buckets of a fixed relative width (``ACCURACY``), kept as one row a bucket, so
that partial aggregation merges them before any exchange and a hot group never meets in one task. Measures are ratios
or odds with a small count added, so that a text without a symbol still has a place by its length and a group's spread
is never zero for want of symbols.

From a group's quartiles, in buckets (that is on a logarithmic scale), come Tukey fences: no fence has a constant part. The
quartiles of a group are drawn towards those of its language, and those of a language towards all, with the weight of
``PRIOR_ROWS`` rows, so small groups need no switch to another sketch. A document outside a fence of its own group fails,
unless it has none of what the rule counts.

Defined results: a null or empty text has no words and fails the base rule; null languages and sources are
groups of their own; very long texts are measured whole; a measure on a fence (a tie) is inside; repeated rows are
measured alike and count each; an empty table gives no thresholds and no rows; input columns named like a new one are
replaced.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

MEASURES = {n: T.LongType() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")}

#: Relative accuracy of a sketch, and so the ratio of neighbouring bucket bounds.
ACCURACY = 0.002
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)

#: Rule: (measure as a SQL expression over decimals, sides fenced, width of the fence in interquartile ranges, what it
#: counts: a document with none of it is inside).
RULES = {
    "symbols": ("(n_symbols + 1D) / (n_words + 20)", "high", 3.0, "n_symbols"),
    "dup_lines": ("(n_dup_lines + 0.5D) / (n_lines - n_dup_lines + 0.5D)", "high", 1.25, "n_dup_lines"),
    "repeats": ("(n_repeat_words + 0.5D) / (n_words - n_repeat_words + 0.5D)", "high", 2.5, "n_repeat_words"),
    "word_length": ("(word_chars + 100D) / (n_words + 20)", "both", 4.0, "n_words"),
}
#: Rows that the wider group's quartiles weigh.
PRIOR_ROWS = 50
#: Thresholds of up to this many groups are broadcast; beyond it the join is an exchange.
BROADCAST_GROUPS = 50_000


def repeated_window_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by ``width``-word windows that occur twice or more (exact: windows compare by content)."""
    n = len(words)
    if n <= width:
        return 0
    ids = np.array(list(map({}.setdefault, words, count())), dtype=np.int64)
    windows, covered = ids, 1
    while covered < width:  # pairs of runs, renumbered to below n, so the product fits in 64 bits
        step = min(covered, width - covered)
        windows = windows[: len(windows) - step] * n + windows[step:]
        covered += step
        if covered < width:
            windows = np.unique(windows, return_inverse=True)[1]
    in_order = np.sort(windows)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    hits = np.flatnonzero(np.isin(windows, twice))
    seen = np.zeros(n, dtype=bool)
    for k in range(width):
        seen[hits + k] = True
    return int(seen.sum())


def measure_text(text: bytes | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    blanks = sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(text.count(s.encode()) for s in SYMBOLS)
    return len(words), len(text.decode("utf-8", "replace")) - blanks, symbols, len(lines) - len(set(lines)), repeated_window_words(words), len(lines)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the measures of each whole text."""

    def make():
        return lambda texts: list(map(list, zip(*map(measure_text, texts)))) if texts else [[] for _ in MEASURES]

    return map_texts(docs, MEASURES, make, text, keep).withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    )


def _bucket(value: str) -> str:
    return f"cast(ceil(ln({value}) / {math.log(GAMMA)!r}D) as int)"


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Sketch buckets (lang, source, rule, bucket, n) of the documents with words."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(_bucket(e)).alias("bucket")) for r, (e, *_) in RULES.items()])
    return (
        measured.where("n_words > 0")
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p"))
        .groupBy("lang", "source", "p.rule", "p.bucket")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, rule, total, first and third quartile as buckets) of the sketches merged by ``keys``."""
    part = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    spread = "partition by " + ", ".join([*keys, "rule"])
    sums = part.selectExpr("*", f"sum(n) over ({spread} order by bucket) as up_to", f"sum(n) over ({spread}) as total")
    return sums.groupBy(*[F.col(k).alias(f"{k}_{name}") for k in keys], F.col("rule").alias(f"rule_{name}")).agg(
        F.max("total").cast("double").alias(f"n_{name}"),
        F.expr("min(case when 4 * up_to >= total then bucket end)").cast("double").alias(f"q1_{name}"),
        F.expr("min(case when 4 * up_to >= 3 * total then bucket end)").cast("double").alias(f"q3_{name}"),
    )


def thresholds(sketch: DataFrame, rules: dict = RULES, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Low and high fences in buckets, one row per (lang, source) with columns <rule>_low and <rule>_high.

    Works on sketch buckets only: their number follows groups and accuracy, not documents.
    """
    own, by_lang, overall = _quartiles(sketch, ["lang", "source"], "own"), _quartiles(sketch, ["lang"], "lang"), _quartiles(sketch, [], "all")
    joined = own.join(by_lang, F.col("lang_own").eqNullSafe(F.col("lang_lang")) & (F.col("rule_own") == F.col("rule_lang"))).join(
        overall, F.col("rule_own") == F.col("rule_all")
    )
    w = f"{float(prior_rows)!r}D"
    drawn = joined.selectExpr("*", *[f"(n_lang * {q}_lang + {w} * {q}_all) / (n_lang + {w}) as {q}_wide" for q in ("q1", "q3")])
    drawn = drawn.selectExpr("*", *[f"(n_own * {q}_own + {w} * {q}_wide) / (n_own + {w}) as {q}" for q in ("q1", "q3")])
    width = "case rule_own " + " ".join(f"when '{r}' then {f!r}D" for r, (_, _, f, _) in rules.items()) + " end"
    both = ", ".join(f"'{r}'" for r, (_, s, _, _) in rules.items() if s == "both")
    fences = drawn.selectExpr(
        "lang_own as lang", "source_own as source", "rule_own as rule",
        f"case when rule_own in ({both}) then q1 - {width} * (q3 - q1) else double('-infinity') end as low",
        f"q3 + {width} * (q3 - q1) as high",
    )
    return fences.groupBy("lang", "source").pivot("rule", list(rules)).agg(F.first("low").alias("low"), F.first("high").alias("high"))


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``kept``: inside every fence of its own group and not failed by the base rule.

    ``limits`` should be a written table: it is counted once, and broadcast only up to ``BROADCAST_GROUPS`` rows.
    """
    fences = [f"{r}_{side}" for r in RULES for side in ("low", "high")]
    small = limits.select(F.col("lang").alias("__q_lang"), F.col("source").alias("__q_source"), *[F.col(f).alias(f"__q_{f}") for f in fences])
    if limits.count() <= BROADCAST_GROUPS:
        small = F.broadcast(small)
    on = F.col(lang).eqNullSafe(F.col("__q_lang")) & F.col(source).eqNullSafe(F.col("__q_source"))
    inside = " and ".join(f"({count} = 0 or {_bucket(e)} between __q_{r}_low and __q_{r}_high)" for r, (e, _, _, count) in RULES.items())
    verdict = F.expr(f"not base_failed and coalesce({inside}, false)")
    return measured.join(small, on, "left").withColumn("kept", verdict).drop("__q_lang", "__q_source", *[f"__q_{f}" for f in fences])
