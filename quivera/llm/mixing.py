"""Mixing sources to target weights by nested hash-threshold histograms.

A document's place is a 60-bit hash of its id. Sizes are summed by source and leading hash bits; the bucket in
which a source's budget runs out is found from running sums over those buckets, and only its documents are
summed again by their next bits, until it holds a single hash. What is left is a threshold per source, and
taking a document is a filter: no sort and no exchange of documents. DataFrame operations only.

Targets: a share of all sizes is dealt to the sources by weight; a source stops at ``max_repeats`` times its
size and the excess is dealt again by weight. A target above a source's size takes every document once (or
more) and the rest by threshold.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of one
id share one fate, as do rows repeated; a table without words has targets of 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash60, n_words_column, write_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
HASH_BITS = 60
#: Bits a level: at most 2**LEVEL_BITS buckets a source in any histogram.
LEVEL_BITS = 12
#: Tables of one row per source are broadcast up to this many sources; beyond it joins are exchanges.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h): all that mixing needs of a document, in one pass over the texts."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        n_words_column(text).alias("size"),
        hash60(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target. Works on one row per source."""
    cycle = "array(" + ",".join(map(str, weights)) + ")"
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.selectExpr("source", "source_size", "row_number() over (order by source asc nulls last) - 1 as place").selectExpr(
        "source", "source_size", "place", f"cast({cycle}[cast(place % {len(weights)} as int)] as double) as weight", f"cast({max_repeats} * source_size as double) as most"
    )
    # Sources fill up in the order of most / weight; the first level at which no further source is full holds for all.
    by_fill = ranked.selectExpr(
        "*",
        "row_number() over (order by most / weight, place) as fill",
        f"{share!r}D * sum(source_size) over () as whole",
        "sum(weight) over () as all_weights",
        "sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding) as full_before",
        "sum(weight) over (order by most / weight, place rows between unbounded preceding and 1 preceding) as weight_before",
    ).selectExpr("*", "(whole - coalesce(full_before, 0D)) / (all_weights - coalesce(weight_before, 0D)) as level")
    levelled = by_fill.selectExpr("*", "(min(case when level * weight <= most then struct(fill, level) end) over ()).level as common")
    return levelled.selectExpr("source", "source_size", "case when common is null or common * weight > most then most else common * weight end as target")


def _joined(big: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    small = per_source.withColumnRenamed("source", "__q_source")
    small = F.broadcast(small) if n_sources <= BROADCAST_SOURCES else small
    return big.join(small, F.col("source").eqNullSafe(F.col("__q_source"))).drop("__q_source")


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): documents of the source with ``h < cut`` fill its budget as nearly as whole documents can.

    ``budgets``: (source, budget), a written table of one row per source. A level sums only the documents of the
    buckets that the last one left open; sums and bounds stay in DataFrames.
    """
    n_sources = budgets.count()
    found: DataFrame | None = None
    open_ = budgets.selectExpr("source", "cast(budget as double) as left_over", "0L as prefix")
    bits = 0
    while True:
        bits = min(bits + LEVEL_BITS, HASH_BITS)
        above, below = HASH_BITS - min(bits, HASH_BITS), min(LEVEL_BITS, bits)
        inside = _joined(sizes, open_, n_sources)
        if bits > LEVEL_BITS:
            inside = inside.where(F.shiftright("h", above + below) == F.col("prefix"))
        buckets = inside.groupBy("source", "left_over", F.shiftright("h", above).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last")
        )
        sums = buckets.selectExpr("*", "sum(size) over (partition by source order by bucket) as up_to")
        # The first bucket that does not fit is open; where all fit, the cut lies behind the last.
        edge = sums.groupBy("source", "left_over").agg(
            F.min(F.when(F.col("up_to") > F.col("left_over"), F.struct("bucket", "size", "up_to", "first", "last"))).alias("e"),
            F.max("bucket").alias("end"),
        )
        level = write_table(
            edge.selectExpr(
                "source", "e is null or e.first = e.last as done", "e.bucket as prefix", "left_over - (e.up_to - e.size) as left_over",
                f"case when e is null then shiftleft(end + 1, {above}) when 2 * (left_over - (e.up_to - e.size)) >= e.size then e.first + 1 else e.first end as cut",
            ),
            "mix-level",
        )
        part = level.where("done").select("source", "cut")
        found = part if found is None else found.unionByName(part)
        if bits >= HASH_BITS or level.where("not done").isEmpty():
            return found
        open_ = level.where("not done").select("source", "left_over", "prefix")


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (a written table of ``sized``) with source_size, target, times and taken = times * size."""
    goal = write_table(targets(sizes, weights, share, max_repeats), "mix-targets")
    whole = "case when source_size > 0 then least(floor(target / source_size), 1000000) else 0 end"
    goal = goal.selectExpr("*", f"cast({whole} as int) as whole_times")
    cuts = thresholds(sizes, goal.selectExpr("source", "target - whole_times * source_size as budget"))
    n_sources = goal.count()
    cut = cuts.withColumnRenamed("source", "_cut_source")
    plan = goal.join(cut, F.col("source").eqNullSafe(F.col("_cut_source")), "left").drop("_cut_source")
    plan = write_table(plan.selectExpr("source", "source_size", "target", "whole_times", "coalesce(cut, 0L) as cut"), "mix-plan")
    return (
        _joined(sizes, plan, n_sources)
        .withColumn("times", F.expr(f"case when source_size = 0 then 0 else least(whole_times + cast(h < cut as int), {max_repeats}) end"))
        .withColumn("taken", F.expr("cast(times * size as long)"))
        .drop("whole_times", "cut")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them.

    The decision is a join of one row per source and a comparison of the id's hash, so texts are not exchanged.
    """
    sizes = write_table(sized(docs), "mix-sizes")
    goal = mix(sizes)
    per_source = write_table(
        goal.groupBy("source").agg(F.min("times").alias("__q_least"), F.max(F.when(F.col("times") == 2, F.col("h"))).alias("__q_h2"), F.max(F.when(F.col("times") == 1, F.col("h"))).alias("__q_h1")),
        "mix-sources",
    ).withColumnRenamed("source", "__q_source")
    columns = docs.columns
    per_source = F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source
    h = hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    times = F.when(h <= F.coalesce("__q_h2", F.lit(-1)), 2).when(h <= F.coalesce("__q_h1", F.lit(-1)), 1).otherwise(F.col("__q_least"))
    joined = docs.join(per_source, F.col("source").eqNullSafe(F.col("__q_source")))
    return joined.select(*columns, F.explode(F.expr("sequence(1, 2)")).alias("__q_copy"), times.alias("__q_times")).where("__q_copy <= __q_times").select(*columns)
