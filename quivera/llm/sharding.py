"""Sharding into shards of near-equal bytes by histogram sort, with equal texts together.

Groups of equal texts between ``HEAVY`` of a mean shard and a whole one are few (their number follows shards, not the
table); they are dealt whole, the largest first, forth and back over the shards. Everything else is ordered by a hash of
its text, then by a hash of its id, so that equal texts are neighbours, and each shard takes from that order what it
lacks to the common level. The splitters of the order are found without sorting: exact bytes below candidate
boundaries are counted across all partitions, and only the intervals that still hold a wanted splitter get finer
candidates, until each holds one text or, within a group of copies larger than a shard, one id. A smaller group is not
cut: it goes to the side that its middle is on. Every shard is cut into ``ranges`` ranges in the same way; documents are then
exchanged once, by range, and numbered there, so that no task gets more than a range. DataFrame operations only.

Law: ``bytes``. Equal texts share a shard unless they alone are larger than a mean shard. Defined results: a null text
has size 16 and no CRC (null), and all null texts are one group; an empty text is one like any other; rows repeated
with one id and text stay together; an empty table gives an empty result; input columns beyond id and text are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, write_table

SHARDS = 40
#: Bytes that a document counts besides its text.
OVERHEAD = 16
#: Ranges a shard is numbered in (a power of two); more of them mean smaller tasks.
RANGES = 8
#: A group of equal texts above this part of a mean shard is dealt by itself: SHARDS / HEAVY groups at most.
HEAVY = 0.002
HASH_BITS, LEVEL_BITS, DIGIT_BITS = 60, 12, 8
LAW = "bytes"


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2): all that sharding needs of a document."""
    t, i = F.col(text), F.col(doc_id).cast("string")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"),
        F.when(t.isNull(), F.lit(0)).otherwise(hash60(t)).cast("long").alias("k1"),
        hash60(F.coalesce(i, F.lit(""))).alias("k2"),
    )


def _values(spark, rows: list[tuple[int, ...]], names: str) -> DataFrame:
    """A small table of whole numbers, as part of the plan."""
    return spark.sql("select * from values " + ",".join("(" + ",".join(f"{x}L" for x in r) + ")" for r in rows) + f" as t({names})")


#: (splitter, group, twice its position in bytes from the group's start)
Wanted = list[tuple[int, int, int]]
#: splitter -> (group, key, bytes of the group below the key, bytes of the key)
Found = dict[int, tuple[int, int, int, int]]


def _locate(rows: DataFrame, wanted: Wanted) -> Found:
    """The key that each wanted position falls into. ``rows``: (g, key, size).

    A level sums the bytes of 2**LEVEL_BITS buckets in each interval that still holds a wanted splitter and picks the
    bucket of each by running sums, so that one row a splitter comes to the driver.
    """
    spark, found = rows.sparkSession, {}
    open_ = [(j, g, 0, twice, 0) for j, g, twice in wanted]  # splitter, group, prefix, twice the position from the interval's start, start
    bits = 0
    while open_:
        bits = min(bits + LEVEL_BITS, HASH_BITS)
        above, width = HASH_BITS - bits, min(LEVEL_BITS, bits)
        prefix = F.shiftright("key", above + width)
        intervals = sorted({(g, p) for _, g, p, _, _ in open_})
        inside = rows.withColumn("p", prefix)
        if len(intervals) == 1:
            inside = inside.where((F.col("g") == intervals[0][0]) & (F.col("p") == intervals[0][1]))
        else:
            inside = inside.join(F.broadcast(_values(spark, intervals, "g, p")), ["g", "p"])
        buckets = inside.groupBy("g", "p", F.shiftright("key", above).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last")
        )
        order = Window.partitionBy("g", "p").orderBy("bucket")
        sums = buckets.withColumn("up_to", F.sum("size").over(order)).withColumn("is_last", F.lead("bucket").over(order).isNull())
        asked = _values(spark, open_, "j, g, p, twice, start")
        hit = sums.join(F.broadcast(asked), ["g", "p"]).where("2 * up_to > twice or is_last")
        hit = hit.groupBy("j", "g", "twice", "start").agg(F.min_by(F.struct("bucket", "size", "up_to", "first", "last"), "bucket").alias("b")).collect()
        open_ = []
        for r in hit:
            below = r["b"]["up_to"] - r["b"]["size"]
            if r["b"]["first"] == r["b"]["last"]:
                found[r["j"]] = (r["g"], r["b"]["first"], r["start"] + below, r["b"]["size"])
            else:
                open_.append((r["j"], r["g"], r["b"]["bucket"], r["twice"] - 2 * below, r["start"] + below))
    return found


def splitters(keys: DataFrame, positions: list[int], whole: float) -> list[tuple[int, int]]:
    """An ascending key (k1, k2) for each position in bytes: a document's part is the number of keys up to its own.

    A group of equal texts of up to ``whole`` bytes is not cut.
    """
    place = {j: 2 * p for j, p in enumerate(positions)}
    if not place:
        return []
    texts = _locate(keys.select(F.lit(0).cast("long").alias("g"), F.col("k1").alias("key"), "size"), [(j, 0, t) for j, t in place.items()])
    cut, large = {}, []
    for j, (_, k1, start, size) in texts.items():
        if size > whole:
            large.append((j, k1, place[j] - 2 * start))
        else:
            cut[j] = (k1, 0) if 2 * start + size >= place[j] else (k1 + 1, 0)
    if large:
        ids = keys.where(F.col("k1").isin(sorted({k1 for _, k1, _ in large}))).select(F.col("k1").alias("g"), F.col("k2").alias("key"), "size")
        twice = {j: t for j, _, t in large}
        for j, (k1, k2, start, size) in _locate(ids, large).items():
            cut[j] = (k1, k2) if 2 * start + size >= twice[j] else (k1, k2 + 1)
    return [cut[j] for j in sorted(cut)]


def _ranged(keys: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """``keys`` with ``_range``, the number of cuts up to a row's key.

    A join with one row per range and leading digit of k1 that it covers: 2**DIGIT_BITS + ranges rows at most.
    """
    ends = [(0, 0), *cuts, (1 << HASH_BITS, 0)]
    shift = HASH_BITS - DIGIT_BITS
    rows = []
    for part, ((lo1, lo2), (hi1, hi2)) in enumerate(zip(ends, ends[1:])):
        if (lo1, lo2) < (hi1, hi2):
            rows += [(d, part, lo1, lo2, hi1, hi2) for d in range(lo1 >> shift, min((hi1 >> shift) + 1, 1 << DIGIT_BITS))]
    table = _values(keys.sparkSession, rows, "_digit, _range, _lo1, _lo2, _hi1, _hi2")
    inside = F.expr("(k1 > _lo1 or k1 = _lo1 and k2 >= _lo2) and (k1 < _hi1 or k1 = _hi1 and k2 < _hi2)")
    joined = keys.join(F.broadcast(table), (F.shiftright("k1", shift) == F.col("_digit")) & inside)
    return joined.drop("_digit", "_lo1", "_lo2", "_hi1", "_hi2")


def heavy_groups(keys: DataFrame, shards: int, heavy: float) -> tuple[DataFrame, int]:
    """((k1, bytes, rank, shard) of the groups that are dealt by themselves, bytes of all), the former written."""
    by_text = keys.groupBy("k1").agg(F.sum("size").alias("bytes"))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = by_text.where((F.col("bytes") * shards > heavy * total) & (F.col("bytes") * shards <= total))
    rank = F.row_number().over(Window.orderBy(F.desc("bytes"), "k1")) - 1  # shards / heavy rows at most
    turn = F.expr(f"rank % {2 * shards}")
    shard_of = F.when(turn < shards, turn).otherwise(2 * shards - 1 - turn)
    return write_table(found.withColumn("rank", rank).withColumn("shard", shard_of.cast("long")), "shard-heavy"), total


def budgets(heavy: list[int], rest: int) -> list[int]:
    """What each shard takes of the rest, so that shards below a common level reach it."""
    rising = sorted(heavy)
    level, below = 0, 0
    for k, h in enumerate(rising, 1):
        below += h
        level = -(-(rest + below) // k)
        if k == len(rising) or level <= rising[k]:
            break
    return [max(0, level - h) for h in heavy]


def shard(keys: DataFrame, shards: int = SHARDS, ranges: int = RANGES, heavy: float = HEAVY) -> DataFrame:
    """``keys`` (a written table of ``keyed``, or one with more columns) with law, shard, slot and grown_shard."""
    groups, total = heavy_groups(keys, shards, heavy)
    dealt = {r["shard"]: r["b"] for r in groups.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # one row a shard
    own = [dealt.get(s, 0) for s in range(shards)]
    positions, at = [], 0
    for budget in budgets(own, total - sum(own)):
        positions += [at + budget * r // ranges for r in range(ranges)]
        at += budget
    by_itself = groups.select(F.col("k1").alias("_k1"), F.col("rank").alias("_rank"), F.col("shard").alias("_shard"))
    ours = keys.join(F.broadcast(by_itself), F.col("k1") == F.col("_k1"), "left").drop("_k1")
    stream = write_table(ours.where("_rank is null").drop("_rank", "_shard"), "shard-stream")
    cuts = splitters(stream, positions[1:], total / shards) if total > sum(own) else []
    ranged = _ranged(stream, cuts).selectExpr("*", f"_range div {ranges} as _shard", "-1L as _rank", f"_range % {ranges} as _part")
    # A heavy group is numbered in parts by the leading bits of its ids' hashes.
    digits = (ranges - 1).bit_length()
    whole = ours.where("_rank is not null").select("*", F.shiftright("k2", HASH_BITS - digits).alias("_part"))
    rows = write_table(ranged.drop("_range").unionByName(whole), "shard-rows")
    counts = rows.groupBy("_shard", "_rank", "_part").agg(F.count("*").alias("_n"))
    place = Window.partitionBy("_shard").orderBy("_rank", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_shard", "_rank", "_part", F.coalesce(F.sum("_n").over(place), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_shard", "_rank", "_part").orderBy("k1", "k2", "doc_id"))
    return (
        rows.join(F.broadcast(offsets), ["_shard", "_rank", "_part"])
        .withColumn("slot", number + F.col("_before") - 1)
        .withColumn("shard", F.col("_shard").cast("int"))
        .withColumn("law", F.lit(LAW))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("_shard", "_rank", "_part", "_before")
    )
