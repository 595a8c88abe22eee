"""SimHash near-duplicates with BK-trees.

Fingerprint: each 4-word shingle's XXH64 votes on 64 bits; a bit is set if over half the shingles have it set.
Two fingerprints link at ``RADIUS`` or fewer differing bits (``near_duplicates``).

Search: 64 bits are cut into one block more than the radius, so each linked pair has a block in common. Fingerprints
(distinct ones, copies have been folded) are dealt by block, and each such shard gets a BK-tree: a child hangs under its
parent by their Hamming distance, and a query follows the edges within the radius of its own distance only. One tree over
all fingerprints would be visited at a tenth of its nodes by each query (README), so trees are not broadcast
whole: a shard's tree is built where its queries are dealt. A shard of over ``SHARD_ROWS`` fingerprints is dealt again by
blocks of its other bits, ``LEVELS`` times at most; what is then still larger agrees in half of all bits, and is cut into
slices of which every pair is a shard. No task gets more than two slices, however hot the group. A shard emits one link per fingerprint that
joins an earlier one, not all pairs.

``near_similar`` links by similarity instead: texts whose sets of five-word shingles have a Jaccard similarity of 0.8
differ in 15 % of the bits, which is too far for blocks. It takes ``BITS`` bits, deals each fingerprint by the bits of
``TABLES`` samples of ``KEY_BITS`` bits, and a BK-tree a shard finds what differs in ``WIDE_RADIUS`` bits or fewer; a shard
that is too large is cut into slices of which every pair is compared. What samples miss an exact search finds
(``similar_texts``): all pairs of texts in different groups whose Jaccard similarity is ``SIMILAR`` or more. Shingles have
one order, rare ones first; similar texts share a shingle among the first fifth of theirs (prefix filtering); of those that
do the whole sets are compared, unless bitmaps show that too many shingles differ.

Components: alternating large-star and small-star steps over link tables in the shared folder.

Defined results: null and empty texts have fingerprint 0 and link like any other; very long texts are read whole; rows
repeated share their fingerprint and component; a null doc_id is never the smallest of its component unless all are null;
an empty table gives an empty one; only id and text are used, so other columns may have any name.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_importable, give_back, map_texts, write_table
from .components import components

WIDTH = 4
SEED = 42
RADIUS = 4
SHARD_ROWS = 4096
LEVELS = 3
#: The search by similarity: words of a shingle, bits of a fingerprint, differing bits, samples and their bits.
SIMILAR_WIDTH, BITS, WIDE_RADIUS, TABLES, KEY_BITS = 5, 256, 44, 80, 20
#: Ids of rows that go are broadcast up to this number (about 24 MB); beyond it the texts are exchanged for the join.
BROADCAST_IDS = 1_000_000
#: The least Jaccard similarity of the exact search, as a fraction.
SIMILAR = (4, 5)
#: The order of shingles comes from those that two texts share of a sample, one of so many texts, but of about so many
#: texts at least; the commonest so many shingles are broadcast (8 MB). Any order gives the same links; a common shingle
#: that it does not know costs time.
ORDER_STEP, ORDER_TEXTS, ORDER_SHINGLES = 12, 4_000, 500_000
#: Rows of a batch that a task makes, and distinct texts that it remembers so as not to read copies again.
MADE_ROWS, SEEN_TEXTS = 100_000, 100_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _votes(bits: np.ndarray) -> np.ndarray:
    """Column sums of an array of 0 and 1; runs of 255 rows are added in bytes."""
    whole = len(bits) // 255 * 255
    runs = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8)
    return runs.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def _more(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash."""
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; none without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")


def fingerprint_words(text: bytes | None, width: int = WIDTH, bits: int = 64) -> np.ndarray:
    """The fingerprint of a text as ``bits`` / 64 unsigned words."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return np.zeros(bits // 64, np.uint64)
    made = []
    for k in range(bits // 64):
        votes = np.zeros(64, np.int64)
        for at in range(0, n, 65536):
            part = hashes[at : at + 65536]
            votes += _votes(np.unpackbits((_more(part, k) if k else part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        made.append(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])
    return np.array(made, np.uint64)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number."""
    return int(fingerprint_words(text, width)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WIDTH, bits: int = 64) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as signed longs of the same bits: ``fp``, or ``fp0``, ``fp1``... """
    names = _columns(bits)

    def make():
        def work(texts):
            made = np.array([fingerprint_words(t, width, bits) for t in texts], np.uint64).reshape(-1, len(names)).view(np.int64)
            return [pa.array(np.ascontiguousarray(made[:, k])) for k in range(len(names))]

        return work

    return map_texts(docs, {n: T.LongType() for n in names}, make, text, keep)


def _columns(bits: int) -> list[str]:
    return ["fp"] if bits == 64 else [f"fp{k}" for k in range(bits // 64)]


class BKTree:
    """A tree over integers: ``children[node]`` maps a Hamming distance to the child at that distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node, values = 0, self.values
        if values:
            while True:
                d = (values[node] ^ value).bit_count()
                child = self.children[node].get(d)
                if child is None:
                    self.children[node][d] = len(values)
                    break
                node = child
        values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Values within ``radius``; only edges whose label is within it of the node's own distance are followed."""
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield self.values[node]
            for label, child in self.children[node].items():
                if d - radius <= label <= d + radius:
                    stack.append(child)


def link_shard(own: list[int], other: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links (as places in ``own`` + ``other``) that connect all within ``radius`` in ``own``, or between ``own`` and
    ``other`` if that is not empty."""
    tree, root = BKTree(), {}
    place = {v: k for k, v in enumerate([*own, *other])}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if other:
        for value in own:
            tree.add(value)
    for value in other or own:
        for hit in tree.near(value, radius):
            a, b = find(hit), find(value)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield place[hit], place[value]
        if not other:
            tree.add(value)


def link_slices(own: list[int], other: list[int], radius: int, words: int) -> Iterator[tuple[int, int]]:
    """As ``link_shard``, by comparing all pairs: at a wide radius a tree leaves hardly any out, and arrays are faster."""
    both = np.frombuffer(b"".join(v.to_bytes(8 * words, "little") for v in [*own, *other]), "<u8").reshape(-1, words)
    group = np.arange(len(both))
    for at in range(len(own) if other else 1, len(both)):
        upto = len(own) if other else at
        hits = np.flatnonzero(np.bitwise_count(both[:upto] ^ both[at]).sum(axis=1, dtype=np.int64) <= radius)
        for g in np.unique(group[hits]).tolist():
            if g != group[at]:
                yield int(hits[group[hits] == g][0]), at
                group[group == g] = group[at]


def _tree_links(work: DataFrame, names: list[str], radius: int, shard_rows: int | None) -> DataFrame:
    """(a, b, large): links of nodes by a BK-tree for each key of ``work`` (key, fingerprint, maybe ``first``); a row with
    ``large`` alone names a key of over ``shard_rows`` rows, which is left out. Rows whose ``first`` is false are searched
    in the others only."""
    ensure_importable(work.sparkSession)
    n = max(1, int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = "first" in work.columns
    # Order brings a shard's rows together, and makes reruns agree.
    work = work.select("key", *names, *(["first"] if split else []))
    work = work.repartition(n, "key").sortWithinPartitions("key", *names)
    ends = [f"{side}{k}" for side in "ab" for k in range(len(names))]
    size = 8 * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, other, over = None, [], [], False

        def flush(pairs, large):
            if over:
                large.append(at)
            elif len(own) + len(other) > 1 and own:
                both = own + other
                wide = split and len(names) > 1
                found = link_slices(own, other, radius, len(names)) if wide else link_shard(own, other, radius)
                pairs.extend((both[a], both[b]) for a, b in found)

        def batch_of(pairs, large):
            raw = b"".join(v.to_bytes(size, "little") for p in pairs for v in p)
            words = np.frombuffer(raw, "<i8").reshape(len(pairs), len(ends))
            none = [None] * len(large)
            return pa.RecordBatch.from_arrays(
                [pa.array([*words[:, k].tolist(), *none], pa.int64()) for k in range(len(ends))] + [pa.array([None] * len(pairs) + large, pa.int64())], names=[*ends, "large"]
            )

        for batch in batches:
            pairs, large = [], []
            keys = batch.column(0).to_pylist()
            first = batch.column(1 + len(names)).to_pylist() if split else None
            packed = np.stack([batch.column(1 + k).to_numpy() for k in range(len(names))], axis=1).astype("<i8").tobytes() if keys else b""
            for k, key in enumerate(keys):
                if key != at:
                    flush(pairs, large)
                    at, own, other, over = key, [], [], False
                if shard_rows is not None and len(own) >= shard_rows:
                    over = True
                else:
                    (own if first is None or first[k] else other).append(int.from_bytes(packed[k * size : (k + 1) * size], "little"))
            yield batch_of(pairs, large)
        pairs, large = [], []
        flush(pairs, large)
        yield batch_of(pairs, large)
        give_back()

    found = work.mapInArrow(run, ", ".join(f"{c} long" for c in [*ends, "large"]))
    a, b = (_node([f"{side}{k}" for k in range(len(names))]) for side in "ab")
    return found.select(F.when(F.col("a0").isNotNull(), F.least(a, b)).alias("a"), F.when(F.col("a0").isNotNull(), F.greatest(a, b)).alias("b"), "large").distinct()


def _node(names: list[str]) -> Column:
    """What names a fingerprint in links."""
    return F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)


def _sliced(rows: DataFrame, names: list[str], shard_rows: int) -> DataFrame:
    """Rows of large shards under a key for every pair of slices that theirs is in."""
    slices = rows.groupBy("key").agg(F.expr(f"cast(ceil(count(*) / {shard_rows}) as int)").alias("slices"))
    slice_of = F.pmod(F.xxhash64(*names), "slices").cast("int")
    both = rows.join(slices, "key").select("key", *names, slice_of.alias("s"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("o"))
    return both.select(F.xxhash64("key", F.least("s", "o"), F.greatest("s", "o")).alias("key"), *names, (F.col("s") <= F.col("o")).alias("first"))


def _searched(start: DataFrame, deal, levels: int, names: list[str], radius: int, shard_rows: int) -> DataFrame:
    """(a, b) found by trees; ``deal(rows, level)`` gives each row its keys, and rows of large shards are dealt again."""
    links, open_ = None, start
    for level in range(levels):
        found = write_table(_tree_links(deal(open_, level), names, radius, shard_rows), "simhash-found")
        part, large = found.where("large is null").select("a", "b"), found.where("large is not null").select(F.col("large").alias("key"))
        links = part if links is None else links.unionByName(part)
        if large.isEmpty():
            break
        rows = deal(open_, level).join(large, "key", "left_semi")
        if level == levels - 1:
            last = write_table(_tree_links(_sliced(rows, names, shard_rows), names, radius, None), "simhash-found")
            links = links.unionByName(last.select("a", "b"))
        else:
            open_ = write_table(rows, "simhash-open")
    return links.distinct()


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` blocks of nearly equal widths."""
    ends = [bits * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, levels: int = LEVELS) -> DataFrame:
    """(a, b): links between the distinct values of ``fps.fp`` whose components are those of all links."""

    def deal(rows: DataFrame, level: int) -> DataFrame:
        bits = 64
        for _ in range(level):  # what is left when the widest block is cut out
            bits -= min(w for _, w in _blocks(bits, radius + 1))
        made = []
        for k, (shift, width) in enumerate(_blocks(bits, radius + 1)):
            rest, mask = F.col("rest"), (1 << width) - 1
            value = F.shiftrightunsigned(rest, shift).bitwiseAND(mask)
            above = F.shiftleft(F.shiftrightunsigned(rest, shift + width), shift) if shift + width < 64 else F.lit(0).cast("long")
            below = rest.bitwiseAND((1 << shift) - 1) if shift else F.lit(0).cast("long")
            made.append(F.struct(F.xxhash64("key", F.lit(level * 64 + k), value).alias("key"), above.bitwiseOR(below).alias("rest")))
        return rows.select("fp", F.explode(F.array(*made)).alias("d")).select("fp", "d.key", "d.rest")

    start = fps.selectExpr("fp", "0L as key", "fp as rest")
    return _searched(start, deal, levels, ["fp"], radius, shard_rows)


def _deal_by_samples(rows: DataFrame, names: list[str], samples: list[list[int]]) -> DataFrame:
    """``rows`` (fingerprint, key) under a key for each sample of bits: the old key, the sample and its values."""
    ensure_importable(rows.sparkSession)
    schema = ", ".join(f"{n} long" for n in names) + ", key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.array(samples)
        weights = np.left_shift(np.uint64(1), np.arange(which.shape[1], dtype=np.uint64))
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names]
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy().view(np.uint64)
            packed = np.stack(columns, axis=1).astype("<i8").view(np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(packed, axis=1, bitorder="little")
            dealt = np.empty((batch.num_rows, len(which)), np.uint64)
            for k, sample in enumerate(which):
                values = (bits[:, sample].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                dealt[:, k] = _more(keys * np.uint64(0xC2B2AE3D27D4EB4F) + values, k + 1)
            arrays = [np.repeat(c, len(which)) for c in columns] + [dealt.reshape(-1).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[*names, "key"])
        give_back()

    return rows.select(*names, "key").mapInArrow(run, schema)


def similar_links(fps: DataFrame, bits: int = BITS, radius: int = WIDE_RADIUS, tables: int = TABLES, key_bits: int = KEY_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links between the nodes of ``fps`` (fp0, fp1...) that differ in ``radius`` bits or fewer and agree in
    all bits of a sample."""
    names, rng = _columns(bits), random.Random(SEED)
    samples = [rng.sample(range(bits), key_bits) for _ in range(tables)]

    def deal(rows: DataFrame, level: int) -> DataFrame:
        return _deal_by_samples(rows, names, samples)

    return _searched(fps.selectExpr(*names, "0L as key"), deal, 1, names, radius, shard_rows)


def _shingle_rows(rows: DataFrame, width: int, make, columns: list[str]) -> DataFrame:
    """``columns`` (longs) that ``make(t, hashes)`` gives as arrays for the set of shingles of each text of ``rows`` (t, text)."""
    ensure_importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[list[np.ndarray]] = []
        size = 0

        def batch_of():
            arrays = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(columns))]
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64, copy=False)) for a in arrays], names=columns)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for k, t in enumerate(batch.column(0).to_pylist()):
                if t in seen or not texts[k].is_valid:
                    continue
                if len(seen) >= SEEN_TEXTS:
                    seen.clear()
                seen.add(t)
                made = make(t, np.unique(shingle_hashes(texts[k].as_py(), width)).view(np.int64))
                parts.append(made)
                size += len(made[0])
                if size >= MADE_ROWS:
                    yield batch_of()
                    parts, size = [], 0
        yield batch_of()
        give_back()

    return rows.select("t", "text").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, ascending, and their places in the order (the commonest last)."""
    step = max(1, min(ORDER_STEP, rows.count() // ORDER_TEXTS))
    sample = _shingle_rows(rows.where(F.pmod("t", F.lit(step)) == 0), width, lambda t, s: [s], ["key"])
    counted = sample.groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(ORDER_SHINGLES)
    keys = counted.select("key").toArrow().column(0).to_numpy()
    order = np.argsort(keys)
    return keys[order], -order


def _prefixes(rows: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, t, n, at): the first shingles of each text, of which similar texts share one; ``n`` counts its shingles."""
    (p, q), shared = SIMILAR, rows.sparkSession.sparkContext.broadcast(common)

    def make(t, hashes):
        known, place = shared.value
        n = len(hashes)
        if len(known):
            found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hot = known[found] == hashes
            if hot.any():
                hashes = np.concatenate([hashes[~hot], hashes[hot][np.argsort(place[found[hot]])]])
        upto = n + (-p * n // q) + 1 if n else 0  # n - ceil(n * p / q) + 1
        return [hashes[:upto], np.full(upto, t), np.full(upto, n), np.arange(upto)]

    return _shingle_rows(rows, width, make, ["key", "t", "n", "at"])


def _may_be_similar(n, at, other_n, other_at):
    """Whether two texts whose first common shingle has these places can be similar; of numbers or arrays."""
    p, q = SIMILAR
    rest = np.minimum(n - at, other_n - other_at)
    return (q * n >= p * other_n) & (q * other_n >= p * n) & ((p + q) * rest >= p * (n + other_n))


def candidate_pairs(n: np.ndarray, at: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places) of the texts of a shingle, ascending by ``n``, that lie in different groups and may be similar. Pairs
    inside the largest group are not visited, nor are those of too different sizes."""
    p, q = SIMILAR
    roots, counts = np.unique(root, return_counts=True)
    largest = roots[counts.argmax()]
    for k in np.flatnonzero(root != largest).tolist():
        low, high = np.searchsorted(n, -(-p * n[k] // q)), np.searchsorted(n, q * n[k] // p, "right")
        part = slice(int(low), int(high))
        other = root[part]
        ok = (other != root[k]) & _may_be_similar(n[k], at[k], n[part], at[part])
        ok &= (other == largest) | (np.arange(part.start, part.stop) > k)
        if ok.any():
            yield k, np.flatnonzero(ok) + part.start


def _candidates(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): texts of different groups that share one of their first shingles and may be similar."""
    over = Window.partitionBy("key")

    def several(rows: DataFrame, column: str) -> DataFrame:
        ends = rows.withColumn("low", F.min(column).over(over)).withColumn("high", F.max(column).over(over))
        return ends.where("low <> high").drop("low", "high")

    parts = max(1, int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = write_table(several(prefixes, "t"), "simhash-shared")
    work = several(shared.join(roots, "t").select("key", "t", "n", "at", "root").repartition(parts, "key"), "root")
    work = work.sortWithinPartitions("key", "n", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pairs_of(rows: np.ndarray) -> Iterator[np.ndarray]:
            """Pairs of the texts of whole shingles, in parts of bounded size."""
            rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]  # copies that other tasks have read
            ends = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])
            made, size = [], 0
            for a, b in zip(ends, ends[1:]):
                _, t, n, at, root = rows[a:b].T
                for k, others in candidate_pairs(n, at, root):
                    made.append(np.stack([np.minimum(t[k], t[others]), np.maximum(t[k], t[others])], axis=1))
                    size += len(others)
                    if size >= MADE_ROWS:
                        yield np.concatenate(made)
                        made, size = [], 0
            if made:
                yield np.concatenate(made)

        def batches_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for made in pairs_of(rows) if len(rows) else ():
                made = np.unique(made, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy() for k in range(5)], axis=1)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # keys ascend; the last one may go on
            if last:
                yield from batches_of(np.concatenate([*held, rows[:last]]))
                held = []
            elif held and held[-1][-1, 0] != rows[0, 0]:
                yield from batches_of(np.concatenate(held))
                held = []
            held.append(rows[last:])
        if held:
            yield from batches_of(np.concatenate(held))
        give_back()

    return work.mapInArrow(run, "a long, b long").distinct()


def shingle_bits(text: bytes | None, width: int) -> bytes:
    """The size of a text's set of shingles, and a bitmap of two to four bits a shingle."""
    hashes = np.unique(shingle_hashes(text, width))
    n, size = len(hashes), 64
    while size < 2 * n:
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(size)] = 1
    return n.to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def bits_allow(a: bytes, b: bytes) -> bool:
    """Whether sets may be similar by their ``shingle_bits``: each bit that one alone has is a shingle that it alone has."""
    (p, q), n, m = SIMILAR, int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    x, y = np.frombuffer(a, np.uint8, offset=8), np.frombuffer(b, np.uint8, offset=8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size)) for z in (x, y))
    both = min(n - int(np.bitwise_count(x & ~y).sum(dtype=np.int64)), m - int(np.bitwise_count(y & ~x).sum(dtype=np.int64)))
    return (p + q) * both >= p * (n + m)


def sets_agree(a: bytes, b: bytes) -> bool:
    """Whether two sets of shingles, as sorted 64-bit hashes, have a Jaccard similarity of ``SIMILAR`` or more."""
    (p, q), x, y = SIMILAR, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    return (p + q) * len(np.intersect1d(x, y, assume_unique=True)) >= p * (len(x) + len(y))


def _pairs_where(pairs: DataFrame, rows: DataFrame, describe, holds) -> DataFrame:
    """The written pairs (a, b) for which ``holds`` is true of what ``describe`` gives of both texts as bytes."""
    ends = write_table(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct(), "simhash-ends")
    few = ends.count() <= BROADCAST_IDS  # of more ends no texts are exchanged, all are described
    wanted = rows.join(F.broadcast(ends), "t", "left_semi") if few else rows
    made = map_texts(wanted, {"is": T.BinaryType()}, lambda: lambda texts: [pa.array([describe(x) for x in texts], pa.binary())], keep=["t"])
    made = write_table((made if few else made.join(ends, "t", "left_semi")).dropDuplicates(["t"]), "simhash-described")
    both = pairs.join(made.withColumnsRenamed({"t": "a", "is": "a_is"}), "a").join(made.withColumnsRenamed({"t": "b", "is": "b_is"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            true = [holds(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(true, pa.bool_()))
        give_back()

    return write_table(both.select("a", "b", "a_is", "b_is").mapInArrow(run, "a long, b long"), "simhash-pairs")


def similar_texts(rows: DataFrame, roots: DataFrame, width: int = SIMILAR_WIDTH) -> DataFrame:
    """(a, b): roots of all pairs of texts of ``rows`` (t, text; t names a text) that ``roots`` (t, root) leaves apart and
    whose sets of shingles have a Jaccard similarity of ``SIMILAR`` or more. Bitmaps rule most candidates out, for certain;
    whole sets are compared of the others."""
    pairs = write_table(_candidates(_prefixes(rows, width, _common_shingles(rows, width)), roots), "simhash-candidates")
    pairs = _pairs_where(pairs, rows, lambda text: shingle_bits(text, width), bits_allow)
    pairs = _pairs_where(pairs, rows, lambda text: np.unique(shingle_hashes(text, width)).tobytes(), sets_agree)
    side = lambda x: roots.select(F.col("t").alias(x), F.col("root").alias(f"{x}_root"))
    ends = pairs.join(side("a"), "a").join(side("b"), "b")
    return ends.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()


def _grouped(printed: DataFrame, names: list[str], link) -> DataFrame:
    """``printed`` (doc_id, fingerprint, maybe more) with component_id and root: copies are folded, then linked."""
    node = _node(names)
    distinct = write_table(printed.groupBy(node.alias("node"), *names).agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(write_table(link(distinct), "simhash-links"))
    in_link = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    in_link = write_table(in_link, "simhash-roots")
    smallest = in_link.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = write_table(in_link.join(smallest, "root").select("node", "root", "component_id"), "simhash-classes")
    return printed.withColumn("node", node).join(by_node, "node").select(*printed.columns, "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row per document; component_id is the smallest doc_id reachable by links."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    printed = write_table(fingerprints(rows, keep=["doc_id"]), "simhash-fps")
    return _grouped(printed, ["fp"], lambda distinct: links(distinct.select("fp"), radius)).select("doc_id", "fp", "component_id")


def near_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SIMILAR_WIDTH, bits: int = BITS, radius: int = WIDE_RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp0, fp1..., component_id, root), linked by the similarity of sets of ``width``-word shingles: by
    ``similar_links`` of fingerprints, and by ``similar_texts``, which finds all that are as similar as ``SIMILAR`` says."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    printed = write_table(fingerprints(rows, keep=["doc_id", "text_hash"], width=width, bits=bits), "simhash-wide")
    names = _columns(bits)
    near = write_table(_grouped(printed, names, lambda distinct: similar_links(distinct.select(*names), bits, radius)), "simhash-near")
    roots = write_table(near.select(F.col("text_hash").alias("t"), "root").distinct(), "simhash-text-roots")
    more = write_table(similar_texts(rows.select(F.col("text_hash").alias("t"), "text"), roots, width), "simhash-more")
    if more.isEmpty():
        return near
    joined = write_table(components(more).selectExpr("node as root", "root as top"), "simhash-joined")
    least = near.join(joined, "root").groupBy("top").agg(F.min("component_id").alias("least"))
    moved = write_table(joined.join(least, "top"), "simhash-moved")
    kept = F.when(F.col("top").isNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id")
    return near.join(moved, "root", "left").select("doc_id", "text_hash", *names, kept, F.coalesce("top", "root").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of ``near_similar``: that of the smallest id (null ids last), then of the least
    text hash; of rows repeated, one. Texts are not exchanged unless over ``BROADCAST_IDS`` rows go."""
    grouped = write_table(near_similar(docs, doc_id, text).select("doc_id", "text_hash", "root"), "simhash-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k")
    kept = grouped.groupBy("root").agg(first).select("root", F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    judged = grouped.join(kept, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")))
    per_row = judged.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
    odd = write_table(per_row.where("not stays or rows > 1").select(F.col("doc_id").alias("__q_id"), F.col("text_hash").alias("__q_hash"), "stays"), "simhash-dropped")
    small = F.broadcast(odd) if odd.count() <= BROADCAST_IDS else odd
    same = F.col(doc_id).eqNullSafe(F.col("__q_id")) & (F.xxhash64(F.col(text)) == F.col("__q_hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = docs.join(small, same, "left_anti").select(*columns)
    repeated = odd.where("stays")
    if repeated.isEmpty():
        return alone
    again = docs.join(F.broadcast(repeated) if odd.count() <= BROADCAST_IDS else repeated, same)
    return alone.unionByName(again.dropDuplicates(["__q_id", "__q_hash"]).select(*columns))
