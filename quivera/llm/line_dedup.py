"""Line dedup with a log-template tree.

The tree has a fixed depth: a line goes by its number of tokens, then by its ``DEPTH`` leading tokens, to a
leaf. A token with a digit is a variable field from the start. In a leaf, the count of a token is
the number of different lines that have it at its position. A line's template has ``CONSTANT_SHARE`` of its tokens
as constants at least, so the count that this share of its tokens reaches is the size of its template; tokens of
``RELATIVE`` times this count or more (and of ``MIN_DOCUMENTS``) are constant and any other is a variable field.
Besides its leading tokens, which all lines of a leaf have, a template has a constant at least. Sizes are compared
within a line, so neither more lines nor other templates of the leaf change the verdict. Leaves are worked on by
counts of (leaf, line) and (leaf, position, token), which combine before an exchange, so a hot leaf or line is
never in one task and the result does not depend on the order of lines.

A template recurs if lines of it stand in ``MIN_DOCUMENTS`` different texts or more: copies of a whole text are one,
however many there are, so copies never change what is found, and a text that only its copies repeat is left for
document dedup. All lines of recurring templates are dropped from all documents, of any length and whatever share of a
document they are. Near copies are different texts: lines that three of them share go from all of them.

Defined results: blank lines are never dropped; a null text stays null and an empty one empty; a text all of whose
lines recur becomes empty; rows repeated count as one text and lose the same lines; very long texts and lines are read
whole; lines compare by 64-bit hashes of their tokens, so white space within a line does not count; an empty table
gives an empty one; input columns pass unchanged, also those named like columns used here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_importable, give_back, map_texts, write_table

DEPTH = 3
MIN_DOCUMENTS = 3
CONSTANT_SHARE = 0.6
RELATIVE = 0.1
VARIABLE = b"<*>"
#: Hashes of leaves, or of lines to drop, that are sent to the tasks as one sorted array (32 MB); beyond it they are joined.
SHIPPED = 4_000_000
#: Lines of which a task remembers that it has given their tokens; beyond it the memory starts anew.
KEPT_LINES = 200_000
_DIGIT = re.compile(rb"[0-9]")

LINES = "doc_id {id}, text_hash long, line_no int, leaf long, line_hash long"


def masked_tokens(line: bytes) -> list[bytes]:
    """Tokens of a line; those with a digit as variable fields."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return tokens


def leaf_of(tokens: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join([b"%d" % len(tokens), *tokens[:DEPTH]]))


def parse_text(text: bytes | None) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(line_no, leaf, line_hash, tokens) of each line that is not blank."""
    for k, line in enumerate((text or b"").split(b"\n")):
        tokens = masked_tokens(line)
        if tokens:
            yield k, leaf_of(tokens), xxhash.xxh64_intdigest(b" ".join(tokens)), tokens


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of hashes for each line that is not blank."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parsed = [], []
            for k, value in enumerate(batch.column(1).cast(pa.binary())):
                lines = [x[:3] for x in parse_text(value.as_py())]
                rows += [k] * len(lines)
                parsed += lines
            number, leaf, line = zip(*parsed) if parsed else ((), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array(number, pa.int32()), _signed(leaf), _signed(line)],
                names=["doc_id", "text_hash", "line_no", "leaf", "line_hash"],
            )
        give_back()

    source = _texts(docs, doc_id, text)
    return source.mapInArrow(run, LINES.format(id=source.schema["doc_id"].dataType.simpleString()))


def _shipped(hashes: DataFrame):
    """A broadcast of the sorted hashes (one column) if they are few enough, else None."""
    if hashes.count() > SHIPPED:
        return None
    return hashes.sparkSession.sparkContext.broadcast(np.sort(hashes.toArrow().column(0).to_numpy().view(np.uint64)))


def _among(sorted_hashes: np.ndarray, hashes: list[int]) -> np.ndarray:
    """Which of ``hashes`` are in the sorted array."""
    asked = np.array(hashes, dtype=np.uint64)
    if not len(sorted_hashes):
        return np.zeros(len(asked), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, asked), len(sorted_hashes) - 1)] == asked


def _tokens_of(docs: DataFrame, leaves: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(leaf, line_hash, tokens): the distinct lines of the given leaves."""
    shipped = _shipped(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            got = []
            for value in batch.column(1).cast(pa.binary()):
                lines = list(parse_text(value.as_py()))
                wanted = [True] * len(lines) if shipped is None else _among(shipped.value, [x[1] for x in lines]).tolist()
                for (_, leaf, line, tokens), want in zip(lines, wanted):
                    if want and line not in seen:
                        seen.add(line)
                        got.append((leaf, line, [t.decode("utf-8", "replace") for t in tokens]))
            leaf, line, tokens = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([_signed(leaf), _signed(line), pa.array(tokens, pa.list_(pa.string()))], names=["leaf", "line_hash", "tokens"])
            if len(seen) > KEPT_LINES:
                seen.clear()
        del seen
        give_back()

    found = _texts(docs, doc_id, text).mapInArrow(run, "leaf long, line_hash long, tokens array<string>")
    if shipped is None:
        found = found.join(leaves, "leaf", "left_semi")
    return found.groupBy("leaf", "line_hash").agg(F.first("tokens").alias("tokens"))


def recurring_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(line_hash): the lines to drop, as a written table; a line's hash is that of its masked tokens."""
    # A line counts once for all copies of a text. Distinct rows combine before the exchange, and so do the counts.
    lines = write_table(parse(docs, doc_id, text).select("leaf", "line_hash", "text_hash").distinct(), "lines")
    counted = write_table(lines.groupBy("leaf", "line_hash").agg(F.count("*").alias("texts")), "lines-counted")
    exact = counted.where(F.col("texts") >= MIN_DOCUMENTS).select("leaf", "line_hash")
    # Lines that do not recur as they are may be lines of a template with variable fields.
    rare = counted.where(F.col("texts") < MIN_DOCUMENTS)
    open_leaves = rare.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("texts").alias("texts")).where((F.col("n") > 1) & (F.col("texts") >= MIN_DOCUMENTS))
    open_leaves = write_table(open_leaves.select("leaf"), "lines-leaves")
    distinct = _tokens_of(docs, open_leaves, doc_id, text).join(exact, ["leaf", "line_hash"], "left_anti")
    distinct = write_table(distinct, "lines-open")
    tokens = distinct.select("leaf", "line_hash", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "token"))
    constant = tokens.groupBy("leaf", "at", "token").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
    kept = tokens.join(constant, ["leaf", "at", "token"])
    size_of_template = F.element_at(F.sort_array(F.transform("kept", lambda x: x["n"]), False), F.ceil(CONSTANT_SHARE * F.col("size")).cast("int"))
    constants = F.transform(F.filter("kept", lambda x: x["n"] >= RELATIVE * F.col("enough")), lambda x: F.struct(x["at"], x["token"]))
    candidates = (
        kept.groupBy("leaf", "line_hash", "size")
        .agg(F.sort_array(F.collect_list(F.struct("at", "token", "n"))).alias("kept"))  # a line's own tokens
        .where(F.size("kept") >= CONSTANT_SHARE * F.col("size"))
        .select("leaf", "line_hash", "kept", size_of_template.alias("enough"))
    )
    # Written, as the plan would else find the size again for every token.
    template = (
        write_table(candidates, "lines-candidates")
        .withColumn("constants", constants)
        .where(F.exists("constants", lambda x: x["at"] >= DEPTH))
        .select("leaf", "line_hash", F.xxhash64("leaf", "constants").alias("template"))
    )
    template = write_table(template, "lines-templates")
    texts_of = lines.join(template, ["leaf", "line_hash"]).select("template", "text_hash").distinct()
    recurring = texts_of.groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= MIN_DOCUMENTS)
    general = template.join(recurring, "template", "left_semi").select("line_hash")
    return write_table(exact.select("line_hash").unionByName(general).distinct(), "lines-dropped")


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, line_no): the lines to drop."""
    return parse(docs, doc_id, text).join(recurring_hashes(docs, doc_id, text), "line_hash", "left_semi").select("doc_id", "text_hash", "line_no")


def _drop_shipped(docs: DataFrame, shipped, text: str, count_into: str) -> DataFrame:
    """Drop in one pass over the texts: the hashes are with the tasks."""

    def work(texts: list[bytes | None]) -> list[list]:
        at, numbers, hashes = [], [], []
        for k, t in enumerate(texts):
            for number, line in enumerate((t or b"").split(b"\n")):
                tokens = masked_tokens(line)
                if tokens:
                    at.append(k)
                    numbers.append(number)
                    hashes.append(xxhash.xxh64_intdigest(b" ".join(tokens)))
        gone: dict[int, set[int]] = {}
        for j in np.flatnonzero(_among(shipped.value, hashes)).tolist():
            gone.setdefault(at[j], set()).add(numbers[j])
        out, dropped = list(texts), [0] * len(texts)
        for k, lines in gone.items():
            out[k], dropped[k] = b"\n".join(x for n, x in enumerate(texts[k].split(b"\n")) if n not in lines), len(lines)
        return [pa.array(out, pa.binary()).cast(pa.string(), safe=False), dropped]

    return map_texts(docs, {text: T.StringType(), count_into: T.IntegerType()}, lambda: work, text)


def _drop_joined(docs: DataFrame, found: DataFrame, doc_id: str, text: str, count_into: str) -> DataFrame:
    """Drop by a join of the documents with their line numbers."""
    per_doc = write_table(found.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("__q_lines")), "lines-per-document")
    per_doc = per_doc.select(F.col("doc_id").alias("__q_id"), F.col("text_hash").alias("__q_hash"), "__q_lines")
    joined = docs.join(per_doc, F.col(doc_id).eqNullSafe(F.col("__q_id")) & (F.xxhash64(F.col(text)) == F.col("__q_hash")), "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, k: ~F.array_contains("__q_lines", k)), "\n")
    out = joined.withColumn("__q_left", F.when(F.col("__q_lines").isNotNull(), left).otherwise(F.col(text)))
    return out.withColumn(count_into, F.coalesce(F.size("__q_lines"), F.lit(0))).withColumn(text, F.col("__q_left"))


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count_into: str | None = None) -> DataFrame:
    """``docs`` without the lines of recurring templates; ``count_into``: a column for the number dropped.

    Up to ``SHIPPED`` hashes of lines go to the tasks, which drop in one pass; beyond it documents are joined.
    """
    dropped = recurring_hashes(docs, doc_id, text)
    shipped, count = _shipped(dropped), count_into or "__q_count"
    if shipped is not None:
        out = _drop_shipped(docs, shipped, text, count)
    else:
        found = parse(docs, doc_id, text).join(dropped, "line_hash", "left_semi").select("doc_id", "text_hash", "line_no").distinct()
        out = _drop_joined(docs, found, doc_id, text, count)
    return out.select(*[f"`{c}`" for c in docs.columns if c != count_into], *([count_into] if count_into else []))
