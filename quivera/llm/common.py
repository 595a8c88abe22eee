"""Shared plumbing of the text operators: shared-folder tables, row identity, word rules."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space bytes that end a word (a word is ``[^\x20\x09-\x0D]+``).
WORD_BREAKS = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Columns that operators add for themselves begin with this; input columns must not.
OWN = "__q_"
TEXT = f"{OWN}text"

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own_root: dict[str, str] = {}


#: Rows of an Arrow batch to and from Python workers, unless the session sets its own number (Spark's default is 10,000).
BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver found it by ``sys.path`` alone; keep their batches small."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _PACKAGE_ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{_PACKAGE_ROOT}:{have}".rstrip(":")
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def give_back() -> None:
    """Return a worker's freed memory to the system: idle workers stay with their executor for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to return
        pass


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a folder of our own where it is unset on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="quivera-")
        spark.sparkContext.setCheckpointDir(_own_root[app])
    return _own_root[app]


#: Paths of this driver's tables that are still there, oldest first.
written: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/quivera/{label}-{uuid.uuid4().hex}"


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``written`` that no plan reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in written:
            written.remove(path)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and executors may be lost."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(
    df: DataFrame,
    columns: dict[str, T.DataType],
    make: Callable[[], Callable[[list[bytes | None]], list[list]]],
    text: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """Append ``columns`` computed from the whole UTF-8 text of each row, in Arrow batches.

    ``make()`` is called once a task and gives a function from a block of texts (bytes or None) to one list
    per new column. Blocks hold about ``block_bytes`` of text, so memory does not follow the batch size.
    ``keep``: the input columns to pass on (all when None). New columns replace input columns of the same name.
    A function with an attribute ``done`` has it called when the task's rows are through.
    """
    ensure_importable(df.sparkSession)
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in columns]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in columns.items()])
    names = [f.name for f in kept]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {n: to_arrow_type(t) for n, t in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(TEXT)).cast(pa.binary())
            start, size = 0, 0
            for end in range(1, batch.num_rows + 1):
                value = texts[end - 1]
                size += 0 if not value.is_valid else value.as_buffer().size
                if size < block_bytes and end < batch.num_rows:
                    continue
                made = work(texts[start:end].to_pylist())
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(n)) for n in names]
                    + [v if isinstance(v, pa.Array) else pa.array(v, kinds[n]) for v, n in zip(made, kinds)],
                    names=[*names, *kinds],
                )
                start, size = end, 0
        getattr(work, "done", lambda: None)()
        del work
        give_back()

    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias(TEXT))
    return source.mapInArrow(run, schema)


def n_words_column(text: str) -> Column:
    """Number of words of a text, JVM-side; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash60(column: Column) -> Column:
    """A 60-bit hash of a string column that DuckDB computes alike: the first 15 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(column), 1, 15), 16, 10).cast("long")
