"""The change log: what each transaction added and removed, as rows that can be appended, streamed and replayed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.graph import EDGE_COLUMNS, VERTEX_COLUMNS, Graph

ADDED, REMOVED, ANY = "ADDED", "REMOVED", "ANY"
CHANGE = T.StructType(
    [
        T.StructField("log", T.StringType()),
        T.StructField("tx_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("op", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _rows(df: DataFrame, kind: str, op: str, log: str, tx_id: int, ts) -> DataFrame:
    reserved = VERTEX_COLUMNS if kind == "vertex" else EDGE_COLUMNS
    names = [c for c in df.columns if c not in reserved]
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("string").alias("value")) for n in names]) if names else None
    bag = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())) if names else F.create_map().cast("map<string,string>")
    end = lambda c: (F.col(c).cast("long") if kind == "edge" else F.lit(None).cast("long")).alias(c)
    return df.select(
        F.lit(log).alias("log"), F.lit(tx_id).cast("long").alias("tx_id"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(op).alias("op"), F.lit(kind).alias("kind"),
        "label", F.col("id").cast("string").alias("id"), end("src"), end("dst"), bag.alias("properties"),
    )


def changes_between(before: Graph, after: Graph, log: str, tx_id: int, ts) -> DataFrame:
    """Change rows that lead from one graph to the next: elements by id that only one of them has, and properties (kind
    ``property``, their key as label) that changed on elements that both have."""
    parts = []
    for kind, old, new in (("vertex", before.vertices(), after.vertices()), ("edge", before.edges(), after.edges())):
        parts.append(_rows(new.join(old.select("id"), "id", "left_anti"), kind, ADDED, log, tx_id, ts))
        parts.append(_rows(old.join(new.select("id"), "id", "left_anti"), kind, REMOVED, log, tx_id, ts))
        reserved = VERTEX_COLUMNS if kind == "vertex" else EDGE_COLUMNS
        names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in reserved]
        if not names:
            continue
        bag = lambda df: df.select("id", F.struct(*[(F.col(f"`{n}`").cast("string") if n in df.columns else F.lit(None).cast("string")).alias(n) for n in names]).alias("s"))
        both = bag(old).withColumnRenamed("s", "o").join(bag(new).withColumnRenamed("s", "n"), "id").where("not (o <=> n)")
        for op, side, other in ((REMOVED, "o", "n"), (ADDED, "n", "o")):
            pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(side)[n].alias("value"), F.col(other)[n].alias("before")) for n in names])
            changed = both.select("id", F.explode(pairs).alias("p")).where("p.value is not null and not (p.value <=> p.before)")
            parts.append(
                changed.select(
                    F.lit(log).alias("log"), F.lit(tx_id).cast("long").alias("tx_id"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(op).alias("op"), F.lit("property").alias("kind"),
                    F.col("p.key").alias("label"), F.col("id").cast("string").alias("id"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"),
                    F.create_map("p.key", "p.value").alias("properties"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def append(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


class ChangeState:
    """The changes of a batch, by op, kind and label."""

    def __init__(self, changes: DataFrame):
        self.changes = changes

    def _of(self, kind: str, op: str, labels: tuple[str, ...]) -> DataFrame:
        df = self.changes.where(F.col("kind") == kind)
        df = df if op == ANY else df.where(F.col("op") == op)
        return df.where(F.col("label").isin(list(labels))) if labels else df

    def vertices(self, op: str = ANY, *labels: str) -> DataFrame:
        return self._of("vertex", op, labels)

    def edges(self, op: str = ANY, *labels: str) -> DataFrame:
        return self._of("edge", op, labels)

    def relations(self, op: str = ANY, *labels: str) -> DataFrame:
        """Edges and properties."""
        return self.edges(op, *labels).select("tx_id", "op", "kind", "label", "id").unionByName(
            self.properties(op).select("tx_id", "op", F.lit("property").alias("kind"), F.col("key").alias("label"), "id")
        )

    def properties(self, op: str = ANY, *keys: str) -> DataFrame:
        """Properties of changed vertices, and those that changed on their own."""
        df = self._of("vertex", op, ()).unionByName(self._of("property", op, ())).select("tx_id", "op", "id", F.explode("properties").alias("key", "value"))
        return df.where(F.col("key").isin(list(keys))) if keys else df


class LogProcessor:
    """Named processors over one log: each gets every micro-batch, once per identifier (its checkpoint)."""

    def __init__(self, spark: SparkSession, path: str, log: str, identifier: str, checkpoint_dir: str):
        self.spark, self.path, self.log, self.identifier, self.checkpoint_dir = spark, path, log, identifier, checkpoint_dir
        self.processors: list[Callable[[ChangeState, int], None]] = []
        self.start_time = None
        self.max_files = 1000

    def add(self, processor: Callable[[ChangeState, int], None]) -> "LogProcessor":
        self.processors.append(processor)
        return self

    def from_time(self, ts) -> "LogProcessor":
        self.start_time = ts
        return self

    def stream(self) -> DataFrame:
        df = self.spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", self.max_files).parquet(self.path).where(F.col("log") == self.log)
        return df if self.start_time is None else df.where(F.col("ts") >= F.lit(self.start_time))

    def start(self, once: bool = False, interval: str = "5 seconds"):
        """A streaming query; it resumes where its identifier's checkpoint stands. A batch that fails runs again."""

        def each(batch: DataFrame, number: int) -> None:
            state = ChangeState(batch)
            for p in self.processors:
                p(state, number)

        writer = self.stream().writeStream.foreachBatch(each).option("checkpointLocation", f"{self.checkpoint_dir}/{self.log}-{self.identifier}")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def events_as_changes(events: DataFrame, log: str = "events") -> DataFrame:
    """An event table as a change feed: signups add, errors remove, the rest add too."""
    return events.select(
        F.lit(log).alias("log"), F.col("event_id").alias("tx_id"), F.col("ts"), F.when(F.col("event_type") == "error", REMOVED).otherwise(ADDED).alias("op"), F.lit("edge").alias("kind"),
        F.col("event_type").alias("label"), F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("src"), F.col("event_id").alias("dst"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("properties"),
    )


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op", "kind", "label").agg(F.count("*").alias("n"))


def latest_state(changes: DataFrame) -> DataFrame:
    """Elements that the log leaves: the last change of an id decides."""
    last = changes.groupBy("kind", "id").agg(F.max_by(F.struct("op", "label", "src", "dst", "properties"), F.struct("ts", "tx_id")).alias("s"))
    return last.where(F.col("s.op") == ADDED).select("kind", "id", "s.label", "s.src", "s.dst", "s.properties")


def alive(elements: DataFrame, created: str, ttl_seconds: int, now) -> DataFrame:
    """Elements whose time to live has not run out at ``now``."""
    return elements.where(F.col(created) + F.expr(f"interval {int(ttl_seconds)} seconds") > F.lit(now).cast("timestamp"))


def with_ttl(stream: DataFrame, created: str, ttl: str, keys: list[str]) -> DataFrame:
    """A stream's elements without repeats; state is let go ``ttl`` after an element's time."""
    return stream.withWatermark(created, ttl).dropDuplicatesWithinWatermark(keys)
