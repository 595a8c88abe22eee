"""Graph computing in supersteps: a driver of message rounds, and the programs that run on it.

A round joins the state with the edges, sends messages along them and combines those by target with an
aggregate, which Spark combines before the exchange too. Every ``checkpoint_every`` rounds the state is
checkpointed (to ``spark.checkpoint.dir``), so plans stay short and lost executors cost no more than that.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        set_to = context.getConf().get("spark.checkpoint.dir")
        if not set_to and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="quivera-checkpoint-"))
    return df.checkpoint()


@dataclass(frozen=True)
class VertexProgram:
    """``setup``: columns of a vertex at first (over id and degree); ``message``: what an edge carries from its sender;
    ``combine``: aggregate of a vertex's messages; ``update``: new columns from the old ones and ``message`` (null if
    none came). ``changed``: which vertices send in the next round (all, if None). ``against``: send to the source."""

    setup: dict[str, Column]
    message: Column
    combine: Callable[[str], Column]
    update: dict[str, Column]
    changed: Column | None = None
    against: bool = False
    both: bool = False


@dataclass
class Computer:
    """Runs a program on a filtered graph; results are new columns of the vertices, or a new graph."""

    graph: Graph
    vertex_filter: Column | None = None
    edge_labels: tuple[str, ...] = ()
    edge_filter: Column | None = None
    max_rounds: int = 10
    checkpoint_every: int = 3
    memory: dict[str, object] = field(default_factory=dict)

    def vertices(self) -> DataFrame:
        v = self.graph.vertices()
        return v if self.vertex_filter is None else v.where(self.vertex_filter)

    def edges(self) -> DataFrame:
        e = self.graph.edges(self.edge_labels)
        return e if self.edge_filter is None else e.where(self.edge_filter)

    def run(self, program: VertexProgram, aggregates: dict[str, Column] | None = None, edge_columns: tuple[str, ...] = ()) -> DataFrame:
        """(id, state columns). ``aggregates``: global memory, refreshed after each round (one row at the driver)."""
        e = self.edges().select("src", "dst", *edge_columns)
        degree = e.groupBy("dst" if program.against else "src").agg(F.count("*").alias("degree")).withColumnRenamed("dst" if program.against else "src", "id")
        state = self.vertices().select("id").join(degree, "id", "left").fillna(0, ["degree"])
        state = state.select("id", "degree", *[c.alias(n) for n, c in program.setup.items()], F.lit(True).alias("_sends"))
        names = list(program.setup)
        sender, target = ("dst", "src") if program.against else ("src", "dst")
        flow = e.select(F.col(sender).alias("id"), F.col(target).alias("_to"), *edge_columns)
        if program.both:
            flow = flow.unionByName(e.select(F.col(target).alias("id"), F.col(sender).alias("_to"), *edge_columns))
        flow = checkpointed(flow.repartition("id"))  # dealt by sender once; a hot sender is split by the join's skew rule
        for k in range(1, self.max_rounds + 1):
            sent = state.where("_sends").join(flow, "id").select(F.col("_to").alias("id"), program.message.alias("_m"))
            got = sent.groupBy("id").agg(program.combine("_m").alias("message"))
            joined = state.join(got, "id", "left")
            old = [F.col(n).alias(f"_old_{n}") for n in names]
            moved = joined.select("id", "degree", *[c.alias(n) for n, c in program.update.items()], *[F.col(n) for n in names if n not in program.update], *old)
            sends = F.lit(True) if program.changed is None else F.coalesce(program.changed, F.lit(False))
            state = moved.withColumn("_sends", sends).drop(*[f"_old_{n}" for n in names])
            if k % self.checkpoint_every == 0 or program.changed is not None:
                state = checkpointed(state)
            if aggregates:
                self.memory = state.agg(*[c.alias(n) for n, c in aggregates.items()]).first().asDict() | {"rounds": k}
            if program.changed is not None and state.where("_sends").isEmpty():
                break
        return state.select("id", *names)

    def map_reduce(self, state: DataFrame, key: Column, value: Column, reduce_with: Callable[[str], Column], name: str = "value") -> DataFrame:
        """(key, value): the map stage emits a pair a vertex, the reduce stage aggregates and sorts by key."""
        emitted = state.select(key.alias("key"), value.alias("_v"))
        return emitted.groupBy("key").agg(reduce_with("_v").alias(name)).orderBy("key")

    def persist(self, state: DataFrame, mode: str = "NEW") -> Graph:
        """A graph whose vertices have the state's columns; ORIGINAL keeps all tables, NEW those without edges too."""
        tables = {x: t.join(state, "id", "left") for x, t in self.graph.vertex_tables.items()}
        return replace(self.graph, vertex_tables=tables) if mode == "ORIGINAL" else replace(self.graph, vertex_tables=tables, edge_tables={})


def page_rank(graph: Graph, damping: float = 0.85, rounds: int = 9, edge_labels: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """(id, rank): starts at 1/N; each round gives (1-d)/N + d * (sum of neighbours' rank / out-degree). Mass of
    vertices without out-edges is not dealt again. Ten supersteps of the usual program are nine updates."""
    computer = Computer(graph, edge_labels=edge_labels, max_rounds=rounds)
    n = graph.vertices().count()
    program = VertexProgram(
        setup={"rank": F.lit(1.0 / max(1, n))},
        message=F.col("rank") / F.col("degree"),
        combine=F.sum,
        update={"rank": (1 - damping) / max(1, n) + damping * F.coalesce("message", F.lit(0.0))},
    )
    return computer.run(program)


def shortest_distance(graph: Graph, seed_id: int, edge_labels: tuple[str, ...] = (), weight: str | None = None, max_depth: int = 10, against: bool = True) -> DataFrame:
    """(id, distance) from the seed; messages travel against the edges unless told otherwise; null: not reached."""
    program = VertexProgram(
        setup={"distance": F.when(F.col("id") == seed_id, F.lit(0.0))},
        message=F.col("distance") + (F.col(weight).cast("double") if weight else F.lit(1.0)),
        combine=F.min,
        update={"distance": F.least("distance", "message")},
        changed=F.col("distance").isNotNull() & (F.col("_old_distance").isNull() | (F.col("distance") < F.col("_old_distance"))),
        against=against,
    )
    computer = Computer(graph, edge_labels=edge_labels, max_rounds=max_depth)
    return computer.run(program, edge_columns=(weight,) if weight else ())


def degree_counts(graph: Graph, direction: str = "out", edge_labels: tuple[str, ...] = (), length: int = 1) -> DataFrame:
    """(id, degree) of every vertex; ``length`` over 1 counts walks of that many edges."""
    e = graph.edges(edge_labels, properties=False)
    start, end = ("src", "dst") if direction == "out" else ("dst", "src")
    if direction == "both":
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        start, end = "src", "dst"
    counts = e.groupBy(F.col(start).alias("id")).agg(F.count("*").alias("degree"))
    for _ in range(length - 1):
        step = e.join(counts.withColumnRenamed("id", end), end)
        counts = step.groupBy(F.col(start).alias("id")).agg(F.sum("degree").alias("degree"))
    return graph.vertices().select("id").join(counts, "id", "left").fillna(0, ["degree"])


def connected_components(graph: Graph, edge_labels: tuple[str, ...] = ()) -> DataFrame:
    """(id, component): the least id that a vertex is connected with, edges taken both ways.

    Star contraction: each round hangs every neighbour of a vertex under its least neighbour, first the greater ones,
    then the others, so that components become stars in a number of rounds that follows the logarithm of their size,
    however long their chains are. A round that changes nothing ends the loop.
    """
    e = graph.edges(edge_labels, properties=False).where("src <> dst")
    pairs = checkpointed(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = checkpointed(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return graph.vertices().select("id").join(pairs.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def peer_pressure(graph: Graph, rounds: int = 10, edge_labels: tuple[str, ...] = ()) -> DataFrame:
    """(id, cluster): each vertex joins the cluster most votes come from; equal votes go to the least cluster."""
    e = graph.edges(edge_labels, properties=False)
    state = graph.vertices().select("id", F.col("id").alias("cluster"))
    for k in range(rounds):
        votes = state.join(e.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id"), "cluster").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("best"))
        state = state.join(best, "id", "left").select("id", F.coalesce("best", "cluster").alias("cluster"))
        if (k + 1) % 3 == 0:
            state = checkpointed(state)
    return state


def _distances(e: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(id, left): how many edges of ``e`` (src, dst) lead to a vertex from the nearest of ``starts`` (id)."""
    found = frontier = starts.select("id", F.lit(0).alias("left"))
    for k in range(1, max_depth + 1):
        step = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(step.join(found, "id", "left_anti").select("id", F.lit(k).alias("left")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def shortest_paths(graph: Graph, sources: DataFrame, edge_labels: tuple[str, ...] = (), max_depth: int = 10, targets: DataFrame | None = None) -> DataFrame:
    """(source, target, distance, path): a shortest path (the least by its ids) to all reached, edges taken both ways.

    With ``targets`` (_id) to those alone: the search begins at the fewer of both sides and follows a path only while the
    other side is near enough for the rest of ``max_depth``, which every vertex of a path to return is. So rows follow
    the fewer side and what is near the other, not all vertices for each source.
    """
    e = graph.edges(edge_labels, properties=False)
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    begin, end, ids = "source", "target", sources
    if targets is not None:
        ends = checkpointed(targets.select("_id").distinct())
        ids = checkpointed(sources.select("_id").distinct())
        if ends.count() < ids.count():
            begin, end, ids, ends = "target", "source", ends, ids
        left = _distances(e, ends.withColumnRenamed("_id", "id"), max_depth - 1)
        e = checkpointed(e.distinct().join(left, F.col("dst") == F.col("id")).select("src", "dst", "left"))
    ids = ids.select(F.col("_id").alias(begin))
    found = ids.select(begin, F.col(begin).alias(end), F.lit(0).alias("distance"), F.array(F.col(begin).cast("string")).alias("path"))
    frontier = found
    for k in range(1, max_depth + 1):
        near = e if targets is None else e.where(F.col("left") <= max_depth - k)
        longer = F.array_append("path", near.dst.cast("string")) if begin == "source" else F.array_prepend("path", near.dst.cast("string"))
        step = frontier.join(near, frontier[end] == near.src).select(begin, near.dst.alias(end), F.lit(k).alias("distance"), longer.alias("path"))
        fresh = step.groupBy(begin, end).agg(F.min("distance").alias("distance"), F.min("path").alias("path")).join(found.select(begin, end), [begin, end], "left_anti")
        frontier = checkpointed(fresh)
        if frontier.isEmpty():
            break
        found = checkpointed(found.unionByName(frontier))
    if targets is not None:
        found = found.join(ends.select(F.col("_id").alias(end)), end, "left_semi")
    return found.select("source", "target", "distance", "path")


def scan_job(graph: Graph, function, schema: str, vertex_labels: tuple[str, ...] | None = None) -> DataFrame:
    """A user's job over vertices in pandas batches (``mapInPandas``)."""
    return graph.vertices(vertex_labels).mapInPandas(function, schema)
