"""Reading orders of modules: tours from the doors, and callees before callers."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.sources.storage import cut

#: Edges that one task orders by itself once every remaining module waits for a cycle.
CORE_EDGES = 200_000


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their number, from 0, in an order that leaves no ties.

    Rows are dealt out by ranges of the order and numbered within each range, behind the
    sizes of the ranges before it, so no task sees them all.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("n")).alias("__before"))  # a row per range
    at = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "__part").withColumn(name, at).drop("__part", "__before")


def _inside(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct edges between two different modules of the given ones."""
    known = modules.select("module")
    kept = edges.where("source <> target").select("source", "target").distinct()
    return kept.join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi").select("source", "target")


def doors(edges: DataFrame) -> DataFrame:
    """Modules that import others and that none imports."""
    return edges.select(F.col("source").alias("module")).distinct().join(edges.select(F.col("target").alias("module")), "module", "left_anti")


def door_reach(edges: DataFrame) -> DataFrame:
    """door, n_reached: how many modules each door opens, itself included.

    Sixty-four doors share a bit set per module they reach, and only sets that grew move
    on, so rows are modules times doors / 64 at most and cycles end by themselves. Null
    ends of edges open nothing; without doors the result is empty.
    """
    step = cut(edges.where("source is not null and target is not null").select(F.col("source").alias("node"), F.col("target").alias("next")).distinct())
    marked = cut(numbered(cut(doors(step.toDF("source", "target"))), [F.col("module")]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    front = seen = cut(marked.select(F.col("module").alias("node"), F.floor(F.col("place") / 64).alias("word"), bit.alias("bits")))
    while not front.isEmpty():
        found = front.join(step, "node").groupBy(F.col("next").alias("node"), "word").agg(F.bit_or("bits").alias("now"))
        fresh = F.col("now").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))))
        front = cut(found.join(seen, ["node", "word"], "left").select("node", "word", fresh.alias("bits")).where("bits <> 0"))
        seen = cut(seen.union(front).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    each = [F.sum(F.call_function("shiftright", "bits", F.lit(i)).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{i}") for i in range(64)]
    counts = seen.groupBy("word").agg(*each).select("word", F.posexplode(F.array(*(f"b{i}" for i in range(64)))).alias("at", "n_reached"))
    return marked.join(counts.select((F.col("word") * 64 + F.col("at")).alias("place"), "n_reached"), "place").select(F.col("module").alias("door"), "n_reached")


def tour(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """module, position, is_door: every module of modules (module) in reading order.

    Doors come first, the one that opens most modules before others; then what they
    import, breadth-first, in the very order of a queue: a module stands behind the first
    module that imports it, among that one's imports by name. What no door opens follows
    by how many modules import it, most first, then by name. Edges to or from unknown
    modules, from a module to itself, and repeated ones say nothing; a null module is none.
    """
    modules = cut(modules.where("module is not null").select("module").distinct())
    deps = cut(_inside(edges, modules))
    into = deps.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("fan_in"))
    first = cut(door_reach(deps).select(F.col("door").alias("module"), "n_reached"))
    seen = front = cut(numbered(first, [F.desc("n_reached"), F.col("module")]).select("module", "place", F.lit(True).alias("is_door")))
    n = seen.count()
    while not front.isEmpty():
        found = front.join(deps, front["module"] == deps["source"]).groupBy(F.col("target").alias("module")).agg(F.min("place").alias("parent"))
        new = cut(found.join(seen.select("module"), "module", "left_anti"))
        front = cut(numbered(new, [F.col("parent"), F.col("module")]).select("module", (F.col("place") + n).alias("place"), F.lit(False).alias("is_door")))
        seen = seen.union(front)
        n += front.count()
    rest = cut(modules.join(seen.select("module"), "module", "left_anti").join(into, "module", "left").select("module", F.coalesce("fan_in", F.lit(0)).alias("fan_in")))
    behind = numbered(rest, [F.desc("fan_in"), F.col("module")]).select("module", (F.col("place") + n).alias("place"), F.lit(False).alias("is_door"))
    return seen.union(behind).select("module", F.col("place").alias("position"), "is_door")


def _finish(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds of the modules that all wait for each other; rows without a target name the modules."""
    names = sorted(rows["source"].unique())
    waits = dict.fromkeys(names, 0)
    users: dict[str, list[str]] = {}
    for source, target in zip(rows["source"], rows["target"], strict=True):
        if isinstance(target, str):
            waits[source] += 1
            users.setdefault(target, []).append(source)
    out, placed, first, ready, at = [], set(), 0, [n for n in names if not waits[n]], 0
    while len(placed) < len(names):
        if not ready:  # the least module still waiting goes before what it needs
            while names[first] in placed:
                first += 1
            ready = [names[first]]
        heapq.heapify(after := [])
        for name in ready:
            placed.add(name)
            out.append((name, at))
        for name in ready:
            for user in users.get(name, ()):
                waits[user] -= 1
                if not waits[user] and user not in placed:
                    heapq.heappush(after, user)
        ready, at = sorted(after), at + 1
    return pd.DataFrame(out, columns=["module", "round"])


def rounds(modules: DataFrame, edges: DataFrame, core_edges: int = CORE_EDGES) -> DataFrame:
    """module, round: in which round each module is placed, when a round places all whose imports are placed.

    A round in which nothing is ready, because all that is left waits for a cycle, places
    the least module left by name. Without cycles, rounds are layers. Edges to or from
    unknown modules and to itself don't count; null modules are none.

    Rounds are joins over all edges. Once only a core that waits for cycles is left and
    it has core_edges edges at most, one task places it; a larger core goes on by rounds.
    """
    left = cut(modules.where("module is not null").select("module").distinct())
    step = cut(_inside(edges, left))
    placed, level = left.limit(0).withColumn("round", F.lit(0)), 0
    while not left.isEmpty():
        ready = cut(left.join(step.select(F.col("source").alias("module")), "module", "left_anti"))
        if ready.isEmpty():
            if step.count() <= core_edges:
                core = step.union(left.select("module", F.lit(None).cast("string"))).withColumn("core", F.lit(0))
                rest = core.groupBy("core").applyInPandas(_finish, "module string, round int")
                return placed.union(rest.select("module", (F.col("round") + level).alias("round")))
            ready = cut(left.agg(F.min("module").alias("module")))
        placed = placed.union(ready.withColumn("round", F.lit(level)))
        left = cut(left.join(ready, "module", "left_anti"))
        step = cut(step.join(ready.toDF("target"), "target", "left_anti").join(ready.toDF("source"), "source", "left_anti").select("source", "target"))
        level += 1
    return placed


def bottom_up(modules: DataFrame, edges: DataFrame, core_edges: int = CORE_EDGES) -> DataFrame:
    """module, round, position: callees before callers, by round and then by name (see rounds)."""
    return numbered(cut(rounds(modules, edges, core_edges)), [F.col("round"), F.col("module")], "position")
