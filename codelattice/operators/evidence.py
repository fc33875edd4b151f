"""Tests that speak for a symbol: its own, those of a class's members, those that name it bare, and those of what it calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import short
from codelattice.sources.storage import cut


def tests_of(asked: DataFrame, nodes: DataFrame, contains: DataFrame, calls: DataFrame, tested: DataFrame, depth: int = 1, frontier: int | None = 50) -> DataFrame:
    """qualified_name, test, indirect of each asked symbol (qualified_name).

    nodes: qualified_name, kind; contains: source, target; calls: source, target, of any
    form; tested: source (a symbol or a bare name), target (the test). A class stands for
    itself and what it contains. Direct are the tests of those, and of the asked symbol's
    bare name. Indirect ones test what is called in up to `depth` steps, of which each step
    follows the first `frontier` by name (all, if None). A test counts once, as direct if
    it can; tests that nodes lacks don't count. Nulls ask for nothing.
    """
    roots = asked.where("qualified_name is not null").select(F.col("qualified_name").alias("root")).distinct()
    classes = nodes.where("kind = 'Class'").select(F.col("qualified_name").alias("root")).distinct()
    members = roots.join(classes, "root", "left_semi").join(contains.select(F.col("source").alias("root"), F.col("target").alias("node")), "root")
    front = cut(roots.select("root", F.col("root").alias("node")).union(members.select("root", "node")).distinct())
    proof = cut(tested.select(F.col("source").alias("node"), F.col("target").alias("test")).distinct())
    steps = cut(calls.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct())
    bare = roots.select("root", short(F.col("root")).alias("node"))
    found = front.union(bare).join(proof, "node").select("root", "test", F.lit(0).alias("late"))
    for _ in range(depth):
        after = front.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        if frontier is not None:
            after = after.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("node"))).where(F.col("place") <= frontier).drop("place")
        front = cut(after)
        found = found.union(front.join(proof, "node").select("root", "test", F.lit(1)))
    known = nodes.select(F.col("qualified_name").alias("test")).distinct()
    return found.join(known, "test", "left_semi").groupBy(F.col("root").alias("qualified_name"), "test").agg((F.min("late") > 0).alias("indirect"))


def counts(found: DataFrame) -> DataFrame:
    """qualified_name, n_tests, n_indirect of what tests_of gives."""
    return found.groupBy("qualified_name").agg(F.count("*").alias("n_tests"), F.count_if("indirect").alias("n_indirect"))
