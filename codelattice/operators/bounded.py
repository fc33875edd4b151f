"""Traversals with a bound of depth and a budget of nodes, cut the same way every time."""

from __future__ import annotations

from functools import reduce


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.sources.storage import cut

#: Kinds of edges that make the file of their source depend on that of their target.
DEPENDS = ("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS")


def reach(steps: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """root, node, depth, truncated, total: what each root's seeds (root, node) lead to by steps (node, next), besides the seeds.

    A root that has found over `most` nodes goes no further; of its nodes the nearest stay,
    by depth and then by name, truncated is true, and total tells how many were found. Each
    level is a join for all roots together. Repeated seeds and steps count once; nulls lead nowhere.
    """
    steps = cut(steps.where("node is not null and next is not null").select("node", "next").distinct())
    seen = front = cut(seeds.where("node is not null").select("root", "node").distinct().withColumn("depth", F.lit(0)))
    counts = None
    for level in range(1, depth + 1):
        found = front.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        new = cut(found.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        seen = seen.union(new.select("root", "node", "depth"))
        counts = seen.where("depth > 0").groupBy("root").agg(F.count("*").alias("total"))
        front = new.select("root", "node").join(counts.where(F.col("total") > most), "root", "left_anti")
    if counts is None:
        return seen.where("depth > 0").select("root", "node", "depth", F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("total"))
    rows = seen.where("depth > 0").join(counts, "root").withColumn("truncated", F.col("total") > most)
    over = rows.where("truncated").withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("depth", "node"))).where(F.col("place") <= most)
    columns = ["root", "node", "depth", "truncated", "total"]
    return rows.where("not truncated").select(columns).union(over.select(columns))


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 500) -> DataFrame:
    """node, depth, truncated, total: what edges of any kind (source, target), either way, lead to from the seeds (node)."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).union(edges.select("target", "source"))
    return reach(both, seeds.select(F.lit(0).alias("root"), "node"), depth, most).drop("root")


def dependents(edges: DataFrame, nodes: DataFrame, roots: DataFrame, hops: int = 2, most: int = 500) -> DataFrame:
    """root, node, depth, truncated, total: files that depend on each file of roots (file_path), by edges (kind, source, target, file_path).

    An import of the file itself counts, and any edge of DEPENDS to one of its symbols
    (nodes: qualified_name, file_path); file_path of an edge is where it stands.
    """
    homes = nodes.select(F.col("qualified_name").alias("target"), F.col("file_path").alias("home")).distinct()
    by_symbol = edges.where(F.col("kind").isin(*DEPENDS)).join(homes, "target").select(F.col("home").alias("node"), F.col("file_path").alias("next"))
    by_file = edges.where("kind = 'IMPORTS_FROM'").select(F.col("target").alias("node"), F.col("file_path").alias("next"))
    return reach(by_symbol.union(by_file).where("node <> next"), roots.select(F.col("file_path").alias("root"), F.col("file_path").alias("node")), hops, most)


def ripple(edges: DataFrame, nodes: DataFrame, changed: DataFrame, hops: int = 1, most: int = 500) -> DataFrame:
    """node, depth, truncated, total: files that depend on any of the changed ones (file_path), all changed ones as one root."""
    files = changed.select("file_path").distinct()
    homes = nodes.select(F.col("qualified_name").alias("target"), F.col("file_path").alias("home")).distinct()
    met = edges.where(F.col("kind").isin(*DEPENDS)).join(homes, "target").select(F.col("home").alias("node"), F.col("file_path").alias("next"))
    steps = met.union(edges.where("kind = 'IMPORTS_FROM'").select(F.col("target").alias("node"), F.col("file_path").alias("next"))).where("node <> next")
    return reach(steps, files.select(F.lit(0).alias("root"), F.col("file_path").alias("node")), hops, most).drop("root")


def induced(edges: DataFrame, *node_sets: DataFrame) -> DataFrame:
    """The edges with both ends in one of the sets (column node)."""
    inside = reduce(DataFrame.union, (n.select("node") for n in node_sets)).distinct()
    return edges.join(inside.toDF("source"), "source", "left_semi").join(inside.toDF("target"), "target", "left_semi").select(*edges.columns)
