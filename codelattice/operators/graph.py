"""Joins, aggregates and bounded traversals over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.sources.storage import cut


def stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind", "language").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("n_files"))


def by_size(nodes: DataFrame, min_lines: int) -> DataFrame:
    """Symbols of min_lines at least."""
    lines = F.col("line_end") - F.col("line_start") + 1
    return nodes.select("qualified_name", "kind", lines.alias("n_lines")).where(F.col("n_lines") >= min_lines)


def resolve_bare(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bare targets with exactly one symbol of that name become qualified; others stay as they are."""
    unique = nodes.groupBy("name").agg(F.count("*").alias("c"), F.min("qualified_name").alias("found")).where("c = 1").select(F.col("name").alias("target"), "found")
    joined = calls.join(unique, "target", "left")
    hit = F.col("is_bare") & F.col("found").isNotNull()
    return joined.select("source", F.when(hit, F.col("found")).otherwise(F.col("target")).alias("target"), "file_path", "line", (F.col("is_bare") & ~hit).alias("is_bare"))


def callers(calls: DataFrame) -> DataFrame:
    """Per qualified target: distinct callers and call sites."""
    return calls.where("not is_bare").groupBy("target").agg(F.countDistinct("source").alias("n_callers"), F.count("*").alias("n_sites"))


def callees(calls: DataFrame) -> DataFrame:
    return calls.groupBy("source").agg(F.countDistinct("target").alias("n_callees"), F.count("*").alias("n_sites"))


def tested_by(calls: DataFrame) -> DataFrame:
    """TESTED_BY edges: from what a test calls to the test."""
    return calls.where("source_test and not target_test").select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()


def test_gaps(nodes: DataFrame, tested: DataFrame) -> DataFrame:
    """Production functions that no test calls."""
    production = nodes.where("kind = 'Function'").select("qualified_name", "file_path")
    return production.join(tested.select(F.col("source").alias("qualified_name")), "qualified_name", "left_anti")


def module_edges(calls: DataFrame) -> DataFrame:
    """Call counts between the folders of source and target."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    pairs = calls.where("not is_bare").select(folder("file_path").alias("from_dir"), folder(F.split_part("target", F.lit("::"), F.lit(1))).alias("to_dir"))
    return pairs.where("from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count("*").alias("n"))


def entry_points(nodes: DataFrame, calls: DataFrame, names: str | None = None, decorators: DataFrame | None = None) -> DataFrame:
    """Functions that nothing calls by their qualified name; with `names`, those whose name matches it, and
    with `decorators` (qualified_name), those that a framework decorates, called or not."""
    called = calls.where("not is_bare").select(F.col("target").alias("qualified_name"))
    functions = nodes.where("kind = 'Function'")
    found = functions.select("qualified_name").join(called, "qualified_name", "left_anti")
    if names is not None:
        found = found.union(functions.where(F.col("name").rlike(names)).select("qualified_name"))
    if decorators is not None:
        found = found.union(functions.select("qualified_name").join(decorators, "qualified_name", "left_semi"))
    return found if names is None and decorators is None else found.distinct()


def overlaps(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols whose lines meet a changed range of their file, with the number of such ranges.

    Ranges are cut into line buckets, so a large file is spread over many tasks.
    """
    width = 64
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    left = nodes.where("line_end >= line_start").select("qualified_name", "file_path", "line_start", "line_end", spread("line_start", "line_end").alias("bucket"))
    right = ranges.where("end >= start").select("file_path", "start", "end", spread("start", "end").alias("bucket"))
    met = (F.col("line_start") <= F.col("end")) & (F.col("start") <= F.col("line_end"))
    first = F.col("bucket") == F.floor(F.greatest("line_start", "start") / width)  # count each pair once
    return left.join(right, ["file_path", "bucket"]).where(met & first).groupBy("qualified_name").agg(F.count("*").alias("n_ranges"))


def churn(commits: DataFrame) -> DataFrame:
    return commits.groupBy("file_path").agg(F.countDistinct("sha").alias("n_commits"), F.max("ts").alias("last_ts"))


def co_change(commits: DataFrame, min_together: int = 2, max_files: int = 50) -> DataFrame:
    """Pairs of files with min_together common commits at least; commits of over max_files files say nothing."""
    small = commits.groupBy("sha").agg(F.count("*").alias("c")).where(F.col("c").between(2, max_files)).select("sha")
    files = commits.join(small, "sha").select("sha", "file_path")
    pairs = files.select("sha", F.col("file_path").alias("file_a")).join(files.select("sha", F.col("file_path").alias("file_b")), "sha").where("file_a < file_b")
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("n")).where(F.col("n") >= min_together)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, *, both_ways: bool = True) -> DataFrame:
    """node, depth: what `depth` steps at most lead to from the seeds (column node), level by level."""
    step = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    if both_ways:
        step = step.union(edges.select(F.col("target"), F.col("source")))
    step = cut(step.distinct())
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.join(step, "node").select(F.col("next").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen
