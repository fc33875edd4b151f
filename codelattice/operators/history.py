"""Coverage of documentation, and what the commit history says about files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.operators.graph import churn, co_change

FOLDER = "^(.*)/[^/]*$"


def _measures() -> list[Column]:
    done = F.count_if(F.col("doc").isNotNull())
    return [F.count("*").alias("n"), done.alias("n_documented"), F.expr("count_if(doc is not null) * 100 div greatest(count(*), 1)").alias("percent")]


def coverage(documented: DataFrame) -> DataFrame:
    """documented: symbols with `doc`, null where there is none. One row of counts and the percentage, rounded down; 0 without symbols."""
    return documented.agg(*_measures())


def coverage_by_dir(documented: DataFrame) -> DataFrame:
    return documented.groupBy(F.regexp_extract("file_path", FOLDER, 1).alias("dir")).agg(*_measures())


def coverage_rollup(documented: DataFrame) -> DataFrame:
    """Per file, per folder and in all; the levels above have null names."""
    return documented.withColumn("dir", F.regexp_extract("file_path", FOLDER, 1)).rollup("dir", "file_path").agg(*_measures())


def small_commits(commits: DataFrame, most: int = 8) -> DataFrame:
    """Commits that touch `most` files at most; bulk changes say nothing about a file."""
    small = commits.groupBy("sha").agg(F.count("*").alias("c")).where(F.col("c") <= most).select("sha")
    return commits.join(small, "sha", "left_semi")


def hottest(commits: DataFrame, top: int = 5) -> DataFrame:
    """The files with most commits, two at least."""
    return churn(small_commits(commits)).where("n_commits >= 2").orderBy(F.desc("n_commits"), "file_path").limit(top).select("file_path", "n_commits")


def coupled(commits: DataFrame, imports: DataFrame, *, share: int = 2, least: int = 3, top: int = 5) -> DataFrame:
    """Pairs that change together without an import between them: n >= least and share * n >= the smaller churn."""
    small = small_commits(commits)
    counts = churn(small).select("file_path", "n_commits")
    pairs = co_change(small, least)
    linked = imports.select(F.least("source", "target").alias("file_a"), F.greatest("source", "target").alias("file_b")).distinct()
    rated = pairs.join(linked, ["file_a", "file_b"], "left_anti").join(counts.toDF("file_a", "n_a"), "file_a").join(counts.toDF("file_b", "n_b"), "file_b")
    close = rated.where(share * F.col("n") >= F.least("n_a", "n_b"))
    return close.orderBy(F.desc("n"), "file_a", "file_b").limit(top).select("file_a", "file_b", "n")


def origins(commits: DataFrame, subjects: DataFrame) -> DataFrame:
    """The subject of the oldest small commit of each file."""
    rows = small_commits(commits).join(subjects, "sha")
    return rows.groupBy("file_path").agg(F.min_by("subject", F.struct("ts", "sha")).alias("origin"))
