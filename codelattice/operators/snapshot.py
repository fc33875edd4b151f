"""The state of a repository's documentation as numbers, and the listings that stand beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import short
from codelattice.sources.readers import STAMP

METRICS = ["symbols_documented", "symbols_total", "modules_documented", "modules_total", "files_documented", "files_total", "doc_lines", "pages_generated", "pages_authored", "page_lines"]


def n_lines(text: Column) -> Column:
    """Lines of a text: what line ends cut it into; one at its very end opens no line. Empty and null texts have none."""
    ends = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    return F.length(F.regexp_replace(ends, "[^\n]", "")) + F.when((ends != "") & ~ends.endswith("\n"), 1).otherwise(0)


def without_twins(symbols: DataFrame) -> DataFrame:
    """symbols (file_path, qualified_name, line_start, ...) without the inner ones of one declaration: a dotted name whose owner starts on the same line."""
    tail = short(F.col("qualified_name"))
    owners = symbols.select("file_path", tail.alias("__owner"), "line_start").distinct()
    inner = symbols.where(tail.contains(".")).withColumn("__owner", F.regexp_replace(tail, r"\.[^.]*$", ""))
    twins = inner.join(owners, ["file_path", "__owner", "line_start"], "left_semi").select("file_path", "qualified_name", "line_start").distinct()
    return symbols.join(twins, ["file_path", "qualified_name", "line_start"], "left_anti").select(*symbols.columns)


def snapshot(modules: DataFrame, symbols: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of METRICS of modules (module, doc), their symbols (module, doc) and all pages (text).

    A text is documentation if it isn't empty; null is none. A file is documented if its
    module and each of its symbols are; pages are told apart by their stamp.
    """
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    of_file = symbols.groupBy("module").agg(F.count("*").alias("n"), F.count_if(has("doc")).alias("n_done"), F.sum(n_lines(F.col("doc"))).alias("lines"))
    rows = modules.groupBy("module").agg(F.max("doc").alias("doc")).join(of_file, "module", "left").na.fill(0, ["n", "n_done", "lines"])
    code = rows.agg(
        F.coalesce(F.sum("n_done"), F.lit(0)).alias("symbols_documented"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols_total"), F.count_if(has("doc")).alias("modules_documented"), F.count("*").alias("modules_total"),
        F.count_if(has("doc") & (F.col("n") == F.col("n_done"))).alias("files_documented"), F.count("*").alias("files_total"), F.coalesce(F.sum(F.col("lines") + n_lines(F.col("doc"))), F.lit(0)).alias("doc_lines"),
    )
    ours = F.coalesce(F.col("text").startswith(STAMP), F.lit(False))
    texts = pages.agg(F.count_if(ours).alias("pages_generated"), F.count_if(~ours).alias("pages_authored"), F.coalesce(F.sum(n_lines(F.col("text"))), F.lit(0)).alias("page_lines"))
    return code.join(F.broadcast(texts)).select(*METRICS)  # one row each


def listings(symbols: DataFrame, most: int = 8) -> DataFrame:
    """file_path, names, n_more: the first `most` names of a file's symbols (file_path, name, line_start), by line, and how many more there are."""
    order = Window.partitionBy("file_path").orderBy("line_start", "name")
    placed = symbols.select("file_path", "name", "line_start").withColumn("place", F.row_number().over(order))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "name"))))["name"]
    return placed.groupBy("file_path").agg(F.array_join(first, ", ").alias("names"), F.greatest(F.count("*") - most, F.lit(0)).alias("n_more"))


def memberships(flows: DataFrame) -> DataFrame:
    """node, n_flows: in how many flows (entry, node) each node is."""
    return flows.groupBy("node").agg(F.countDistinct("entry").alias("n_flows"))


def folder_ranks(positions: DataFrame) -> DataFrame:
    """dir, rank, n_modules: folders in the order in which a tour (module, position) first comes to them."""
    folder = F.regexp_extract("module", "^(.*)/[^/]*$", 1)
    return positions.groupBy(folder.alias("dir")).agg(F.min("position").alias("rank"), F.count("*").alias("n_modules"))
