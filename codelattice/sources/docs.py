"""Authored pages, their anchors and the history they are checked against, as projections of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.sources import projection
from codelattice.sources.storage import table


def fingerprint(text: Column) -> Column:
    """Sixteen hex digits of a text whose runs of white space count as one space."""
    return F.substring(F.sha2(F.regexp_replace(text, "[ \\t\\r\\n]+", " ").cast("binary"), 256), 1, 16)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, generated, pinned (its code was verified once) and text of every page."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    path = F.concat_ws("/", F.lit("docs"), "lang", "source", F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.concat(path, F.lit(".md")).alias("page"), (F.coalesce("quality", F.lit(1)) == 0).alias("generated"), F.col("quality").isNotNull().alias("pinned"), "text")


def anchor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pos, token: each page names the symbol of its number, verified pages with a fingerprint, and the next symbol with its file; one in ten has a further mark, a broken, conflicting or repeated one."""
    symbols = projection.nodes(spark, sf_dir).select("symbol_id", "name", "file_path")
    rows = pages(spark, sf_dir)
    own = rows.join(symbols, rows["doc_id"] == symbols["symbol_id"], "left").select("page", F.lit(0).alias("pos"), F.concat(F.lit("sym:"), F.coalesce("name", F.concat(F.lit("ghost_"), F.col("doc_id").cast("string")))).alias("token"))
    pins = rows.where("pinned").select("page", F.lit(1).alias("pos"), F.concat(F.lit("sig:"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16)).alias("token"))
    after = rows.join(symbols, rows["doc_id"] + 1 == symbols["symbol_id"]).select("page", F.lit(2).alias("pos"), F.concat(F.lit("sym:"), "name", F.lit("@"), "file_path").alias("token"))
    odd = rows.where("doc_id % 10 = 3").join(symbols, rows["doc_id"] == symbols["symbol_id"], "left")
    name = F.concat(F.lit("sym:"), F.coalesce("name", F.concat(F.lit("ghost_"), F.col("doc_id").cast("string"))))
    third = odd.select("page", F.lit(3).alias("pos"), F.when(F.col("doc_id") % 3 == 0, "sig:oops").when(F.col("doc_id") % 3 == 1, name).otherwise(F.concat(F.lit("sig:"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16))).alias("token"))
    fourth = odd.where("doc_id % 3 = 1").select("page", F.lit(4).alias("pos"), F.concat(F.lit("sig:"), F.substring(F.sha2(F.col("page").cast("binary"), 256), 1, 16)).alias("token"))
    return own.union(pins).union(after).union(third).union(fourth)


def symbol_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qualified_name and fingerprint of the symbols that have a text; it stands for their code."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("symbol_id"), fingerprint(F.col("text")).alias("fingerprint"))
    return projection.nodes(spark, sf_dir).join(texts, "symbol_id").select("qualified_name", "fingerprint")


def base_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints before the last commits: three of four symbols had their text in lower case."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("symbol_id"), fingerprint(F.when(F.col("doc_id") % 4 != 0, F.lower("text")).otherwise(F.col("text"))).alias("fingerprint"))
    return projection.nodes(spark, sf_dir).join(texts, "symbol_id").select("qualified_name", "fingerprint")


def changed_symbols(spark: SparkSession, sf_dir: str, days: int = 2) -> DataFrame:
    """Symbols of the commits of the last days: symbol_id, qualified_name, name, file_path."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last"))
    late = orders.join(F.broadcast(last)).where(F.col("o_orderdate") >= F.col("last") - F.make_interval(days=F.lit(days))).select(F.col("o_orderkey").alias("l_orderkey"))
    touched = table(spark, sf_dir, "lineitem").join(late, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("symbol_id"))
    return projection.nodes(spark, sf_dir).join(touched, "symbol_id", "left_semi").select("symbol_id", "qualified_name", "name", "file_path")


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose last commit, by time and number, didn't delete them: commits of priority 5-LOW delete."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") == "5-LOW").alias("deletes"))
    touched = projection.commits(spark, sf_dir, None).select("sha", "file_path").join(orders, "sha")
    last = touched.groupBy("file_path").agg(F.max_by("deletes", F.struct("ts", "sha")).alias("deleted"))
    return last.where("not deleted").select("file_path")


def module_edges(spark: SparkSession, sf_dir: str, ratio: int = 2) -> DataFrame:
    """source, target: modules that follow each other over all orders at least ratio times as often one way as the other."""
    files = projection.nodes(spark, sf_dir).select("symbol_id", "file_path")
    pairs = projection.raw_calls(spark, sf_dir, None).join(files.toDF("a", "source"), "a").join(files.toDF("b", "target"), "b").where("source <> target")
    counts = pairs.groupBy("source", "target").agg(F.count("*").alias("n"))
    back = counts.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("n").alias("m"))
    return counts.join(back, ["source", "target"], "left").where(F.col("n") >= ratio * F.coalesce("m", F.lit(0))).select("source", "target")


def main_imports(spark: SparkSession, sf_dir: str, top: int = 2) -> DataFrame:
    """source, target: the `top` modules that each module is followed by most oftener than it follows them, ties by name."""
    files = projection.nodes(spark, sf_dir).select("symbol_id", "file_path")
    pairs = projection.raw_calls(spark, sf_dir, None).join(files.toDF("a", "source"), "a").join(files.toDF("b", "target"), "b").where("source <> target")
    counts = pairs.groupBy("source", "target").agg(F.count("*").alias("n"))
    back = counts.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("n").alias("m"))
    more = counts.join(back, ["source", "target"], "left").withColumn("more", F.col("n") - F.coalesce("m", F.lit(0))).where("more > 0")
    order = Window.partitionBy("source").orderBy(F.desc("more"), "target")
    return more.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("source", "target")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day and the counts of events and users of the day, in the order of days: the states that a ledger records."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.to_date("ts").alias("day")).agg((F.count("*") / 100).cast("long").alias("hundreds"), F.countDistinct("event_type").alias("types"))
