"""Source trees with folders, includes, imports and injected fields, as projections of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.sources import projection

#: Symbols of one rendered Java file.
FILE_SYMBOLS = 100


def _header(p: Column) -> Column:
    """The header of a symbol's number: names below 300 are shared by several folders, and tops by all."""
    top = F.element_at(F.array(F.lit("src"), F.lit("lib"), F.lit("vendor/src")), (p % 3 + 1).cast("int"))
    return F.concat(top, F.lit("/d"), (p % 7).cast("string"), F.lit("/h"), F.when(p % 2 == 0, p % 300).otherwise(p).cast("string"), F.lit(".h"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.nodes(spark, sf_dir).select(_header(F.col("symbol_id")).alias("file_path")).distinct()


def includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: the header of each symbol includes that of the one behind it in an order, by one of four spellings."""
    path = _header(F.col("b"))
    parts = F.split(path, "/")
    tail = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    kind = (F.col("a") + F.col("b")) % 4
    spelled = F.when(kind == 0, F.element_at(parts, -1)).when(kind == 1, tail).when(kind == 2, path).otherwise(F.concat(F.lit("../"), tail))
    return projection.raw_calls(spark, sf_dir, None).select(_header(F.col("a")).alias("source"), spelled.alias("target"))


def _package(p: Column) -> Column:
    part = F.concat(F.lit("p"), (p % 40).cast("string"))
    return F.when(p % 3 == 0, F.concat(F.lit("src/core/"), part)).when(p % 3 == 1, F.concat(F.lit("core/"), part)).otherwise(part)


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.nodes(spark, sf_dir).select(F.concat(_package(F.col("symbol_id")), F.lit("/f"), F.col("symbol_id").cast("string"), F.lit(".go")).alias("file_path"))


def package_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: files that import the package of the symbol behind theirs by its address, often below a longer one."""
    host = F.when(F.col("a") % 2 == 0, "git.example/x/src/core/").when(F.col("a") % 5 == 0, "git.example/xcore/").otherwise("git.example/core/")
    source = F.concat(_package(F.col("a")), F.lit("/f"), F.col("a").cast("string"), F.lit(".go"))
    return projection.raw_calls(spark, sf_dir, None).select(source.alias("source"), F.concat(host, F.lit("p"), (F.col("b") % 45).cast("string")).alias("target"))


def module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, language, module: the file of each symbol imports that of the one behind it, by a dotted name of one to three parts."""
    files = projection.nodes(spark, sf_dir).select("symbol_id", "file_path")
    pairs = projection.raw_calls(spark, sf_dir, None).join(files.toDF("a", "file_path"), "a").join(files.toDF("b", "other"), "b")
    parts = F.split(F.regexp_replace("other", "\\.py$", ""), "/")
    return pairs.select("file_path", F.lit("python").alias("language"), F.array_join(F.slice(parts, -((F.col("a") + F.col("b")) % 3 + 1).cast("int"), F.lit(3)), ".").alias("module")).distinct()


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a hundred symbols to a file, each with an interface, a class that implements it and calls the next symbol's through a field.

    Every fifth interface has a second class, every third class leaves its field bare, and
    of every second interface, named for a workflow's activity, every other one says so.
    """
    rows = projection.nodes(spark, sf_dir).select("symbol_id", "name", F.regexp_replace("file_path", "\\.py$", F.concat(F.lit("/J"), F.floor(F.col("symbol_id") / FILE_SYMBOLS).cast("string"), F.lit(".java"))).alias("path"))
    after = Window.partitionBy("path").orderBy("symbol_id")
    rows = rows.withColumn("q", F.lead("symbol_id").over(after)).withColumn("next", F.lead("name").over(after))
    kind = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"), F.when(F.col(c) % 2 == 0, "Activity").otherwise(""))
    p = F.col("symbol_id").cast("string")
    field = F.when(F.col("q").isNotNull(), F.concat(F.when(F.col("symbol_id") % 3 != 0, "@Autowired ").otherwise(""), F.lit("private "), kind("q"), F.lit(" dep;\n"))).otherwise("")
    body = F.when(F.col("q").isNotNull(), F.concat(F.lit("{ dep."), "next", F.lit("(); }"))).otherwise("{ }")
    unit = F.concat(
        F.when(F.col("symbol_id") % 4 == 0, "@ActivityInterface ").otherwise(""), F.lit("interface "), kind("symbol_id"), F.lit(" { void "), "name", F.lit("(); }\nclass K"), p, F.lit(" implements "), kind("symbol_id"), F.lit(" {\n"),
        field, F.lit("public void "), "name", F.lit("() "), body, F.lit(" // dep.no()\n}\n"), F.when(F.col("symbol_id") % 5 == 0, F.concat(F.lit("class L"), p, F.lit(" implements "), kind("symbol_id"), F.lit(" { }\n"))).otherwise(""),
    )
    placed = rows.select("path", "symbol_id", unit.alias("unit"))
    return placed.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("symbol_id", "unit")))["unit"], "").alias("content"))
