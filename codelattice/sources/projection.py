"""The code-graph relations as projections of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.functions import marks
from codelattice.sources.storage import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols: one per part."""
    promo = F.col("p_type") == "PROMO"
    folder = F.when(promo, "tests/promo/").otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/")))
    base = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"),
        F.concat(folder, F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".py")).alias("file_path"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_partkey") % 20).cast("string")).alias("name"),
        F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("parent_name"),
        F.when(promo, "Test").when(F.col("p_size") >= 40, "Class").otherwise("Function").alias("kind"),
        promo.alias("is_test"),
        (1 + F.col("p_partkey") % 400).alias("line_start"),
        (F.col("p_partkey") % 400 + F.col("p_size")).alias("line_end"),
        F.lit("python").alias("language"),
    )
    return base.withColumn("qualified_name", F.concat("file_path", F.lit("::"), "parent_name", F.lit("."), "name"))


def _lines(spark: SparkSession, sf_dir: str, min_quantity: int | None) -> DataFrame:
    """Lines of min_quantity at least; every line where it is None."""
    lines = table(spark, sf_dir, "lineitem")
    return lines if min_quantity is None else lines.where(F.col("l_quantity") >= min_quantity)


def raw_calls(spark: SparkSession, sf_dir: str, min_quantity: int | None = 45) -> DataFrame:
    """a, b, line: consecutive parts of an order, of lines of min_quantity at least (None: of all)."""
    lines = _lines(spark, sf_dir, min_quantity).select("l_orderkey", "l_partkey", "l_linenumber")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return lines.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"), F.col("l_linenumber").alias("line")).where("b is not null and a <> b")


def calls(spark: SparkSession, sf_dir: str, min_quantity: int | None = 45, callers: DataFrame | None = None) -> DataFrame:
    """CALLS edges: source, target (bare where (a + b) % 5 = 0), file_path, line, source_test, target_test; with callers (a), only theirs."""
    symbols = nodes(spark, sf_dir).select("symbol_id", "qualified_name", "name", "file_path", "is_test")
    source = symbols.select(F.col("symbol_id").alias("a"), F.col("qualified_name").alias("source"), "file_path", F.col("is_test").alias("source_test"))
    target = symbols.select(F.col("symbol_id").alias("b"), F.col("qualified_name").alias("__qn"), F.col("name").alias("__name"), F.col("is_test").alias("target_test"))
    raw = raw_calls(spark, sf_dir, min_quantity)
    raw = raw if callers is None else raw.join(callers, "a", "left_semi")
    joined = raw.join(source, "a").join(target, "b")
    bare = (F.col("a") + F.col("b")) % 5 == 0
    return joined.select("source", F.when(bare, F.col("__name")).otherwise(F.col("__qn")).alias("target"), "file_path", "line", bare.alias("is_bare"), "source_test", F.when(~bare, F.col("target_test")).alias("target_test")).distinct()


def imports(spark: SparkSession, sf_dir: str, min_quantity: int | None = 49) -> DataFrame:
    """IMPORTS_FROM edges between files."""
    files = nodes(spark, sf_dir).select("symbol_id", "file_path")
    joined = raw_calls(spark, sf_dir, min_quantity).join(files.toDF("a", "source"), "a").join(files.toDF("b", "target"), "b")
    return joined.where("source <> target").select("source", "target").distinct()


def commits(spark: SparkSession, sf_dir: str, min_quantity: int | None = 45) -> DataFrame:
    """sha, ts, file_path: the files that each order's lines of min_quantity at least touch (None: all its lines)."""
    lines = _lines(spark, sf_dir, min_quantity).select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("symbol_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"))
    return lines.join(nodes(spark, sf_dir).select("symbol_id", "file_path"), "symbol_id").join(orders, "sha").select("sha", "ts", "file_path").distinct()


def diff_ranges(spark: SparkSession, sf_dir: str, since: str | None = "2001-10-15") -> DataFrame:
    """file_path, start, end of changed lines, of those shipped since that day (None: of all)."""
    lines = table(spark, sf_dir, "lineitem")
    if since is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    rows = lines.join(nodes(spark, sf_dir).select(F.col("symbol_id").alias("l_partkey"), "file_path"), "l_partkey")
    start = 1 + F.col("l_orderkey") % 400
    return rows.select("file_path", start.alias("start"), (start + F.col("l_linenumber")).alias("end")).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File nodes: qualified_name, kind."""
    return nodes(spark, sf_dir).select(F.col("file_path").alias("qualified_name"), F.lit("File").alias("kind")).distinct()


def edges(spark: SparkSession, sf_dir: str, min_call: int | None = 45, min_import: int | None = 49) -> DataFrame:
    """kind, source, target, line of CALLS, IMPORTS_FROM, CONTAINS (file to symbol) and INHERITS (class to the next of its stem)."""
    symbols = nodes(spark, sf_dir)
    order = Window.partitionBy(F.regexp_replace("name", "_[0-9]+$", "")).orderBy("symbol_id")
    heirs = symbols.where("kind = 'Class'").select(F.lit("INHERITS").alias("kind"), F.col("qualified_name").alias("source"), F.lead("qualified_name").over(order).alias("target"), F.lit(0).alias("line"))
    contains = symbols.select(F.lit("CONTAINS"), "file_path", "qualified_name", F.lit(0))
    imported = imports(spark, sf_dir, min_import).select(F.lit("IMPORTS_FROM"), "source", "target", F.lit(0))
    called = calls(spark, sf_dir, min_call).select(F.lit("CALLS"), "source", "target", "line")
    return heirs.where("target is not null").union(contains).union(imported).union(called)


def documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production symbols with `doc`, the text of the document of their number."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("symbol_id"), F.col("text").alias("doc"))
    return nodes(spark, sf_dir).where("not is_test").join(texts, "symbol_id", "left").select("qualified_name", "file_path", "doc")


#: Decorators that symbols have by turns; the framework's are those at 0, 2, 4, 6, 8 and 9.
DECORATORS = ['app.get("/x")', "functools.cache", "pytest.mark.slow", "property", "Router.Post", "staticmethod", "receiver(saved)", "dataclass", "tool", "bp.route('/')", "my_tool.helper", "Pytest.Mark"]


def decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qualified_name, decorators (array): two of every seven symbols have one or two."""
    k = F.col("symbol_id")
    listed = F.array(*(F.lit(d) for d in DECORATORS))
    first, second = F.get(listed, (k % 12).cast("int")), F.get(listed, (F.floor(k / 12) % 12).cast("int"))
    return nodes(spark, sf_dir).select("qualified_name", F.when(k % 7 == 0, F.array(first)).when(k % 7 == 1, F.array(first, second)).alias("decorators"))


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qualified_name of the symbols with a framework's decorator."""
    return decorators(spark, sf_dir).where(marks.entry_decorator(F.col("decorators"))).select("qualified_name")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("subject"))
