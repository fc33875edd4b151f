"""The readers on texts that Spark renders from the given tables: diffs, commit logs, ledgers and code, with SQL of what they must find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.functions import text as texts
from codelattice.jobs.queries import _NODES
from codelattice.sources import projection, python_code, readers
from codelattice.sources.storage import table

#: Symbols of one rendered file.
FILE_SYMBOLS = 100


def _diffs(s: SparkSession, d: str) -> DataFrame:
    """One unified diff per order: a hunk for each line of the order, in the file of its part."""
    files = projection.nodes(s, d).select(F.col("symbol_id").alias("l_partkey"), "file_path")
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey", "l_linenumber").join(files, "l_partkey")
    hunk = F.format_string("+++ b/%s\n@@ -0,0 +%d,%d @@ part\n+code", "file_path", 1 + F.col("sha") % 400, (F.col("l_linenumber") + 1).cast("long"))
    return rows.groupBy("sha").agg(F.array_join(F.array_sort(F.collect_list(hunk)), "\n").alias("text"))


def _logs(s: SparkSession, d: str) -> DataFrame:
    """One log per customer: the customer's orders, newest first, each with the files of its lines."""
    files = projection.commits(s, d, None).groupBy("sha").agg(F.array_join(F.array_sort(F.collect_list("file_path")), "\n").alias("files"))
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("sha"), "o_custkey", "o_orderdate", "o_orderpriority")
    commit = F.concat(F.lit("\x00"), "o_orderpriority", F.lit("\n"), F.coalesce("files", F.lit("")), F.lit("\n"))
    listed = orders.join(files, "sha", "left").groupBy("o_custkey").agg(F.reverse(F.array_sort(F.collect_list(F.struct("o_orderdate", "sha", commit.alias("commit"))))).alias("commits"))
    return listed.select("o_custkey", F.array_join("commits.commit", "").alias("text"))


def _ledger(s: SparkSession, d: str) -> DataFrame:
    """Each event as a JSON line, each also cut short, which no reader may count."""
    events = table(s, d, "events").select("event_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    return readers.ledger(events.select(line.alias("value")).union(events.select(F.left(line, F.lit(12)))), schema)


def _code(s: SparkSession, d: str) -> DataFrame:
    """Python files of a hundred symbols at most: a class with one method each, which calls the method of the next one."""
    rows = projection.nodes(s, d).select("symbol_id", "name", "parent_name", F.regexp_replace("file_path", "\\.py$", F.concat(F.lit("/m"), F.floor(F.col("symbol_id") / FILE_SYMBOLS).cast("string"), F.lit(".py"))).alias("path"))
    after = F.lead("name").over(Window.partitionBy("path").orderBy("symbol_id"))
    unit = F.concat(F.lit("class "), "parent_name", F.lit(":\n    def "), "name", F.lit("(self):\n        return "), F.coalesce(F.concat(after, F.lit("()")), F.lit("None")), F.lit("\n"))
    placed = rows.withColumn("unit", unit)
    return placed.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("symbol_id", "unit")))["unit"], "\n").alias("content"))


def _extracted(s: SparkSession, d: str) -> DataFrame:
    return python_code.extract(_code(s, d))


def _names(s: SparkSession, d: str) -> DataFrame:
    """The column helpers on every symbol."""
    q, f = F.col("qualified_name"), F.col("file_path")
    return projection.nodes(s, d).select(
        "symbol_id", texts.short(q).alias("short"), texts.file_part(q).alias("file"), texts.folder(f).alias("folder"), texts.stem(f).alias("stem"), texts.suffix(f).alias("suffix"),
        texts.page_slug(f).alias("slug"), texts.file_slug(q).alias("file_slug"), texts.humanized(F.col("name")).alias("words"), texts.clipped(q, 20).alias("clipped"), texts.short_hash(q).alias("hash"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parsed_diff_ranges": lambda s, d: readers.diff_ranges(_diffs(s, d), ["sha"]),
    "parsed_commit_log": lambda s, d: readers.commit_log(_logs(s, d), ["o_custkey"]),
    "parsed_ledger": _ledger,
    "extracted_symbols": lambda s, d: python_code.symbols(_extracted(s, d)).select("kind", "qualified_name", "line_start", "line_end", "is_test"),
    "extracted_calls": lambda s, d: python_code.edges(_extracted(s, d)).where("kind = 'CALLS'").select("source", "target", "line"),
    "symbol_names": _names,
}

_CODE = rf"""WITH {_NODES}, code AS (SELECT *, regexp_replace(file_path, '\.py$', '/m' || (symbol_id // 100) || '.py') AS path, p - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY file_path, symbol_id // 100 ORDER BY symbol_id) AS p FROM nodes)),
methods AS (SELECT *, path || '::' || parent_name || '.' || name AS q, lead(name) OVER (PARTITION BY path ORDER BY symbol_id) AS callee FROM code),
firsts AS (SELECT path, name, arg_min(q, symbol_id) AS q FROM methods GROUP BY path, name)
"""

ORACLE_SQL: dict[str, str] = {
    "parsed_diff_ranges": f"WITH {_NODES} SELECT l_orderkey AS sha, file_path, 1 + l_orderkey % 400 AS start, 1 + l_orderkey % 400 + l_linenumber AS \"end\" FROM lineitem JOIN nodes ON symbol_id = l_partkey",
    "parsed_commit_log": f"""WITH {_NODES}, ranked AS (SELECT o_orderkey, o_custkey, o_orderpriority AS subject, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS ord FROM orders)
SELECT DISTINCT o_custkey, ord, subject, file_path FROM ranked JOIN lineitem ON l_orderkey = o_orderkey JOIN nodes ON symbol_id = l_partkey""",
    "parsed_ledger": "SELECT event_id, event_type, value FROM events",
    "extracted_symbols": _CODE
    + """SELECT DISTINCT 'File' AS kind, path AS qualified_name, 1 AS line_start, 4 * CAST(max(i) OVER (PARTITION BY path) AS INTEGER) + 4 AS line_end, is_test FROM methods
UNION ALL SELECT 'Class', path || '::' || parent_name, 4 * i + 1, 4 * i + 3, is_test FROM methods UNION ALL SELECT 'Function', q, 4 * i + 2, 4 * i + 3, is_test FROM methods""",
    "extracted_calls": _CODE + "SELECT m.q AS source, f.q AS target, 4 * i + 3 AS line FROM methods m JOIN firsts f ON f.path = m.path AND f.name = m.callee",
    "symbol_names": rf"""WITH {_NODES} SELECT symbol_id, split_part(qualified_name, '::', 2) AS short, file_path AS file, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.py$', '') AS stem, '.py' AS suffix,
  regexp_replace(replace(file_path, '/', '.'), '\.py$', '') AS slug, regexp_replace(qualified_name, '[^A-Za-z0-9_.-]', '-', 'g') AS file_slug, trim(lower(regexp_replace(name, '_+', ' ', 'g'))) AS words,
  CASE WHEN length(qualified_name) > 20 THEN substr(qualified_name, 1, 19) || '…' ELSE qualified_name END AS clipped, substr(sha256(qualified_name), 1, 16) AS hash FROM nodes""",
}
