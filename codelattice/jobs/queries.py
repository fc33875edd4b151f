"""Registered queries of the code graph, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators import graph, ledger
from codelattice.sources import projection
from codelattice.sources.storage import table

SEED_FILE = "src/economy/brand_1.py"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def queries_on(p) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries over the relations that p projects."""

    def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
        seeds = p.nodes(spark, sf_dir).where(F.col("file_path") == SEED_FILE).select(F.col("qualified_name").alias("node"))
        return graph.reach(p.calls(spark, sf_dir).where("not is_bare"), seeds, 2)

    return {
        "node_stats": lambda s, d: graph.stats(p.nodes(s, d)),
        "nodes_by_size": lambda s, d: graph.by_size(p.nodes(s, d), 30),
        "resolve_bare_calls": lambda s, d: graph.resolve_bare(p.calls(s, d), p.nodes(s, d)),
        "xref_callers": lambda s, d: graph.callers(p.calls(s, d)),
        "xref_callees": lambda s, d: graph.callees(p.calls(s, d)),
        "tested_by_derivation": lambda s, d: graph.tested_by(p.calls(s, d)),
        "test_gaps": lambda s, d: graph.test_gaps(p.nodes(s, d), graph.tested_by(p.calls(s, d))),
        "module_edges": lambda s, d: graph.module_edges(p.calls(s, d)),
        "entry_points": lambda s, d: graph.entry_points(p.nodes(s, d), p.calls(s, d)),
        "import_edges": lambda s, d: p.imports(s, d),
        "changed_symbols_overlap": lambda s, d: graph.overlaps(p.nodes(s, d), p.diff_ranges(s, d)),
        "churn": lambda s, d: graph.churn(p.commits(s, d)),
        "co_change": lambda s, d: graph.co_change(p.commits(s, d)),
        "impact_radius": _impact,
        "ledger_changes": lambda s, d: ledger.daily(_events(s, d)),
        "ledger_deltas": lambda s, d: ledger.deltas(ledger.daily(_events(s, d))),
        "spend_totals": lambda s, d: ledger.spend(_events(s, d)),
        "event_tumbling": lambda s, d: ledger.tumbling(_events(s, d)),
        "upsert_last_wins": lambda s, d: ledger.latest(_events(s, d)),
    }


QUERIES = queries_on(projection)

_NODES = """nodes AS (
  SELECT *, file_path || '::' || parent_name || '.' || name AS qualified_name FROM (
    SELECT p_partkey AS symbol_id,
      CASE WHEN p_type = 'PROMO' THEN 'tests/promo/' ELSE 'src/' || lower(p_type) || '/' END || lower(replace(p_brand, '#', '_')) || '.py' AS file_path,
      replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 20 AS VARCHAR) AS name, 'K' || CAST(p_partkey AS VARCHAR) AS parent_name,
      CASE WHEN p_type = 'PROMO' THEN 'Test' WHEN p_size >= 40 THEN 'Class' ELSE 'Function' END AS kind, p_type = 'PROMO' AS is_test,
      1 + p_partkey % 400 AS line_start, p_partkey % 400 + p_size AS line_end, 'python' AS language FROM part) q)"""
_RAW = """raw AS (SELECT * FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, l_linenumber AS line
  FROM lineitem WHERE l_quantity >= {q}) r WHERE b IS NOT NULL AND a <> b)"""
_CALLS = (
    f"WITH RECURSIVE {_NODES}, {_RAW.format(q=45)}, "
    """calls AS (SELECT DISTINCT s.qualified_name AS source, CASE WHEN (a + b) % 5 = 0 THEN t.name ELSE t.qualified_name END AS target, s.file_path, line,
  (a + b) % 5 = 0 AS is_bare, s.is_test AS source_test, CASE WHEN (a + b) % 5 <> 0 THEN t.is_test END AS target_test
  FROM raw JOIN nodes s ON s.symbol_id = a JOIN nodes t ON t.symbol_id = b)
"""
)
_TESTED = "SELECT DISTINCT target AS source, source AS target FROM calls WHERE source_test AND NOT target_test"
_COMMITS = f"""WITH {_NODES}, commits AS (SELECT DISTINCT l_orderkey AS sha, o_orderdate AS ts, file_path FROM lineitem
  JOIN nodes ON symbol_id = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 45)
"""
_DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"

ORACLE_SQL: dict[str, str] = {
    "node_stats": f"WITH {_NODES} SELECT kind, language, count(*) AS n, count(DISTINCT file_path) AS n_files FROM nodes GROUP BY kind, language",
    "nodes_by_size": f"WITH {_NODES} SELECT qualified_name, kind, line_end - line_start + 1 AS n_lines FROM nodes WHERE line_end - line_start + 1 >= 30",
    "resolve_bare_calls": _CALLS
    + """, uniq AS (SELECT name, min(qualified_name) AS found FROM nodes GROUP BY name HAVING count(*) = 1)
SELECT source, CASE WHEN is_bare AND found IS NOT NULL THEN found ELSE target END AS target, file_path, line, is_bare AND found IS NULL AS is_bare FROM calls LEFT JOIN uniq ON target = name""",
    "xref_callers": _CALLS + "SELECT target, count(DISTINCT source) AS n_callers, count(*) AS n_sites FROM calls WHERE NOT is_bare GROUP BY target",
    "xref_callees": _CALLS + "SELECT source, count(DISTINCT target) AS n_callees, count(*) AS n_sites FROM calls GROUP BY source",
    "tested_by_derivation": _CALLS + _TESTED,
    "test_gaps": _CALLS + f"SELECT qualified_name, file_path FROM nodes WHERE kind = 'Function' AND qualified_name NOT IN (SELECT source FROM ({_TESTED}) t)",
    "module_edges": _CALLS
    + """SELECT from_dir, to_dir, count(*) AS n FROM (SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS from_dir,
  regexp_extract(split_part(target, '::', 1), '^(.*)/[^/]*$', 1) AS to_dir FROM calls WHERE NOT is_bare) m WHERE from_dir <> to_dir GROUP BY from_dir, to_dir""",
    "entry_points": _CALLS + "SELECT qualified_name FROM nodes WHERE kind = 'Function' AND qualified_name NOT IN (SELECT target FROM calls WHERE NOT is_bare)",
    "import_edges": f"WITH {_NODES}, {_RAW.format(q=49)} SELECT DISTINCT s.file_path AS source, t.file_path AS target FROM raw JOIN nodes s ON s.symbol_id = a JOIN nodes t ON t.symbol_id = b WHERE s.file_path <> t.file_path",
    "changed_symbols_overlap": f"""WITH {_NODES}, ranges AS (SELECT DISTINCT file_path, 1 + l_orderkey % 400 AS s, 1 + l_orderkey % 400 + l_linenumber AS e
  FROM lineitem JOIN nodes ON symbol_id = l_partkey WHERE l_shipdate >= TIMESTAMP '2001-10-15')
SELECT qualified_name, count(*) AS n_ranges FROM nodes n JOIN ranges r ON n.file_path = r.file_path AND line_start <= e AND s <= line_end AND line_end >= line_start GROUP BY qualified_name""",
    "churn": _COMMITS + "SELECT file_path, count(DISTINCT sha) AS n_commits, max(ts) AS last_ts FROM commits GROUP BY file_path",
    "co_change": _COMMITS
    + """, small AS (SELECT sha FROM commits GROUP BY sha HAVING count(*) BETWEEN 2 AND 50)
SELECT x.file_path AS file_a, y.file_path AS file_b, count(*) AS n FROM commits x JOIN commits y ON x.sha = y.sha AND x.file_path < y.file_path
WHERE x.sha IN (SELECT sha FROM small) GROUP BY ALL HAVING count(*) >= 2""",
    "impact_radius": _CALLS
    + f""", step AS (SELECT source AS u, target AS v FROM calls WHERE NOT is_bare UNION SELECT target, source FROM calls WHERE NOT is_bare),
walk AS (SELECT qualified_name AS node, 0 AS depth FROM nodes WHERE file_path = '{SEED_FILE}' UNION SELECT v, depth + 1 FROM walk JOIN step ON node = u WHERE depth < 2)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
    "ledger_changes": _DAILY,
    "ledger_deltas": f"SELECT day, event_type, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM ({_DAILY}) d",
    "spend_totals": "SELECT event_type AS model, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS tokens, CAST(round(sum(CAST(value AS DECIMAL(38,6))), 2) AS DOUBLE) AS usd FROM events GROUP BY event_type",
    "event_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL",
    "upsert_last_wins": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) e WHERE r = 1",
}
