"""All registered queries of the code graph: those of `queries`, and lookups, history, flows and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import marks
from codelattice.jobs import queries as base
from codelattice.jobs.queries import _CALLS, _COMMITS, _DAILY, _NODES, _RAW, _TESTED, SEED_FILE
from codelattice.operators import flows, graph, history, ledger, lookup
from codelattice.sources import projection
from codelattice.sources.storage import stored, table
from codelattice.streaming import ledger as streams

#: The lists of the library, and what stands for them in the given tables.
SECURITY = [*marks.SECURITY_WORDS, "hot", "gear", "bolt"]
ENTRY_NAME = marks.any_of([*marks.ENTRY_NAMES, "^hot_", "^red_"])
TEST_PATH = "(^|/)tests?/"


def queries_on(p) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries over the relations that p projects."""

    def _seed(s: SparkSession, d: str) -> DataFrame:
        return p.nodes(s, d).where(F.col("file_path") == SEED_FILE)

    def _calls(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        """Entry points and calls, written once."""
        calls = stored(p.calls(s, d), "calls")
        return p.entries(s, d, calls) if hasattr(p, "entries") else graph.entry_points(p.nodes(s, d), calls), calls

    def _flows(s: SparkSession, d: str) -> DataFrame:
        return flows.flow_nodes(*_calls(s, d))

    def _criticality(s: SparkSession, d: str) -> DataFrame:
        entries, calls = _calls(s, d)
        return flows.set_criticality(flows.flow_sets(entries, calls, about=flows.traits(p.nodes(s, d), calls, graph.tested_by(calls), SECURITY)))

    def _impact_edges(s: SparkSession, d: str) -> DataFrame:
        calls = p.calls(s, d).where("not is_bare").withColumn("kind", F.lit("CALLS"))
        return lookup.induced(calls, graph.reach(calls, _seed(s, d).select(F.col("qualified_name").alias("node")), 2).withColumnRenamed("node", "qualified_name"))

    def _dependents(s: SparkSession, d: str) -> DataFrame:
        back = p.imports(s, d).select(F.col("target").alias("source"), F.col("source").alias("target"))
        return graph.reach(back, _seed(s, d).select(F.col("file_path").alias("node")), 2, both_ways=False)

    return base.queries_on(p) | {
        "edge_stats": lambda s, d: lookup.edge_stats(p.edges(s, d)),
        "language_list": lambda s, d: lookup.languages(p.nodes(s, d)),
        "node_lookup": lambda s, d: lookup.named(p.nodes(s, d), p.calls(s, d).where("source_test").select(F.col("target").alias("qualified_name"))),
        "nodes_by_file": lambda s, d: _seed(s, d).select("qualified_name", "kind", "line_start", "line_end"),
        "nodes_by_kind": lambda s, d: lookup.of_kinds(p.nodes(s, d), ["Class", "Test"], "ECONOMY"),
        "files_matching": lambda s, d: lookup.files_matching(p.nodes(s, d), "/BRAND_1.py"),
        "edges_by_source": lambda s, d: lookup.edges_at(p.calls(s, d), _seed(s, d), "source"),
        "edges_by_target": lambda s, d: lookup.edges_at(p.calls(s, d), _seed(s, d), "target"),
        "edges_by_name": lambda s, d: lookup.edges_at(p.calls(s, d).where("is_bare"), _seed(s, d), "target", "name"),
        "induced_subgraph": lambda s, d: lookup.induced(p.edges(s, d), p.nodes(s, d).where("kind = 'Function'")),
        "skip_docs_vs_resolver": lambda s, d: lookup.skipped(p.nodes(s, d), "/tests/"),
        "entry_name_match": lambda s, d: p.nodes(s, d).where(F.col("name").rlike(ENTRY_NAME)).select("qualified_name"),
        "test_file_match": lambda s, d: p.nodes(s, d).where(F.col("file_path").rlike(TEST_PATH)).select("file_path").distinct(),
        "security_match": lambda s, d: p.nodes(s, d).where(lookup.any_word(SECURITY, "name", "qualified_name")).select("qualified_name"),
        "hygiene_scan": lambda s, d: lookup.hygiene(table(s, d, "documents")),
        "sanitize_names": lambda s, d: table(s, d, "documents").select("doc_id", lookup.sanitize("text").alias("name")),
        "call_targets_non_file": lambda s, d: lookup.call_targets(p.edges(s, d), p.nodes(s, d).select("qualified_name", "kind").union(p.files(s, d))),
        "xref_top8": lambda s, d: lookup.first_callers(p.calls(s, d)),
        "name_search": lambda s, d: lookup.name_search(p.nodes(s, d), ["red", "widget"]),
        "token_search": lambda s, d: lookup.token_search(p.nodes(s, d), ["red", "7"]),
        "text_fingerprint": lambda s, d: lookup.fingerprints(table(s, d, "documents")),
        "token_estimate": lambda s, d: lookup.token_estimate(table(s, d, "documents")),
        "brief_batches": lambda s, d: lookup.batches(p.nodes(s, d), 10),
        "dead_links": lambda s, d: lookup.dead_links(table(s, d, "pages")),
        "import_dir_edges": lambda s, d: p.imports(s, d).select(*(F.regexp_extract(c, history.FOLDER, 1).alias(c) for c in ("source", "target"))).where("source <> target").distinct(),
        "stem_edges": lambda s, d: p.imports(s, d).select(*(F.regexp_extract(c, r"([^/]+)\.py$", 1).alias(c) for c in ("source", "target"))).where("source <> target").distinct(),
        "coverage": lambda s, d: history.coverage(p.documented(s, d)),
        "coverage_by_dir": lambda s, d: history.coverage_by_dir(p.documented(s, d)),
        "coverage_rollup": lambda s, d: history.coverage_rollup(p.documented(s, d)),
        "hotspots_hot": lambda s, d: history.hottest(p.commits(s, d)),
        "hotspots_coupled": lambda s, d: history.coupled(p.commits(s, d), p.imports(s, d), share=20, least=2),
        "origins": lambda s, d: history.origins(p.commits(s, d), p.subjects(s, d)),
        "impact_edges": _impact_edges,
        "dependents_2hop": _dependents,
        "ripple_1hop": lambda s, d: flows.ripple(p.calls(s, d), _seed(s, d)),
        "flow_nodes": _flows,
        "flow_depth": lambda s, d: flows.depths(flows.flow_sets(*_calls(s, d))),
        "flow_criticality": _criticality,
        "flows_topk": lambda s, d: _criticality(s, d).orderBy(F.desc("criticality"), "entry").limit(20),
        "affected_flows": lambda s, d: flows.touched_sets(*_calls(s, d), graph.overlaps(p.nodes(s, d), p.diff_ranges(s, d))),
        "transitive_tests": lambda s, d: flows.tests_of(p.nodes(s, d).where("not is_test and file_path like 'src/economy/%'"), p.calls(s, d), graph.tested_by(p.calls(s, d))),
        "test_evidence": lambda s, d: flows.test_evidence(p.nodes(s, d), p.calls(s, d), graph.tested_by(p.calls(s, d))),
        "event_sliding": lambda s, d: ledger.sliding(table(s, d, "events")),
        "event_session": lambda s, d: ledger.sessions(table(s, d, "events"), "6 hours"),
        "event_dedup": lambda s, d: ledger.first_of_hour(table(s, d, "events")),
        "ledger_stream": lambda s, d: streams.daily(s, streams.event_stream(s, d)),
        "watch_stream_upsert": lambda s, d: streams.latest(s, streams.event_stream(s, d)),
    }


QUERIES = queries_on(projection)

_IMPORTS = f""", {_RAW.format(q=49).replace("raw AS", "raw49 AS", 1)}, imports AS (SELECT DISTINCT s.file_path AS source, t.file_path AS target
  FROM raw49 JOIN nodes s ON s.symbol_id = a JOIN nodes t ON t.symbol_id = b WHERE s.file_path <> t.file_path)
"""
_EDGES = (
    _CALLS
    + _IMPORTS
    + """, edges AS (SELECT 'CALLS' AS kind, source, target, line FROM calls UNION ALL SELECT 'IMPORTS_FROM', source, target, 0 FROM imports
  UNION ALL SELECT 'CONTAINS', file_path, qualified_name, 0 FROM nodes
  UNION ALL SELECT * FROM (SELECT 'INHERITS' AS kind, qualified_name AS source, lead(qualified_name) OVER (PARTITION BY regexp_replace(name, '_[0-9]+$', '') ORDER BY symbol_id) AS target, 0 AS line
    FROM nodes WHERE kind = 'Class') h WHERE target IS NOT NULL)
"""
)
_SEED = f"SELECT * FROM nodes WHERE file_path = '{SEED_FILE}'"
_DOCUMENTED = f"""WITH {_NODES}, documented AS (SELECT qualified_name, file_path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, text AS doc
  FROM nodes LEFT JOIN documents ON doc_id = symbol_id WHERE NOT is_test)
"""
_MEASURES = "count(*) AS n, count(doc) AS n_documented, count(doc) * 100 // count(*) AS percent"
_SMALL = """, few AS (SELECT * FROM commits WHERE sha IN (SELECT sha FROM commits GROUP BY sha HAVING count(*) <= 8)),
churn AS (SELECT file_path, count(DISTINCT sha) AS n_commits FROM few GROUP BY file_path)
"""
_FLOWS = (
    _CALLS
    + """, walk AS (SELECT qualified_name AS entry, qualified_name AS node, 0 AS depth FROM nodes WHERE kind = 'Function' AND qualified_name NOT IN (SELECT target FROM calls WHERE NOT is_bare)
  UNION SELECT entry, c.target, depth + 1 FROM walk JOIN calls c ON c.source = node AND NOT is_bare WHERE depth < 15),
flows AS (SELECT entry, node, min(depth) AS depth FROM walk GROUP BY entry, node QUALIFY count(*) OVER (PARTITION BY entry) > 1)
"""
)
_CRITICAL = (
    _FLOWS
    + f""", tested AS (SELECT DISTINCT source FROM ({_TESTED}) t),
outside AS (SELECT source, count(*) AS n FROM calls WHERE is_bare GROUP BY source),
sums AS (SELECT entry, count(*) AS n, count(DISTINCT file_path) AS files, coalesce(sum(o.n), 0) AS outside, count(*) FILTER (regexp_matches(lower(qualified_name), 'hot|gear|bolt')) AS secure,
  count(t.source) AS covered, max(depth) AS depth FROM flows JOIN nodes ON node = qualified_name LEFT JOIN outside o ON o.source = node LEFT JOIN tested t ON t.source = node GROUP BY entry),
critical AS (SELECT entry, CAST((20 * ((75 * least(files - 1, 4) + 40 * least(outside, 5) + 10 * least(depth, 10)) * n + 250 * secure + 150 * (n - covered)) + n) // (2 * n) AS DOUBLE) / 10000 AS criticality FROM sums)
"""
)
_N = f"WITH {_NODES} "

ORACLE_SQL: dict[str, str] = base.ORACLE_SQL | {
    "edge_stats": _EDGES + "SELECT kind, count(*) AS n, count(DISTINCT source) AS n_sources FROM edges GROUP BY kind",
    "language_list": _N + "SELECT DISTINCT language FROM nodes WHERE language <> ''",
    "node_lookup": _CALLS + "SELECT qualified_name, kind, file_path, line_start, line_end FROM nodes WHERE qualified_name IN (SELECT target FROM calls WHERE source_test)",
    "nodes_by_file": _N + f"SELECT qualified_name, kind, line_start, line_end FROM ({_SEED}) s",
    "nodes_by_kind": _N + "SELECT qualified_name, kind FROM nodes WHERE kind IN ('Class', 'Test') AND file_path ILIKE '%ECONOMY%'",
    "files_matching": _N + "SELECT DISTINCT file_path FROM nodes WHERE file_path ILIKE '%/BRAND_1.py'",
    "edges_by_source": _CALLS + f"SELECT source, target, line FROM calls WHERE source IN (SELECT qualified_name FROM ({_SEED}) s)",
    "edges_by_target": _CALLS + f"SELECT source, target, line FROM calls WHERE target IN (SELECT qualified_name FROM ({_SEED}) s)",
    "edges_by_name": _CALLS + f"SELECT source, target, line FROM calls WHERE is_bare AND target IN (SELECT name FROM ({_SEED}) s)",
    "induced_subgraph": _EDGES + ", f AS (SELECT qualified_name AS q FROM nodes WHERE kind = 'Function') SELECT * FROM edges WHERE source IN (SELECT q FROM f) AND target IN (SELECT q FROM f)",
    "skip_docs_vs_resolver": _N + "SELECT DISTINCT file_path, contains('/' || file_path, '/tests/') AS docs_skip, contains(file_path, '/tests/') AS resolver_skip FROM nodes",
    "entry_name_match": _N + f"SELECT qualified_name FROM nodes WHERE regexp_matches(name, '{ENTRY_NAME}')",
    "test_file_match": _N + f"SELECT DISTINCT file_path FROM nodes WHERE regexp_matches(file_path, '{TEST_PATH}')",
    "security_match": _N + "SELECT qualified_name FROM nodes WHERE regexp_matches(lower(name), '" + "|".join(SECURITY) + "') OR regexp_matches(lower(qualified_name), '" + "|".join(SECURITY) + "')",
    "hygiene_scan": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{lookup.HYGIENE}')",
    "sanitize_names": r"SELECT doc_id, substring(regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g'), 1, 256) AS name FROM documents",
    "call_targets_non_file": _EDGES + "SELECT DISTINCT target FROM edges WHERE source NOT IN (SELECT file_path FROM nodes)",
    "xref_top8": _CALLS
    + """SELECT target, source, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) AS place
  FROM (SELECT DISTINCT target, source FROM calls WHERE NOT is_bare) x) y WHERE place <= 8""",
    "name_search": _N + "SELECT qualified_name, kind FROM nodes WHERE contains(lower(qualified_name), 'red') AND contains(lower(qualified_name), 'widget')",
    "token_search": _N + "SELECT qualified_name FROM nodes WHERE list_has_all(regexp_split_to_array(lower(name), '[^a-z0-9]+'), ['red', '7'])",
    "text_fingerprint": r"SELECT doc_id, substring(sha256(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')), 1, 16) AS fingerprint FROM documents",
    "token_estimate": "SELECT source, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens_in, 35 * count(*) AS tokens_out FROM documents GROUP BY source",
    "brief_batches": _N + "SELECT file_path, qualified_name, (row_number() OVER (PARTITION BY file_path ORDER BY qualified_name) - 1) // 10 AS batch FROM nodes",
    "dead_links": """WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM links WHERE regexp_extract(href, '^(?:https?://[^/?#]+)?([^?#]*)', 1) NOT IN (SELECT regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) FROM pages) GROUP BY page_id, href""",
    "import_dir_edges": _CALLS + _IMPORTS + "SELECT DISTINCT regexp_extract(source, '^(.*)/[^/]*$', 1) AS source, regexp_extract(target, '^(.*)/[^/]*$', 1) AS target FROM imports WHERE regexp_extract(imports.source, '^(.*)/[^/]*$', 1) <> regexp_extract(imports.target, '^(.*)/[^/]*$', 1)",
    "stem_edges": _CALLS + _IMPORTS + r"SELECT DISTINCT * FROM (SELECT regexp_extract(source, '([^/]+)\.py$', 1) AS source, regexp_extract(target, '([^/]+)\.py$', 1) AS target FROM imports) i WHERE source <> target",
    "coverage": _DOCUMENTED + f"SELECT {_MEASURES} FROM documented",
    "coverage_by_dir": _DOCUMENTED + f"SELECT dir, {_MEASURES} FROM documented GROUP BY dir",
    "coverage_rollup": _DOCUMENTED + f"SELECT dir, file_path, {_MEASURES} FROM documented GROUP BY ROLLUP (dir, file_path)",
    "hotspots_hot": _COMMITS + _SMALL + "SELECT file_path, n_commits FROM churn WHERE n_commits >= 2 ORDER BY n_commits DESC, file_path LIMIT 5",
    "hotspots_coupled": _COMMITS.replace("WITH", "WITH RECURSIVE", 1)
    + _IMPORTS
    + _SMALL
    + """, pairs AS (SELECT x.file_path AS file_a, y.file_path AS file_b, count(*) AS n FROM few x JOIN few y ON x.sha = y.sha AND x.file_path < y.file_path GROUP BY ALL HAVING count(*) >= 2)
SELECT file_a, file_b, n FROM pairs JOIN churn u ON u.file_path = file_a JOIN churn v ON v.file_path = file_b
WHERE 20 * n >= least(u.n_commits, v.n_commits) AND NOT EXISTS (SELECT 1 FROM imports WHERE (source = file_a AND target = file_b) OR (source = file_b AND target = file_a)) ORDER BY n DESC, file_a, file_b LIMIT 5""",
    "origins": _COMMITS + _SMALL + "SELECT file_path, arg_min(o_orderpriority, {'ts': ts, 'sha': sha}) AS origin FROM few JOIN orders ON o_orderkey = sha GROUP BY file_path",
    "impact_edges": base.ORACLE_SQL["impact_radius"].rpartition("SELECT node, min(depth)")[0] + "SELECT 'CALLS' AS kind, source, target, line FROM calls WHERE NOT is_bare AND source IN (SELECT node FROM walk) AND target IN (SELECT node FROM walk)",
    "dependents_2hop": _CALLS + _IMPORTS + f", walk AS (SELECT DISTINCT file_path AS node, 0 AS depth FROM ({_SEED}) s UNION SELECT source, depth + 1 FROM walk JOIN imports ON target = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM walk GROUP BY node",
    "ripple_1hop": _CALLS + f", seed AS ({_SEED}) SELECT DISTINCT file_path FROM calls WHERE ((is_bare AND target IN (SELECT name FROM seed)) OR (NOT is_bare AND target IN (SELECT qualified_name FROM seed))) AND file_path NOT IN (SELECT file_path FROM seed)",
    "flow_nodes": _FLOWS + "SELECT * FROM flows",
    "flow_depth": _FLOWS + "SELECT entry, count(*) AS n_nodes, max(depth) AS depth FROM flows GROUP BY entry",
    "flow_criticality": _CRITICAL + "SELECT * FROM critical",
    "flows_topk": _CRITICAL + "SELECT * FROM critical ORDER BY criticality DESC, entry LIMIT 20",
    "affected_flows": _FLOWS + "SELECT entry, count(*) AS n_changed FROM flows WHERE node IN (SELECT qualified_name FROM (" + base.ORACLE_SQL["changed_symbols_overlap"] + ")) GROUP BY entry",
    "transitive_tests": _CALLS
    + f""", direct AS (SELECT qualified_name AS q FROM nodes WHERE NOT is_test AND file_path LIKE 'src/economy/%'),
either AS (SELECT q, false AS indirect FROM direct UNION ALL SELECT target, true FROM calls WHERE NOT is_bare AND source IN (SELECT q FROM direct))
SELECT t.target AS test, bool_and(indirect) AS indirect FROM ({_TESTED}) t JOIN either ON q = t.source GROUP BY t.target""",
    "test_evidence": _CALLS
    + f""", uniq AS (SELECT name FROM nodes GROUP BY name HAVING count(*) = 1),
marked AS (SELECT qualified_name, qualified_name IN (SELECT source FROM ({_TESTED}) t) AS by_qualified, name IN (SELECT name FROM uniq) AND name IN (SELECT target FROM calls WHERE is_bare AND source_test) AS by_name FROM nodes WHERE NOT is_test)
SELECT * FROM marked WHERE by_qualified OR by_name""",
    "event_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) e GROUP BY ALL",
    "event_session": """WITH cut AS (SELECT *, sum(CASE WHEN ts <= before + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) e)
SELECT user_id, min(ts) AS start, max(ts) AS last_ts, count(*) AS n FROM cut GROUP BY user_id, k""",
    "event_dedup": "SELECT user_id, event_type, date_trunc('hour', ts) AS start, min(event_id) AS event_id FROM events GROUP BY ALL",
    "ledger_stream": _DAILY,
    "watch_stream_upsert": base.ORACLE_SQL["upsert_last_wins"],
}
