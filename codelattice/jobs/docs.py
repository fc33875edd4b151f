"""Queries on authored pages, review and module order, over every row of their tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.jobs import catalogue
from codelattice.jobs.whole import DECORATED
from codelattice.jobs.queries import _CALLS, _NODES, _RAW, _TESTED
from codelattice.operators import docs, flows, graph, history, review
from codelattice.sources import docs as source
from codelattice.sources import projection
from codelattice.sources.storage import stored, table


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return docs.anchor_pairs(source.anchor_tokens(s, d))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return docs.resolve(_pairs(s, d), projection.nodes(s, d))


def _no_pages(s: SparkSession) -> DataFrame:
    """Commits of the given tables touch no page."""
    return s.createDataFrame([], "page string")


def _direct(s: SparkSession, d: str) -> DataFrame:
    return docs.drift_direct(_pairs(s, d), _resolved(s, d), source.symbol_prints(s, d), source.base_prints(s, d), source.changed_symbols(s, d).select("file_path"), _no_pages(s))


def _ripple(s: SparkSession, d: str) -> DataFrame:
    changed = source.changed_symbols(s, d).select("file_path").distinct()
    symbols = projection.nodes(s, d).join(changed, "file_path", "left_semi")
    dependents = flows.ripple(projection.calls(s, d, None), symbols)
    return docs.drift_ripple(_pairs(s, d), _resolved(s, d), changed, dependents, _no_pages(s))


def _gate(s: SparkSession, d: str) -> DataFrame:
    """The gate's row; pages, anchors and what they resolve to are written once, and only calls from files without a change are taken for the ripple."""
    tokens = stored(source.anchor_tokens(s, d), "tokens")
    pairs = stored(docs.anchor_pairs(tokens), "pairs")
    nodes = projection.nodes(s, d)
    resolved = stored(docs.resolve(pairs, nodes), "resolved")
    changed = stored(source.changed_symbols(s, d).select("file_path").distinct(), "changed")
    symbols = nodes.join(changed, "file_path", "left_semi")
    callers = nodes.join(changed, "file_path", "left_anti").select(F.col("symbol_id").alias("a"))
    dependents = stored(flows.ripple(projection.calls(s, d, None, callers), symbols), "dependents")
    none = _no_pages(s)
    ripple = docs.drift_ripple(pairs, resolved, changed, dependents, none)
    direct = docs.drift_direct(pairs, resolved, source.symbol_prints(s, d), source.base_prints(s, d), changed, none)
    return docs.gate(_freshness(s, d), docs.dangling(pairs, resolved), direct, ripple, docs.bad_pins(tokens))


def _dangling(s: SparkSession, d: str) -> DataFrame:
    return docs.dangling(_pairs(s, d), _resolved(s, d))


def _wanted(s: SparkSession, d: str) -> DataFrame:
    return source.pages(s, d).where("page not like 'docs/es/%'").select("page", source.fingerprint(F.col("text")).alias("fingerprint"))


def _on_disk(s: SparkSession, d: str) -> DataFrame:
    return source.pages(s, d).where("page not like '%/src0/%'").select("page", "generated", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("fingerprint"))


def _freshness(s: SparkSession, d: str) -> DataFrame:
    return docs.freshness(_wanted(s, d), _on_disk(s, d))


def _with_community(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("community", F.element_at(F.split("file_path", "/"), -1))


def _whole_calls(s: SparkSession, d: str) -> DataFrame:
    return projection.calls(s, d, None)


def _risk(s: SparkSession, d: str) -> DataFrame:
    known = catalogue.QUERIES
    calls = projection.calls(s, d)
    return review.risk(_with_community(projection.nodes(s, d)), known["flow_nodes"](s, d), known["flow_criticality"](s, d), calls, graph.tested_by(calls), catalogue.SECURITY)


def _mentions(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("text"))
    words = table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z0-9_./-]+)"'), F.lit(1))).alias("w"))
    modules = words.select(F.concat_ws("/", F.lit("src"), F.regexp_replace("w", "[.]+$", "")).alias("module")).where("module <> 'src/'").distinct()
    return docs.mentions(pages, modules)


def _undo(s: SparkSession, d: str) -> DataFrame:
    before = source.pages(s, d).select("page", source.fingerprint(F.col("text")).alias("written"))
    return docs.undo(before, _on_disk(s, d).select("page", F.col("fingerprint").alias("now")))


def _replaced(s: SparkSession, d: str) -> DataFrame:
    nodes = projection.nodes(s, d).select("file_path", "qualified_name", "line_start")
    changed = source.changed_symbols(s, d).select("file_path").distinct()
    gone = nodes.select("file_path").distinct().join(source.tracked(s, d), "file_path", "left_anti")
    fresh = nodes.join(changed, "file_path", "left_semi").join(gone, "file_path", "left_anti").withColumn("line_start", F.col("line_start") + 1)
    return review.replace_files(nodes, fresh, gone)


def _decorated(s: SparkSession, d: str) -> DataFrame:
    functions = projection.nodes(s, d).where("kind = 'Function'").select("qualified_name")
    return functions.join(projection.decorated(s, d), "qualified_name", "left_semi")


def _node_dict(s: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.substring(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", ""), 1, 256)
    return projection.nodes(s, d).select(F.col("symbol_id").alias("id"), "kind", clean("name").alias("name"), clean("qualified_name").alias("qualified_name"), "file_path", "line_start", "line_end", "language", "is_test")


def _briefs(s: SparkSession, d: str) -> DataFrame:
    """Work orders: undocumented symbols by file, with how many files call into the file."""
    bare = projection.documented(s, d).where("doc is null").groupBy("file_path").agg(F.count("*").alias("n_symbols"), F.min("qualified_name").alias("first_symbol"))
    users = _whole_calls(s, d).where("not is_bare").select(F.split_part("target", F.lit("::"), F.lit(1)).alias("file_path"), F.col("file_path").alias("user")).where("file_path <> user").groupBy("file_path").agg(F.countDistinct("user").alias("n_users"))
    return bare.join(users, "file_path", "left").select("file_path", "n_symbols", "first_symbol", F.coalesce("n_users", F.lit(0)).alias("n_users"))


def _nav(s: SparkSession, d: str) -> DataFrame:
    pages = source.pages(s, d)
    return pages.groupBy(F.split_part("page", F.lit("/"), F.lit(2)).alias("section"), F.split_part("page", F.lit("/"), F.lit(3)).alias("subsection")).agg(F.count("*").alias("n_pages"), F.count(F.when(F.col("generated"), 1)).alias("n_generated"), F.min("page").alias("first_page"))


def _roles(s: SparkSession, d: str) -> DataFrame:
    edges = source.module_edges(s, d)
    out = edges.groupBy(F.col("source").alias("module")).agg(F.count("*").alias("fan_out"))
    into = edges.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("fan_in"))
    both = out.join(into, "module", "full").select("module", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return both.withColumn("role", F.when(F.col("fan_in") == 0, "door").when(F.col("fan_out") == 0, "foundation").when(F.col("fan_in") > 2 * F.col("fan_out"), "core").otherwise("middle"))


def _search_index(s: SparkSession, d: str) -> DataFrame:
    words = projection.nodes(s, d).select("qualified_name", F.explode(F.array_distinct(F.split(F.lower("name"), "[^a-z0-9]+"))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n_symbols"), F.min("qualified_name").alias("first_symbol"))


def _moved(s: SparkSession, d: str) -> DataFrame:
    return review.moved_snapshots(source.snapshots(s, d), "day", ["hundreds", "types"])


def _spend(s: SparkSession, d: str) -> DataFrame:
    return review.spend_rollup(table(s, d, "events").select(F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("usd")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "anchor_sig_pairs": _pairs,
    "anchor_resolution": _resolved,
    "dangling_anchors": _dangling,
    "bad_pins": lambda s, d: docs.bad_pins(source.anchor_tokens(s, d)),
    "drift_notes": lambda s, d: docs.drift_notes(_pairs(s, d), _resolved(s, d), source.symbol_prints(s, d), source.base_prints(s, d), source.changed_symbols(s, d).select("file_path")),
    "drift_direct": _direct,
    "drift_ripple": _ripple,
    "freshness_diff": _freshness,
    "gate_summary": _gate,
    "stale_files": lambda s, d: projection.nodes(s, d).select("file_path").distinct().join(source.tracked(s, d), "file_path", "left_anti"),
    "undo_guard": _undo,
    "doc_mentions": _mentions,
    "incremental_replace": _replaced,
    "decorator_match": _decorated,
    "node_dict": _node_dict,
    "brief_index": _briefs,
    "nav_groups": _nav,
    "map_roles": _roles,
    "search_index": _search_index,
    "cross_community_callers": lambda s, d: review.cross_callers(_whole_calls(s, d), _with_community(projection.nodes(s, d))),
    "resolve_calls_by_imports": lambda s, d: review.resolve_by_imports(_whole_calls(s, d), projection.nodes(s, d), projection.imports(s, d, None)),
    "transitive_test_counts": lambda s, d: review.tests_by_hops(_whole_calls(s, d), graph.tested_by(_whole_calls(s, d))),
    "flow_positions": lambda s, d: review.positions(catalogue.QUERIES["flow_nodes"](s, d)),
    "risk_scores": _risk,
    "review_priorities": lambda s, d: review.first_risks(_risk(s, d)),
    "small_commit_churn": lambda s, d: graph.churn(history.small_commits(projection.commits(s, d, None))),
    "ledger_moved": _moved,
    "spend_rollup": _spend,
}

_ALL_CALLS = _CALLS.replace("l_quantity >= 45", "true")
_PRINT = r"substr(sha256(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), 1, 16)"
_PAGES = """labelled AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
authored AS (SELECT d.doc_id, 'docs/' || lang || '/' || source || '/' || d.doc_id || '.md' AS page, coalesce(quality, 1) = 0 AS generated, quality IS NOT NULL AS pinned, text FROM documents d LEFT JOIN labelled l ON d.doc_id = l.doc_id)"""
_ANCHORS = f"""{_PAGES},
tokens AS (SELECT page, 0 AS pos, 'sym:' || coalesce(name, 'ghost_' || doc_id) AS token FROM authored LEFT JOIN nodes ON symbol_id = doc_id
  UNION ALL SELECT page, 1, 'sig:' || substr(sha256(text), 1, 16) FROM authored WHERE pinned
  UNION ALL SELECT page, 2, 'sym:' || name || '@' || file_path FROM authored JOIN nodes ON symbol_id = doc_id + 1
  UNION ALL SELECT page, 3, CASE WHEN doc_id % 3 = 0 THEN 'sig:oops' WHEN doc_id % 3 = 1 THEN 'sym:' || coalesce(name, 'ghost_' || doc_id) ELSE 'sig:' || substr(sha256(text), 1, 16) END FROM authored LEFT JOIN nodes ON symbol_id = doc_id WHERE doc_id % 10 = 3
  UNION ALL SELECT page, 4, 'sig:' || substr(sha256(page), 1, 16) FROM authored WHERE doc_id % 10 = 3 AND doc_id % 3 = 1),
placed AS (SELECT page, pos, last_value(CASE WHEN token LIKE 'sym:%' THEN token END IGNORE NULLS) OVER (PARTITION BY page ORDER BY pos) AS anchor, CASE WHEN token LIKE 'sig:%' THEN substr(token, 5) END AS sig FROM tokens),
pairs AS (SELECT page, anchor, arg_min(sig, pos) FILTER (length(sig) = 16) AS sig FROM placed WHERE anchor IS NOT NULL GROUP BY page, anchor),
bad AS (SELECT page, 'sig:' || placed.sig AS token, CASE WHEN length(placed.sig) <> 16 THEN 'malformed' WHEN anchor IS NULL THEN 'orphaned' ELSE 'conflicting' END AS reason FROM placed LEFT JOIN pairs p USING (page, anchor) WHERE placed.sig IS NOT NULL AND (length(placed.sig) <> 16 OR anchor IS NULL OR placed.sig <> p.sig)),
asked AS (SELECT DISTINCT anchor, split_part(substr(anchor, 5), '@', 1) AS name, split_part(substr(anchor, 5), '@', 2) AS path FROM pairs),
sites AS (SELECT a.anchor, a.name, a.path, n.qualified_name, n.file_path, n.is_test, bool_or(NOT n.is_test) OVER (PARTITION BY a.anchor) AS live FROM asked a LEFT JOIN nodes n ON n.name = a.name),
fitting AS (SELECT *, qualified_name IS NOT NULL AND (NOT live OR NOT is_test) AND (path = '' OR file_path = path OR file_path LIKE '%/' || path) AS fits FROM sites),
resolved AS (SELECT anchor, CASE WHEN name = '' THEN 'malformed' WHEN n_sites = 0 THEN 'missing' WHEN n_sites = 1 THEN 'ok' ELSE 'ambiguous' END AS status, n_sites,
  CASE WHEN n_sites = 1 THEN q END AS qualified_name, CASE WHEN n_sites = 1 THEN f END AS file_path
  FROM (SELECT anchor, name, count(*) FILTER (fits) AS n_sites, min(qualified_name) FILTER (fits) AS q, min(file_path) FILTER (fits) AS f FROM fitting GROUP BY anchor, name)),
dangling AS (SELECT anchor, status, count(DISTINCT page) AS n_pages, min(page) AS first_page FROM pairs JOIN resolved USING (anchor) WHERE status <> 'ok' GROUP BY anchor, status),
prints AS (SELECT qualified_name, {_PRINT} AS fingerprint, CASE WHEN symbol_id % 4 <> 0 THEN {_PRINT.replace('text', 'lower(text)')} ELSE {_PRINT} END AS base FROM nodes JOIN documents ON doc_id = symbol_id),
changed AS (SELECT * FROM nodes WHERE symbol_id IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 2 DAY)),
direct AS (SELECT page, file_path, min(anchor) AS anchor FROM (
  SELECT page, file_path, anchor FROM pairs JOIN resolved USING (anchor) JOIN prints USING (qualified_name) WHERE status = 'ok' AND sig IS NOT NULL AND fingerprint <> sig
  UNION ALL SELECT page, file_path, anchor FROM pairs JOIN resolved USING (anchor) JOIN prints USING (qualified_name) WHERE status = 'ok' AND sig IS NULL AND fingerprint <> base AND file_path IN (SELECT file_path FROM changed)) GROUP BY page, file_path)
"""
_RIPPLE = """, names AS (SELECT name, qualified_name FROM nodes WHERE file_path IN (SELECT file_path FROM changed)),
dependents AS (SELECT DISTINCT file_path FROM calls WHERE CASE WHEN is_bare THEN target IN (SELECT name FROM names) ELSE target IN (SELECT qualified_name FROM names) END AND file_path NOT IN (SELECT file_path FROM changed)),
ripple AS (SELECT page, file_path, min(anchor) AS anchor FROM pairs JOIN resolved USING (anchor) WHERE status = 'ok' AND sig IS NULL AND file_path IN (SELECT file_path FROM dependents) AND file_path NOT IN (SELECT file_path FROM changed) GROUP BY page, file_path)
"""
_FRESH = f""", want AS (SELECT page, {_PRINT} AS w FROM authored WHERE page NOT LIKE 'docs/es/%'),
disk AS (SELECT page, generated, substr(sha256(text), 1, 16) AS d FROM authored WHERE page NOT LIKE '%/src0/%'),
fresh AS (SELECT * FROM (SELECT page, CASE WHEN d IS NULL THEN 'missing' WHEN w IS NULL THEN CASE WHEN generated THEN 'orphan' END WHEN w <> d THEN 'stale' END AS status FROM want FULL JOIN disk USING (page)) WHERE status IS NOT NULL)
"""
_DOCS = f"WITH {_NODES}, {_ANCHORS}"
_TRACKED = """last AS (SELECT file_path, arg_max(o_orderpriority = '5-LOW', struct_pack(t := o_orderdate, s := o_orderkey)) AS deleted
  FROM (SELECT DISTINCT o_orderkey, o_orderdate, o_orderpriority, file_path FROM lineitem JOIN nodes ON symbol_id = l_partkey JOIN orders ON o_orderkey = l_orderkey) GROUP BY file_path),
tracked AS (SELECT file_path FROM last WHERE NOT deleted)"""
_EDGES = f"""WITH RECURSIVE {_NODES}, {_RAW.format(q=0).replace("l_quantity >= 0", "true")},
counts AS (SELECT s.file_path AS source, t.file_path AS target, count(*) AS n FROM raw JOIN nodes s ON s.symbol_id = a JOIN nodes t ON t.symbol_id = b WHERE s.file_path <> t.file_path GROUP BY ALL),
deps AS (SELECT x.source, x.target FROM counts x LEFT JOIN counts y ON x.source = y.target AND x.target = y.source WHERE x.n >= 2 * coalesce(y.n, 0))
"""
_IMPORTS = "imports AS (SELECT DISTINCT s.file_path AS source, t.file_path AS target FROM raw JOIN nodes s ON s.symbol_id = a JOIN nodes t ON t.symbol_id = b WHERE s.file_path <> t.file_path)"
_HOPS = f"""tested AS ({_TESTED}), hops AS (SELECT source AS qualified_name, count(DISTINCT test) AS n_tests FROM (
  SELECT source, target AS test FROM tested UNION ALL SELECT c.source, t.target FROM calls c JOIN tested t ON c.target = t.source WHERE NOT is_bare) GROUP BY source)"""
_CROSS = r"""crossed AS (SELECT target AS qualified_name, count(*) AS n_cross FROM (SELECT DISTINCT source, target FROM calls WHERE NOT is_bare) c JOIN nodes s ON s.qualified_name = source JOIN nodes t ON t.qualified_name = target
  WHERE regexp_extract(s.file_path, '[^/]*$') <> regexp_extract(t.file_path, '[^/]*$') GROUP BY target)"""
_WORDS = "|".join(catalogue.SECURITY)
_RISK = (
    _CALLS
    + f""", {_HOPS}, {_CROSS}, flows AS ({catalogue.ORACLE_SQL["flow_nodes"]}), crit AS ({catalogue.ORACLE_SQL["flow_criticality"]}),
part AS (SELECT node AS qualified_name, CAST(sum(CAST(round(criticality * 10000) AS BIGINT)) AS BIGINT) AS w FROM flows JOIN crit USING (entry) GROUP BY node),
sites AS (SELECT target AS qualified_name, count(*) AS n_sites FROM calls WHERE NOT is_bare GROUP BY target),
risks AS (SELECT qualified_name, least(least(coalesce(w, 0), 2500) + least(500 * coalesce(n_cross, 0), 1500) + 3000 - 500 * least(coalesce(n_tests, 0), 5)
  + CASE WHEN regexp_matches(lower(name), '{_WORDS}') OR regexp_matches(lower(qualified_name), '{_WORDS}') THEN 2000 ELSE 0 END + least(500 * coalesce(n_sites, 0), 1000), 10000) / 10000 AS risk
  FROM nodes LEFT JOIN part USING (qualified_name) LEFT JOIN sites USING (qualified_name) LEFT JOIN crossed USING (qualified_name) LEFT JOIN hops USING (qualified_name))
"""
)
_USD = "CAST(round(sum(CAST(value AS DECIMAL(38,6))), 2) AS DOUBLE)"
_TOK = "CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT)"

ORACLE_SQL: dict[str, str] = {
    "anchor_sig_pairs": _DOCS + "SELECT page, anchor, sig FROM pairs",
    "anchor_resolution": _DOCS + "SELECT anchor, status, n_sites, qualified_name, file_path FROM resolved",
    "dangling_anchors": _DOCS + "SELECT anchor, status, n_pages, first_page FROM dangling",
    "bad_pins": _DOCS + "SELECT page, token, reason FROM bad",
    "drift_notes": _DOCS
    + """SELECT DISTINCT anchor, CASE WHEN status <> 'ok' THEN 'unresolved' WHEN sig IS NOT NULL THEN 'unverifiable' ELSE 'unreadable' END AS note FROM pairs JOIN resolved USING (anchor) LEFT JOIN prints USING (qualified_name)
WHERE status <> 'ok' OR (fingerprint IS NULL AND (sig IS NOT NULL OR file_path IN (SELECT file_path FROM changed)))""",
    "drift_direct": _DOCS + "SELECT page, file_path, anchor FROM direct",
    "drift_ripple": f"{_ALL_CALLS}, {_ANCHORS} {_RIPPLE} SELECT page, file_path, anchor FROM ripple",
    "freshness_diff": f"WITH {_PAGES} {_FRESH} SELECT page, status FROM fresh",
    "gate_summary": f"""{_ALL_CALLS}, {_ANCHORS} {_RIPPLE} {_FRESH}, n AS (SELECT (SELECT count(*) FROM fresh WHERE status <> 'orphan') AS n_stale, (SELECT count(*) FROM fresh WHERE status = 'orphan') AS n_orphan,
  (SELECT count(*) FROM dangling) AS n_dangling, (SELECT count(*) FROM bad) AS n_bad, (SELECT count(*) FROM direct) AS n_direct, (SELECT count(*) FROM ripple) AS n_ripple)
SELECT *, CAST((n_stale + n_orphan > 0) AS INTEGER) + CAST((n_dangling + n_bad > 0) AS INTEGER) + CAST((n_direct > 0) AS INTEGER) AS failures FROM n""",
    "stale_files": f"WITH {_NODES}, {_TRACKED} SELECT DISTINCT file_path FROM nodes WHERE file_path NOT IN (SELECT file_path FROM tracked)",
    "undo_guard": f"""WITH {_PAGES} {_FRESH} SELECT a.page, CASE WHEN d IS NULL THEN 'gone' WHEN d = {_PRINT} THEN 'restore' ELSE 'refuse' END AS action FROM authored a LEFT JOIN disk ON a.page = disk.page""",
    "doc_mentions": r"""WITH modules AS (SELECT DISTINCT 'src/' || regexp_replace(w, '[.]+$', '') AS module FROM (SELECT unnest(regexp_extract_all(html, 'href="/([A-Za-z0-9_./-]+)"', 1)) AS w FROM pages) WHERE regexp_replace(w, '[.]+$', '') <> ''),
lone AS (SELECT module, token FROM (SELECT module, regexp_extract(module, '[^/]*$') AS token, count(*) OVER (PARTITION BY regexp_extract(module, '[^/]*$')) AS n FROM modules) WHERE n = 1 AND token <> module),
names AS (SELECT module, module AS token FROM modules UNION ALL SELECT * FROM lone),
runs AS (SELECT DISTINCT page_id AS page, unnest(regexp_extract_all(html, '[\pL\pN_./-]+')) AS t FROM pages),
words AS (SELECT DISTINCT page, unnest([t[:i] FOR i IN range(1, len(t) + 1) IF i = len(t) OR t[i + 1] IN ('.', '/')]) AS token FROM runs)
SELECT DISTINCT module, page FROM words JOIN names USING (token)""",
    "incremental_replace": f"""WITH {_NODES}, {_TRACKED}, touched AS (SELECT file_path FROM nodes WHERE symbol_id IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 2 DAY))
SELECT file_path, qualified_name, line_start + CASE WHEN file_path IN (SELECT file_path FROM touched) THEN 1 ELSE 0 END AS line_start FROM nodes WHERE file_path IN (SELECT file_path FROM tracked)""",
    "decorator_match": f"WITH {_NODES} SELECT qualified_name FROM nodes WHERE kind = 'Function' AND {DECORATED}",
    "node_dict": f"WITH {_NODES} SELECT symbol_id AS id, kind, substr(name, 1, 256) AS name, substr(qualified_name, 1, 256) AS qualified_name, file_path, line_start, line_end, language, is_test FROM nodes",
    "brief_index": f"""{_ALL_CALLS}, users AS (SELECT split_part(target, '::', 1) AS file_path, count(DISTINCT file_path) AS n_users FROM calls WHERE NOT is_bare AND split_part(target, '::', 1) <> file_path GROUP BY 1)
SELECT n.file_path, count(*) AS n_symbols, min(qualified_name) AS first_symbol, coalesce(any_value(n_users), 0) AS n_users FROM nodes n LEFT JOIN documents ON doc_id = symbol_id LEFT JOIN users u ON u.file_path = n.file_path WHERE NOT is_test AND text IS NULL GROUP BY n.file_path""",
    "nav_groups": f"WITH {_PAGES} SELECT split_part(page, '/', 2) AS section, split_part(page, '/', 3) AS subsection, count(*) AS n_pages, count(*) FILTER (generated) AS n_generated, min(page) AS first_page FROM authored GROUP BY 1, 2",
    "map_roles": _EDGES
    + """, o AS (SELECT source AS module, count(*) AS fan_out FROM deps GROUP BY 1), i AS (SELECT target AS module, count(*) AS fan_in FROM deps GROUP BY 1), b AS (SELECT module, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM o FULL JOIN i USING (module))
SELECT *, CASE WHEN fan_in = 0 THEN 'door' WHEN fan_out = 0 THEN 'foundation' WHEN fan_in > 2 * fan_out THEN 'core' ELSE 'middle' END AS role FROM b""",
    "search_index": f"WITH {_NODES} SELECT word, count(*) AS n_symbols, min(qualified_name) AS first_symbol FROM (SELECT DISTINCT qualified_name, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS word FROM nodes) GROUP BY word",
    "cross_community_callers": f"{_ALL_CALLS}, {_CROSS} SELECT qualified_name, n_cross FROM crossed",
    "resolve_calls_by_imports": f"""{_ALL_CALLS}, {_IMPORTS}, cands AS (SELECT name, qualified_name, file_path, count(*) OVER (PARTITION BY name) AS n FROM nodes),
chosen AS (SELECT k.file_path, k.target, min(c.qualified_name) AS found FROM (SELECT DISTINCT file_path, target FROM calls WHERE is_bare) k JOIN cands c ON c.name = k.target WHERE c.n = 1 OR (k.file_path, c.file_path) IN (SELECT (source, target) FROM imports) GROUP BY ALL HAVING count(*) = 1)
SELECT source, coalesce(found, calls.target) AS target, calls.file_path, line, is_bare AND found IS NULL AS is_bare FROM calls LEFT JOIN chosen ON is_bare AND calls.file_path = chosen.file_path AND calls.target = chosen.target""",
    "transitive_test_counts": f"{_ALL_CALLS}, {_HOPS} SELECT qualified_name, n_tests FROM hops",
    "flow_positions": f"SELECT entry, node, row_number() OVER (PARTITION BY entry ORDER BY depth, node) - 1 AS position FROM ({catalogue.ORACLE_SQL['flow_nodes']})",
    "risk_scores": _RISK + "SELECT qualified_name, risk FROM risks",
    "review_priorities": _RISK + "SELECT qualified_name, risk FROM risks ORDER BY risk DESC, qualified_name LIMIT 10",
    "small_commit_churn": f"""WITH {_NODES}, touched AS (SELECT DISTINCT l_orderkey AS sha, o_orderdate AS ts, file_path FROM lineitem JOIN nodes ON symbol_id = l_partkey JOIN orders ON o_orderkey = l_orderkey)
SELECT file_path, count(DISTINCT sha) AS n_commits, max(ts) AS last_ts FROM touched WHERE sha IN (SELECT sha FROM touched GROUP BY sha HAVING count(*) <= 8) GROUP BY file_path""",
    "ledger_moved": """WITH snaps AS (SELECT CAST(ts AS DATE) AS day, CAST(floor(count(*) / 100) AS BIGINT) AS hundreds, count(DISTINCT event_type) AS types FROM events GROUP BY 1),
lagged AS (SELECT *, lag(hundreds) OVER (ORDER BY day) AS ph, lag(types) OVER (ORDER BY day) AS pt, row_number() OVER (ORDER BY day) AS r FROM snaps)
SELECT day, hundreds, types, hundreds - ph AS d_hundreds, types - pt AS d_types FROM lagged WHERE r = 1 OR hundreds <> ph OR types <> pt""",
    "spend_rollup": f"SELECT event_type AS model, count(*) AS runs, {_TOK} AS tokens, {_USD} AS usd FROM events GROUP BY ROLLUP (event_type)",
}
