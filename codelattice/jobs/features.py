"""Queries on module order, search, resolution, bounded traversal and maintained flows, over every row of their tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.jobs import catalogue
from codelattice.jobs.docs import _EDGES, _PAGES
from codelattice.jobs.queries import _CALLS, _NODES, SEED_FILE
from codelattice.operators import bounded, evidence, flows, graph, history, line_diff, lookup, order, pages, resolution, search, snapshot
from codelattice.sources import docs as source
from codelattice.sources import change_lists, comments, java_code, projection, trees
from codelattice.sources.storage import table
from codelattice.streaming import watch


def _modules(s: SparkSession, d: str) -> DataFrame:
    return projection.nodes(s, d).select(F.col("file_path").alias("module")).distinct()


def _injected(s: SparkSession, d: str, temporal: bool) -> DataFrame:
    rows = java_code.extract(trees.java_files(s, d))
    nodes = java_code.nodes(rows)
    fields = java_code.edges(rows, "TEMPORAL_STUB" if temporal else "INJECTS")
    if temporal:
        fields = resolution.temporal_fields(fields, nodes.select("name", "role"))
    calls = java_code.edges(rows, "CALLS").select("source", "target", "receiver")
    return resolution.resolve_injected(calls, fields, nodes, java_code.edges(rows, "INHERITS"))


def _questions(s: SparkSession, d: str) -> DataFrame:
    """query_id, text: two words of each kind of name, inflected; every third with a part that only a substring finds."""
    names = table(s, d, "part").select(F.split(F.lower("p_name"), " ").alias("w")).select(F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b")).where("b is not null").distinct()
    text = F.when(F.length("a") == 3, F.concat(F.left("a", F.lit(2)), F.lit(" "), F.substring("b", 2, 9))).otherwise(F.concat(F.initcap("b"), F.lit("s "), F.upper("a")))
    return names.select(F.concat("a", F.lit("-"), "b").alias("query_id"), text.alias("text"))


def _search(s: SparkSession, d: str) -> DataFrame:
    nodes = projection.nodes(s, d).select("name", "qualified_name", "file_path")
    return search.search(_questions(s, d), search.build_index(nodes), nodes).select("query_id", "id", "how", "place")


def _depends(s: SparkSession, d: str) -> DataFrame:
    called = projection.calls(s, d, None).select(F.lit("CALLS").alias("kind"), "source", "target", "file_path")
    return called.union(source.main_imports(s, d).select(F.lit("IMPORTS_FROM"), "source", "target", "source"))


def _impact(s: SparkSession, d: str) -> DataFrame:
    nodes = projection.nodes(s, d).where(F.col("file_path") == SEED_FILE).select(F.col("qualified_name").alias("node"))
    return bounded.impact(projection.calls(s, d, None).where("not is_bare").select("source", "target"), nodes, 2, 200)


def _before(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Calls as they were before the files of the last commits changed, when those made only their calls of even lines; and those files."""
    calls, changed = projection.calls(s, d), source.changed_symbols(s, d).select("file_path").distinct()
    then = calls.join(changed.withColumn("changed", F.lit(True)), "file_path", "left").where("changed is null or line % 2 = 0").drop("changed")
    return then.select(*calls.columns), changed


def _retraced(s: SparkSession, d: str) -> DataFrame:
    nodes, now = projection.nodes(s, d), projection.calls(s, d)
    then, changed = _before(s, d)
    before, entries = graph.entry_points(nodes, then), graph.entry_points(nodes, now)
    return flows.retrace(flows.flow_nodes(before, then), before, entries, now, nodes, changed)


def _line_pairs(s: SparkSession, d: str) -> DataFrame:
    """doc_id, before, after: each document's lines numbered, and the same without every seventh and with one line more in every fifth document."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(":"), F.regexp_replace(x, r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", " ")))
    rows = table(s, d, "documents").select("doc_id", lines.alias("lines"))
    fewer = F.filter("lines", lambda x, i: i % 7 != 3)
    more = F.when(F.col("doc_id") % 5 == 0, F.concat(F.array(F.lit("new line")), fewer)).otherwise(fewer)
    return rows.select("doc_id", F.array_join("lines", "\n").alias("before"), F.array_join(more, "\n").alias("after"))


def _listings(s: SparkSession, d: str) -> DataFrame:
    """snapshot, file_path, hash: after each month, the files that orders touched in it or the month before, with their latest order as their hash."""
    months = projection.commits(s, d, None).select("file_path", "sha", F.trunc("ts", "month").alias("month"))
    both = months.union(months.select("file_path", "sha", F.add_months("month", 1)))
    last = months.groupBy().agg(F.max("month").alias("last"))
    return both.join(F.broadcast(last)).where("month <= last").groupBy(F.col("month").alias("snapshot"), "file_path").agg(F.max("sha").cast("string").alias("hash"))


def _commented(s: SparkSession, d: str) -> DataFrame:
    """path, language, content: a C file per document, whose lines are comments by turns of four: a run of two, a string, a block behind code, a function."""
    line = F.regexp_replace("x", "[^A-Za-z ]", "")
    kind = F.col("i") % 5
    text = F.when(kind < 2, F.concat(F.lit("// "), line)).when(kind == 2, F.concat(F.lit("void f"), F.col("i").cast("string"), F.lit("() { puts(\"// no /* "), line, F.lit("\"); }")))
    text = text.when(kind == 3, F.concat(F.lit("int x; /* "), line, F.lit(" */"))).otherwise("")
    rows = table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x")).select("doc_id", "i", text.alias("t"))
    whole = rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "t")))["t"], "\n").alias("content"))
    return whole.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"), F.lit("c").alias("language"), "content")


def _documented(s: SparkSession, d: str) -> DataFrame:
    files = _commented(s, d)
    found = comments.comments(files)
    lines = files.select("path", F.size(F.split("content", "\n")).alias("n")).where("n >= 3").select("path", F.explode(F.sequence(F.lit(3), "n", F.lit(5))).alias("line_start"))
    return comments.doc_above(lines, found).where("doc is not null")


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Every module's page: origins, main imports, symbols with the text of their document's first line, callers and callees by resolved calls."""
    calls = projection.calls(s, d, None).where("not is_bare")
    named = lambda c: F.element_at(F.split(c, "[.]"), -1)
    into = calls.groupBy(F.col("target").alias("qualified_name")).agg(F.array_sort(F.collect_set(named("source"))).alias("callers"))
    out = calls.groupBy(F.col("source").alias("qualified_name")).agg(F.array_sort(F.collect_set(named("target"))).alias("callees"))
    texts = table(s, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("doc"))
    symbols = projection.nodes(s, d).join(texts, "symbol_id", "left").join(into, "qualified_name", "left").join(out, "qualified_name", "left")
    symbols = symbols.select(F.col("file_path").alias("module"), "name", F.lit(None).cast("string").alias("signature"), F.col("line_start").alias("line"), (F.col("kind") == "Function").alias("is_member"), "doc", "callers", "callees", F.array(F.lit("works")).alias("tested"))
    modules = _modules(s, d).join(history.origins(projection.commits(s, d, None), projection.subjects(s, d)).select(F.col("file_path").alias("module"), "origin"), "module", "left")
    told = _modules(s, d).where("module like '%1.py'").select("module", F.explode(F.array(F.lit("docs/architecture/a.md"), F.lit("docs/b.md"), F.lit("c.md"))).alias("page"))
    flow = source.main_imports(s, d).select(F.col("source").alias("module"), F.regexp_extract("source", r"([^/]+)\.py$", 1).alias("a"), F.regexp_extract("target", r"([^/]+)\.py$", 1).alias("b"))
    return pages.render(modules.withColumn("doc", F.lit(None).cast("string")), source.main_imports(s, d), symbols, told, flow)


def _tests_of(s: SparkSession, d: str) -> DataFrame:
    """Tests of all symbols; a class contains the function of the next number, and tests also name what they call bare."""
    nodes, calls = projection.nodes(s, d), projection.calls(s, d, None)
    after = nodes.where("kind = 'Function'").select((F.col("symbol_id") - 1).alias("symbol_id"), F.col("qualified_name").alias("target"))
    contains = nodes.where("kind = 'Class'").join(after, "symbol_id").select(F.col("qualified_name").alias("source"), "target")
    bare = calls.where("is_bare and source_test").select(F.regexp_replace("target", "^", "K1.").alias("source"), F.col("source").alias("target"))
    return evidence.tests_of(nodes, nodes, contains, calls, graph.tested_by(calls).union(bare))


def _search_rows(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.col("text").alias("doc"))
    symbols = projection.nodes(s, d).join(docs, "symbol_id", "left").select(F.col("file_path").alias("module"), "kind", "name", "doc")
    guides = source.pages(s, d).where("page like 'docs/fr/%'").select(F.regexp_extract("page", r"([^/]+)\.md$", 1).alias("title"), F.regexp_replace(F.regexp_replace("page", r"\.md$", ""), "/", ".").alias("slug"))
    return pages.search_rows(_modules(s, d), symbols, guides)


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    """Documents speak for the symbols of their number, those of the first symbol of a file for the module, and pages are pages."""
    texts = table(s, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.col("text").alias("doc"))
    symbols = projection.nodes(s, d).join(texts, "symbol_id", "left").select(F.col("file_path").alias("module"), "symbol_id", "doc")
    modules = symbols.groupBy("module").agg(F.min_by("doc", "symbol_id").alias("doc"))
    written = source.pages(s, d).select(F.when(F.col("generated"), F.concat(F.lit(pages.FIRST_LINE + "\n"), "text")).otherwise(F.col("text")).alias("text"))
    return snapshot.snapshot(modules, symbols, written)


def _change_lists(s: SparkSession, d: str) -> DataFrame:
    """sha, file_path out of four prints of each order's files: its first line names them bare, the second summarized, the third as a working copy, the others as renames."""
    files = projection.nodes(s, d).select(F.col("symbol_id").alias("l_partkey"), "file_path")
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey", "l_linenumber").join(files, "l_partkey")
    one = lambda n: rows.where(F.col("l_linenumber") == n)
    text = lambda r, line: r.groupBy("sha").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    bare = change_lists.names(text(one(1), F.col("file_path")), ["sha"])
    summed = change_lists.summaries(text(one(2), F.concat(F.lit("M       "), "file_path", F.lit("\n?       no.py"))), ["sha"])
    copied = change_lists.working_copies(text(one(3), F.concat(F.lit("A  +    "), "file_path", F.lit("\n?       no.py\nX"))), ["sha"])
    moved = change_lists.short_states(text(rows.where("l_linenumber > 3"), F.concat(F.lit("R  old.py -> "), "file_path")), ["sha"])
    return change_lists.changed(["sha"], bare, summed, copied, moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tour_doors": lambda s, d: order.doors(source.main_imports(s, d)),
    "tour_reach": lambda s, d: order.door_reach(source.main_imports(s, d)),
    "tour_order": lambda s, d: order.tour(_modules(s, d), source.main_imports(s, d)),
    "bottom_up_layers": lambda s, d: order.bottom_up(_modules(s, d), source.main_imports(s, d)),
    "package_suffix_join": lambda s, d: resolution.package_imports(trees.package_imports(s, d), trees.package_files(s, d)),
    "include_resolution": lambda s, d: resolution.resolve_includes(trees.includes(s, d), trees.headers(s, d)),
    "module_resolution": lambda s, d: resolution.resolve_modules(trees.module_imports(s, d), projection.files(s, d).select(F.col("qualified_name").alias("file_path"))),
    "di_resolution_spring": lambda s, d: _injected(s, d, temporal=False),
    "di_resolution_temporal": lambda s, d: _injected(s, d, temporal=True),
    "symbol_search": _search,
    "impact_bounded": _impact,
    "dependents_bounded": lambda s, d: bounded.dependents(_depends(s, d), projection.nodes(s, d), _modules(s, d).toDF("file_path"), 2, 60),
    "ripple_bounded": lambda s, d: bounded.ripple(_depends(s, d), projection.nodes(s, d), source.changed_symbols(s, d, days=0).select("file_path").distinct(), 1, 40),
    "flows_retraced": _retraced,
    "listing_history": lambda s, d: watch.history(_listings(s, d)),
    "doc_comments": _documented,
    "page_render": _pages,
    "stats_snapshot": _snapshot,
    "changed_file_lists": _change_lists,
    "symbol_listings": lambda s, d: snapshot.listings(projection.nodes(s, d)),
    "folder_ranks": lambda s, d: snapshot.folder_ranks(order.tour(_modules(s, d), source.main_imports(s, d))),
    "tests_of_symbols": _tests_of,
    "site_search": _search_rows,
    "edge_dict": lambda s, d: lookup.edge_dict(projection.edges(s, d, None, None)),
    "line_diff_tally": lambda s, d: line_diff.tallies(_line_pairs(s, d), ["doc_id"]),
}

_MAIN = (
    _EDGES[: _EDGES.index("deps AS")]
    + """deps AS (SELECT x.source, x.target FROM counts x LEFT JOIN counts y ON x.source = y.target AND x.target = y.source WHERE x.n > coalesce(y.n, 0)
  QUALIFY row_number() OVER (PARTITION BY x.source ORDER BY x.n - coalesce(y.n, 0) DESC, x.target) <= 2),
modules AS (SELECT DISTINCT file_path AS module FROM nodes),
doors AS (SELECT DISTINCT source AS module FROM deps WHERE source NOT IN (SELECT target FROM deps)),
walk AS (SELECT module AS door, module AS node FROM doors UNION SELECT door, target FROM walk JOIN deps ON node = source),
reach AS (SELECT door, count(*) AS n_reached FROM walk GROUP BY door)
"""
)

_RAW_ALL = "raw AS (SELECT * FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b)"
_HEADER = "(['src', 'lib', 'vendor/src'])[{0} % 3 + 1] || '/d' || ({0} % 7) || '/h' || CASE WHEN {0} % 2 = 0 THEN {0} % 300 ELSE {0} END || '.h'"
_PACKAGE = "CASE {0} % 3 WHEN 0 THEN 'src/core/p' WHEN 1 THEN 'core/p' ELSE 'p' END || ({0} % 40)"
_ALL = _CALLS.replace("l_quantity >= 45", "true")
_DEPENDS = (
    _ALL
    + """, counts AS (SELECT s.file_path AS source, t.file_path AS target, count(*) AS n FROM raw JOIN nodes s ON s.symbol_id = a JOIN nodes t ON t.symbol_id = b WHERE s.file_path <> t.file_path GROUP BY ALL),
deps AS (SELECT x.source, x.target FROM counts x LEFT JOIN counts y ON x.source = y.target AND x.target = y.source WHERE x.n > coalesce(y.n, 0) QUALIFY row_number() OVER (PARTITION BY x.source ORDER BY x.n - coalesce(y.n, 0) DESC, x.target) <= 2),
steps AS (SELECT DISTINCT split_part(target, '::', 1) AS n, file_path AS m FROM calls WHERE NOT is_bare AND split_part(target, '::', 1) <> file_path UNION SELECT target, source FROM deps)"""
)
_JAVA = rf"""WITH {_NODES}, java AS (SELECT *, regexp_replace(file_path, '\.py$', '/J' || (symbol_id // 100) || '.java') AS path FROM nodes),
pairs AS (SELECT symbol_id AS p, path || '::K' || symbol_id || '.' || name AS source, lead(symbol_id) OVER w AS q, lead(name) OVER w AS target, path FROM java WINDOW w AS (PARTITION BY path ORDER BY symbol_id))
SELECT source, target, 'dep' AS receiver, CASE WHEN {{0}} THEN path || '::' || CASE WHEN q % 5 = 0 THEN 'S' || q || CASE WHEN q % 2 = 0 THEN 'Activity' ELSE '' END ELSE 'K' || q END || '.' || target END AS found FROM pairs WHERE q IS NOT NULL"""

_LINES = "len(regexp_replace(regexp_replace(coalesce({0}, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '[^\\n]', '', 'g')) + CASE WHEN regexp_matches({0}, '[^\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]$') THEN 1 ELSE 0 END"
_SLUG = r"regexp_replace(replace({0}, '/', '.'), '\.py$', '')"
_STEM = r"regexp_extract({0}, '([^/]+)\.py$', 1)"
_PAGE = (
    _MAIN
    + f""", calls AS (SELECT DISTINCT s.qualified_name AS source, t.qualified_name AS target, s.name AS caller, t.name AS callee FROM raw JOIN nodes s ON s.symbol_id = a JOIN nodes t ON t.symbol_id = b WHERE (a + b) % 5 <> 0),
i AS (SELECT target AS q, '**called by** ' || string_agg('`' || caller || '`', ', ' ORDER BY caller) AS into_it FROM (SELECT DISTINCT target, caller FROM calls) GROUP BY target),
o AS (SELECT source AS q, '**calls** ' || string_agg('`' || callee || '`', ', ' ORDER BY callee) AS out_of_it FROM (SELECT DISTINCT source, callee FROM calls) GROUP BY source),
told AS (SELECT n.file_path AS module, n.name, line_start AS line, kind, trim(coalesce(split_part(text, chr(10), 1), ''), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS doc, concat_ws('  ·  ', into_it, out_of_it) AS refs FROM nodes n LEFT JOIN documents ON doc_id = symbol_id LEFT JOIN i ON i.q = n.qualified_name LEFT JOIN o ON o.q = n.qualified_name),
api AS (SELECT module, string_agg(CASE WHEN kind = 'Function' THEN '####' ELSE '###' END || ' `' || name || '`' || chr(10) || '`' || module || ':' || line || '`' || chr(10) || chr(10) || doc || CASE WHEN refs <> '' THEN chr(10) || chr(10) || refs ELSE '' END || chr(10) || chr(10), '' ORDER BY line, name) AS api FROM told WHERE doc <> '' GROUP BY module),
bare AS (SELECT module, count(*) AS n_bare, string_agg('- `' || name || '` — tested: works' || chr(10), '' ORDER BY line, name) AS bare FROM told WHERE doc = '' GROUP BY module),
touched AS (SELECT DISTINCT l_orderkey AS sha, o_orderdate AS ts, o_orderpriority AS subject, file_path FROM lineitem JOIN nodes ON symbol_id = l_partkey JOIN orders ON o_orderkey = l_orderkey),
origin AS (SELECT file_path AS module, arg_min(subject, struct_pack(t := ts, s := sha)) AS origin FROM touched WHERE sha IN (SELECT sha FROM touched GROUP BY sha HAVING count(*) <= 8) GROUP BY file_path),
ahead AS (SELECT source AS module, '**depends on** ' || string_agg('[`' || target || '`](' || {_SLUG.format("target")} || '.md)', ', ' ORDER BY target) AS ahead, string_agg(DISTINCT '  ' || {_STEM.format("source")} || ' --> ' || {_STEM.format("target")} || chr(10), '' ORDER BY '  ' || {_STEM.format("source")} || ' --> ' || {_STEM.format("target")} || chr(10)) AS drawn FROM deps GROUP BY source),
back AS (SELECT target AS module, '**used by** ' || string_agg('[`' || source || '`](' || {_SLUG.format("source")} || '.md)', ', ' ORDER BY source) AS back FROM deps GROUP BY target),
linked AS (SELECT m.module, concat_ws('  ·  ', ahead, back, CASE WHEN m.module LIKE '%1.py' THEN '**discussed in** [`c.md`](../../c.md), [`docs/architecture/a.md`](a.md), [`docs/b.md`](../b.md)' END) AS links, drawn, origin, api, bare, n_bare
  FROM modules m LEFT JOIN ahead USING (module) LEFT JOIN back USING (module) LEFT JOIN origin USING (module) LEFT JOIN api USING (module) LEFT JOIN bare USING (module)),
whole AS (SELECT module, '{pages.FIRST_LINE}' || chr(10) || '# `' || module || '`' || chr(10) || chr(10) || CASE WHEN origin <> '' THEN '*No module docstring. First commit: "' || origin || '".*' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN links <> '' THEN links || chr(10) || chr(10) ELSE '' END || CASE WHEN drawn <> '' THEN '```mermaid' || chr(10) || 'flowchart TD' || chr(10) || drawn || '```' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN api <> '' THEN '## API' || chr(10) || chr(10) || api ELSE '' END || CASE WHEN bare <> '' THEN '<details><summary>Undocumented (' || n_bare || ')</summary>' || chr(10) || chr(10) || bare || chr(10) || '</details>' || chr(10) || chr(10) ELSE '' END AS t FROM linked)
SELECT module, {_SLUG.format("module")} || '.md' AS page, substr(t, 1, length(t) - 1) AS text FROM whole"""
)

ORACLE_SQL: dict[str, str] = {
    "package_suffix_join": f"""WITH {_NODES}, {_RAW_ALL}, dirs AS (SELECT DISTINCT {_PACKAGE.format("symbol_id")} AS dir FROM nodes),
asked AS (SELECT DISTINCT {_PACKAGE.format("a")} || '/f' || a || '.go' AS source, CASE WHEN a % 2 = 0 THEN 'git.example/x/src/core/' WHEN a % 5 = 0 THEN 'git.example/xcore/' ELSE 'git.example/core/' END || 'p' || (b % 45) AS target FROM raw)
SELECT source, target, arg_max(dir, length(dir)) AS dir FROM (SELECT DISTINCT target FROM asked) t JOIN dirs ON t.target = dir OR t.target LIKE '%/' || dir JOIN asked USING (target) GROUP BY source, target""",
    "include_resolution": f"""WITH {_NODES}, {_RAW_ALL}, owned AS (SELECT DISTINCT {_HEADER.format("symbol_id")} AS f FROM nodes),
spelled AS (SELECT DISTINCT {_HEADER.format("a")} AS source, (a + b) % 4 AS kind, string_split({_HEADER.format("b")}, '/') AS p FROM raw),
asked AS (SELECT DISTINCT source, regexp_extract(source, '^(.*)/[^/]*$', 1) AS dir, CASE kind WHEN 0 THEN p[-1] WHEN 1 THEN p[-2] || '/' || p[-1] WHEN 2 THEN array_to_string(p, '/') ELSE '../' || p[-2] || '/' || p[-1] END AS target FROM spelled),
near AS (SELECT *, contains(target, '/') AS deep, CASE WHEN target LIKE '../%' THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) || substr(target, 3) ELSE dir || '/' || target END AS beside FROM asked),
tails AS (SELECT t AS target, min(f) AS f FROM (SELECT f, unnest([array_to_string(string_split(f, '/')[i:], '/') FOR i IN range(2, len(string_split(f, '/')))]) AS t FROM owned) GROUP BY t HAVING count(*) = 1),
below AS (SELECT dir, target, min(f) AS f FROM (SELECT f, regexp_extract(f, '[^/]*$') AS target, unnest([array_to_string(string_split(f, '/')[:i], '/') FOR i IN range(1, len(string_split(f, '/')))]) AS dir FROM owned) GROUP BY ALL HAVING count(*) = 1),
lone AS (SELECT regexp_extract(f, '[^/]*$') AS target, min(f) AS f FROM owned GROUP BY 1 HAVING count(*) = 1),
hits AS (SELECT source, target, beside AS f, 1 AS rung FROM near WHERE beside IN (SELECT f FROM owned) UNION ALL SELECT source, target, target, 2 FROM near WHERE deep AND target IN (SELECT f FROM owned)
  UNION ALL SELECT source, target, f, 3 FROM near JOIN tails USING (target) WHERE deep UNION ALL SELECT source, target, f, 2 FROM near JOIN below USING (dir, target) WHERE NOT deep
  UNION ALL SELECT source, target, f, 3 FROM near JOIN lone USING (target) WHERE NOT deep AND split_part(f, '/', 1) = split_part(source, '/', 1))
SELECT source, target, arg_min(f, rung) AS found, min(rung) AS rung FROM hits GROUP BY source, target""",
    "module_resolution": f"""WITH {_NODES}, {_RAW_ALL}, files AS (SELECT DISTINCT file_path AS f FROM nodes),
asked AS (SELECT DISTINCT s.file_path, string_split(regexp_replace(t.file_path, '\\.py$', ''), '/')[-((a + b) % 3 + 1):] AS m FROM raw JOIN nodes s ON s.symbol_id = a JOIN nodes t ON t.symbol_id = b),
tried AS (SELECT file_path, m, i, CASE WHEN i = 0 THEN '' ELSE array_to_string(string_split(file_path, '/')[:i], '/') || '/' END || array_to_string(m, '/') || '.py' AS f FROM asked, (SELECT unnest(range(0, 3)) AS i))
SELECT file_path, 'python' AS language, array_to_string(m, '.') AS module, arg_max(f, i) AS found FROM tried JOIN files USING (f) GROUP BY ALL""",
    "di_resolution_spring": _JAVA.format("p % 3 <> 0"),
    "di_resolution_temporal": _JAVA.format("q % 4 = 0"),
    "symbol_search": f"""WITH {_NODES}, asked AS (SELECT DISTINCT a, b FROM (SELECT string_split(lower(p_name), ' ') AS w, w[1] AS a, w[2] AS b FROM part) WHERE b IS NOT NULL),
hits AS (SELECT a, b, qualified_name, CASE WHEN length(a) = 3 THEN 'substring' ELSE 'index' END AS how FROM asked JOIN nodes ON CASE WHEN length(a) = 3 THEN contains(lower(qualified_name), substr(a, 1, 2)) AND contains(lower(qualified_name), substr(b, 2))
  ELSE list_contains(regexp_extract_all(lower(qualified_name), '[a-z0-9]+'), a) AND list_contains(regexp_extract_all(lower(qualified_name), '[a-z0-9]+'), b) END)
SELECT a || '-' || b AS query_id, qualified_name AS id, how, row_number() OVER (PARTITION BY a, b ORDER BY qualified_name) AS place FROM hits QUALIFY place <= 20""",
    "impact_bounded": f"""{_ALL}, steps AS (SELECT source AS n, target AS m FROM calls WHERE NOT is_bare UNION SELECT target, source FROM calls WHERE NOT is_bare), seeds AS (SELECT qualified_name AS n FROM nodes WHERE file_path = '{SEED_FILE}'),
one AS (SELECT DISTINCT m AS n FROM steps JOIN seeds USING (n) WHERE m NOT IN (SELECT n FROM seeds)),
two AS (SELECT DISTINCT m AS n FROM steps JOIN one USING (n) WHERE m NOT IN (SELECT n FROM seeds) AND m NOT IN (SELECT n FROM one) AND (SELECT count(*) FROM one) <= 200),
found AS (SELECT n, 1 AS depth FROM one UNION ALL SELECT n, 2 FROM two)
SELECT n AS node, CAST(depth AS INTEGER) AS depth, count(*) OVER () > 200 AS truncated, count(*) OVER () AS total FROM found QUALIFY row_number() OVER (ORDER BY depth, n) <= 200""",
    "dependents_bounded": _DEPENDS
    + """, one AS (SELECT n AS root, m FROM steps), over AS (SELECT root FROM one GROUP BY root HAVING count(*) > 60),
two AS (SELECT DISTINCT o.root, s.m FROM one o JOIN steps s ON s.n = o.m WHERE s.m <> o.root AND o.root NOT IN (SELECT root FROM over) AND (o.root, s.m) NOT IN (SELECT (root, m) FROM one)),
found AS (SELECT root, m, 1 AS depth FROM one UNION ALL SELECT root, m, 2 FROM two)
SELECT root, m AS node, CAST(depth AS INTEGER) AS depth, count(*) OVER (PARTITION BY root) > 60 AS truncated, count(*) OVER (PARTITION BY root) AS total FROM found QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, m) <= 60""",
    "ripple_bounded": _DEPENDS
    + """, changed AS (SELECT DISTINCT file_path AS n FROM nodes WHERE symbol_id IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders))),
one AS (SELECT DISTINCT m FROM steps JOIN changed USING (n) WHERE m NOT IN (SELECT n FROM changed))
SELECT m AS node, CAST(1 AS INTEGER) AS depth, count(*) OVER () > 40 AS truncated, count(*) OVER () AS total FROM one QUALIFY row_number() OVER (ORDER BY m) <= 40""",
    "flows_retraced": catalogue.ORACLE_SQL["flow_nodes"],
    "listing_history": f"""WITH {_NODES}, touched AS (SELECT DISTINCT file_path, o_orderkey AS sha, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM lineitem JOIN nodes ON symbol_id = l_partkey JOIN orders ON o_orderkey = l_orderkey),
both_months AS (SELECT * FROM touched UNION ALL SELECT file_path, sha, CAST(month + INTERVAL 1 MONTH AS DATE) FROM touched),
states AS (SELECT month, file_path, CAST(max(sha) AS VARCHAR) AS hash FROM both_months WHERE month <= (SELECT max(month) FROM touched) GROUP BY ALL),
ranked AS (SELECT month, row_number() OVER (ORDER BY month) AS place FROM (SELECT DISTINCT month FROM states)), placed AS (SELECT states.*, place FROM states JOIN ranked USING (month)),
joined AS (SELECT coalesce(n.place, o.place + 1) AS place, coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.hash, o.hash) AS hash, CASE WHEN o.hash IS NULL THEN 'created' WHEN n.hash IS NULL THEN 'deleted' WHEN n.hash <> o.hash THEN 'changed' END AS event
  FROM placed n FULL JOIN placed o ON n.file_path = o.file_path AND n.place = o.place + 1)
SELECT month AS snapshot, file_path, hash, event FROM joined JOIN ranked USING (place) WHERE event IS NOT NULL""",
    "doc_comments": r"""WITH lines AS (SELECT doc_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
plain AS (SELECT doc_id, i, trim(regexp_replace(x, '[^A-Za-z ]', '', 'g')) AS x FROM lines),
coded AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
SELECT 'd' || a.doc_id || '.c' AS path, CAST(a.i + 2 AS INTEGER) AS line_start, CASE WHEN a.x = '' THEN b.x WHEN b.x = '' THEN a.x ELSE a.x || chr(10) || b.x END AS doc
FROM plain a JOIN plain b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN coded ON coded.doc_id = a.doc_id WHERE a.i % 5 = 1 AND a.i + 2 <= coded.n AND (a.x <> '' OR b.x <> '')""",
    "page_render": _PAGE,
    "stats_snapshot": f"""WITH {_NODES}, sym AS (SELECT file_path AS module, symbol_id, text AS doc, {_LINES.format('text')} AS lines FROM nodes LEFT JOIN documents ON doc_id = symbol_id),
f AS (SELECT module, count(*) AS n, count(*) FILTER (doc <> '') AS n_done, sum(lines) AS lines, first(doc ORDER BY symbol_id) AS doc, first(lines ORDER BY symbol_id) AS own FROM sym GROUP BY module),
{_PAGES}
SELECT CAST(sum(n_done) AS BIGINT) AS symbols_documented, CAST(sum(n) AS BIGINT) AS symbols_total, count(*) FILTER (doc <> '') AS modules_documented, count(*) AS modules_total, count(*) FILTER (doc <> '' AND n = n_done) AS files_documented, count(*) AS files_total,
  CAST(sum(lines) + sum(own) AS BIGINT) AS doc_lines, (SELECT count(*) FILTER (generated) FROM authored) AS pages_generated, (SELECT count(*) FILTER (NOT generated) FROM authored) AS pages_authored,
  (SELECT CAST(sum({_LINES.format('text')} + CASE WHEN generated THEN 1 ELSE 0 END) AS BIGINT) FROM authored) AS page_lines FROM f""",
    "changed_file_lists": f"WITH {_NODES} SELECT DISTINCT l_orderkey AS sha, file_path FROM lineitem JOIN nodes ON symbol_id = l_partkey",
    "symbol_listings": f"""WITH {_NODES}, placed AS (SELECT file_path, name, row_number() OVER (PARTITION BY file_path ORDER BY line_start, name) AS p FROM nodes)
SELECT file_path, string_agg(name, ', ' ORDER BY p) FILTER (p <= 8) AS names, greatest(count(*) - 8, 0) AS n_more FROM placed GROUP BY file_path""",
    "tests_of_symbols": f"""{_ALL}, bare_tests AS (SELECT 'K1.' || target AS source, source AS test FROM calls WHERE is_bare AND source_test),
proof AS (SELECT DISTINCT target AS node, source AS test FROM calls WHERE NOT is_bare AND source_test AND NOT target_test UNION SELECT * FROM bare_tests),
front AS (SELECT qualified_name AS root, qualified_name AS node FROM nodes UNION SELECT c.qualified_name, f.qualified_name FROM nodes c JOIN nodes f ON f.symbol_id = c.symbol_id + 1 WHERE c.kind = 'Class' AND f.kind = 'Function'),
direct AS (SELECT root, test FROM (SELECT * FROM front UNION SELECT qualified_name, regexp_extract(qualified_name, '::(.*)$', 1) FROM nodes) JOIN proof USING (node)),
hop AS (SELECT root, next FROM (SELECT DISTINCT root, target AS next FROM front JOIN calls ON source = node) QUALIFY row_number() OVER (PARTITION BY root ORDER BY next) <= 50),
late AS (SELECT root, test FROM hop JOIN proof ON node = next)
SELECT root AS qualified_name, test, min(n) > 0 AS indirect FROM (SELECT root, test, 0 AS n FROM direct UNION ALL SELECT root, test, 1 FROM late) WHERE test IN (SELECT qualified_name FROM nodes) GROUP BY root, test""",
    "site_search": f"""WITH {_NODES}, authored AS (SELECT 'docs/' || lang || '/' || source || '/' || doc_id AS page FROM documents WHERE lang = 'fr')
SELECT * FROM (VALUES ('page', 'Overview', '', 'index.html'), ('page', 'Architecture', '', 'architecture.html')) t(kind, name, context, href)
UNION ALL SELECT 'guide', regexp_extract(page, '[^/]*$'), '', replace(page, '/', '.') || '.html' FROM authored
UNION ALL SELECT DISTINCT 'module', file_path, '', {_SLUG.format("file_path")} || '.html' FROM nodes
UNION ALL SELECT lower(kind), name, regexp_extract(file_path, '[^/]*$'), {_SLUG.format("file_path")} || '.html#' || name FROM nodes JOIN documents ON doc_id = symbol_id WHERE regexp_matches(text, '[^\\s]')""",
    "edge_dict": f"""{catalogue._EDGES.replace("l_quantity >= 45", "true").replace("l_quantity >= 49", "true")} SELECT kind, substr(source, 1, 256) AS source, substr(target, 1, 256) AS target, split_part(source, '::', 1) AS file_path, line FROM edges""",
    "line_diff_tally": """SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS added, CAST((n + 3) // 7 AS BIGINT) AS removed FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)""",
    "tour_doors": _MAIN + "SELECT module FROM doors",
    "tour_reach": _MAIN + "SELECT door, n_reached FROM reach",
    "tour_order": _MAIN
    + """, queue AS (SELECT 0 AS level, (SELECT list(door ORDER BY n_reached DESC, door) FROM reach) AS front, (SELECT list(door ORDER BY n_reached DESC, door) FROM reach) AS seen
  UNION ALL SELECT level + 1, now, list_concat(seen, now) FROM (SELECT level, seen, (SELECT list(target ORDER BY p, target) FROM (
    SELECT d.target, min(list_position(front, d.source)) AS p FROM deps d WHERE list_contains(front, d.source) AND NOT list_contains(seen, d.target) GROUP BY d.target)) AS now FROM queue) WHERE now IS NOT NULL),
walked AS (SELECT seen FROM queue ORDER BY level DESC LIMIT 1),
rest AS (SELECT module, row_number() OVER (ORDER BY n DESC, module) - 1 + (SELECT len(seen) FROM walked) AS position FROM (
  SELECT m.module, (SELECT count(*) FROM deps d WHERE d.target = m.module) AS n FROM modules m WHERE NOT list_contains((SELECT seen FROM walked), m.module)))
SELECT module, position, module IN (SELECT module FROM doors) AS is_door FROM (SELECT unnest(seen) AS module, unnest(range(len(seen))) AS position FROM walked UNION ALL SELECT module, position FROM rest)""",
    "bottom_up_layers": _MAIN
    + """, loop AS (SELECT 0 AS level, CAST([] AS VARCHAR[]) AS placed, CAST([] AS VARCHAR[]) AS ready
  UNION ALL SELECT level + 1, list_concat(placed, now), now FROM (SELECT level, placed, coalesce(
    (SELECT list(m.module ORDER BY m.module) FROM modules m WHERE NOT list_contains(placed, m.module) AND NOT EXISTS (SELECT 1 FROM deps d WHERE d.source = m.module AND NOT list_contains(placed, d.target))),
    (SELECT [min(m.module)] FROM modules m WHERE NOT list_contains(placed, m.module))) AS now FROM loop) WHERE now[1] IS NOT NULL)
SELECT module, CAST(round AS INTEGER) AS round, row_number() OVER (ORDER BY round, module) - 1 AS position FROM (SELECT unnest(ready) AS module, level - 1 AS round FROM loop)""",
}
ORACLE_SQL["folder_ranks"] = f"SELECT regexp_extract(module, '^(.*)/[^/]*$', 1) AS dir, min(position) AS rank, count(*) AS n_modules FROM ({ORACLE_SQL['tour_order']}) GROUP BY 1"
