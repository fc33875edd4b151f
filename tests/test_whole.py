"""The relations and queries over every line: against SQL without cuts, flows against brute force."""

import duckdb
import pytest
from test_queries import rows

from codelattice.jobs.whole import ORACLE_SQL, QUERIES, RELATIONS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_line_is_projected(spark, con):
    orders = {}
    for sha, part, line in con.execute("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey").fetchall():
        orders.setdefault(sha, []).append((part, line))
    qn = {r.symbol_id: (r.qualified_name, r.name, r.file_path) for r in RELATIONS.nodes(spark, SF).collect()}
    pairs = [(a, b, line) for o in orders.values() for (a, line), (b, _) in zip(o, o[1:]) if a != b]
    calls = {(qn[a][0], qn[b][1 if (a + b) % 5 == 0 else 0], line) for a, b, line in pairs}
    assert {(r.source, r.target, r.line) for r in RELATIONS.calls(spark, SF).collect()} == calls
    assert {(r.source, r.target) for r in RELATIONS.imports(spark, SF).collect()} == {(qn[a][2], qn[b][2]) for a, b, _ in pairs if qn[a][2] != qn[b][2]}
    touched = {(sha, qn[part][2]) for sha, o in orders.items() for part, _ in o}
    assert {(r.sha, r.file_path) for r in RELATIONS.commits(spark, SF).collect()} == touched
    assert max(sum(1 for s, _ in touched if s == sha) for sha in orders) > 8  # so that the cap on bulk commits acts
    ranges = {(qn[part][2], 1 + sha % 400, 1 + sha % 400 + line) for sha, o in orders.items() for part, line in o}
    assert {(r.file_path, r.start, r.end) for r in RELATIONS.diff_ranges(spark, SF).collect()} == ranges


def small(spark, folder):
    """Parts 1, 2, 4, 5, 37, 38 and 50 in orders that call each other; every line of small quantity and early."""
    parts = [(1, "plain bolt"), (2, "hot gear"), (4, "plain nut"), (5, "blue nut"), (37, "plain rod"), (38, "green rod"), (50, "green nut")]
    spark.createDataFrame([(k, n, "Brand#1", "ECONOMY", 5) for k, n in parts], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    # 1 calls 2, 2 calls 37, 37 calls 5, 4 calls 2; 38 and 50 call each other
    pairs = [(1, 2), (2, 37), (37, 5), (4, 2), (38, 50), (50, 38)]
    lines = [(i, part, n, 1.0) for i, pair in enumerate(pairs) for n, part in enumerate(pair, 1)]
    day = "timestamp_ntz'1995-01-01'"
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").selectExpr("*", f"{day} AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def number(qualified):
    return int(qualified.split("::K")[1].split(".")[0])


def test_affected_flows_takes_every_changed_symbol(spark, tmp_path):
    sf = small(spark, tmp_path)
    # order i changes the lines i + 1 to i + 3 of the one file, symbol k stands at k + 1 to k + 5: 1 to 5 change, 50 doesn't
    nodes = {r.qualified_name: (r.file_path, r.line_start, r.line_end) for r in RELATIONS.nodes(spark, sf).collect()}
    ranges = [tuple(r) for r in RELATIONS.diff_ranges(spark, sf).collect()]
    assert len(ranges) == 12
    changed = {q for q, (f, a, b) in nodes.items() if any(f == g and a <= e and s <= b for g, s, e in ranges)}
    want = {}
    for r in QUERIES["flow_nodes_whole"](spark, sf).collect():
        if r.node in changed:
            want[r.entry] = want.get(r.entry, 0) + 1
    assert {number(e): n for e, n in want.items()}.items() >= {1: 3, 4: 3}.items()
    assert {r.entry: r.n_changed for r in QUERIES["affected_flows_whole"](spark, sf).collect()} == want


def test_named_and_decorated_functions_are_entries_though_called(spark, tmp_path):
    sf = small(spark, tmp_path)
    got = [number(r.qualified_name) for r in QUERIES["entry_points_whole"](spark, sf).collect()]
    # 1 and 4 by no caller, 2 by its name (hot_), 50 by its decorator (pytest.mark.slow); (38 + 50) % 5 is 3, so 38 and 50 have callers
    assert sorted(got) == [1, 2, 4, 50]


def test_flows_match_brute_force(spark, tmp_path):
    sf = small(spark, tmp_path)
    step = {}
    for r in RELATIONS.calls(spark, sf).where("not is_bare").collect():
        step.setdefault(number(r.source), set()).add(number(r.target))
    want = set()
    for e in (1, 2, 4, 50):
        depth, frontier = {e: 0}, [e]
        while frontier:
            frontier = [n for n in {n for m in frontier for n in step.get(m, ())} if n not in depth and not depth.update({n: max(depth.values()) + 1})]
        if len(depth) > 1:
            want |= {(e, n, k) for n, k in depth.items()}
    assert {(number(r.entry), number(r.node), r.depth) for r in QUERIES["flow_nodes_whole"](spark, sf).collect()} == want
    assert {(number(r.entry), r.n_nodes, r.depth) for r in QUERIES["flow_depth_whole"](spark, sf).collect()} == {(e, sum(x[0] == e for x in want), max(x[2] for x in want if x[0] == e)) for e in {x[0] for x in want}}
    ranked = [(number(r.entry), r.criticality) for r in QUERIES["flows_topk_whole"](spark, sf).collect()]
    assert {e for e, _ in ranked} == {x[0] for x in want} and [c for _, c in ranked] == sorted((c for _, c in ranked), reverse=True)
    assert {(number(r.entry), r.criticality) for r in QUERIES["flow_criticality_whole"](spark, sf).collect()} == set(ranked)
