"""The relations' operators on small inputs: nulls, ties, repeats, empty tables, columns of other names."""

import datetime

import pytest

from codelattice.operators import flows, graph, history, ledger, lookup

NODES = "qualified_name string, name string, file_path string, kind string, language string, is_test boolean, line_start int, line_end int, extra string"
CALLS = "source string, target string, file_path string, line int, is_bare boolean, source_test boolean, target_test boolean"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("a.py::f", "f", "a.py", "Function", "python", False, 1, 9), ("a.py::g", "g", "a.py", "Function", "python", False, 10, 10), ("b.py::K", "K", "b.py", "Class", "python", False, 1, 50),
        ("b.py::f", "f", "b.py", "Function", "", False, 60, 59), ("t.py::t", "t", "t.py", "Test", None, True, 1, 3), ("c.py::lone", "lone", "c.py", "Function", "python", False, None, None),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], NODES)


@pytest.fixture(scope="module")
def calls(spark):
    rows = [
        ("a.py::f", "a.py::g", "a.py", 3, False, False, False), ("a.py::f", "a.py::g", "a.py", 4, False, False, False), ("t.py::t", "a.py::f", "t.py", 2, False, True, False),
        ("t.py::t", "lone", "t.py", 3, True, True, None), ("a.py::g", "f", "a.py", 10, True, False, None), ("a.py::g", "gone", "a.py", 10, True, False, None), ("b.py::K", "b.py::K", "b.py", 7, False, False, False),
    ]
    return spark.createDataFrame(rows, CALLS)


def found(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_graph(spark, nodes, calls):
    assert found(graph.stats(nodes), "kind", "language", "n", "n_files") == sorted([("Class", "python", 1, 1), ("Function", "", 1, 1), ("Function", "python", 3, 2), ("Test", None, 1, 1)], key=repr)
    assert found(graph.by_size(nodes, 9)) == [("a.py::f", "Function", 9), ("b.py::K", "Class", 50)]
    solved = found(graph.resolve_bare(calls, nodes), "source", "target", "is_bare")
    assert ("t.py::t", "c.py::lone", False) in solved and ("a.py::g", "f", True) in solved and ("a.py::g", "gone", True) in solved and len(solved) == 7
    assert found(graph.callers(calls)) == [("a.py::f", 1, 1), ("a.py::g", 1, 2), ("b.py::K", 1, 1)]
    tested = graph.tested_by(calls)
    assert found(tested) == [("a.py::f", "t.py::t")]
    assert found(graph.test_gaps(nodes, tested), "qualified_name") == [("a.py::g",), ("b.py::f",), ("c.py::lone",)]
    assert found(graph.entry_points(nodes, calls)) == [("b.py::f",), ("c.py::lone",)]
    decorated = spark.createDataFrame([("a.py::g",), ("a.py::g",), ("b.py::K",), (None,)], "qualified_name string")
    assert found(graph.entry_points(nodes, calls, "^f$", decorated)) == [("a.py::f",), ("a.py::g",), ("b.py::f",), ("c.py::lone",)]
    ranges = spark.createDataFrame([("a.py", 9, 12), ("a.py", 9, 12), ("a.py", 10, 9), ("b.py", 50, 60), ("b.py", None, 3), ("none.py", 1, 2)], "file_path string, start int, end int")
    assert found(graph.overlaps(nodes, ranges)) == [("a.py::f", 2), ("a.py::g", 2), ("b.py::K", 1)]
    seeds = spark.createDataFrame([("t.py::t",), ("t.py::t",)], "node string")
    step = calls.where("not is_bare").select("source", "target")
    assert found(graph.reach(step, seeds, 1, both_ways=False)) == [("a.py::f", 1), ("t.py::t", 0)]
    assert found(graph.reach(step, seeds, 9)) == [("a.py::f", 1), ("a.py::g", 2), ("t.py::t", 0)]
    assert found(graph.reach(step.limit(0), seeds.limit(0), 3)) == []


def test_flows(spark, nodes, calls):
    entries = spark.createDataFrame([("t.py::t",), ("c.py::lone",), ("b.py::K",)], "qualified_name string")
    traced = flows.flow_nodes(entries, calls)
    assert found(traced, "entry", "node", "depth") == [("t.py::t", "a.py::f", 1), ("t.py::t", "a.py::g", 2), ("t.py::t", "t.py::t", 0)]
    assert found(flows.flow_nodes(entries, calls, depth=1), "node") == [("a.py::f",), ("t.py::t",)]
    assert found(flows.flow_depth(traced)) == [("t.py::t", 3, 2)]
    changed = spark.createDataFrame([("a.py::g", "g", "a.py"), ("a.py::g", "g", "a.py"), (None, None, None)], "qualified_name string, name string, file_path string")
    assert found(flows.touched_flows(traced, changed)) == [("t.py::t", 1)]
    assert found(flows.ripple(calls, changed)) == []
    assert found(flows.ripple(calls, spark.createDataFrame([("a.py::f", "lone", "x.py")], changed.schema))) == [("t.py",)]
    worth = flows.criticality(traced, nodes, calls, graph.tested_by(calls), ["lone"]).first()
    assert worth.entry == "t.py::t" and worth.criticality == pytest.approx(round(0.3 * 1 / 4 + 0.2 * 3 / 5 + 0.15 * (1 - 1 / 3) + 0.1 * 2 / 10, 4))
    assert found(flows.tests_of(changed, calls, graph.tested_by(calls))) == []
    proof = flows.test_evidence(nodes, calls, graph.tested_by(calls))
    assert found(proof) == [("a.py::f", True, False), ("c.py::lone", False, True)]
    assert found(flows.flow_nodes(entries.limit(0), calls.limit(0))) == []


def test_history(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(s, day + datetime.timedelta(s), f) for s, files in enumerate(["ab", "ab", "abc", "c", "abcdefghi"]) for f in files]
    commits = spark.createDataFrame([*rows, rows[0]], "sha int, ts date, file_path string").distinct()
    assert found(history.small_commits(commits).select("sha").distinct()) == [(0,), (1,), (2,), (3,)]
    assert found(history.hottest(commits)) == [("a", 3), ("b", 3), ("c", 2)]
    imports = spark.createDataFrame([("b", "a")], "source string, target string")
    assert found(history.coupled(commits, imports.limit(0))) == [("a", "b", 3)] and found(history.coupled(commits, imports)) == []
    assert found(history.coupled(commits, imports.limit(0), least=1)) == [("a", "b", 3), ("a", "c", 1), ("b", "c", 1)]
    subjects = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "sha int, subject string")
    assert found(history.origins(commits, subjects)) == [("a", "s0"), ("b", "s0"), ("c", "s2")]
    done = spark.createDataFrame([("q", "d/a.py", "x"), ("r", "d/a.py", None), ("s", "b.py", None)], "qualified_name string, file_path string, doc string")
    assert found(history.coverage(done)) == [(3, 1, 33)] and found(history.coverage_by_dir(done)) == [("", 1, 0, 0), ("d", 2, 1, 50)]
    assert len(history.coverage_rollup(done).collect()) == 5
    assert found(history.coverage(done.limit(0))) == [(0, 0, 0)]


def test_ledger(spark):
    at = lambda s: datetime.datetime.fromisoformat(s)
    rows = [(1, at("2020-01-01T23:59:59"), "u", "x", 1.005, '{"k": 3}'), (2, at("2020-01-02T00:00:00"), "u", "x", 2.0, None), (3, at("2020-01-02T00:00:00"), "u", "y", None, "{}"), (4, None, None, None, None, None)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id string, event_type string, value double, props string")
    assert [(r.n, r.event_type) for r in ledger.daily(events.where("event_id < 4")).orderBy("day", "event_type").collect()] == [(1, "x"), (1, "x"), (1, "y")]
    moved = ledger.deltas(ledger.daily(events.where("event_id < 4"))).orderBy("event_type", "day").collect()
    assert [r.delta for r in moved] == [None, 0, None]
    newest = {r.user_id: r.event_id for r in ledger.latest(events).collect()}
    assert newest == {"u": 3, None: 4}
    assert {r.model: (r.tokens, r.usd) for r in ledger.spend(events).collect()} == {"x": (3, 3.01), "y": (None, None), None: (None, None)}
    assert ledger.daily(events.limit(0)).collect() == ledger.latest(events.limit(0)).collect() == []


def test_lookup(spark, nodes):
    assert found(lookup.languages(nodes)) == [("python",)]
    assert found(lookup.of_kinds(nodes, ["Class"], "B.P")) == [("b.py::K", "Class")]
    assert found(lookup.name_search(nodes, ["lone"])) == [("c.py::lone", "Function")] and len(lookup.name_search(nodes, []).collect()) == 6
    assert found(lookup.token_search(nodes, ["f"])) == [("a.py::f",), ("b.py::f",)]
    edges = spark.createDataFrame([("CALLS", "a.py::f", "b.py::K", 1), ("CALLS", "a.py::f", "b.py::K", 1), ("CALLS", None, "b.py::K", 2), ("X", "a.py", "gone", 0)], "kind string, source string, target string, line int")
    assert len(lookup.edges_at(edges, nodes, "source").collect()) == 2 and len(lookup.induced(edges, nodes).collect()) == 2
    assert found(lookup.edge_stats(edges)) == [("CALLS", 3, 1), ("X", 1, 1)]
    docs = spark.createDataFrame([(1, "me@x.org"), (2, "a\x00b"), (3, None), (4, "")], "doc_id int, text string")
    assert found(lookup.hygiene(docs)) == [(1,)]
    assert [r[0] for r in docs.orderBy("doc_id").select(lookup.sanitize("text")).collect()] == ["me@x.org", "ab", None, ""]
    prints = {r.doc_id: r.fingerprint for r in lookup.fingerprints(docs).collect()}
    assert prints[3] == prints[4] and len(set(prints.values())) == 3
