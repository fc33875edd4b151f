"""Bounded traversal, retraced flows and line tallies against plain versions."""

import difflib
import random

import pytest

from codelattice.operators import bounded, flows, graph, line_diff


def plain_reach(steps, seeds, depth, most):
    out = []
    for root in {r for r, _ in seeds}:
        seen, front, found = {n for r, n in seeds if r == root}, {n for r, n in seeds if r == root}, []
        for level in range(1, depth + 1):
            front = {b for a, b in steps if a in front} - seen
            seen |= front
            found += [(level, n) for n in front]
            if not front or len(found) > most:
                break
        out += [(root, n, d, len(found) > most, len(found)) for d, n in sorted(found)[:most]]
    return sorted(out)


@pytest.mark.parametrize(("depth", "most"), [(1, 100), (2, 3), (3, 7), (5, 1), (4, 0)])
def test_reach(spark, depth, most):
    rng = random.Random(depth)
    names = [f"n{i}" for i in range(40)]
    steps = [(rng.choice(names), rng.choice(names)) for _ in range(60)]
    seeds = [(i, rng.choice(names)) for i in range(6) for _ in range(2)]
    got = bounded.reach(spark.createDataFrame([*steps, *steps[:3], (None, "n1"), ("n1", None)], "node string, next string"), spark.createDataFrame([*seeds, seeds[0], (9, None)], "root int, node string"), depth, most)
    assert sorted(tuple(r) for r in got.collect()) == plain_reach(steps, seeds, depth, most)


def test_dependents_by_kind(spark):
    edges = spark.createDataFrame([("IMPORTS_FROM", "b", "a", "b"), ("CALLS", "c::f", "b::g", "c"), ("CONTAINS", "d", "b::g", "d"), ("INHERITS", "e::K", "a::K", "e"), ("TESTED_BY", "t", "a::K", "t"), ("CALLS", "a::x", "a::K", "a")], "kind string, source string, target string, file_path string")
    nodes = spark.createDataFrame([("a::K", "a"), ("b::g", "b"), ("c::f", "c")], "qualified_name string, file_path string")
    roots = spark.createDataFrame([("a",), ("c",)], "file_path string")
    got = {(r.root, r.node, r.depth, r.truncated) for r in bounded.dependents(edges, nodes, roots).collect()}
    assert got == {("a", "b", 1, False), ("a", "e", 1, False), ("a", "c", 2, False)}
    assert {(r.node, r.truncated, r.total) for r in bounded.dependents(edges, nodes, roots, most=1).where("root = 'a'").collect()} == {("b", True, 2)}
    assert {r.node for r in bounded.ripple(edges, nodes, roots).collect()} == {"b", "e"}
    assert {(r.source, r.target) for r in bounded.induced(edges.select("source", "target"), spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("b",)], "node string")).collect()} == {("b", "a")}


@pytest.mark.parametrize("seed", range(3))
def test_retraced_flows_equal_a_full_trace(spark, seed):
    rng = random.Random(seed)
    files = [f"f{i}" for i in range(8)]
    names = [f"{rng.choice(files)}::s{i}" for i in range(50)]
    home = lambda q: q.split("::")[0]
    nodes = spark.createDataFrame([(q, home(q), "Function") for q in names], "qualified_name string, file_path string, kind string")
    old = {(rng.choice(names), rng.choice(names)) for _ in range(45)}
    changed = {"f0", "f3"}
    new = {(a, b) for a, b in old if home(a) not in changed} | {(rng.choice([n for n in names if home(n) in changed]), rng.choice(names)) for _ in range(8)}
    calls = lambda pairs: spark.createDataFrame([(a, b, False) for a, b in pairs], "source string, target string, is_bare boolean")
    entries = lambda pairs: graph.entry_points(nodes, calls(pairs))
    stored = flows.flow_nodes(entries(old), calls(old))
    touched = spark.createDataFrame([(f,) for f in changed], "file_path string")
    got = flows.retrace(stored, entries(old), entries(new), calls(new), nodes, touched)
    full = flows.flow_nodes(entries(new), calls(new))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.select("entry", "node", "depth").collect()))
    again = {r.qualified_name for r in flows.to_retrace(stored, entries(old), entries(new), nodes, touched).collect()}
    before, now = {r.qualified_name for r in entries(old).collect()}, {r.qualified_name for r in entries(new).collect()}
    through = {r.entry for r in stored.collect() if home(r.node) in changed}
    assert again == {e for e in now if e not in before or e in through or home(e) in changed} and len(again) < len(now)


def test_line_tallies(spark):
    rng = random.Random(7)
    lines = ["a", "b", "c", "", "++x", "--y", "+z", "-- ", "é"]
    pairs = [(i, "\n".join(rng.choices(lines, k=rng.randrange(12))), "\n".join(rng.choices(lines, k=rng.randrange(12)))) for i in range(120)]
    pairs += [(120, None, "a\nb"), (121, "a\r\nb\x0bc", None), (122, None, None), (123, "x\n" * 400, "x\n" * 300 + "y\n")]
    want = {}
    for i, a, b in pairs:
        diff = [x for x in difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="") if not x.startswith(("+++", "---"))]
        want[i] = (sum(x.startswith("+") for x in diff), sum(x.startswith("-") for x in diff))
    counts = line_diff.tallies(spark.createDataFrame(pairs, "i int, before string, after string"), ["i"])
    assert {r.i: (r.added, r.removed) for r in counts.collect()} == want
    assert tuple(line_diff.totals(counts).first()) == (sum(v != (0, 0) for v in want.values()), *(sum(x) for x in zip(*want.values())))
