"""Tests of symbols against a plain walk; rows of a site's search."""

import random

import pytest

from codelattice.operators import evidence, lookup, pages


def plain(asked, kinds, contains, calls, tested, depth, frontier):
    out = {}
    for root in asked:
        nodes = {root} | ({b for a, b in contains if a == root} if kinds.get(root) == "Class" else set())
        found = {t: False for n in nodes | {root.rsplit("::", 1)[-1]} for s, t in tested if s == n}
        for _ in range(depth):
            nodes = set(sorted({b for a, b in calls if a in nodes})[:frontier])
            for n in nodes:
                for s, t in tested:
                    if s == n:
                        found.setdefault(t, True)
        out |= {(root, t): late for t, late in found.items() if t in kinds}
    return out


@pytest.mark.parametrize(("depth", "frontier"), [(1, 50), (2, 2), (0, 1), (3, None)])
def test_tests_of(spark, depth, frontier):
    rng = random.Random(depth)
    names = [f"f{i % 4}::s{i}" for i in range(24)]
    kinds = {n: rng.choice(["Class", "Function"]) for n in names} | {f"t::t{i}": "Test" for i in range(6)}
    pair = lambda a, b, k: [(rng.choice(a), rng.choice(b)) for _ in range(k)]
    contains, calls = pair(names, names, 15), pair(names, names + ["s1", "s2"], 50)
    tested = pair(names + [n.split("::")[1] for n in names], [*[f"t::t{i}" for i in range(6)], "gone::t"], 30)
    frame = lambda rows, c="source string, target string": spark.createDataFrame(rows, c)
    nodes = frame(list(kinds.items()), "qualified_name string, kind string")
    got = evidence.tests_of(frame([(n,) for n in [*names, names[0], None]], "qualified_name string"), nodes, frame(contains), frame(calls), frame(tested), depth, frontier)
    want = plain(names, kinds, contains, calls, tested, depth, frontier)
    assert {(r.qualified_name, r.test): r.indirect for r in got.collect()} == want and got.count() == len(want)
    totals = {r.qualified_name: (r.n_tests, r.n_indirect) for r in evidence.counts(got).collect()}
    assert totals == {q: (sum(k[0] == q for k in want), sum(v for k, v in want.items() if k[0] == q)) for q in {k[0] for k in want}}


def test_site_search_and_edges(spark):
    modules = spark.createDataFrame([("src/a.py",), ("src/a.py",)], "module string")
    symbols = spark.createDataFrame([("src/a.py", "Class", "K", "Doc."), ("src/a.py", "Function", "f", " \n"), ("src/a.py", "Function", "g", None)], "module string, kind string, name string, doc string")
    guides = spark.createDataFrame([("Start", "start")], "title string, slug string")
    got = [tuple(r) for r in pages.search_rows(modules, symbols, guides).collect()]
    assert sorted(got) == sorted([("page", "Overview", "", "index.html"), ("page", "Architecture", "", "architecture.html"), ("guide", "Start", "", "start.html"), ("module", "src/a.py", "", "src.a.html"), ("class", "K", "a.py", "src.a.html#K")])
    edges = spark.createDataFrame([("CALLS", "a.py::f\x01", "g" * 300, 3)], "kind string, source string, target string, line int")
    assert tuple(lookup.edge_dict(edges).first()) == ("CALLS", "a.py::f", "g" * 256, "a.py", 3)
