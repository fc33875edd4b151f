"""Flows as bit sets: several turns against brute force, and what they leave on disk."""

import os

from codelattice.operators import flows
from codelattice.sources.storage import shared_dir


def test_turns_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(flows, "WORDS", 1)
    monkeypatch.setattr(flows, "ROWS", 3)
    pairs = [(i, (i * 7 + k * k) % 90) for i in range(80) for k in range(1, 3)]
    calls = spark.createDataFrame([(f"n{a}", f"n{b}", False) for a, b in pairs] + [("n85", "bare", True)], "source string, target string, is_bare boolean")
    entries = spark.createDataFrame([(f"n{i}",) for i in range(90)], "qualified_name string")
    want = {}
    for e in range(90):
        seen, front = {e: 0}, {e}
        for depth in range(1, 4):
            front = {b for a, b in pairs if a in front} - set(seen)
            seen |= dict.fromkeys(front, depth)
        if len(seen) > 1:
            want[f"n{e}"] = {f"n{n}": d for n, d in seen.items()}
    sets = flows.flow_sets(entries, calls, depth=3)
    assert len(sets.turns) == 2
    assert {(r.entry, r.node, r.depth) for r in sets.rows().collect()} == {(e, n, d) for e, found in want.items() for n, d in found.items()}
    assert {(r.entry, r.n_nodes, r.depth) for r in flows.depths(sets).collect()} == {(e, len(found), max(found.values())) for e, found in want.items()}
    about = spark.createDataFrame([(f"n{i}", f"f{i % 4}", i) for i in range(0, 90, 3)], "node string, file string, worth long")
    told = flows.flow_sets(entries, calls, depth=3, about=about).summed("worth", distinct="file")
    sums = {e: [int(n[1:]) for n in found if int(n[1:]) % 3 == 0] for e, found in want.items()}
    assert {(r.entry, r.n, r.worth, r.files) for r in told.collect()} == {(e, len(x), sum(x), len({i % 4 for i in x})) for e, x in sums.items() if x}


def test_flows_leave_little_on_disk(spark):
    shared_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    folder = os.path.dirname(folder.rstrip("/"))  # Spark's own is one below
    size = lambda: sum(os.path.getsize(os.path.join(top, f)) for top, _, files in os.walk(folder) for f in files)
    nodes, fan = 2000, 8
    calls = spark.range(nodes * fan).selectExpr("concat('src/some/folder/file.py::K', id div 8) as source", f"concat('src/some/folder/file.py::K', (id div 8 * 31 + id % 8 * 17 + 1) % {nodes}) as target", "false as is_bare")
    entries = spark.range(500).selectExpr("concat('src/some/folder/file.py::K', id) as qualified_name")
    before = size()
    found = flows.flow_nodes(entries, calls)
    assert found.count() > 500_000
    assert 0 < size() - before < 2_000_000, size() - before
