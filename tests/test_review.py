"""Anchors, drift, freshness, tours and replacement on small inputs: nulls, ties, repeats, empty tables, clashing names."""


import pytest

from codelattice.operators import docs, order, review

SF = "/root/testdata/sf0.001"
PIN = {c: c * 16 for c in "abcd"}
NODES = "name string, qualified_name string, file_path string, is_test boolean"


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODES)


def test_pins_bind_to_the_anchor_before_them(spark):
    rows = [("p", 0, "sig:" + PIN["a"]), ("p", 1, "sym:a"), ("p", 2, "sig:" + PIN["b"]), ("p", 3, "sym:b"), ("q", 0, "sym:a"), ("q", 1, "sig:" + PIN["d"]), ("q", 2, "sym:a"), ("q", 3, "sig:" + PIN["c"]), ("q", 4, "sig:short"), ("r", 0, None)]
    found = docs.anchor_pairs(spark.createDataFrame(rows, "page string, pos int, token string"))
    assert sorted(map(tuple, found.collect()), key=repr) == [("p", "sym:a", PIN["b"]), ("p", "sym:b", None), ("q", "sym:a", PIN["d"])]
    bad = docs.bad_pins(spark.createDataFrame(rows, "page string, pos int, token string"))
    assert sorted(map(tuple, bad.collect())) == [("p", "sig:" + PIN["a"], "orphaned"), ("q", "sig:" + PIN["c"], "conflicting"), ("q", "sig:short", "malformed")]


def test_anchor_ladder(spark):
    sites = nodes(spark, [("a", "x.py::a", "x.py", False), ("b", "x.py::b", "x.py", False), ("b", "t/x.py::b", "t/x.py", True), ("c", "x.py::c", "x.py", False), ("c", "src/y.py::c", "src/y.py", False), ("d", "t/x.py::d", "t/x.py", True)])
    asked = ["sym:a", "sym:b", "sym:c", "sym:c@y.py", "sym:c@src/y.py", "sym:c@z.py", "sym:d", "sym:gone", "sym: ", "sym:c@.py"]
    found = docs.resolve(spark.createDataFrame([(a,) for a in asked * 2], "anchor string"), sites)
    got = {r.anchor: (r.status, r.qualified_name) for r in found.collect()}
    assert got["sym:a"] == ("ok", "x.py::a") and got["sym:b"] == ("ok", "x.py::b") and got["sym:d"] == ("ok", "t/x.py::d")
    assert got["sym:c"] == ("ambiguous", None) and got["sym:c@y.py"] == got["sym:c@src/y.py"] == ("ok", "src/y.py::c")
    assert got["sym:c@z.py"][0] == got["sym:gone"][0] == got["sym:c@.py"][0] == "missing" and got["sym: "][0] == "malformed"
    assert docs.resolve(found.select("anchor"), nodes(spark, [])).where("status = 'ok'").count() == 0


def test_drift(spark):
    pairs = spark.createDataFrame([("p1", "sym:a", "old"), ("p2", "sym:a", "new"), ("p3", "sym:a", None), ("p4", "sym:b", None), ("p5", "sym:a", None), ("p6", "sym:ghost", None), ("p7", "sym:c", None), ("p8", "sym:d", None), ("p9", "sym:e", "x")], "page string, anchor string, sig string")
    resolved = spark.createDataFrame([("sym:a", "ok", 1, "f::a", "f"), ("sym:b", "ok", 1, "g::b", "g"), ("sym:ghost", "missing", 0, None, None), ("sym:c", "ok", 1, "f::c", "f"), ("sym:d", "ok", 1, "f::d", "f"), ("sym:e", "ok", 1, "h::e", "h")], "anchor string, status string, n_sites int, qualified_name string, file_path string")
    prints = spark.createDataFrame([("f::a", "new"), ("f::c", "same"), ("f::d", "made"), ("g::b", "y")], "qualified_name string, fingerprint string")
    base = spark.createDataFrame([("f::a", "old"), ("f::c", "same"), ("g::b", "z")], prints.schema)
    changed = spark.createDataFrame([("f",), ("f",)], "file_path string")
    pages = spark.createDataFrame([("p5",)], "page string")
    assert sorted(r.page for r in docs.drift_direct(pairs, resolved, prints, base, changed, pages).collect()) == ["p1", "p3"]
    dependents = spark.createDataFrame([("g",), ("f",)], "file_path string")
    assert [r.page for r in docs.drift_ripple(pairs, resolved, changed, dependents, pages).collect()] == ["p4"]
    assert sorted(map(tuple, docs.drift_notes(pairs, resolved, prints, base, changed).collect())) == [("sym:d", "new"), ("sym:e", "unverifiable"), ("sym:ghost", "unresolved")]
    none = changed.limit(0)
    assert [r.page for r in docs.drift_direct(pairs, resolved, prints, base, none, pages).collect()] == ["p1"]


def test_gate_of_nothing_passes(spark):
    want = spark.createDataFrame([], "page string, fingerprint string")
    disk = spark.createDataFrame([("hand", "x", False)], "page string, fingerprint string, generated boolean")
    fresh = docs.freshness(want, disk)
    lost = spark.createDataFrame([], "anchor string")
    assert fresh.count() == 0 and docs.gate(fresh, lost, lost, lost).first().failures == 0
    stale = docs.freshness(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], want.schema), spark.createDataFrame([("a", "1", True), ("b", "9", True), ("z", "0", True), ("y", "0", None)], disk.schema))
    assert sorted(map(tuple, stale.collect())) == [("b", "stale"), ("c", "missing"), ("z", "orphan")]
    assert docs.gate(stale, lost, lost, lost).first().failures == 1


def test_mentions_are_whole_paths(spark):
    modules = spark.createDataFrame([("src/key.c",), ("lib/a/util.c",), ("lib/b/util.c",), ("src/c++/odd name.cc",), ("größe.c",), ("@scope/x.js",)], "module string")
    pages = spark.createDataFrame([(1, "see src/key.c."), (2, "vendor/src/key.c"), (3, "key.c, and util.c"), (4, "lib/a/util.c"), (5, None), (6, ""), (7, "key.c-old key.cc"), (8, "src/key.c.bak src/key.c"), (9, "(src/c++/odd name.cc)"), (10, "xsrc/c++/odd name.cc größe.cc"), (11, "größe.c!"), (12, "use @scope/x.js.map"), (13, "src/c++/odd name.cc_"), (14, "<!-- generated --> src/key.c")], "page int, text string")
    assert sorted(map(tuple, docs.mentions(pages, modules).collect())) == [("@scope/x.js", 12), ("größe.c", 11), ("lib/a/util.c", 4), ("src/c++/odd name.cc", 9), ("src/key.c", 1), ("src/key.c", 3), ("src/key.c", 8)]


def test_undo(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "page string, written string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0")], "page string, now string")
    assert dict(map(tuple, docs.undo(before, after).collect())) == {"a": "restore", "b": "refuse", "c": "gone"}


def edges(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], "source string, target string")


@pytest.mark.parametrize("text", ["ab bc ac", "ab ba cb", "ab bc ca dc", "", "ab ab ab ac"])
def test_tours_match_plain_walks(spark, text):
    pairs = {tuple(e) for e in text.split()}
    names = {x for p in pairs for x in p}
    graph = edges(spark, text)
    doors = {a for a, _ in pairs} - {b for _, b in pairs}
    assert {r.module for r in order.doors(graph).collect()} == doors


def test_replacement_by_file(spark):
    old = spark.createDataFrame([("f", "f::a"), ("f", "f::b"), ("g", "g::a"), ("h", "h::a")], "file_path string, qualified_name string")
    new = spark.createDataFrame([("f::c", "f", 1)], "qualified_name string, file_path string, extra int")
    gone = spark.createDataFrame([("h",)], "file_path string")
    assert sorted(map(tuple, review.replace_files(old, new, gone).collect())) == [("f", "f::c"), ("g", "g::a")]
    assert sorted(map(tuple, review.replace_files(old, new.limit(0), gone.limit(0)).collect())) == sorted(map(tuple, old.collect()))


def test_ledger_keeps_states(spark):
    rows = [(1, 5, 1), (2, 5, 1), (3, 7, 1), (4, 7, None), (5, 5, 1)]
    found = review.moved_snapshots(spark.createDataFrame(rows, "day int, a int, b int"), "day", ["a", "b"])
    assert sorted(map(tuple, found.collect())) == [(1, 5, 1, None, None), (3, 7, 1, 2, 0), (4, 7, None, 0, None), (5, 5, 1, -2, None)]


def test_bare_calls_by_imports(spark):
    calls = spark.createDataFrame([("f::m", "only", "f", 1, True), ("f::m", "two", "f", 2, True), ("g::m", "two", "g", 3, True), ("f::m", "none", "f", 4, True), ("f::m", "h::two", "f", 5, False)], "source string, target string, file_path string, line int, is_bare boolean")
    sites = nodes(spark, [("only", "h::only", "h", False), ("two", "h::two", "h", False), ("two", "k::two", "k", False)])
    imports = spark.createDataFrame([("f", "h"), ("f", "h"), ("g", "h"), ("g", "k")], "source string, target string")
    got = {r.line: (r.target, r.is_bare) for r in review.resolve_by_imports(calls, sites, imports).collect()}
    assert got == {1: ("h::only", False), 2: ("h::two", False), 3: ("two", True), 4: ("none", True), 5: ("h::two", False)}


def test_risk_counts_by_hand(spark):
    sites = spark.createDataFrame([("login", "f::login", "f", False, "c1"), ("b", "g::b", "g", False, "c2"), ("t", "t::t", "t", True, "c3")], NODES + ", community string")
    calls = spark.createDataFrame([("g::b", "f::login", "g", 1, False), ("t::t", "g::b", "t", 2, False)], "source string, target string, file_path string, line int, is_bare boolean")
    tested = spark.createDataFrame([("g::b", "t::t")], "source string, target string")
    flows = spark.createDataFrame([("g::b", "g::b", 0), ("g::b", "f::login", 1)], "entry string, node string, depth int")
    weight = spark.createDataFrame([("g::b", 0.9)], "entry string, criticality double")
    got = {r.qualified_name: r.risk for r in review.risk(sites, flows, weight, calls, tested, ["login"]).collect()}
    # flows .25, one foreign caller .05, no test .30, word .20, one call .05
    assert got["f::login"] == 0.85
    # flows .25, one foreign caller .05, one test .25, one call .05; the test calls what it tests
    assert got["g::b"] == 0.60 and got["t::t"] == 0.25
