"""Change lists, the ten metrics, twins, listings and folder ranks on small inputs."""

import pytest
from pyspark.sql import functions as F

from codelattice.operators import snapshot
from codelattice.sources import change_lists


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "k int, text string")


def found(df):
    return sorted(map(tuple, df.collect()))


def test_change_lists(spark):
    assert found(change_lists.names(texts(spark, "a.py\nb c.py\n\na.py", None, "x\0y\r\nz\0"), ["k"])) == [(0, "a.py"), (0, "b c.py"), (2, "x"), (2, "y"), (2, "z")]
    assert found(change_lists.summaries(texts(spark, "M       a.py\r\nD       dir/b c.py\nX       no\n?  no\nM\nA x", ""), ["k"])) == [(0, "A", "x"), (0, "D", "dir/b c.py"), (0, "M", "a.py")]
    assert found(change_lists.working_copies(texts(spark, "M       a.py\nA  +    dir/b.py\n?       no.py\nR x\nC       c d.py\n!       gone\nM"), ["k"])) == [(0, "A", "dir/b.py"), (0, "C", "c d.py"), (0, "M", "a.py"), (0, "R", "x")]
    short = change_lists.short_states(texts(spark, " M a.py\nR  old.py -> new dir/n.py\n?? u.py\nM\n", None, "AM b -> c -> d"), ["k"])
    assert found(short) == [(0, "??", "u.py"), (0, "M", "a.py"), (0, "R", "new dir/n.py"), (2, "AM", "c -> d")]
    assert found(change_lists.changed(["k"], short, short)) == [(0, "a.py"), (0, "new dir/n.py"), (0, "u.py"), (2, "c -> d")]
    names = ["main", "HEAD~2", "a b", "-x", "x;y", "r10:HEAD", "", None, "v1.0^{}"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(change_lists.safe(F.col("n")).alias("a"), change_lists.safe(F.col("n"), ranges=True).alias("b")).collect()
    assert [r.a for r in rows] == [True, True, False, False, False, False, False, False, True] and [i for i, r in enumerate(rows) if r.b] == [5]


def test_lines(spark):
    cases = [None, "", "a", "a\n", "a\nb", "\n", "\n\n", "a\r\nb\r", "a\x0bb\x0cc", "a b\x85", "\r\n\r\n", " "]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", snapshot.n_lines(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: len((c or "").splitlines()) for i, c in enumerate(cases)}


def test_snapshot(spark):
    modules = spark.createDataFrame([("a", "One.\nTwo."), ("b", "x"), ("c", None), ("d", "")], "module string, doc string")
    symbols = spark.createDataFrame([("a", "s"), ("a", "t\nu\n"), ("b", None), ("c", "v"), ("d", "")], "module string, doc string")
    pages = spark.createDataFrame([("<!-- generated x\nb",), ("hand\nmade\n",), (None,)], "text string")
    assert snapshot.snapshot(modules, symbols, pages).first().asDict() == dict(zip(snapshot.METRICS, [3, 5, 2, 4, 1, 4, 7, 1, 2, 4], strict=True))
    none = snapshot.snapshot(modules.limit(0), symbols.limit(0), pages.limit(0)).first()
    assert list(none) == [0] * 10


def test_twins_and_listings(spark):
    rows = [("f.c", "f.c::x", 3), ("f.c", "f.c::x.y", 3), ("f.c", "f.c::x.z", 4), ("f.c", "f.c::x.z.q", 4), ("g.c", "g.c::x.y", 3), ("f.c", "f.c::w.v", 9)]
    symbols = spark.createDataFrame(rows, "file_path string, qualified_name string, line_start int")
    assert found(snapshot.without_twins(symbols).select("qualified_name")) == [("f.c::w.v",), ("f.c::x",), ("f.c::x.z",), ("g.c::x.y",)]
    named = spark.createDataFrame([("f", f"s{i}", 10 - i) for i in range(10)] + [("g", "only", 1)], "file_path string, name string, line_start int")
    assert found(snapshot.listings(named, 3)) == [("f", "s9, s8, s7", 7), ("g", "only", 0)]
    flows = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "x"), ("a", "y")], "entry string, node string")
    assert found(snapshot.memberships(flows)) == [("x", 2), ("y", 1)]
    tour = spark.createDataFrame([("a/x", 3), ("a/y", 1), ("b/z", 0), ("top", 2)], "module string, position long")
    assert found(snapshot.folder_ranks(tour)) == [("", 2, 1), ("a", 1, 2), ("b", 0, 1)]


@pytest.mark.parametrize("reader", [change_lists.names, change_lists.summaries, change_lists.working_copies, change_lists.short_states])
def test_no_texts(spark, reader):
    assert reader(texts(spark, "x").limit(0), ["k"]).collect() == []
