"""Readers and extraction on small repositories, and streams that resume."""


import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.functions import text
from codelattice.operators import ledger as batch
from codelattice.sources import python_code, readers
from codelattice.streaming import ledger as streams


def test_unified_diff(spark):
    body = "@@ -1 +9 @@ before any file\n+++ b/a.py\n@@ -1,2 +3,4 @@ def f\n+x\n@@ -9 +12 @@\n@@ -5,3 +7,0 @@\n--- a/b.py\r\n+++ b/b dir/b.py\r\n@@ -0,0 +1,2 @@\n@@ garbled @@\n"
    found = readers.diff_ranges(spark.createDataFrame([(1, body), (2, None), (3, "")], "k int, text string"), ["k"])
    assert sorted(map(tuple, found.collect())) == [(1, "a.py", 3, 6), (1, "a.py", 7, 7), (1, "a.py", 12, 12), (1, "b dir/b.py", 1, 2)]


def test_commit_log(spark):
    log = "\0newest\n\na.py\nb.py\n\0empty\n\0oldest\n\n  a.py \n"
    found = readers.commit_log(spark.createDataFrame([(1, log), (2, None)], "k int, text string"), ["k"])
    assert sorted(map(tuple, found.collect())) == [(1, 0, "newest", "a.py"), (1, 0, "newest", "b.py"), (1, 2, "oldest", "a.py")]


def test_ledger_leaves_out_garbled_lines(spark):
    lines = ['{"a": 1, "b": "x"}', '{"a": 2', "[1, 2]", "", None, "7", '{"b": "y", "more": 3}', '{"a": "no number"}']
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    found = readers.ledger(spark.createDataFrame([(x,) for x in lines], "value string"), schema)
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "x"), (None, "y")]


def test_page_marks(spark):
    page = "<!-- documents: sym:a sig:0123456789abcdef\n sym:b@x/y.c sig:short -->\ntext sym:no\n%% documents: sym:a sig:fedcba9876543210\n<!-- documents: sig:0123456789abcdef sym:c -->"
    pages = spark.createDataFrame([("p", page), ("g", readers.STAMP + " --><!-- documents: sym:z -->"), ("e", "")], "page string, text string")
    named, bad = readers.page_anchors(readers.page_tokens(pages))
    assert sorted(map(tuple, named.collect()), key=repr) == [("p", "sym:a", "0123456789abcdef"), ("p", "sym:b@x/y.c", None), ("p", "sym:c", None)]
    assert sorted((r.token, r.reason) for r in bad.collect()) == [("sig:0123456789abcdef", "orphaned"), ("sig:fedcba9876543210", "conflicting"), ("sig:short", "malformed")]


def test_tracked_files(spark, tmp_path):
    held = {"src/a.py": b"x = 1\n", "src/B.PY": b"pass", "src/empty.py": b"", "vendor/deep/c.py": b"", "lib/vendor/d.py": b"", "run": b"#!/usr/bin/env -S python3 -u\n", "data.bin": b"\0", "bin.py": b"a\0b", "late.py": b"a" * 9000 + b"\0", "notes.txt": b"hello", "build/x_test.py": b""}
    for path, content in held.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    found = readers.tracked_files(spark, str(tmp_path), ["vendor/**", "*_test.py"])
    assert {(r.path, r.language) for r in found.collect()} == {("src/a.py", "python"), ("src/B.PY", "python"), ("run", "python"), ("late.py", "python")}


CODE = '''"""Module."""
import os
from pkg.mod import helper as h, other

@app.get("/")
async def route(x, *, y=1):
    """Answers.

    More."""
    return h(x) + local()

class Base(Root, pkg.Mixin):
    kind = make()

    def local(self):
        self.other2()
        return [other(i) for i in range(3)]

    def other2(self): pass

def local(): return os.getcwd()
'''


def test_extraction(spark):
    files = spark.createDataFrame([("src/a.py", CODE.encode()), ("tests/test_a.py", b"from a import f\ndef test_f():\n    f()\ndef helper(): f()\n"), ("bad.py", b"def ("), ("none.py", None), ("empty.py", b"")], "path string, content binary")
    rows = python_code.extract(files).cache()
    found = {r.qualified_name: r for r in python_code.symbols(rows).collect()}
    assert {q: r.kind for q, r in found.items() if r.file_path == "src/a.py"} == {"src/a.py": "File", "src/a.py::route": "Function", "src/a.py::Base": "Class", "src/a.py::Base.local": "Function", "src/a.py::Base.other2": "Function", "src/a.py::local": "Function"}
    route = found["src/a.py::route"]
    assert (route.signature, route.decorators, route.line_start, route.line_end) == ("route(x, *, y=1)", ["app.get"], 6, 10) and route.doc.startswith("Answers.")
    assert found["src/a.py"].doc == "Module." and found["tests/test_a.py::test_f"].kind == "Test" and found["tests/test_a.py::helper"].kind == "Function"
    assert {"bad.py", "none.py", "empty.py"} <= set(found) and sum(r.file_path == "bad.py" for r in found.values()) == 1
    links = {(r.kind, r.source, r.target) for r in python_code.edges(rows).collect()}
    assert {("CALLS", "src/a.py::route", "pkg.mod::helper"), ("CALLS", "src/a.py::route", "src/a.py::Base.local"), ("CALLS", "src/a.py", "make"), ("CALLS", "src/a.py::Base.local", "src/a.py::Base.other2"), ("CALLS", "src/a.py::Base.local", "pkg.mod::other"), ("CALLS", "src/a.py::local", "os.getcwd")} <= links
    assert {("INHERITS", "src/a.py::Base", "Root"), ("INHERITS", "src/a.py::Base", "pkg.Mixin"), ("IMPORTS_FROM", "src/a.py", "os"), ("IMPORTS_FROM", "src/a.py", "pkg.mod"), ("CONTAINS", "src/a.py", "src/a.py::Base.local")} <= links
    assert {tuple(r) for r in python_code.tested_by(rows).collect()} == {("a::f", "tests/test_a.py::test_f")}


NESTED = """class A(B, metaclass=M):
    def m(self, x: int = 1) -> "str":
        def inner(*a, **k): return k
        class Local:
            def deep(self): return inner()
        return inner()
    class Sub:
        async def n(self): pass
    if True:
        def late(self): pass
def outer():
    def m(): pass
"""


def test_names_and_signatures(spark):
    """Classes name what they hold, functions don't; a signature has its dotted name, bases and what it returns."""
    rows = python_code.symbols(python_code.extract(spark.createDataFrame([("n.py", NESTED)], "path string, content string")))
    got = {r.qualified_name.split("::")[1]: r.signature for r in rows.where("kind <> 'File'").collect()}
    assert got == {
        "A": "class A(B)", "A.m": "A.m(self, x: int=1) -> 'str'", "inner": "inner(*a, **k)", "Local": "class Local", "Local.deep": "Local.deep(self)",
        "A.Sub": "class A.Sub", "A.Sub.n": "A.Sub.n(self)", "A.late": "A.late(self)", "outer": "outer()", "m": "m()",
    }


@pytest.mark.parametrize(("other", "same"), [("def f( a ):\n        return a+1  # why\n", True), ("def f(a):\n\n    return (a + 1)\n", False), ("def f(a):\n    return a + 2\n", False), ("def f(b):\n    return b + 1\n", False), ("def f(a):\n    return a - 1\n", False)])
def test_fingerprint_reads_tokens(other, same):
    assert (python_code.span_fingerprint("def f(a):\n    return a + 1\n") == python_code.span_fingerprint(other)) is same
    assert python_code.span_fingerprint("x = '''") is None


def test_column_helpers(spark):
    row = spark.range(1).select(
        text.short(F.lit("a::b::c")), text.file_part(F.lit("a::b::c")), text.folder(F.lit("x")), text.stem(F.lit("a/.env")), text.stem(F.lit("a/b.tar.gz")), text.suffix(F.lit("A/B.PY")), text.suffix(F.lit("a.d/b")),
        text.page_slug(F.lit("")), text.page_slug(F.lit("a/b.py")), text.humanized(F.lit("test_readsEmpty_file")), text.relative(F.lit("/r/a.py::f"), "/r"), text.relative(F.lit("/rest/a.py"), "/r"),
        text.summary(F.lit("  One.\n\nTwo.")), text.clipped(F.lit("a  b\nc"), 3), text.gauge(F.lit(1), F.lit(1000), 4), text.gauge(F.lit(0), F.lit(0), 4), text.delta(F.lit(3)), text.delta(F.lit(-3)), text.delta(F.lit(0)), text.percent(F.lit(2), F.lit(3)), text.percent(F.lit(2), F.lit(0)),
        text.links(F.lit("[a](b.md) ![i](c.png) [d]( e)")),
    ).first()
    assert list(row) == ["c", "a", "", ".env", "b.tar", ".py", "", "root", "a.b", "reads empty file", "a.py::f", "/rest/a.py", "One.", "a…", "█░░░", "░░░░", "+3", "-3", "", 66, 0, ["b.md", "c.png"]]


def test_streams_resume(spark, tmp_path):
    """A stream that stops after some files, and has one batch run again, ends where one batch over all files ends."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    feed = tmp_path / "events.parquet"
    parts = events.randomSplit([1.0, 1.0, 1.0], 5)
    for i in (0, 1):
        parts[i].coalesce(1).write.mode("append").parquet(str(feed))
    read = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
    for run, plain in ((streams.daily, batch.daily), (streams.latest, batch.latest)):
        folder = str(tmp_path / run.__name__)
        run(spark, read(), folder)
    parts[2].coalesce(1).write.mode("append").parquet(str(feed))
    for run, plain in ((streams.daily, batch.daily), (streams.latest, batch.latest)):
        folder = tmp_path / run.__name__
        # the batch that ended last is run again, as after a crash before its commit was noted
        commits = sorted((folder / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        commits[-1].unlink()
        (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
        got, want = run(spark, read(), str(folder)), plain(events)
        assert len(commits) == 2 and sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(map(tuple, want.select(*sorted(want.columns)).collect()))


def test_an_empty_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0)
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    assert streams.daily(spark, stream, str(tmp_path / "a")).count() == 0
