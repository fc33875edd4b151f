"""The maintained symbol table against full builds: creates, changes, deletes, dependents, restarts and batches run again."""

import hashlib

from pyspark.sql import functions as F

from codelattice.sources import python_code
from codelattice.streaming import watch

A, B, C = "def f():\n    return g()\n", "def g():\n    pass\n", "class K:\n    def m(self):\n        f()\n"
STATES = [
    {"a.py": A, "b.py": B},
    {"a.py": A, "b.py": B + "\n\ndef h():\n    g()\n", "c.py": C},
    {"b.py": B, "c.py": C},
    {"b.py": B, "c.py": C},
    {},
    {"d.py": A, "c.py": "def broken(:\n"},
]


def build(files):
    rows = python_code.extract(files.select(F.col("file_path").alias("path"), "content"))
    return rows.select("file_path", "row_type", "kind", "qualified_name", "target", "line_start")


def listing(state, snapshot):
    return [(snapshot, p, hashlib.sha256(t.encode()).hexdigest(), t) for p, t in state.items()]


LISTING = "snapshot int, file_path string, hash string, content string"


def put(spark, folder, snapshot, state):
    rows = spark.createDataFrame(listing(state, snapshot) or [(snapshot, None, None, None)], LISTING)
    rows.coalesce(1).write.mode("append").parquet(folder)


def found(rows):
    return sorted(repr(tuple(r)) for r in rows.collect())


def test_watch(spark, tmp_path):
    schema = build(spark.createDataFrame([], "file_path string, content string")).schema
    made = watch.Watch(spark, f"{tmp_path}/table", build, schema)
    source = f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(source)
    full = lambda s: found(build(spark.createDataFrame(list(s.items()), "file_path string, content string")))
    for i, state in enumerate(STATES):
        put(spark, source, i, state)
        watch.Watch(spark, f"{tmp_path}/table", build, schema).drain(stream())  # a new process each time
        assert found(made.rows()) == full(state), i
    want = []
    for i, state in enumerate(STATES):
        last = STATES[i - 1] if i else {}
        want += [(i, p, "created" if p not in last else "deleted" if p not in state else "changed") for p in {*last, *state} if last.get(p) != state.get(p)]
    assert sorted((r.batch, r.file_path, r.event) for r in made.events().collect()) == sorted(want)
    whole = spark.createDataFrame([r for i, s in enumerate(STATES) for r in listing(s, i) or [(i, None, None, None)]], LISTING)
    assert {(r.snapshot, r.file_path, r.event) for r in watch.history(whole).collect()} == set(want)
    before = found(made.rows()), found(made.events())
    made.apply(spark.createDataFrame(listing(STATES[5], 5), LISTING), 5)  # the last batch again
    assert (found(made.rows()), found(made.events())) == before
    made.drain(stream())  # nothing new
    assert found(made.rows()) == before[0]


def test_several_listings_at_once_and_dependents(spark, tmp_path):
    schema = build(spark.createDataFrame([], "file_path string, content string")).schema
    built = []

    def counted(files):
        built.append({r.file_path for r in files.collect()})
        return build(files)

    def users(rows, changed):
        """Files that call what a changed file defines."""
        names = rows.where("row_type = 'node'").join(changed, "file_path", "left_semi").select(F.element_at(F.split("qualified_name", "[:.]"), -1).alias("target"))
        return rows.where("kind = 'CALLS'").join(names, "target", "left_semi").select("file_path")

    made = watch.Watch(spark, f"{tmp_path}/t", counted, schema, users)
    made.apply(spark.createDataFrame(listing(STATES[0], 0) + listing(STATES[1], 1), LISTING), 0)
    assert {r.event for r in made.events().collect()} == {"created"} and built[-1] == {"a.py", "b.py", "c.py"}
    made.apply(spark.createDataFrame(listing(STATES[1] | {"b.py": B}, 2), LISTING), 1)
    assert built[-1] == {"a.py", "b.py"}  # a.py calls g, c.py calls only f
    assert found(made.rows()) == found(build(spark.createDataFrame(list((STATES[1] | {"b.py": B}).items()), "file_path string, content string")))
