"""Rendered pages against the lines they must have; what a run writes, keeps, refuses and prunes."""

import posixpath

from pyspark.sql import functions as F

from codelattice.operators import pages


def frames(spark):
    modules = spark.createDataFrame([("src/a.py", "Does a.\n ", "first"), ("src/b.py", None, "add b"), ("c.py", None, None), (None, None, None)], "module string, doc string, origin string")
    edges = spark.createDataFrame([("src/a.py", "src/b.py"), ("src/a.py", "c.py"), ("src/a.py", "c.py"), ("src/b.py", "c.py"), ("src/a.py", "gone.py"), ("c.py", "c.py")], "source string, target string")
    symbols = [
        ("src/a.py", "g", "def g(x)", 9, False, " Helps.\n", ["f", "main"], ["h"], None), ("src/a.py", "f", None, 3, True, "Runs.", None, [], []),
        ("src/a.py", "z", None, 5, False, " \n", ["f"], None, ["works", "fails"]), ("src/a.py", "y", None, 4, False, None, None, None, None), ("gone.py", "q", None, 1, False, "x", None, None, None),
    ]
    kinds = "module string, name string, signature string, line int, is_member boolean, doc string, callers array<string>, callees array<string>, tested array<string>"
    mentions = spark.createDataFrame([("src/a.py", "docs/x.md"), ("src/a.py", "README.md"), ("src/a.py", "docs/architecture/y.md")], "module string, page string")
    flow = spark.createDataFrame([("src/a.py", "g", "h"), ("src/a.py", "f", "g"), ("src/a.py", "f", "g")], "module string, a string, b string")
    return modules, edges, spark.createDataFrame(symbols, kinds), mentions, flow


A = """<!-- generated documentation — edit the source, not this file -->
# `src/a.py`

Does a.

**depends on** [`c.py`](c.md), [`src/b.py`](src.b.md)  ·  **discussed in** [`README.md`](../../README.md), [`docs/architecture/y.md`](y.md), [`docs/x.md`](../x.md)

```mermaid
flowchart TD
  f --> g
  g --> h
```

## API

#### `f`
`src/a.py:3`

Runs.

### `def g(x)`
`src/a.py:9`

Helps.

**called by** `f`, `main`  ·  **calls** `h`

<details><summary>Undocumented (2)</summary>

- `y`
- `z` — tested: works; fails

</details>
"""


def test_render(spark):
    got = {r.page: r.text for r in pages.render(*frames(spark)).collect()}
    head = pages.FIRST_LINE
    assert got == {
        "src.a.md": A,
        "src.b.md": f'{head}\n# `src/b.py`\n\n*No module docstring. First commit: "add b".*\n\n**depends on** [`c.py`](c.md)  ·  **used by** [`src/a.py`](src.a.md)\n',
        "c.md": f"{head}\n# `c.py`\n\n**used by** [`src/a.py`](src.a.md), [`src/b.py`](src.b.md)\n",
    }
    paths = ["docs/architecture/x/y.md", "docs/z.md", "q", "docs2/a", "docs/architecture2/b"]
    links = spark.createDataFrame([(p,) for p in paths], "p string").select(pages.relative_link(F.col("p"), "docs/architecture").alias("l")).collect()
    assert [r.l for r in links] == [posixpath.relpath(p, "docs/architecture") for p in paths]
    none = [f.limit(0) for f in frames(spark)]
    assert pages.render(*none).collect() == []


def test_plan_and_apply(spark, tmp_path):
    stamp = pages.FIRST_LINE
    want = spark.createDataFrame([("a.md", stamp + "\nnew"), ("d/b.md", stamp + "\nsame"), ("c.md", stamp)], "page string, text string")
    disk = [("a.md", stamp + "\nold"), ("d/b.md", stamp + "\nsame"), ("old/gone.md", stamp), ("hand.md", "mine"), ("null.md", None)]
    for page, text in disk:
        (tmp_path / page).parent.mkdir(exist_ok=True)
        (tmp_path / page).write_text(text or "")
    planned = pages.plan(want, spark.createDataFrame(disk, want.schema))
    assert {r.page: r.action for r in planned.collect()} == {"a.md": "write", "d/b.md": "keep", "c.md": "write", "old/gone.md": "prune"}
    assert {tuple(r) for r in pages.apply(planned, str(tmp_path)).collect()} == {("a.md", "write"), ("c.md", "write"), ("old/gone.md", "prune")}
    assert (tmp_path / "a.md").read_text() == stamp + "\nnew" and (tmp_path / "c.md").read_text() == stamp and not (tmp_path / "old/gone.md").exists() and (tmp_path / "hand.md").read_text() == "mine"
    theirs = pages.plan(want, spark.createDataFrame([("a.md", "by hand")], want.schema))
    assert {tuple(r) for r in pages.apply(theirs, str(tmp_path)).collect()} == {("a.md", "refuse")} and (tmp_path / "a.md").read_text() == stamp + "\nnew"
