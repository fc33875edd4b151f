"""Entry points and security words against the lists, name by name."""

import re

from pyspark.sql import functions as F

from codelattice.functions import marks


def test_marks(spark):
    decorators = [["app.get('/x')"], ["APP.POST"], ["functools.cache", "celery.task"], ["property"], [], None, ["pytest.mark.slow"], ["Pytest.Mark"], ["tool"], ["my.tool"], ["Tool"], ["a_tool_b"], ["PostMapping"], ["bp.route('/')"], ["x.middleware('http')"], ["faction"], ["action"], ["router.use(f)"], ["Router.Use"], [None, "receiver"]]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(decorators)], "i int, d array<string>")
    got = {r.i: r.m for r in rows.select("i", marks.entry_decorator(F.col("d")).alias("m")).collect()}
    plain = lambda ds: any(re.search(p, d, re.I) for d in ds for p in marks.ENTRY_DECORATORS) or any(re.search(p, d) for d in ds for p in marks.EXACT_DECORATORS)
    assert got == {i: plain([x for x in d or [] if x]) for i, d in enumerate(decorators)}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 15, 16)] == [True, True, True, False, False, False, True, False, True, False, True]
    names = ["main", "mainly", "test_x", "Testing", "TestX", "on_click", "onCreateView", "onclick", "handle", "handler2", "doGet", "do_GET", "do_get", "render", "rerender", "ngOnInit", "get_db", None]
    found = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", marks.entry_name(F.col("n")).alias("m"), marks.entry_name(F.col("n"), ["^re"]).alias("more")).collect()
    assert {r.i: bool(r.m) for r in found} == {i: bool(n and any(re.search(p, n) for p in marks.ENTRY_NAMES)) for i, n in enumerate(names)} and found[14].more
    words = ["authorize", "Sign_up", "plain", "dbQUERY", None, "tokens", "hot"]
    safe = spark.createDataFrame([(i, n) for i, n in enumerate(words)], "i int, n string").select("i", marks.security(F.col("n")).alias("m"), marks.security(F.lit("x"), F.col("n"), more=["hot"]).alias("more")).collect()
    assert [r.m for r in safe] == [True, True, False, True, False, True, False] and safe[6].more
