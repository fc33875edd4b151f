"""SQL files and notebooks."""

import json

from pyspark.sql import functions as F

from codelattice.sources import notebooks, python_code, sql_code

SQL = """-- create table no_one
CREATE TABLE IF NOT EXISTS app.users (id int, note text DEFAULT 'create view nope');
create or replace view `app`.`active` as select * from users join "Audit".log on true;
CREATE OR REPLACE PROCEDURE app.clean() AS $$ begin delete from users; create table inner_one(x int); end $$;
/* CREATE FUNCTION hidden() */ CREATE FUNCTION f(x int) RETURNS int AS 'select 1';
INSERT INTO app.users SELECT * FROM (SELECT 1) JOIN select_me;
"""


def test_sql(spark):
    files = spark.createDataFrame([("a.sql", SQL), ("b.sql", "select * from ACTIVE a join users u"), ("n.sql", None), ("c.sql", "create table twice(x int)"), ("d.sql", "create table Twice(x int); select 1 from active")], "path string, content string")
    rows = sql_code.extract(files)
    nodes = {(r.kind, r.sql_kind, r.name, r.line_start) for r in rows.where("row_type = 'node' and file_path = 'a.sql'").collect()}
    assert nodes == {("Class", "table", "users", 2), ("Class", "view", "active", 3), ("Function", "procedure", "clean", 4), ("Function", "function", "f", 5)}
    refs = {(r.target, r.line_start) for r in rows.where("row_type = 'edge' and file_path = 'a.sql'").collect()}
    assert refs == {("no_one", 1), ("nope", 2), ("IF", 2), ("active", 3), ("users", 3), ("inner_one", 4), ("select_me", 6)}
    assert not {t.upper() for t, _ in refs} & set(sql_code.NO_TABLES)
    assert {(r.source, r.target, r.name) for r in sql_code.links(rows).collect()} >= {("b.sql", "a.sql", "ACTIVE"), ("b.sql", "a.sql", "users"), ("d.sql", "a.sql", "active")}
    assert sql_code.extract(files.limit(0)).collect() == []


def book(cells, language="python", **more):
    return json.dumps({"metadata": {"kernelspec": {"language": language}} if language else {}, "cells": [{"cell_type": "code", "source": c} | more if not isinstance(c, dict) else c for c in cells]})


def test_notebooks(spark):
    cells = [["import os\n", "%pip install x\n", "def f():\n", "    pass"], {"cell_type": "markdown", "source": "# no"}, "!ls\ndef g():\n    f()\n", ["%sql\n", "select * from t"], "%md\ntext", "%scala x\nval y = 1", "%r\nx <- 1\n", "", "  %time\n", "%python \nclass K:\n    def m(self):\n        g()"]
    files = [("a.ipynb", book(cells)), ("julia.ipynb", book(["x = 1"], "julia")), ("bad.ipynb", "{not json"), ("list.ipynb", "[1]"), ("null.ipynb", None), ("default.ipynb", book(["y = 2\n"], None)), ("empty.ipynb", "{}"), ("odd.ipynb", json.dumps({"cells": [1, {"cell_type": "code"}]}))]
    found = notebooks.cells(spark.createDataFrame(files, "path string, content string"))
    got = {(r.cell_index, r.language): r.source for r in found.where("path = 'a.ipynb'").collect()}
    assert got == {(0, "python"): "import os\ndef f():\n    pass", (2, "python"): "def g():\n    f()\n", (3, "sql"): "select * from t", (6, "r"): "x <- 1\n", (9, "python"): "class K:\n    def m(self):\n        g()"}
    assert {r.path for r in found.collect()} == {"a.ipynb", "default.ipynb"}
    made = notebooks.sources(found)
    python = made.where("language = 'python' and path = 'a.ipynb'").first()
    assert python.content == "import os\ndef f():\n    pass\ndef g():\n    f()\nclass K:\n    def m(self):\n        g()\n" and [tuple(s) for s in python.starts] == [(0, 1), (2, 4), (9, 6)]
    rows = python_code.extract(made.where("language = 'python'").select("path", "content"))
    symbols = python_code.symbols(rows).where("kind <> 'File'").select(F.col("file_path").alias("path"), "name", "line_start")
    assert {(r.name, r.cell_index) for r in notebooks.cell_of(symbols, made, "python").collect()} == {("f", 0), ("g", 2), ("K", 9), ("m", 9)}
    sql = sql_code.extract(made.where("language = 'sql'").select("path", "content"))
    assert {(r.file_path, r.target) for r in sql.collect()} == {("a.ipynb", "t")}
