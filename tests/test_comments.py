"""Comments, documentation above declarations, module prose and signatures."""

from pyspark.sql import functions as F

from codelattice.sources import comments

GO = """// Copyright 2020 Someone
// All rights reserved.

// Package krypto wraps keys.
// It is small.

package krypto

import "x//y"

// Derive makes a key.
//
// Slowly.
func Derive(a int,
	b string) (int, error) { return 1 /* no doc */ }

// far away

func Lone() {}
var s = "/* no */" // trailing
func After() {}
/* Block doc
 * of two lines
 */
@Attr
#[inline]
func Noted(x []int) {
}
/** One. */
type T struct {}
"""
RUST = "/* outer /* inner */ still */\nfn a() {}\nlet c = '\"'; // quote\nfn life<'a>(x: &'a str) {} // tail\n//! mod\nfn b() {}\n"
SHELL = '#!/bin/bash\n# Build it.\n# ------\n# Twice.\n\nx="# no"; y=a#b\n# Runs.\nrun() { :; }\n'
SQL = "-- Users.\nCREATE TABLE u (a text DEFAULT '-- no');\n/* v /* nested */ end */\nCREATE VIEW v AS SELECT 1;\n"


def files(spark):
    rows = [("k.go", "go", GO), ("r.rs", "rust", RUST), ("b.sh", "bash", SHELL), ("s.sql", "sql", SQL), ("n.go", "go", None), ("e.go", "go", ""), ("x.txt", "prose", "// no"), ("open.c", "c", "/* never\nends"), ("crlf.c", "c", "// a\r\n// b\r\nint f();\r\n")]
    return spark.createDataFrame(rows, "path string, language string, content string")


def line(text, part):
    return text[: text.index(part)].count("\n") + 1


def test_scan(spark):
    found = {(r.path, r.style, r.line_start, r.line_end, r.alone, r.text) for r in comments.comments(files(spark)).where("style in ('line', 'block')").collect()}
    assert {f for f in found if f[0] == "r.rs"} == {("r.rs", "block", 1, 1, True, "outer /* inner */ still"), ("r.rs", "line", 3, 3, False, "quote"), ("r.rs", "line", 4, 4, False, "tail"), ("r.rs", "line", 5, 5, True, "mod")}
    assert {f[2:] for f in found if f[0] == "b.sh"} == {(2, 2, True, "Build it."), (3, 3, True, ""), (4, 4, True, "Twice."), (7, 7, True, "Runs.")}
    assert {f[1:] for f in found if f[0] == "s.sql"} == {("line", 1, 1, True, "Users."), ("block", 3, 3, True, "v /* nested */ end")}
    assert {f[5] for f in found if f[0] == "k.go" and not f[4]} == {"no doc", "trailing"}
    assert {f for f in found if f[0] in ("n.go", "e.go", "x.txt")} == set() and ("open.c", "block", 1, 2, True, "never\nends") in found


def test_documentation(spark):
    found = comments.comments(files(spark)).cache()
    at = [("k.go", n, line(GO, f"func {n}")) for n in ("Derive", "Lone", "After", "Noted")] + [("k.go", "T", line(GO, "type T")), ("b.sh", "run", 8), ("r.rs", "a", 2), ("r.rs", "b", 6), ("s.sql", "u", 2), ("s.sql", "v", 4), ("crlf.c", "f", 3)]
    symbols = spark.createDataFrame(at, "path string, qualified_name string, line_start int")
    docs = {(r.path, r.qualified_name): r.doc for r in comments.doc_above(symbols, found).collect()}
    assert docs == {
        ("k.go", "Derive"): "Derive makes a key.\nSlowly.", ("k.go", "Lone"): None, ("k.go", "After"): None, ("k.go", "Noted"): "Block doc\nof two lines", ("k.go", "T"): "One.",
        ("b.sh", "run"): "Runs.", ("r.rs", "a"): "outer /* inner */ still", ("r.rs", "b"): "mod", ("s.sql", "u"): "Users.", ("s.sql", "v"): "v /* nested */ end", ("crlf.c", "f"): "a\nb",
    }
    prose = {r.path: r.doc for r in comments.module_doc(found, symbols).collect()}
    assert prose == {"k.go": "Package krypto wraps keys.\nIt is small.", "b.sh": "Build it.\nTwice.", "open.c": "never\nends"}
    assert {r.path for r in comments.module_doc(found, symbols.limit(0)).collect()} == {"k.go", "b.sh", "open.c", "r.rs", "s.sql", "crlf.c"}
    signed = {r.qualified_name: r.signature for r in comments.signatures(symbols, files(spark)).where(F.col("path") != "s.sql").collect()}
    assert signed["Derive"] == "func Derive(a int, b string) (int, error)" and signed["Noted"] == "func Noted(x []int)" and signed["T"] == "type T struct" and signed["f"] == "int f()"
    assert comments.signature(["f(", "  a,", "  b,", ")"], 0) == "f(a, b)" and comments.signature([], 0) is None and comments.signature(["@A", "x = 1;"], 0) == "x = 1"
