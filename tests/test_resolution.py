"""Resolution of packages, includes, modules, exports, scopes and injected fields, each against a plain reading of its rules."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from codelattice.functions import text as texts
from codelattice.operators import resolution
from codelattice.sources import java_code


def frame(spark, columns, rows):
    kinds = {"ord": "int", "is_interface": "boolean"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns.split()))


def test_paths(spark):
    paths = ["a/./b//c", "a/../b", "../../x", "a/b/../../..", "/../a", "", ".", "/", "a/b/c.h", "./a", "a/.."]
    got = frame(spark, "p", [(p,) for p in paths]).select("p", texts.normpath(F.col("p")).alias("n"), texts.ancestors(F.col("p")).alias("up"), texts.tails(F.col("p")).alias("tails")).collect()
    assert [r.n for r in got] == [posixpath.normpath(p) for p in paths]
    assert got[8].up == ["a/b", "a", ""] and got[8].tails == ["a/b/c.h", "b/c.h", "c.h"]


def plain_include(source, target, owned):
    at = posixpath.dirname(source)
    if "/" in target:
        near = posixpath.normpath(f"{at}/{target}") if at else target
        if near in owned:
            return near
        if target in owned:
            return target
        hits = [f for f in owned if f.endswith("/" + target)]
        return hits[0] if len(hits) == 1 else None
    near = f"{at}/{target}" if at else target
    if near in owned:
        return near
    hits = [f for f in owned if posixpath.basename(f) == target]
    below = [f for f in hits if at and f.startswith(at + "/")]
    if len(below) == 1:
        return below[0]
    return hits[0] if len(hits) == 1 and (not at or hits[0].split("/")[0] == source.split("/")[0]) else None


def test_includes(spark):
    rng = random.Random(5)
    owned = {"/".join([*rng.choices(["src", "lib", "port", "inc"], k=rng.randrange(4)), rng.choice(["a.h", "b.h", "c.c", "d.h", "main.c"])]) for _ in range(60)}
    sources = rng.sample(sorted(owned), 12) + ["main.c", "new/x.c"]
    targets = ["a.h", "b.h", "d.h", "stdio.h", "port/a.h", "../lib/a.h", "inc/../b.h", "./a.h", "src/port/d.h", "lib/inc/b.h", "../../a.h", "", None]
    asked = [(s, t) for s in sources for t in targets]
    got = resolution.resolve_includes(frame(spark, "source target", asked + asked[:9]), frame(spark, "file_path", [(f,) for f in owned] + [(None,)]))
    want = {(s, t): f for s, t in asked if t and (f := plain_include(s, t, owned))}
    assert {(r.source, r.target): r.found for r in got.collect()} == want and len(want) > 20 and got.count() == len(want)


GO = {
    "main.go": 'package main\nimport "example.com/mod/krypto"\nimport "example.com/mod/src"\nimport "example.com/mod/session"\nfunc main() { k := krypto.Derive(1); fmt.Println(k); helper(); store.Open(); x.krypto.Encrypt(2); conn.Read() }',
    "util.go": "package main\nfunc helper() {}",
    "krypto/krypto.go": "package krypto\nfunc Derive() {}\nfunc Encrypt() {}",
    "src/store.go": "package store\nfunc Open() {}",
    "session/session.go": "package session\ntype S struct {}",
    "report/report.go": 'package report\nimport kk "example.com/mod/krypto"\nfunc R() { kk.Encrypt(); twin() }',
    "report/t_a.go": "package report\nfunc twin() {}",
    "report/t_b.go": "package report\nfunc twin() {}",
    "server/server.go": "package server\nfunc Println() {}\nfunc Read() {}",
}


def test_packages(spark):
    symbols = [("main", "main.go"), ("helper", "util.go"), ("Derive", "krypto/krypto.go"), ("Encrypt", "krypto/krypto.go"), ("Open", "src/store.go"), ("R", "report/report.go"), ("twin", "report/t_a.go"), ("twin", "report/t_b.go"), ("Println", "server/server.go"), ("Read", "server/server.go")]
    calls = [("main.go::main", t, "main.go") for t in ("Derive", "Println", "helper", "Open", "Encrypt", "Read", "main", "a.b", "x::y")] + [("report/report.go::R", t, "report/report.go") for t in ("Encrypt", "twin")]
    imports = [("main.go", f"example.com/mod/{p}") for p in ("krypto", "src", "session")] + [("report/report.go", "example.com/mod/krypto"), ("main.go", "fmt"), (None, "x"), ("main.go", None)]
    files = frame(spark, "file_path", [(f,) for f in GO])
    packages = resolution.package_imports(frame(spark, "source target", imports * 2), files)
    assert {(r.source, r.dir) for r in packages.collect()} == {("main.go", "krypto"), ("main.go", "src"), ("main.go", "session"), ("report/report.go", "krypto")}
    called = resolution.package_calls(frame(spark, "name file_path", symbols), frame(spark, "source target file_path", calls), packages, frame(spark, "file_path text", list(GO.items())))
    want = {("main.go", "Derive", "krypto/krypto.go"), ("main.go", "helper", "util.go"), ("main.go", "Open", "src/store.go"), ("main.go", "Encrypt", "krypto/krypto.go"), ("report/report.go", "Encrypt", "krypto/krypto.go"), ("report/report.go", "twin", "report/t_a.go"), ("report/report.go", "twin", "report/t_b.go")}
    assert {(r.file_path, r.target, r.target_file) for r in called.collect()} == want and called.count() == len(want)
    edges = {tuple(r) for r in resolution.package_edges(called, packages, files).collect()}
    assert edges == {(s, f, t) for s, t, f in want} | {("main.go", "session/session.go", None)}


def test_longest_folder_wins(spark):
    files = frame(spark, "file_path", [("mod/krypto/a.go",), ("krypto/b.go",), ("to/b.go",), ("root.go",)])
    got = resolution.package_imports(frame(spark, "source target", [("x.go", "e/mod/krypto"), ("x.go", "krypto"), ("x.go", "e/krypton"), ("x.go", "")]), files)
    assert {(r.target, r.dir) for r in got.collect()} == {("e/mod/krypto", "mod/krypto"), ("krypto", "krypto")}


def test_modules(spark):
    files = ["pkg/core.py", "pkg/sub/__init__.py", "core.py", "web/a.ts", "web/b/index.js", "web/c.vue", "web/c.tsx", "src/com/x/Foo.java", "lib/x.dart", "run/lib.sh", "web/d.js"]
    cases = [
        ("pkg/sub/m.py", "python", "core", "pkg/core.py"), ("pkg/sub/m.py", "python", "pkg.sub", "pkg/sub/__init__.py"), ("m.py", "python", "core", "core.py"), ("m.py", "python", "os", None), ("pkg/x.py", "python", "sub", "pkg/sub/__init__.py"),
        ("web/x.ts", "typescript", "./a", "web/a.ts"), ("web/x.ts", "javascript", "./b", "web/b/index.js"), ("web/x.ts", "tsx", "./c", "web/c.tsx"), ("web/b/y.ts", "vue", "../a.ts", "web/a.ts"), ("web/x.ts", "typescript", "./d.min", "web/d.js"), ("web/x.ts", "typescript", "a", None),
        ("src/com/y/Bar.java", "java", "com.x.Foo", "src/com/x/Foo.java"), ("src/com/y/Bar.java", "java", "com.x.Foo.make", "src/com/x/Foo.java"), ("src/com/y/Bar.java", "java", "com.x.*", None),
        ("lib/main.dart", "dart", "./x", "lib/x.dart"), ("lib/main.dart", "dart", "package:q/x", None), ("run/go.sh", "bash", "./lib.sh", "run/lib.sh"), ("run/go.sh", "bash", "lib.sh", "run/lib.sh"), ("run/go.sh", "cobol", "lib.sh", None), ("run/go.sh", None, "lib.sh", None), ("run/go.sh", "bash", None, None),
    ]
    got = resolution.resolve_modules(frame(spark, "file_path language module", [c[:3] for c in cases] * 2), frame(spark, "file_path", [(f,) for f in files]))
    assert {tuple(r) for r in got.collect()} == {c for c in cases if c[3]} and got.count() == len([c for c in cases if c[3]])


def plain_export(module, name, defined, exports, seen):
    if (module, name) in seen:
        return None
    seen.add((module, name))
    if (module, name) in defined:
        return module, name
    for _, _, kind, exported, original, target in sorted(e for e in exports if e[0] == module):
        if kind == "star":
            if found := plain_export(target, name, defined, exports, seen):
                return found
        elif exported == name:
            return plain_export(target, original, defined, exports, seen) or (target, original) if kind == "named" else (module, original)
    return None


@pytest.mark.parametrize("seed", range(3))
def test_exports(spark, seed):
    """Chains, renames, stars and cycles of them."""
    rng = random.Random(seed)
    modules, names = [f"m{i}" for i in range(7)], ["x", "y", "z"]
    defined = {(rng.choice(modules), rng.choice(names)) for _ in range(5)}
    exports = []
    for m in modules:
        for i in range(rng.randrange(4)):
            kind = rng.choice(["star", "star", "named", "named", "local"])
            exports.append((m, i, kind, "" if kind == "star" else rng.choice(names), "" if kind == "star" else rng.choice(names), "" if kind == "local" else rng.choice(modules)))
    asked = [(m, n) for m in modules for n in names]
    got = resolution.resolve_exports(frame(spark, "module name", asked + asked[:2] + [(None, "x")]), frame(spark, "module name", list(defined)), frame(spark, "module ord kind name original target", exports))
    want = {(m, n, *found) for m, n in asked if (found := plain_export(m, n, defined, exports, set()))}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_scopes(spark):
    files = frame(spark, "file_path is_interface", [("a/Util.res", False), ("a/Util.resi", True), ("Api.resi", True), ("Main.res", False)])
    symbols = frame(spark, "qualified_name", [(q,) for q in ("a/Util.res::parse", "a/Util.res::Sub.run", "Api.resi::get", "Api.resi::parse", "Api.resi::first")])
    opens = frame(spark, "file_path ord module", [("Main.res", 1, "Util.Sub"), ("Main.res", 0, "Api")])
    calls = [("Main.res", t) for t in ("Util.parse", "Util.Sub.run", "Util.Sub.run.x", "Util.parse.resp", "Nope.f", "parse", "get", "none", "Api.first", "q::done", "Util.zip")] + [("Other.res", "parse")]
    got = {(r.file_path, r.target): r.found for r in resolution.resolve_scoped(frame(spark, "file_path target", calls), files, opens, symbols).collect()}
    assert got == dict.fromkeys(calls) | {
        ("Main.res", "Util.parse"): "a/Util.res::parse", ("Main.res", "Util.Sub.run"): "a/Util.res::Sub.run", ("Main.res", "Util.Sub.run.x"): "a/Util.res::Sub.run", ("Main.res", "Util.parse.resp"): "a/Util.res::parse",
        ("Main.res", "parse"): "Api.resi::parse", ("Main.res", "get"): "Api.resi::get", ("Main.res", "Api.first"): "Api.resi::first",
    }


JAVA = '''package p; // class Fake {
import x.Y;
@Service("a{b") @RequiredArgsConstructor
public class Order<T extends Base<T>> extends Parent<T> implements Runnable, Comparable<Order> {
    @Autowired(required = false) private PriceService prices;
    private final List<Mailer> mailers;
    private static final Logger LOG = Logger.get("x;{");
    private BillingActivity billing = make(1, 2);
    int n = 3;
    @Test void run(int a, Map<String, Integer> m) throws E {
        if (a > 0) { prices.total(a); this.prices.skip(); }
        x.y.deep(); helper(); new Thing(1).go(); mailers.send("q(");
        /* ghost(); */ billing.charge();
    }
    public Order(Clock c) { super(c); }
    class Inner { void deep() { prices.inner(); } }
}
@ActivityInterface interface BillingActivity { void charge(); default int two() { return 2; } }
class Wired { @Inject Wired(final PriceService p, List<Mailer> ms) {} Runnable r = () -> { p.run(); }; }
'''


def test_java(spark):
    rows = java_code.extract(frame(spark, "path content", [("O.java", JAVA), ("empty.java", None), ("broken.java", "} class X { void a( { b(); ")]))
    own = rows.where("file_path = 'O.java'")
    nodes = {(r.kind, r.qualified_name, r.role) for r in java_code.nodes(own).collect()}
    assert nodes == {("Class", f"O.java::{c}", None) for c in ("Order", "Inner", "Wired")} | {("Class", "O.java::BillingActivity", "activity_interface"), ("Test", "O.java::Order.run", None)} | {("Function", f"O.java::{m}", None) for m in ("Order.Order", "Inner.deep", "BillingActivity.charge", "BillingActivity.two", "Wired.Wired")}
    of = lambda kind, *cols: {tuple(r[c] for c in cols) for r in java_code.edges(own, kind).collect()}
    assert of("INHERITS", "source", "target") == {("O.java::Order", t) for t in ("Parent", "Runnable", "Comparable")}
    assert of("INJECTS", "source", "target", "field_name") == {("O.java::Order", "PriceService", "prices"), ("O.java::Order", "List", "mailers"), ("O.java::Wired", "PriceService", "p"), ("O.java::Wired", "List", "ms")}
    assert of("TEMPORAL_STUB", "source", "target", "field_name") == {("O.java::Order", "BillingActivity", "billing")}
    calls = of("CALLS", "source", "receiver", "target", "line")
    assert {c[:3] for c in calls if c[0].endswith(".run")} == {("O.java::Order.run", r, t) for r, t in (("prices", "total"), (None, "skip"), (None, "deep"), (None, "helper"), (None, "go"), ("mailers", "send"), ("billing", "charge"))}
    assert ("O.java::Order.run", "prices", "total", 11) in calls and ("O.java::Inner.deep", "prices", "inner", 16) in calls
    assert rows.where("file_path = 'empty.java'").count() == 0


def test_injection(spark):
    """From Java texts to resolved calls: one implementor, none, two, an unknown field, stubs of interfaces only."""
    files = {
        "A.java": "class A { @Autowired Price price; @Inject Mail mail; @Resource Two two; FooActivity foo; BarWorkflow bar; void go() { price.total(); mail.send(); two.x(); other.y(); foo.act(); bar.act(); price.missing(); bare(); } }",
        "P.java": "interface Price { int total(); } class FastPrice implements Price { public int total() { return 1; } }",
        "M.java": "class Mail { void send() {} }",
        "T.java": "interface Two { void x(); } class One implements Two { public void x() {} } class Other implements Two { public void x() {} }",
        "W.java": "@ActivityInterface interface FooActivity { void act(); } class FooImpl implements FooActivity { public void act() {} } interface BarWorkflow { void act(); }",
    }
    rows = java_code.extract(frame(spark, "path content", list(files.items())))
    nodes, inherits, calls = java_code.nodes(rows), java_code.edges(rows, "INHERITS"), java_code.edges(rows, "CALLS")
    spring = {(r.receiver, r.target): r.found for r in resolution.resolve_injected(calls, java_code.edges(rows, "INJECTS"), nodes, inherits).collect()}
    assert {k: v for k, v in spring.items() if v} == {("price", "total"): "P.java::FastPrice.total", ("price", "missing"): "P.java::FastPrice.missing", ("mail", "send"): "M.java::Mail.send", ("two", "x"): "T.java::Two.x"}
    assert spring[("other", "y")] is None and spring[(None, "bare")] is None
    stubs = resolution.temporal_fields(java_code.edges(rows, "TEMPORAL_STUB"), nodes.select("name", "role"))
    temporal = {(r.receiver, r.target): r.found for r in resolution.resolve_injected(calls, stubs, nodes, inherits).collect()}
    assert {k: v for k, v in temporal.items() if v} == {("foo", "act"): "W.java::FooImpl.act"}


def test_empty(spark):
    e = lambda c: frame(spark, c, [])
    assert resolution.resolve_includes(e("source target"), e("file_path")).collect() == []
    assert resolution.resolve_modules(e("file_path language module"), e("file_path")).collect() == []
    assert resolution.resolve_exports(e("module name"), e("module name"), e("module ord kind name original target")).collect() == []
    assert resolution.package_imports(e("source target"), e("file_path")).collect() == []
