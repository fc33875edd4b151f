"""Targets of imports, includes, calls and exports, resolved by joins on candidates.

Each ladder of rules becomes candidate keys with a rank, joined by equality with what
exists; the least rank that meets something wins. Rules that want exactly one candidate
join with keys that only one file has, so no name shared by many files makes pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import ancestors, folder, normpath, tails
from codelattice.sources.storage import cut

#: Suffixes that a module path of these languages is tried with, in order.
SCRIPT_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".vue"]
SCRIPTS = ["javascript", "typescript", "tsx", "vue"]


def package_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """source, target, dir: for each distinct import (source, target) the longest folder of files (file_path) that its path ends with, in whole parts.

    Imports that end with no folder, null ones and the root folder have no row.
    """
    dirs = files.select(folder(F.col("file_path")).alias("dir")).where("dir <> ''").distinct()
    asked = imports.where("source is not null and target is not null").select("source", "target").distinct()
    met = asked.select("source", "target", F.explode(tails(F.col("target"))).alias("dir")).join(dirs, "dir")
    return met.groupBy("source", "target").agg(F.max_by("dir", F.length("dir")).alias("dir"))


#: A call as it stands in a source: a dotted prefix, or none where neither a dot nor a letter stands before the name.
_CALL = r"(?:\b(\w+)\.|(?<![.\w]))(\w+)\s*\("
_ALIAS = r'(\w+)\s+"([^"\n]*)"'


def _pairs(text: Column, pattern: str) -> Column:
    """Both groups of each match, as an array of structs."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))


def package_calls(symbols: DataFrame, calls: DataFrame, packages: DataFrame, texts: DataFrame) -> DataFrame:
    """source, target, file_path, target_file: bare calls that a package's file is literally called by.

    symbols (name, file_path) and texts (file_path, text) of the language; calls (source,
    target, file_path) of which those without dots and `::` count; packages as
    package_imports gives them, by file. A call of a name that its own file defines is
    left alone. The name must be defined in the caller's folder, and called without a
    dot, or in a folder that the file imports, and called behind the package's declared
    name or an alias of the import. Several folders that fit give nothing; several files
    of one folder (variants of one implementation) all count.
    """
    owners = symbols.select(F.col("name").alias("target"), F.col("file_path").alias("target_file")).distinct().withColumn("dir", folder(F.col("target_file")))
    asked = calls.where("not contains(target, '::') and not contains(target, '.') and target <> ''").select("source", "target", "file_path").distinct()
    asked = asked.join(texts.select("file_path"), "file_path", "left_semi").join(symbols.select(F.col("name").alias("target"), "file_path"), ["target", "file_path"], "left_anti")
    said = texts.select("file_path", F.explode(_pairs(F.col("text"), _CALL)).alias("m")).select("file_path", F.coalesce("m.a", F.lit("")).alias("prefix"), F.col("m.b").alias("target")).distinct()
    first = texts.groupBy(folder(F.col("file_path")).alias("dir")).agg(F.min_by("text", "file_path").alias("text"))
    named = first.select("dir", F.regexp_extract("text", r"(?m)^package\s+(\w+)", 1).alias("prefix"))
    last = F.element_at(F.split("dir", "/"), -1)
    named = named.select("dir", F.when(F.col("prefix") == "", last).otherwise(F.col("prefix")).alias("prefix"))
    through = packages.select(F.col("source").alias("file_path"), "dir").distinct()
    alias = texts.select("file_path", F.explode(_pairs(F.col("text"), _ALIAS)).alias("m")).select("file_path", F.col("m.a").alias("prefix"), F.element_at(F.split("m.b", "/"), -1).alias("last"), F.col("m.b").contains("/").alias("deep"))
    aliases = through.withColumn("last", last).join(alias.where("deep"), ["file_path", "last"]).select("file_path", "dir", "prefix")
    own = texts.select("file_path", folder(F.col("file_path")).alias("dir"), F.lit("").alias("prefix"))
    ways = own.union(through.join(own.select("file_path", "dir"), ["file_path", "dir"], "left_anti").join(named, "dir").select("file_path", "dir", "prefix")).union(aliases).distinct()
    spoken = cut(said.join(ways, ["file_path", "prefix"]).select("file_path", "target", "dir").distinct())
    met = asked.join(spoken, ["file_path", "target"]).join(owners, ["target", "dir"]).where("target_file <> file_path")
    one = met.groupBy("source", "target", "file_path").agg(F.countDistinct("dir").alias("n_dirs"), F.collect_set("target_file").alias("files"))
    return one.where("n_dirs = 1").select("source", "target", "file_path", F.explode("files").alias("target_file"))


def package_edges(called: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """source, target, symbol: modules that call each other, and those that import a folder of one file that they never call (null symbol)."""
    edges = called.select(F.col("file_path").alias("source"), F.col("target_file").alias("target"), F.col("target").alias("symbol")).distinct()
    single = files.select("file_path").distinct().groupBy(folder(F.col("file_path")).alias("dir")).agg(F.count("*").alias("n"), F.min("file_path").alias("target")).where("n = 1")
    silent = packages.select("source", "dir").distinct().join(single, "dir").where("source <> target").select("source", "target")
    silent = silent.join(edges.select("source", "target"), ["source", "target"], "left_anti")
    return edges.union(silent.select("source", "target", F.lit(None).cast("string")))


def _alone(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that exactly one file has, with that file."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("file_path").alias("found")).where("n = 1").drop("n")


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """source, target, found, rung: each distinct include (source, target) that a file of files (file_path) answers.

    A target with folders is looked for beside its includer (1), from the root (2), and as
    the only path that ends with it (3). A bare one is the includer's sibling (1), the only
    file of that name below the includer's folder (2), or the only one of all, if it lies
    in the includer's top folder or the includer in none (3). Rungs that meet several
    files give way to the next. Null and empty targets, and what nothing answers, have no row.
    """
    owned = cut(files.where("file_path is not null").select("file_path").distinct())
    asked = includes.where("source is not null and target <> ''").select("source", "target").distinct()
    asked = cut(asked.select("source", "target", folder(F.col("source")).alias("at"), F.col("target").contains("/").alias("deep")))
    beside = F.when(F.col("at") == "", F.col("target")).otherwise(F.concat("at", F.lit("/"), "target"))
    beside = F.when(F.col("deep") & (F.col("at") != ""), normpath(beside)).otherwise(beside)
    exact = asked.select("source", "target", F.posexplode(F.when(F.col("deep"), F.array(beside, "target")).otherwise(F.array(beside))).alias("rung", "file_path"))
    hits = exact.join(owned, "file_path").select("source", "target", F.col("file_path").alias("found"), (F.col("rung") + 1).alias("rung"))
    # a path that ends with `/target`; the whole path is rung 2
    by_tail = _alone(owned.select("file_path", F.explode(F.slice(tails(F.col("file_path")), F.lit(2), F.lit(1 << 30))).alias("target")).where("contains(target, '/')"), "target")
    hits = hits.union(asked.where("deep").join(by_tail, "target").select("source", "target", "found", F.lit(3)))
    base = F.element_at(F.split("file_path", "/"), -1).alias("target")
    below = _alone(owned.select("file_path", base, F.explode(ancestors(F.col("file_path"))).alias("at")).where("at <> ''"), "at", "target")
    hits = hits.union(asked.where("not deep").join(below, ["at", "target"]).select("source", "target", "found", F.lit(2)))
    top = lambda c: F.substring_index(c, "/", 1)
    lone = asked.where("not deep").join(_alone(owned.select("file_path", base), "target"), "target").where((F.col("at") == "") | (top("found") == top("source")))
    hits = hits.union(lone.select("source", "target", "found", F.lit(3)))
    return hits.groupBy("source", "target").agg(F.min_by("found", "rung").alias("found"), F.min("rung").alias("rung"))


def _joined(at: Column, rest: Column) -> Column:
    return normpath(F.when(at == "", rest).otherwise(F.concat_ws("/", at, rest)))


def module_candidates(language: Column, module: Column, file_path: Column) -> Column:
    """The paths that an import may mean, best first, from its language, its text and the file it stands in.

    Python and Java look in every folder above the file, nearest first (Java again without
    the last name, for static members; not for `.*`); scripts and Dart take relative paths
    with the suffixes they may leave out; shells and Nix a path from the file's folder.
    """
    above, at = ancestors(file_path), folder(file_path)
    up = lambda *rest: F.flatten(F.transform(above, lambda d: F.array(*(_joined(d, r) for r in rest))))
    slashed = F.replace(module, F.lit("."), F.lit("/"))
    python = up(F.concat(slashed, F.lit(".py")), F.concat(slashed, F.lit("/__init__.py")))
    outer = F.regexp_extract(module, r"^(.+)\.[^.]*$", 1)
    java = F.when(module.endswith(".*"), F.array().cast("array<string>")).otherwise(
        F.concat(up(F.concat(slashed, F.lit(".java"))), F.when(outer != "", up(F.concat(F.replace(outer, F.lit("."), F.lit("/")), F.lit(".java")))).otherwise(F.array().cast("array<string>")))
    )
    base = _joined(at, module)
    bare = F.regexp_replace(base, r"(?<=[^/])\.[^./]+$", "")
    with_suffix = [F.concat(bare, F.lit(x)) for x in SCRIPT_SUFFIXES]
    index = [F.concat(base, F.lit(f"/index{x}")) for x in SCRIPT_SUFFIXES]
    near = module.startswith(".")
    none = F.array().cast("array<string>")
    return (
        F.when(language == "python", python)
        .when(language == "java", java)
        .when(language.isin(SCRIPTS) & near, F.array(base, *with_suffix, *index))
        .when((language == "dart") & near, F.array(base, F.concat(bare, F.lit(".dart"))))
        .when(language.isin("bash", "nix"), F.array(base))
        .otherwise(none)
    )


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, language, module, found: each distinct import that one of files (file_path) answers, by the first candidate that exists."""
    asked = imports.where("file_path is not null and module <> ''").select("file_path", "language", "module").distinct()
    tried = asked.select("*", F.posexplode(module_candidates(F.col("language"), F.col("module"), F.col("file_path"))).alias("rank", "found"))
    known = files.select(F.col("file_path").alias("found")).distinct()
    return tried.join(known, "found").groupBy("file_path", "language", "module").agg(F.min_by("found", "rank").alias("found"))


def resolve_exports(asked: DataFrame, defined: DataFrame, exports: DataFrame) -> DataFrame:
    """module, name, found_module, found_name: where each asked (module, name) is really defined, through re-exports and barrels.

    exports (module, ord, kind, name, original, target): `named` re-exports original of
    target as name, `star` everything of target, `local` renames original of the module
    itself. A module that defines (defined: module, name) the name ends the search. Else its
    exports are tried in order: stars as far as they lead to something, up to the first
    export of that name, which leads on or, if nothing defines it there, names its target.
    What was tried before in a search isn't tried again, so cycles end. Names that lead
    nowhere have no row.

    Every search is a row with its own stack of what to try next, and all take a step
    together: two joins by the top of the stack. The number of steps is that of the
    longest search.
    """
    first = exports.where("kind <> 'star'").groupBy("module", "name").agg(F.min("ord").alias("end"))
    named = exports.where("kind <> 'star'").join(first, ["module", "name"]).where("ord = end")
    # what a named export leads to, then, if that fails, its answer
    step = lambda module, name, done: F.struct(module.cast("string").alias("module"), name.cast("string").alias("name"), F.lit(done).alias("done"))
    onward = F.when(F.col("kind") == "named", F.array(step(F.col("target"), F.col("original"), False), step(F.col("target"), F.col("original"), True))).otherwise(F.array(step(F.col("module"), F.col("original"), True)))
    named = cut(named.groupBy("module", "name").agg(F.min("end").alias("end"), F.min_by(onward, "original").alias("then")))
    stars = cut(exports.where("kind = 'star'").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("ord", "target"))).alias("stars")))
    ends = cut(defined.select("module", "name").distinct().withColumn("here", F.lit(True)))
    start = asked.where("module is not null and name is not null").select("module", "name").distinct()
    live = cut(start.select(F.col("module").alias("m0"), F.col("name").alias("n0"), F.array(step(F.col("module"), F.col("name"), False)).alias("stack"), F.array().cast("array<struct<module:string,name:string>>").alias("seen")))
    found = None
    while not live.isEmpty():
        top = live.withColumn("top", F.element_at("stack", 1)).withColumn("rest", F.slice("stack", F.lit(2), F.lit(1 << 30)))
        top = top.withColumn("pair", F.struct("top.module", "top.name")).withColumn("again", F.array_contains("seen", F.col("pair")) & ~F.col("top.done"))
        keyed = top.select("*", F.col("top.module").alias("module"), F.col("top.name").alias("name"))
        met = keyed.join(ends, ["module", "name"], "left").join(named, ["module", "name"], "left").join(stars, "module", "left")
        done = F.col("top.done") | (F.coalesce("here", F.lit(False)) & ~F.col("again"))
        fits = F.filter(F.coalesce("stars", F.array().cast("array<struct<ord:int,target:string>>")), lambda s: F.col("end").isNull() | (s["ord"] < F.col("end")))
        more = F.concat(F.transform(fits, lambda s: step(s["target"], F.col("name"), False)), F.coalesce("then", F.array().cast("array<struct<module:string,name:string,done:boolean>>")))
        state = cut(met.select("m0", "n0", "module", "name", done.alias("done"), F.when(F.col("again"), F.col("rest")).otherwise(F.concat(more, "rest")).alias("stack"), F.concat("seen", F.array("pair")).alias("seen")))
        hits = state.where("done").select(F.col("m0").alias("module"), F.col("n0").alias("name"), F.col("module").alias("found_module"), F.col("name").alias("found_name"))
        found = hits if found is None else found.union(hits)
        live = state.where("not done and size(stack) > 0").select("m0", "n0", "stack", "seen")
    return found if found is not None else start.select("module", "name", F.lit(None).cast("string").alias("found_module"), F.lit(None).cast("string").alias("found_name")).limit(0)


def resolve_scoped(calls: DataFrame, files: DataFrame, opens: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (file_path, target, ...) with `found`: the symbol (symbols: qualified_name) that a dotted or bare target means, or null.

    files (file_path, is_interface): a module is its file's stem, an implementation before
    an interface. A dotted target is looked for in the module of its first part, whole, then
    with parts peeled from the right; a bare one in the modules that the file opens
    (opens: file_path, ord, module, of which the first part counts), in their order.
    Targets with `::` are left as they are.
    """
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    homes = files.groupBy(stem.alias("module")).agg(F.min_by("file_path", F.struct("is_interface", "file_path")).alias("home"))
    asked = cut(calls.where("not contains(target, '::')").select("file_path", "target").distinct())
    parts = F.split("target", "[.]")
    peeled = asked.where("contains(target, '.')").select("file_path", "target", F.element_at(parts, 1).alias("module"), F.posexplode(F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(2), k), "."))).alias("rank", "tail"))
    opened = opens.select("file_path", F.col("ord").alias("rank"), F.substring_index("module", ".", 1).alias("module"))
    bare = asked.where("not contains(target, '.')").join(opened, "file_path").select("file_path", "target", "module", "rank", F.col("target").alias("tail"))
    tried = peeled.unionByName(bare).join(homes, "module").select("file_path", "target", "rank", F.concat("home", F.lit("::"), "tail").alias("found"))
    known = symbols.select(F.col("qualified_name").alias("found")).distinct()
    best = tried.join(known, "found").groupBy("file_path", "target").agg(F.min_by("found", "rank").alias("found"))
    return calls.join(best, ["file_path", "target"], "left").select(*calls.columns, "found")


def resolve_injected(calls: DataFrame, fields: DataFrame, nodes: DataFrame, inherits: DataFrame) -> DataFrame:
    """calls (source, target, receiver, ...) with `found`: the method that a call on an injected field means, or null.

    fields (source: the class, field_name, target: the bare type). The field's type stands
    for its only implementing class (inherits: source, target), or else for itself; the
    method of nodes (kind, name, parent_name, qualified_name) with that class's bare name is
    meant, or one is named after the class. Several fields of one name give the smallest
    type, several methods the smallest name. A null receiver resolves to nothing.
    """
    owner = F.when(F.col("source").contains("::"), F.concat(F.substring_index("source", "::", 1), F.lit("::"), F.substring_index(F.split_part("source", F.lit("::"), F.lit(2)), ".", 1)))
    after = F.element_at(F.split("target", "::"), -1)
    method = F.when(F.col("target").contains("::"), F.element_at(F.split(after, "[.]"), -1)).otherwise(F.col("target"))
    typed = fields.where("field_name is not null").groupBy(F.col("source").alias("__class"), F.col("field_name").alias("receiver")).agg(F.min("target").alias("__type"))
    only = inherits.where("contains(source, '::')").groupBy(F.col("target").alias("__type")).agg(F.count("*").alias("n"), F.min("source").alias("__impl")).where("n = 1").drop("n")
    methods = nodes.where("kind in ('Function', 'Test') and parent_name is not null").groupBy(F.col("parent_name").alias("__bare"), F.col("name").alias("__method")).agg(F.min("qualified_name").alias("__known"))
    rows = calls.withColumn("__class", owner).withColumn("__method", method).join(typed, ["__class", "receiver"], "left").join(only, "__type", "left")
    home = F.coalesce("__impl", "__type")
    bare = F.when(F.col("__impl").isNotNull(), F.element_at(F.split("__impl", "::"), -1)).otherwise(F.element_at(F.split("__type", "[.]"), -1))
    rows = rows.withColumn("__bare", bare).join(methods, ["__bare", "__method"], "left")
    return rows.select(*calls.columns, F.coalesce("__known", F.concat(home, F.lit("."), "__method")).alias("found"))


def temporal_fields(stubs: DataFrame, roles: DataFrame) -> DataFrame:
    """Those of the stub fields (source, field_name, target) whose type is a workflow or activity interface (roles: name, role)."""
    return stubs.join(roles.where("role in ('workflow_interface', 'activity_interface')").select(F.col("name").alias("target")).distinct(), "target", "left_semi").select("source", "field_name", "target")
