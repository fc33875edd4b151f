"""Generated pages: one text per module, put together from relations, and what a run writes, keeps, refuses or prunes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.text import page_slug
from codelattice.sources.readers import STAMP
from codelattice.sources.storage import cut

# The first line of a generated page, and the marks between and behind its parts.
FIRST_LINE = "<!-- generated documentation — edit the source, not this file -->"
BETWEEN = "  ·  "


def relative_link(path: Column, folder: str) -> Column:
    """The way from a folder to a path, both from the root."""
    parts, out = folder.split("/"), path
    for n in range(len(parts)):  # the longest common folder comes last and wins
        head = "/".join(parts[: n + 1]) + "/"
        out = F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 30)).otherwise(out)
    up = F.lit(0)
    for n in range(len(parts)):
        up = F.when(path.startswith("/".join(parts[: n + 1]) + "/"), n + 1).otherwise(up)
    return F.concat(F.repeat(F.lit("../"), F.lit(len(parts)) - up), out)


def _links(rows: DataFrame, title: str, name: str, target: str, href: Column) -> DataFrame:
    """module, name: a titled list of links, in the order of what they lead to."""
    links = rows.select("module", target, F.concat(F.lit("[`"), target, F.lit("`]("), href, F.lit(")")).alias("link")).distinct()
    listed = F.array_join(F.array_sort(F.collect_list(F.struct(target, "link")))["link"], ", ")
    return links.groupBy("module").agg(F.concat(F.lit(f"**{title}** "), listed).alias(name))


def _names(title: str, names: Column) -> Column:
    """A titled list of names, null if there is none."""
    return F.when(F.size(names) > 0, F.concat(F.lit(f"**{title}** "), F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")))


def render(modules: DataFrame, edges: DataFrame, symbols: DataFrame, mentions: DataFrame, flow: DataFrame, folder: str = "docs/architecture") -> DataFrame:
    """module, page, text of every module of modules (module, doc, origin).

    edges: source, target. symbols: module, name, signature, line, is_member, doc, callers,
    callees, tested (arrays; nulls are empty). mentions: module, page. flow: module, a, b. A page has the
    module's prose or its origin, links to modules and pages, a diagram of its flow in
    order of names, its documented symbols by line, and the names of the others. Edges and
    symbols of modules that modules lacks are left out.
    """
    known = modules.where("module is not null").groupBy("module").agg(F.min("doc").alias("doc"), F.min("origin").alias("origin"))
    slug = F.concat(page_slug(F.col("target")), F.lit(".md"))
    inside = edges.where("source <> target").join(known.select(F.col("module").alias("source")), "source", "left_semi").join(known.select(F.col("module").alias("target")), "target", "left_semi")
    ahead = _links(inside.select(F.col("source").alias("module"), "target"), "depends on", "depends", "target", slug)
    back = _links(inside.select(F.col("target").alias("module"), F.col("source").alias("target")), "used by", "used", "target", slug)
    told = _links(mentions.select("module", F.col("page").alias("target")), "discussed in", "told", "target", relative_link(F.col("target"), folder))
    arrow = F.concat(F.lit("  "), "a", F.lit(" --> "), "b", F.lit("\n"))
    drawn = flow.select("module", "a", "b").distinct().groupBy("module").agg(F.array_join(F.array_sort(F.collect_list(F.struct("a", "b", arrow.alias("line"))))["line"], "").alias("drawn"))
    doc = F.trim(F.regexp_replace(F.coalesce("doc", F.lit("")), r"^\s+|\s+$", ""))
    refs = F.concat_ws(BETWEEN, _names("called by", F.col("callers")), _names("calls", F.col("callees")))
    head = F.concat(F.when(F.col("is_member"), "####").otherwise("###"), F.lit(" `"), F.coalesce("signature", "name"), F.lit("`\n`"), "module", F.lit(":"), F.col("line").cast("string"), F.lit("`\n\n"))
    whole = F.concat(head, doc, F.when(refs != "", F.concat(F.lit("\n\n"), refs)).otherwise(""), F.lit("\n\n"))
    evidence = F.when(F.size("tested") > 0, F.concat(F.lit(" — tested: "), F.array_join("tested", "; "))).otherwise("")
    brief = F.concat(F.lit("- `"), "name", F.lit("`"), evidence, F.lit("\n"))
    place = F.struct("line", "name", F.when(doc != "", whole).otherwise(brief).alias("text"))
    listed = lambda has: F.array_join(F.array_sort(F.collect_list(F.when((doc != "") == has, place)))["text"], "")
    told_of = symbols.groupBy("module").agg(listed(F.lit(True)).alias("api"), listed(F.lit(False)).alias("bare"), F.count(F.when(doc == "", 1)).alias("n_bare"))
    rows = known
    for part in (ahead, back, told, drawn, told_of):
        rows = rows.join(part, "module", "left")
    if_any = lambda c, *parts: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(*parts)).otherwise("")
    links = F.concat_ws(BETWEEN, "depends", "used", "told")
    text = F.concat(
        F.lit(FIRST_LINE + "\n# `"), "module", F.lit("`\n\n"),
        F.when(doc != "", F.concat(doc, F.lit("\n\n"))).when(F.col("origin") != "", F.concat(F.lit('*No module docstring. First commit: "'), "origin", F.lit('".*\n\n'))).otherwise(""),
        F.when(links != "", F.concat(links, F.lit("\n\n"))).otherwise(""),
        if_any("drawn", F.lit("```mermaid\nflowchart TD\n"), "drawn", F.lit("```\n\n")),
        if_any("api", F.lit("## API\n\n"), "api"),
        if_any("bare", F.lit("<details><summary>Undocumented ("), F.col("n_bare").cast("string"), F.lit(")</summary>\n\n"), "bare", F.lit("\n</details>\n\n")),
    )
    # lines are joined, not ended: the last line break is none
    return rows.select("module", F.concat(page_slug(F.col("module")), F.lit(".md")).alias("page"), F.left(text, F.length(text) - 1).alias("text"))


def search_rows(modules: DataFrame, symbols: DataFrame, guides: DataFrame) -> DataFrame:
    """kind, name, context, href of all that a site's search can jump to: the two head pages, guides (title, slug), modules (module) and symbols with words of their own (module, kind, name, doc)."""
    spark = modules.sparkSession
    row = lambda kind, name, context, href: [kind.alias("kind"), name.alias("name"), context.alias("context"), href.alias("href")]
    none = F.lit("")
    heads = spark.createDataFrame([("page", "Overview", "", "index.html"), ("page", "Architecture", "", "architecture.html")], "kind string, name string, context string, href string")
    site = F.concat(page_slug(F.col("module")), F.lit(".html"))
    named = symbols.where(F.trim(F.regexp_replace(F.coalesce("doc", F.lit("")), r"^\s+|\s+$", "")) != "")
    return (
        heads.union(guides.select(*row(F.lit("guide"), F.col("title"), none, F.concat("slug", F.lit(".html")))))
        .union(modules.select("module").distinct().select(*row(F.lit("module"), F.col("module"), none, site)))
        .union(named.select(*row(F.lower("kind"), F.col("name"), F.element_at(F.split("module", "/"), -1), F.concat(site, F.lit("#"), "name"))))
    )


def plan(want: DataFrame, disk: DataFrame) -> DataFrame:
    """page, action, text: what a run does with each wanted page (page, text) and each page on disk (page, text).

    `write`: new or changed; `keep`: the same; `refuse`: not generated, so not ours to
    change; `prune`: generated, and nobody wants it. Pages on disk that are neither
    wanted nor generated are no business of a run and have no row.
    """
    both = want.select("page", F.col("text").alias("new")).join(disk.select("page", F.coalesce("text", F.lit("")).alias("old")), "page", "full")
    ours = F.col("old").startswith(STAMP)
    action = F.when(F.col("new").isNull(), F.when(ours, "prune")).when(F.col("old").isNull(), "write").when(~ours, "refuse").when(F.col("old") == F.col("new"), "keep").otherwise("write")
    return both.select("page", action.alias("action"), F.col("new").alias("text")).where("action is not null")


def apply(planned: DataFrame, root: str) -> DataFrame:
    """page, action of all that was done below root (a URI that all executors reach): pages written and pruned by the tasks that hold them.

    Nothing is done where a page is refused; its rows tell which. Writing again does no harm, so lost tasks may be repeated.
    """
    refused = planned.where("action = 'refuse'").select("page", "action")
    if not refused.isEmpty():
        return refused
    base = root.rstrip("/")

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
        for batch in batches:
            for page, action, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{top}/{page}"
                if action == "write":
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(path) as out:
                        out.write(text.encode())
                elif store.get_file_info(path).type != fs.FileType.NotFound:
                    store.delete_file(path)
            yield batch.select(["page", "action"])

    return cut(planned.where("action in ('write', 'prune')").select("page", "action", "text").mapInArrow(done, "page string, action string"))
