"""Lookups, predicates and text projections over the code graph and its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mail addresses, IPv4-like strings, home folders.
HYGIENE = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|/home/[a-z]+|/Users/[A-Za-z]+"
CONTROL = r"[\x00-\x08\x0b-\x1f]"


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


def languages(nodes: DataFrame) -> DataFrame:
    """Distinct languages that are neither null nor empty."""
    return nodes.where("language <> ''").select("language").distinct()


def named(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The nodes that `names` (column qualified_name) lists; a batch of point lookups as one semi-join."""
    return nodes.join(names.select("qualified_name"), "qualified_name", "left_semi").select("qualified_name", "kind", "file_path", "line_start", "line_end")


def of_kinds(nodes: DataFrame, kinds: list[str], path_part: str) -> DataFrame:
    """Nodes of the kinds whose path holds path_part, in either case."""
    return nodes.where(F.col("kind").isin(kinds) & F.col("file_path").ilike(f"%{path_part}%")).select("qualified_name", "kind")


def files_matching(nodes: DataFrame, suffix: str) -> DataFrame:
    return nodes.where(F.col("file_path").ilike(f"%{suffix}")).select("file_path").distinct()


def edges_at(edges: DataFrame, nodes: DataFrame, end: str, key: str = "qualified_name") -> DataFrame:
    """Edges whose `end` (source or target) is the `key` of one of nodes; repeated edges stay repeated."""
    return edges.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi").select("source", "target", "line")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    inside = nodes.select("qualified_name").distinct()
    both = edges.join(inside.toDF("source"), "source", "left_semi").join(inside.toDF("target"), "target", "left_semi")
    return both.select("kind", "source", "target", "line")


def skipped(nodes: DataFrame, marker: str) -> DataFrame:
    """Per file: whether the documents' rule (leading slash added) and the resolver's rule (path as it is) leave it out."""
    files = nodes.select("file_path").distinct()
    return files.select("file_path", F.concat(F.lit("/"), "file_path").contains(marker).alias("docs_skip"), F.col("file_path").contains(marker).alias("resolver_skip"))


def any_word(words: list[str], *columns: str) -> Column:
    """One of the words occurs in one of the columns, in either case."""
    pattern = "|".join(words)
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(c).rlike(pattern)
    return found


def hygiene(docs: DataFrame) -> DataFrame:
    """Keys of the documents with personal or local data; never the data itself."""
    return docs.where(F.col("text").rlike(HYGIENE)).select("doc_id")


def sanitize(column: str, most: int = 256) -> Column:
    """Without control characters other than tab and newline, cut to `most` characters: a name, not a text."""
    return F.substring(F.regexp_replace(column, CONTROL, ""), 1, most)


def call_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct targets of edges whose source is unknown or no file."""
    kinds = nodes.select(F.col("qualified_name").alias("source"), F.col("kind").alias("source_kind"))
    return edges.join(kinds, "source", "left").where("source_kind is null or source_kind <> 'File'").select("target").distinct()


def first_callers(calls: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` callers of each target, by name."""
    pairs = calls.where("not is_bare").select("target", "source").distinct()
    order = Window.partitionBy("target").orderBy("source")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def name_search(nodes: DataFrame, words: list[str]) -> DataFrame:
    """Nodes whose name or qualified name holds every word."""
    hit = F.lit(True)
    for w in words:
        hit = hit & (F.lower("name").contains(w) | F.lower("qualified_name").contains(w))
    return nodes.where(hit).select("qualified_name", "kind")


def token_search(nodes: DataFrame, words: list[str]) -> DataFrame:
    """Nodes whose name has every word among its tokens."""
    tokens = nodes.select("qualified_name", F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("token")).where(F.col("token").isin(words))
    return tokens.groupBy("qualified_name").agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(words)).select("qualified_name")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Sixteen hex digits of the text with runs of white space made one space."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+", " ")
    return docs.select("doc_id", F.substring(F.sha2(plain.cast("binary"), 256), 1, 16).alias("fingerprint"))


def token_estimate(docs: DataFrame) -> DataFrame:
    """Per source: a quarter of the characters read, 35 tokens written per document."""
    return docs.groupBy("source").agg(F.expr("sum(char_length(text)) div 4").alias("tokens_in"), (35 * F.count("*")).alias("tokens_out"))


def batches(nodes: DataFrame, size: int = 40) -> DataFrame:
    """Work orders of `size` symbols within each file, in order of names."""
    order = Window.partitionBy("file_path").orderBy("qualified_name")
    return nodes.select("file_path", "qualified_name", F.floor((F.row_number().over(order) - 1) / size).alias("batch"))


def dead_links(pages: DataFrame) -> DataFrame:
    """Links of pages that lead to no page of the site, with how often each stands on its page."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    links = links.withColumn("path", F.regexp_extract("href", "^(?:https?://[^/?#]+)?([^?#]*)", 1))
    site = pages.select(F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path")).distinct()
    return links.join(site, "path", "left_anti").groupBy("page_id", "href").agg(F.count("*").alias("n"))


def edge_dict(edges: DataFrame) -> DataFrame:
    """kind, source, target, file_path, line of edges (kind, source, target, line), ends sanitized; file_path is the file that the source is in."""
    return edges.select("kind", sanitize("source").alias("source"), sanitize("target").alias("target"), F.substring_index("source", "::", 1).alias("file_path"), "line")
