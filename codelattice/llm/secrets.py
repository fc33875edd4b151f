"""Secret scans: pattern matches with spans, and weak candidates linked to their counterparts.

Matching is a built-in expression over one row. Weak candidates are linked by an
interval join of the spans: only spans of texts that have weak ones are shuffled, by
text and place, and the scope bounds how many meet. No Python takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import materialize, text_or_empty

_KEYWORD = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = _KEYWORD + "[A-Za-z0-9+/_.=-]+"
#: A run that is too short fails as a whole, so the least lengths can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

#: Parts that are reported only when a complementary part stands within the scope.
IDENTIFIER = "(?i:access_?key_?id|client_?id|user_?name|account)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@_.-]{4,}"
OPAQUE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
ENDPOINT = "(?i:https?|postgres|mysql|redis|amqp)://[A-Za-z0-9._:@-]+"

_SPANS = "array<struct<start:bigint,kind_order:int,kind:string,end:bigint>>"


def _spans(text: Column, pattern: str, kind: str, order: int, valid=None) -> Column:
    """Spans (code points, end exclusive) of the leftmost, non-overlapping matches of pattern.

    Each chunk runs from the end of the match before to the end of this one, so that
    the running sum of chunk lengths places the match.
    """
    none = F.array().cast(_SPANS)

    def step(acc: Column, chunk: Column) -> Column:
        found = F.regexp_extract(chunk, f"(?s){pattern}", 0)
        end = acc["at"] + F.char_length(chunk)
        span = F.array(F.struct((end - F.char_length(found)).alias("start"), F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), end.alias("end")))
        kept = F.concat(acc["out"], span)
        return F.struct(end.cast("bigint").alias("at"), (F.when(valid(found), kept).otherwise(acc["out"]) if valid else kept).cast(_SPANS).alias("out"))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s)\\G.*?{pattern}"), F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(chunks, start, step, lambda acc: acc["out"])).otherwise(none)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """digest, linked: the weak spans of parts (digest, span) that have their counterparts within scope code points.

    A span counts as near if it doesn't overlap and the gap is at most scope. Cells of
    scope code points are joined by equality: a part that stands behind by its start,
    one that stands ahead by its end.
    """
    kind = F.col("span.kind")
    role = F.when(kind.isin("identifier", "access"), "name").when(kind.isin("assign", "hex", "opaque"), "value")
    weak = parts.where(kind.isin("identifier", "opaque", "endpoint"))
    cell = lambda c: F.floor(c / F.lit(scope)).cast("long")
    other = parts.select("digest", role.alias("role"), F.col("span.start").alias("o_start"), F.col("span.end").alias("o_end")).where("role is not null")
    behind = weak.select("digest", "span", F.explode(F.array(cell(F.col("span.end")), cell(F.col("span.end")) + 1)).alias("cell"))
    behind = behind.join(other.withColumn("cell", cell(F.col("o_start"))), ["digest", "cell"]).where(f"o_start >= span.end and o_start <= span.end + {scope}")
    ahead = weak.select("digest", "span", F.explode(F.array(cell(F.col("span.start")) - 1, cell(F.col("span.start")))).alias("cell"))
    ahead = ahead.join(other.withColumn("cell", cell(F.col("o_end"))), ["digest", "cell"]).where(f"o_end <= span.start and o_end >= span.start - {scope}")
    met = behind.select("digest", "span", "role").union(ahead.select("digest", "span", "role")).groupBy("digest", "span").agg(F.max(F.col("role") == "name").alias("name"), F.max(F.col("role") == "value").alias("value"))
    held = F.when(kind == "identifier", F.col("value")).when(kind == "opaque", F.col("name")).otherwise(F.col("name") & F.col("value"))
    return met.where(held).groupBy("digest").agg(F.collect_list("span").alias("linked"))


def _found(docs: DataFrame, scope: int, with_text: bool = True) -> DataFrame:
    """row (a struct of docs' columns; with_text: `text` too), assign, access, hex, base, weak and found of each row of docs."""
    kept = [c for c in docs.columns if with_text or c != "text"]
    text = F.col("text")
    long_enough = lambda m: F.char_length(F.regexp_extract(m, f"(?s)^{_KEYWORD}(.*)$", 1)) >= 8
    matched = docs.select(F.struct(*(docs[f"`{c}`"] for c in kept)).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).select(
        "row",
        F.md5("text").alias("digest"),
        _spans(text, ASSIGN, "assign", 0, long_enough).alias("assign"),
        _spans(text, ACCESS, "access", 1).alias("access"),
        _spans(text, HEX, "hex", 2).alias("hex"),
        F.concat(_spans(text, IDENTIFIER, "identifier", 3), _spans(text, OPAQUE, "opaque", 4), _spans(text, ENDPOINT, "endpoint", 5)).alias("maybe"),
    )
    # written once: the matches are needed for the join and for the result
    matched = materialize(matched, "matched")
    open_ = matched.where(F.size("maybe") > 0)
    parts = open_.select("digest", F.explode(F.concat("assign", "access", "hex", "maybe")).alias("span")).distinct()
    linked = open_.join(_linked(parts, scope), "digest", "left").select(*matched.columns, F.coalesce("linked", F.array().cast(_SPANS)).alias("weak"))
    rest = matched.where(F.size("maybe") == 0).select("*", F.array().cast(_SPANS).alias("weak"))
    return rest.unionByName(linked).select("*", F.array_sort(F.concat("assign", "access", "hex")).alias("base")).select("*", F.array_sort(F.concat("base", "weak")).alias("found"))


def scan(docs: DataFrame, *, scope: int = 200, keep: list[str] | None = None) -> DataFrame:
    """The secrets of each row's whole `text`.

    Returns the columns in keep (doc_id by default), n_assign, n_access, n_hex,
    base_sha256, spans, n_linked and found (array of start, kind_order, kind, end; by
    start, then kind). Weak kinds are `identifier`, `opaque` and `endpoint`: an
    identifier is reported near a secret, an opaque string near an identifier or
    access key, an endpoint near both; near means within scope code points.
    A null or empty text has no spans, an empty table gives no rows. Equal texts give
    equal results, so repeated rows do. Columns of docs that aren't in keep are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    wanted = docs.select(*(docs[f"`{c}`"] for c in dict.fromkeys([*keep, "text"])))
    return _found(wanted, scope, with_text="text" in keep).select(
        *(F.col(f"row.`{c}`") for c in keep),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size("weak").cast("long").alias("n_linked"),
        "found",
    )


def redact(docs: DataFrame, *, mask: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """docs with every found span of `text` replaced by mask; overlapping spans share one mask.

    All rows and columns stay, in their order, whatever their names. A null text stays
    null; n_chars, where there is such a column, follows the new text.
    """
    text = F.col("row.text").cast("string")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    tail = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    clean = F.when(F.size("found") == 0, text).otherwise(F.aggregate("found", start, step, tail))
    out = _found(docs, scope).select("row", F.size("found").alias("n_found"), clean.alias("clean"))
    new = {"text": F.col("clean").alias("text")}
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_found") == 0, F.col("row.n_chars")).otherwise(F.char_length("clean").cast(docs.schema["n_chars"].dataType))
        new["n_chars"] = changed.alias("n_chars")
    return out.select(*(new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))
