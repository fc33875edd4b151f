"""Mixing sources to target weights by iterative proportional fitting, with built-in functions only.

Documents are pre-aggregated into cells (source, language, topic); only cells take
part in the fitting, so its cost doesn't grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import WORD, materialize, text_or_empty

DIMENSIONS = ("source", "lang", "topic")


def topic_rule(text: Column) -> Column:
    """A topic by plain rules, the first that holds: legal, web, structured, prose; empty without a word."""
    return (
        F.when(~text.rlike(WORD), "")
        .when(text.rlike("(?i)licen[cs]e|copyright|warrant"), "legal")
        .when(text.rlike("https?://|www\\."), "web")
        .when(20 * F.char_length(F.translate(text, "0123456789#*$%&|<>{}[]=", "")) < 19 * F.char_length(text), "structured")
        .otherwise("prose")
    )


def _described(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        *keep,
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"),
        topic_rule(text).alias("__topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("__tokens"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))), 1, 13), 16, 10).cast("double").alias("__draw"),
    )


def _total(weight: str) -> Column:
    """Sum of weights in millionths, as a decimal: it doesn't depend on the order of rows, so reruns agree."""
    return F.sum((F.col(weight) * 1e6).cast("decimal(38,0)"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, power: float = 0.5, rounds: int = 300, tolerance: float = 1e-9) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`, tokens raked to the target shares of each dimension, and `gap`.

    targets: shares by value for each of source, lang and topic; a value that isn't
    named gets none, and a dimension that isn't named takes shares in proportion to
    its tokens ** power. Cells without tokens get no weight. Fitting goes on until no
    marginal is off by more than tolerance of the total, or the largest gap stops
    shrinking, as it does for targets that can't hold together. gap: that largest gap as
    a share of the total, the same in all rows; it tells whether the targets are met.
    """
    spark = cells.sparkSession
    found = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = float(found.agg(F.sum("tokens")).first()[0] or 0)
    for d in DIMENSIONS:
        shares = cells.groupBy(d).agg(F.sum("tokens").alias("__t"))
        if targets and d in targets:
            named = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()] or [("", 0.0)], f"{d} string, __share double")
            shares = shares.join(named, d, "left").select(d, F.coalesce("__share", F.lit(0.0)).alias("__share"))
        else:
            shares = shares.select(d, F.when(F.col("__t") > 0, F.pow("__t", F.lit(power))).otherwise(0.0).alias("__share"))
        scale = float(shares.agg(_total("__share")).first()[0] or 1e6) / 1e6
        found = found.join(shares.select(d, (F.col("__share") * (total / scale)).alias(f"__want_{d}")), d)
    found = materialize(found, "cells")
    now = lambda d: _total("weight").over(Window.partitionBy(d)).cast("double") / 1e6
    gap, last = 0.0, float("inf")
    for r in range(1, rounds + 1):
        for d in DIMENSIONS:
            found = found.withColumn("__now", now(d)).withColumn("weight", F.when(F.col("__now") > 0, F.col("weight") * F.col(f"__want_{d}") / F.col("__now")).otherwise(0.0)).drop("__now")
        if r % 3 == 0 or r == rounds:
            found = materialize(found, "cells")
            off = [F.max(F.abs(F.col(f"__now_{d}") - F.col(f"__want_{d}"))) for d in DIMENSIONS]
            seen = found.select("*", *(now(d).alias(f"__now_{d}") for d in DIMENSIONS))
            gap = (seen.agg(F.greatest(*off)).first()[0] or 0.0) / max(total, 1.0)
            if gap <= tolerance or gap > 0.999 * last:
                break
            last = gap
    return found.select(*DIMENSIONS, "tokens", "weight", F.lit(float(gap)).alias("gap"))


def calibrate(weighted: DataFrame, rate: float) -> DataFrame:
    """weighted with `probability` = min(1, scale * weight / tokens), so that rate of all tokens is expected to stay.

    One row of sums reaches the driver per step; each step adds cells that are kept whole.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    rated = materialize(weighted.withColumn("__ratio", ratio), "weights")
    budget = rate * (rated.agg(F.sum("tokens")).first()[0] or 0)
    scale, n_whole = 0.0, -1
    while True:
        whole = F.col("__ratio") * scale >= 1.0
        n, full, rest = rated.withColumn("__rest", F.when(~whole, F.col("weight")).otherwise(0.0)).agg(F.count(F.when(whole, 1)), F.sum(F.when(whole, F.col("tokens")).otherwise(0)), _total("__rest")).first()
        rest = float(rest or 0) / 1e6
        if n == n_whole or not rest:
            break
        n_whole, scale = n, max(scale, (budget - full) / rest)
    return rated.withColumn("probability", F.least(F.lit(1.0), F.col("__ratio") * scale)).drop("__ratio")


def _drawn(described: DataFrame, counted: DataFrame, targets, rate: float, power: float) -> DataFrame:
    """described rows with their cell's probability and gap, and whether they are drawn; counted: tokens per cell of all rows."""
    cells = calibrate(rake(materialize(counted, "counted"), targets, power=power), rate)
    fitted = materialize(cells, "fitted").select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), F.col("probability").alias("__probability"), F.col("gap").alias("__gap"))
    # the draw depends on the id alone
    return described.join(fitted, [f"__{d}" for d in DIMENSIONS]).withColumn("__kept", F.col("__draw") < F.col("__probability") * float(1 << 52))


def _counted(described: DataFrame) -> DataFrame:
    names = {f"__{d}": d for d in DIMENSIONS}
    return described.groupBy(*names).agg(F.sum("__tokens").alias("tokens")).withColumnsRenamed(names)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, rate: float = 0.5, power: float = 0.5) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept and gap (see rake) of each row of docs.

    Null source and lang count as the empty name, null text as empty. A text without
    words has probability 0. The draw is fixed by doc_id (by the text where that is
    null), so repeated rows are drawn alike and a rerun draws the same rows. An empty
    table gives no rows.
    """
    described = materialize(_described(docs.select("doc_id", "source", "lang", "text"), ["doc_id"]), "described")
    drawn = _drawn(described, _counted(described), targets, rate, power)
    names = {"doc_id": "doc_id", **{f"__{d}": d for d in DIMENSIONS}, "__tokens": "n_tokens", "__probability": "probability", "__kept": "kept", "__gap": "gap"}
    return drawn.select(*(F.col(a).alias(b) for a, b in names.items()))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, rate: float = 0.5, power: float = 0.5) -> DataFrame:
    """The drawn rows of docs, with their own columns, whatever their names."""
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row"), *(docs[c] for c in ("doc_id", "source", "lang", "text")))
    drawn = _drawn(_described(row, ["__row"]), _counted(_described(row, [])), targets, rate, power)
    return drawn.where("__kept").select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
