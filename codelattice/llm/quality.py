"""Quality rules with risk-controlled cutoffs, with built-in functions only.

Per stratum, the lowest cutoff of a fixed grid is chosen whose share of falsely
rejected good documents is, by an exact binomial bound on a labelled holdout, at
most `risk`; the error level is divided among all tests of all strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import WORD, materialize, text_or_empty

WINDOW = 8
#: Strata up to which their cutoffs are broadcast.
BROADCAST_STRATA = 100_000
_SYMBOLS = "#*$%&|<>"
#: Cutoffs of the score to try, from the strictest on.
GRID = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and score of each row's whole text.

    A null or empty text has no words and fails. Windows are compared by 64-bit hashes.
    Rows are judged one by one. score: the largest of the shares of symbols among word
    characters, of repeated lines among lines with words, and of repeated words.
    """
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    one = docs.select(*keep, text_or_empty().alias("__text")).select(
        *keep,
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("__words"),
    )
    n = F.size("__words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    two = one.select(
        *keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("__words", i, WINDOW)).alias("h"), i.alias("at")))).alias("__w"),
    )
    rest = F.when(F.size("__w") > 1, F.slice("__w", 2, F.size("__w") - 1)).otherwise(F.slice("__w", 1, 0))
    three = two.select("*", rest.alias("__next"))
    pairs = F.zip_with("__w", "__next", lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
    four = three.select("*", F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))).alias("__at"))

    def step(acc: Column, at: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(WINDOW), at + WINDOW - acc["to"])).cast("bigint").alias("n"), (at + WINDOW).alias("to"))

    covered = F.aggregate("__at", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])
    five = four.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "__n_lines")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return five.select(
        *(c for c in five.columns if c != "__n_lines"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.greatest(share("n_symbols", "word_chars"), share("n_dup_lines", "__n_lines"), share("n_repeat_words", "n_words")).alias("score"),
    )


#: Terms of a tail that are summed one by one; what is left is bounded from above.
TERMS = 512


def log_factorial(n: Column) -> Column:
    """ln(n!) by the series of the gamma function from 9 on, shifted by eight steps."""
    x = n + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    steps = F.log(n + 1.0)
    for i in range(2, 9):
        steps = steps + F.log(n + float(i))
    return series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X with n trials of probability p, for k below n * p (above it: 1).

    Terms shrink from k downwards; beyond the first TERMS a geometric series bounds them
    from above, so the result is never too small, and the work doesn't grow with k.
    """
    log_top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        j = k - i + 1
        term = acc["term"] * (j * (1 - p)) / ((n - j + 1) * p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    def finish(acc: Column) -> Column:
        j = k - TERMS
        ratio = (j * (1 - p)) / ((n - j + 1) * p)
        return acc["total"] + F.when(j > 0, acc["term"] * ratio / (1 - ratio)).otherwise(0.0)

    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1), F.least(k, F.lit(TERMS))), start, step, finish)).otherwise(F.lit(1.0))
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(log_top) * total)).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, *, stratum: str, risk: float = 0.05, error: float = 0.05, grid: tuple[float, ...] = GRID) -> DataFrame:
    """stratum and cutoff: documents that score above it go. Strata without a safe cutoff are left out.

    Good holdout documents are those of quality 1 that pass the base rules. A doc_id
    that labels names more than once counts once, by its largest quality. Null strata
    share the empty name.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("__quality")).where("__quality = 1").select("doc_id")
    held = measured.where("not base_failed").join(good, "doc_id", "left_semi").select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "score")
    tests = held.groupBy("stratum").agg(F.count("*").cast("int").alias("n"), *(F.count(F.when(F.col("score") > c, 1)).cast("int").alias(f"k{i}") for i, c in enumerate(grid)))
    total = tests.agg((F.count("*") * len(grid)).alias("tests"))
    tried = tests.join(F.broadcast(total)).select(
        "stratum", "n", "tests", F.explode(F.array(*(F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, c in enumerate(grid)))).alias("t")
    )
    safe = tried.where(binomial_tail(F.col("t.k"), F.col("n"), risk) <= F.lit(error) / F.col("tests"))
    return safe.groupBy("stratum").agg(F.min("t.cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "source", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, the measures, base_failed, score, cutoff and kept of each row of docs.

    Where a stratum has too few labels for the bound, its cutoff is null and only the
    base rules reject. Empty tables give no rows; empty labels reject nothing more.
    """
    # written once: a filter on a measure would otherwise be pushed down and repeat the measuring inside each lambda
    measured = materialize(measure(docs.select("doc_id", "text", F.col(stratum).alias("__stratum")), ["doc_id", "__stratum"]), "measured")
    found = materialize(cutoffs(measured, labels, stratum="__stratum", risk=risk, error=error), "cutoffs")
    # one row per stratum: sent to all tasks while they are few, so that no stratum's documents gather in one
    found = F.broadcast(found) if found.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA else found
    joined = measured.withColumn("stratum", F.coalesce(F.col("__stratum").cast("string"), F.lit(""))).join(found, "stratum", "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("cutoff").isNull() | (F.col("score") <= F.col("cutoff")))).alias("kept"), "score", "cutoff",
    )
