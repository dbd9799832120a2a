"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Each rule rejects texts whose measure lies above a cutoff.  Texts labelled as good are the holdout: in each stratum, a
rule's cutoffs are tried from the loosest to the strictest, and a cutoff is certified while the chance of seeing so few
rejected good texts, were the true rate of false rejection at its limit, is small enough (an exact binomial test).  The
tries of one rule in one stratum form a fixed sequence that ends at the first failure, so they need no further correction;
strata and rules share the error, and the limit, in equal parts (Bonferroni).  A stratum without enough labels has no
cutoffs and rejects nothing.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.storage import written

GAP = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
WINDOW = 5

#: Measure: its cutoffs, from the loosest to the strictest.  A text above the cutoff is rejected.
CUTOFFS: dict[str, list[float]] = {
    "symbol_ratio": [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1],
    "dup_line_ratio": [0.9, 0.75, 0.6, 0.5, 0.4, 0.3],
    "repeat_ratio": [0.15, 0.1, 0.08],
    "upper_ratio": [0.9, 0.75, 0.6, 0.5, 0.4, 0.3],
    "mean_word_chars": [40.0, 30.0, 20.0, 15.0, 12.0],
}


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in a window of five that the text holds twice or more.

    Windows are told apart by 64-bit hashes.  To bring equal ones together, hashes are sorted with their low bits replaced
    by the window's place; neighbours are then compared as wholes.  A text whose windows all differ skips this.
    """
    marks = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("marks", marks)
    last = F.size("marks") - WINDOW

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("marks", i + n) for n in range(WINDOW)])

    windows = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)
    )
    rows = rows.withColumn("windows", windows)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("windows", F.when(repeats, F.col("windows")))
    bits = F.ceil(F.log2(F.size("windows") + 1.0)).cast("int")
    rows = rows.withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)

    def placed(x: Column, i: Column) -> Column:
        return x.bitwiseAND(F.bitwise_not(F.col("mask"))).bitwiseOR(i.cast("long"))

    rows = rows.withColumn("sorted", F.sort_array(F.transform("windows", placed)))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.col("mask")).cast("int")

    rows = rows.withColumn("order", F.transform("sorted", place))

    def start(p: Column, j: Column) -> Column:
        own, before, after = (F.get("windows", x) for x in (p, F.get("order", j - 1), F.get("order", j + 1)))
        return F.when(F.coalesce(own == before, F.lit(False)) | F.coalesce(own == after, F.lit(False)), p)

    rows = rows.withColumn("starts", F.sort_array(F.filter(F.transform("order", start), lambda p: p.isNotNull())))
    covered = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def measures(documents: DataFrame, stratum: str = "lang") -> DataFrame:
    """Word counts of every row of ``documents(doc_id, text)``, the base rule, and the measures of ``CUTOFFS``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id",
        "stratum",
        F.filter(F.split("text", GAP, -1), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        lines.alias("lines"),
    )
    n_lines = F.size("lines").cast("long")
    rows = rows.withColumn("n_lines", n_lines).withColumn("n_dup_lines", n_lines - F.size(F.array_distinct("lines")))
    rows = _with_repeats(rows.drop("lines")).withColumn("n_words", F.size("words").cast("long"))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = ("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        *counts,
        base.alias("base_failed"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
    )


def _log_factorial(n: Column) -> Column:
    """By Stirling's series at n + 9, less the factors that this adds."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - reduce(lambda a, b: a + b, [F.log(n + float(i)) for i in range(1, 9)])


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """The chance of ``k`` or fewer hits in ``n`` tries; 1 where ``k`` is at or above the mean.

    Terms are summed downwards from ``k``, each from the one before, until they vanish beside the first.
    """
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    steps = F.least(k, F.ceil(60 * F.sqrt(n * rate)) + 200).cast("int")

    def step(state: Column, j: Column) -> Column:
        i = k - j + 1
        term = state["term"] * i * (1 - rate) / ((n - i + 1) * rate)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    added = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, step)
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(first) * added["sum"])


def certified(good: DataFrame, limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """``(stratum, measure, cutoff)``: the strictest certified cutoff of each rule in each stratum that has one.

    With probability ``1 - error``, the rules together reject at most ``limit`` of the good texts of any stratum.
    """
    tries = [(m, n, c) for m, cutoffs in CUTOFFS.items() for n, c in enumerate(cutoffs)]
    over = [F.count_if(F.col(m) > c).alias(f"{m}_{n}") for m, n, c in tries]
    counts = written(good.groupBy("stratum").agg(F.count("*").alias("n"), *over), "strata")
    share = error / (max(1, counts.count()) * len(CUTOFFS))
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.lit(n).alias("place"), F.lit(c).alias("cutoff"), F.col(f"{m}_{n}").alias("k"))
            for m, n, c in tries
        ]
    )
    rows = counts.select("stratum", "n", F.inline(cells))
    passed = rows.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), limit / len(CUTOFFS)) <= share)
    tried = F.min(F.when(~F.col("passed"), F.col("place"))).alias("failed_at")
    ends = passed.groupBy("stratum", "measure").agg(tried, F.max("place").alias("last"))
    best = F.coalesce(F.col("failed_at") - 1, F.col("last"))
    ends = ends.select(F.col("stratum").alias("s"), F.col("measure").alias("m"), best.alias("best"))
    same = F.col("stratum").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m")) & (F.col("place") == F.col("best"))
    return passed.join(ends, same).select("stratum", "measure", "cutoff")


def judge(
    documents: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.02, error: float = 0.05
) -> DataFrame:
    """The base counts of every row, ``base_failed`` and ``kept``.

    ``labels(doc_id, quality)`` marks good texts with 1; an id that is labelled twice is good if either label is.  A null
    text has no words and fails the base rule; a null stratum is a stratum of its own; rows with a null or repeated
    doc_id stay, each judged by itself.  Other columns are ignored; an empty table gives an empty one.
    """
    rows = written(measures(documents, stratum), "measures")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long")).distinct()
    cutoffs = certified(rows.join(good, "doc_id"), limit, error)
    by_stratum = cutoffs.groupBy(F.col("stratum").alias("s")).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"{m}_cutoff") for m in CUTOFFS]
    )
    joined = rows.join(written(by_stratum, "cutoffs"), F.col("stratum").eqNullSafe(F.col("s")), "left")
    rejected = reduce(
        lambda a, b: a | b, [F.coalesce(F.col(m) > F.col(f"{m}_cutoff"), F.lit(False)) for m in CUTOFFS], F.col("base_failed")
    )
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return joined.select(*counts, (~rejected).alias("kept"))
