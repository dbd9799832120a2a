"""Scores over a table of grammar findings ``(instance_id, rule_id, issue_type, offset, length, ...)``.

The findings come from an external checker; here they are filtered, weighted and rolled up per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx

# --- fixed values ------------------------------------------------------------------------------------------
SEVERITY_WEIGHTS = {"grammar": 3, "misspelling": 2, "typographical": 1, "style": 1}
OTHER_WEIGHT = 1
SPELLING_RULE = "MORFOLOGIK"
GRAMMAR_DECAY = 2.5
UPPER = r"^[\p{Lu}\p{Lt}]"
# --- end of fixed values -----------------------------------------------------------------------------------

#: Characters of a text that are cut up at a time.
STRETCH = 1 << 13


def issue_weight(issue_type: Column) -> Column:
    kind = F.lower(issue_type)
    out = F.lit(OTHER_WEIGHT)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def flagged_word(text: Column, offset: Column, length: Column) -> Column:
    return F.substring(text, offset + 1, length)


def is_proper_noun(rule_id: Column, text: Column, offset: Column, length: Column) -> Column:
    """A spelling finding on a word that starts with a capital."""
    upper = flagged_word(text, offset, length).rlike(UPPER)
    return rule_id.contains(SPELLING_RULE) & (offset < F.char_length(text)) & (length > 0) & upper


def filter_findings(findings: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Join findings to their texts and mark the proper-noun ones in ``skipped``.

    A text's findings meet it in groups, one for each ``STRETCH`` characters, and a group cuts its stretch into characters
    once.  So no finding carries the text or counts its way through it, and the cost of a text doesn't grow with its square.
    """
    others = [c for c in findings.columns if c not in (key, text)]
    stretch = F.floor(F.col("offset") / STRETCH).alias("_stretch")
    groups = findings.where(F.col(key).isNotNull()).groupBy(key, stretch).agg(F.collect_list(F.struct(*others)).alias("_findings"))
    start = F.col("_stretch") * STRETCH
    joined = groups.join(texts.select(key, F.col(text).alias("_text")), key).withColumn(
        "_letters", F.when(start >= 0, F.split(F.substring("_text", (start + 1).cast("int"), F.lit(STRETCH)), ""))
    )

    def skipped(f: Column) -> Column:
        first = F.get(F.col("_letters"), (f["offset"] - start).cast("int"))
        noun = f["rule_id"].contains(SPELLING_RULE) & (f["length"] > 0) & first.rlike(UPPER)
        counted_back = is_proper_noun(f["rule_id"], F.col("_text"), f["offset"], f["length"])
        return F.coalesce(F.when(start >= 0, noun).when(start < 0, counted_back), F.lit(False))

    marked = F.transform("_findings", lambda f: F.struct(*[f[c].alias(c) for c in others], skipped(f).alias("skipped")))
    return joined.select(key, F.inline(marked))


def grammar_scores(
    findings: DataFrame, texts: DataFrame, key: str, text: str, filter_proper_nouns: bool = True
) -> DataFrame:
    """One row per text: counts, weighted errors, density, decay score and percent score.

    Findings are rolled up before they meet the full text table, so only one small row per text is joined.
    """
    marked = filter_findings(findings, texts, key, text) if filter_proper_nouns else findings.withColumn(
        "skipped", F.lit(False)
    )
    kept = ~F.col("skipped")
    sums = marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("raw_error_count"),
        F.count_if(kept).alias("error_count"),
        F.count_if(F.col("skipped")).alias("skipped_proper_nouns"),
        F.sum(F.when(kept, issue_weight(F.col("issue_type"))).otherwise(0)).alias("weighted_errors"),
    )
    counts = texts.select(key, tx.space_word_count(text).alias("total_words"))
    return score_findings(counts.join(sums, key, "left"))


def score_findings(df: DataFrame) -> DataFrame:
    """Scores from ``total_words`` and the (possibly absent) counts; a text without words scores full marks."""
    counts = ["raw_error_count", "error_count", "skipped_proper_nouns", "weighted_errors"]
    has_words = F.col("total_words") > 0
    for name in counts:
        if name in df.columns:
            df = df.withColumn(name, F.when(has_words, F.coalesce(name, F.lit(0))).otherwise(0))
    density = F.when(has_words, F.col("weighted_errors") / F.col("total_words")).otherwise(0.0)
    return (
        df.withColumn("error_density", density)
        .withColumn("grammar_score", tx.decay(F.col("error_density"), GRAMMAR_DECAY))
        .withColumn("percent_score", F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(100.0) * F.col("error_density")))
    )


def report_totals(scores: DataFrame) -> DataFrame:
    """Totals over all scored texts: rows processed and proper nouns skipped."""
    return scores.agg(
        F.count(F.lit(1)).alias("processed"),
        F.coalesce(F.sum("skipped_proper_nouns"), F.lit(0)).alias("skipped_proper_nouns"),
    )


def at_least(scores: DataFrame, n: int) -> DataFrame:
    return scores.where(F.col("error_count") >= n)
