"""Text quality of a text column.

Each function adds columns to its input row by row: no shuffle, no join, one pass over the text.  The lexicon
joins at the end give the same counts from a word table for callers whose word lists are tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.functions import lexicon as lx
from sparkrubric.functions import text as tx

# --- fixed values ------------------------------------------------------------------------------------------
SPACE_BEFORE = f"{tx.WORD_CHAR}{tx.SPACE}+[.,;:!?]"
MISSING_AFTER = r"[.,;:!?][A-ZĂÂÎȘȚ]"
MISSING_AFTER_DECIMAL = r"\p{Nd}\.[A-ZĂÂÎȘȚ]"
MULTI_SPACE = "  +"
SPACE_AFTER_OPEN = rf"[(\[{{„«]{tx.SPACE}+{tx.WORD_CHAR}"
SPACE_BEFORE_CLOSE = rf"{tx.WORD_CHAR}{tx.SPACE}+[)\]}}»]"
LOWER_START = rf"[.!?]{tx.SPACE}+[a-zăâîșț]"
ENGLISH_RATE_LIMIT = 0.15
CODE_SWITCH_DECAY = 20.0
FULL_LENGTH_WORDS = 100
# --- end of fixed values -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Weights of the overall score; the grammar set applies when a grammar score is present."""

    diacritic: float = 0.50
    codeswitch: float = 0.35
    length: float = 0.15
    grammar: float = 0.0


PLAIN_WEIGHTS = Weights()
GRAMMAR_WEIGHTS = Weights(diacritic=0.35, codeswitch=0.20, length=0.10, grammar=0.25)


# --- building blocks on a word array -----------------------------------------------------------------------
def _isin(word: Column, words: list[str]) -> Column:
    return word.isin(words)


def _is_known(word: Column) -> Column:
    return _isin(tx.strip_diacritics(word), lx.known_keys())


def _is_correct(word: Column) -> Column:
    stripped = tx.strip_diacritics(word)
    return _isin(word, lx.correct_words()) | ((word != stripped) & _isin(stripped, lx.assumed_keys()))


def _examples(flagged: Column, limit: int) -> Column:
    """First ``limit`` flagged words, distinct by ASCII spelling, each with the expected spelling."""
    expected = F.create_map(*[F.lit(v) for pair in lx.expected_spelling().items() for v in pair])
    keys = F.slice(F.array_distinct(F.transform(flagged, tx.strip_diacritics)), 1, limit)
    first = lambda key: F.filter(flagged, lambda w: tx.strip_diacritics(w) == key)[0]
    return F.transform(keys, lambda key: F.concat(first(key), F.lit(" → "), F.element_at(expected, key)))


def with_words(df: DataFrame, text: str, prefix: str = "_") -> DataFrame:
    """Add the normalized text and its word list, shared by all scores below."""
    return df.withColumn(f"{prefix}text", tx.normalize_diacritics(F.coalesce(text, F.lit("")))).withColumn(
        f"{prefix}words", tx.tokenize_words(f"{prefix}text")
    )


def diacritics(df: DataFrame, text: str, examples: int = 10) -> DataFrame:
    """Diacritic correctness: score, counts, coverage and the first flagged words."""
    known = with_words(df, text).withColumn("_known", F.filter("_words", _is_known))
    counted = known.withColumn("_bad", F.filter("_known", lambda w: ~_is_correct(w)))
    total, n_words = F.size("_known"), F.size("_words")
    missing = F.size("_bad")
    has_any = tx.has_romanian_diacritics("_text")
    score = (
        F.when(total > 0, (total - missing) / total)
        .when((n_words > 20) & ~has_any, 0.5)
        .otherwise(1.0)
    )
    return (
        counted.withColumn("diacritic_score", score)
        .withColumn("total_checkable", total)
        .withColumn("correct_diacritics", total - missing)
        .withColumn("missing_diacritics", missing)
        .withColumn("has_diacritics", has_any & (n_words > 0))
        .withColumn("total_words", n_words)
        .withColumn("unique_words", F.size(F.array_distinct("_words")))
        .withColumn("coverage", F.when(n_words > 0, total / n_words).otherwise(0.0))
        .withColumn("missing_examples", _examples(F.col("_bad"), examples))
        .drop("_text", "_words", "_known", "_bad")
    )


def quick_diacritics(df: DataFrame, text: str) -> DataFrame:
    """Share of correctly spelled critical function words; a cheap pre-check."""
    must = lx.required_spellings()
    critical = [w for w in lx.CRITICAL_WORDS.split() if w in must]
    words = df.withColumn("_words", tx.tokenize_words(F.coalesce(text, F.lit(""))))
    correct = F.size(F.filter("_words", lambda w: _isin(w, [must[c] for c in critical])))
    bare = F.size(F.filter("_words", lambda w: _isin(w, critical)))
    return (
        words.withColumn("_correct", correct)
        .withColumn("_total", F.col("_correct") + bare)
        .withColumn(
            "quick_score",
            F.when(F.col("_total") > 0, F.col("_correct") / F.col("_total"))
            .when((F.size("_words") > 30) & ~tx.has_romanian_diacritics(text), 0.6)
            .otherwise(1.0),
        )
        .drop("_words", "_correct", "_total")
    )


def code_switching(df: DataFrame, text: str, english: list[str] | None = None, examples: int = 10) -> DataFrame:
    """English words in the text: count, rate, score, and the flag for a text that is mostly English.

    ``english`` is the caller's high-confidence list; without it the default base-word list is used.
    """
    listed = lx.english_words(english)
    flagged = (
        df.withColumn("_words", tx.tokenize_words(F.coalesce(text, F.lit(""))))
        .withColumn("_flagged", F.filter("_words", lambda w: _isin(w, listed)))
        .withColumn("total_words", F.size("_words"))
        .withColumn("english_words", F.size("_flagged"))
        .withColumn("flagged_words", F.slice("_flagged", 1, examples))
    )
    return codeswitch_scores(flagged).drop("_words", "_flagged")


def codeswitch_scores(df: DataFrame) -> DataFrame:
    """Rate, score and flag from ``english_words`` and ``total_words``."""
    rate = F.when(F.col("total_words") > 0, F.col("english_words") / F.col("total_words")).otherwise(0.0)
    return (
        df.withColumn("english_rate", rate)
        .withColumn("codeswitch_score", tx.decay(F.col("english_rate"), CODE_SWITCH_DECAY))
        .withColumn("is_likely_english", F.col("english_rate") > ENGLISH_RATE_LIMIT)
    )


def punctuation(df: DataFrame, text: str) -> DataFrame:
    """Punctuation and spacing issues, and the score from issues per word."""
    c = F.col(text)
    blank = F.coalesce(c, F.lit("")).rlike(f"^{tx.SPACE}*$")

    def count(pattern: str, sign: str | None = None) -> Column:
        """``sign`` must be found for the pattern to be; most texts lack the rare ones, and a search stops at the first."""
        found = F.regexp_count(c, F.lit(pattern))
        return found if sign is None else F.when(c.rlike(sign), found).otherwise(0)

    def unless_blank(value: Column) -> Column:
        return F.when(blank, F.lit(0)).otherwise(value)

    words = tx.space_word_count(c)
    out = (
        df.withColumn("space_before_punct", unless_blank(count(SPACE_BEFORE, f"{tx.SPACE}[.,;:!?]")))
        .withColumn(
            "missing_space_after",
            unless_blank(count(MISSING_AFTER, MISSING_AFTER) - count(MISSING_AFTER_DECIMAL, MISSING_AFTER_DECIMAL)),
        )
        .withColumn("double_spaces", unless_blank(F.when(c.contains("  "), count(MULTI_SPACE)).otherwise(0)))
        .withColumn(
            "other_issues",
            unless_blank(count(SPACE_AFTER_OPEN, r"[(\[{„«]") + count(SPACE_BEFORE_CLOSE, rf"{tx.SPACE}[)\]}}»]")),
        )
        .withColumn(
            "total_issues",
            F.col("space_before_punct")
            + F.col("missing_space_after")
            + F.col("double_spaces")
            + F.col("other_issues"),
        )
    )
    rate = F.col("total_issues") / F.greatest(words, F.lit(1))
    return out.withColumn(
        "punctuation_score",
        F.when(F.col("total_issues") == 0, 1.0).otherwise(F.greatest(F.lit(0.3), F.lit(1.0) - rate * F.lit(5.0))),
    )


def repetition(df: DataFrame, text: str) -> DataFrame:
    """Type-token ratio and the number of three-word phrases seen at least three times."""

    def repeated(words: Column) -> Column:
        triples = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
        in_order = F.sort_array(F.slice(triples, 1, F.size(words) - 2))
        return tx.let(
            in_order,
            lambda a: F.size(
                F.filter(a, lambda x, i: (x == F.get(a, i + 2)) & ((i == 0) | (F.get(a, i - 1) != x)))
            ),
        )

    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = df.withColumn("_w", F.regexp_extract_all(lowered, F.lit(tx.WORD_CHAR + "+"), F.lit(0)))
    short = F.size("_w") < 10
    return (
        words.withColumn("repetition_words", F.size("_w"))
        .withColumn("_ttr", F.when(short, 1.0).otherwise(F.size(F.array_distinct("_w")) / F.size("_w")))
        .withColumn("repeated_phrases", F.when(short, 0).otherwise(tx.let(F.col("_w"), repeated)))
        .withColumn(
            "repetition_score",
            F.when(short, 1.0).otherwise(
                F.greatest(
                    F.lit(0.3),
                    F.least(F.lit(1.0), F.col("_ttr") / F.lit(0.5))
                    - F.least(F.lit(0.3), F.col("repeated_phrases") * F.lit(0.05)),
                )
            ),
        )
        .withColumn("type_token_ratio", F.round("_ttr", 3))
        .drop("_w", "_ttr")
    )


def capitalization(df: DataFrame, text: str) -> DataFrame:
    """Sentences that start in lower case and words written in capitals."""
    shouted = F.filter(
        F.transform(tx.space_split(text), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")),
        lambda w: w.rlike(r"^\p{L}{4,}$") & w.rlike(r"\p{Lu}") & ~w.rlike(r"[\p{Ll}\p{Lt}]"),
    )
    issues = F.col("lowercase_sentence_starts") + F.col("all_caps_words")
    return (
        df.withColumn("lowercase_sentence_starts", F.regexp_count(F.col(text), F.lit(LOWER_START)))
        .withColumn("all_caps_words", F.size(shouted))
        .withColumn(
            "capitalization_score",
            F.when(issues == 0, 1.0).otherwise(F.greatest(F.lit(0.5), F.lit(1.0) - issues * F.lit(0.1))),
        )
    )


def length_score(words: Column) -> Column:
    return (
        F.when(words < 10, 0.2)
        .when(words < 50, F.lit(0.4) + F.lit(0.2) * ((words - 10) / 40))
        .when(words < FULL_LENGTH_WORDS, F.lit(0.6) + F.lit(0.4) * ((words - 50) / 50))
        .otherwise(1.0)
    )


def overall(
    dia: Column,
    cs: Column,
    length: Column,
    punct: Column,
    grammar: Column | None = None,
    weights: Weights = GRAMMAR_WEIGHTS,
) -> Column:
    """Weighted base times the punctuation multiplier; ``weights`` apply only where a grammar score is present."""
    p = PLAIN_WEIGHTS
    base = F.lit(p.diacritic) * dia + F.lit(p.codeswitch) * cs + F.lit(p.length) * length
    if grammar is not None:
        with_grammar = (
            F.lit(weights.diacritic) * dia
            + F.lit(weights.codeswitch) * cs
            + F.lit(weights.length) * length
            + F.lit(weights.grammar) * grammar
        )
        base = F.when(grammar.isNotNull(), with_grammar).otherwise(base)
    return base * (F.lit(0.5) + F.lit(0.5) * punct)


def text_quality(
    df: DataFrame,
    text: str,
    english: list[str] | None = None,
    grammar: str | None = None,
    weights: Weights = GRAMMAR_WEIGHTS,
    detail: bool = True,
) -> DataFrame:
    """The full quality report: G, its parts, counts, flags and (``detail``) the capped example lists."""
    listed = lx.english_words(english)
    base = (
        with_words(df, text)
        .withColumn("_known", F.filter("_words", _is_known))
        .withColumn("_bad", F.filter("_known", lambda w: ~_is_correct(w)))
        .withColumn("_english", F.filter("_words", lambda w: _isin(w, listed)))
        .withColumn("n_tokens", tx.token_count("_text", F.size("_words")))
        .withColumn("n_words", F.size("_words"))
        .withColumn("has_diacritics", tx.has_romanian_diacritics("_text"))
        .withColumn("dia_missing", F.size("_bad"))
        .withColumn("dia_correct", F.size("_known") - F.size("_bad"))
        .withColumn("total_words", F.col("n_words"))
        .withColumn("english_words", F.size("_english"))
    )
    total = F.col("dia_correct") + F.col("dia_missing")
    raw_dia = (
        F.when(total > 0, F.col("dia_correct") / total)
        .when((F.col("n_words") > 20) & ~F.col("has_diacritics"), 0.5)
        .otherwise(1.0)
    )
    scored = punctuation(codeswitch_scores(base), "_text").withColumn("_dia", raw_dia)
    english_flag = F.col("is_likely_english")
    scored = (
        scored.withColumn(
            "G_dia", F.when(english_flag, F.least(F.col("_dia"), F.lit(0.3))).otherwise(F.col("_dia"))
        )
        .withColumn("G_cs", F.when(english_flag, 0.1).otherwise(F.col("codeswitch_score")))
        .withColumn("G_punct", F.col("punctuation_score"))
        .withColumn("G_len", length_score(F.col("n_words")))
        .withColumn("is_too_short", F.col("n_words") < FULL_LENGTH_WORDS)
    )
    g = F.col(grammar) if grammar else None
    scored = scored.withColumn(
        "G", overall(F.col("G_dia"), F.col("G_cs"), F.col("G_len"), F.col("G_punct"), g, weights)
    )
    if detail:
        scored = scored.withColumn("dia_examples", _examples(F.col("_bad"), 10)).withColumn(
            "english_examples", F.slice("_english", 1, 10)
        )
    return scored.drop(
        "_text", "_words", "_known", "_bad", "_english", "_dia", "total_words", "codeswitch_score", "punctuation_score"
    )


# --- the same counts by joining a word table to lexicon tables -----------------------------------------------
def diacritic_counts_by_join(words: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """Correct and missing counts per document from ``text.word_counts`` and a diacritic lexicon table."""
    hit = words.join(lexicon, "stripped")
    valid = F.coalesce(F.array_contains("valid", F.col("word")), F.lit(False))
    correct = (
        F.when(F.col("word") == F.col("must"), True)
        .when(F.col("must").isNotNull() & (F.col("word") == F.col("stripped")), False)
        .when(F.col("must").isNotNull() & F.col("valid").isNull(), True)
        .otherwise(valid)
    )
    return hit.groupBy(*keys).agg(
        F.sum(F.when(correct, F.col("n")).otherwise(0)).alias("correct_diacritics"),
        F.sum(F.when(correct, 0).otherwise(F.col("n"))).alias("missing_diacritics"),
    )


def english_counts_by_join(words: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """English words per document from ``text.word_counts`` and a ``(word, class)`` lexicon table.

    Both lexicon sides stay tables, so a caller's list may be of any size; Spark picks the join from its statistics.
    """
    exempt = lexicon.where(F.col("class").isin("white", "lookalike")).select("word").distinct()
    english = lexicon.where(F.col("class").isin("high", "stop")).select("word").distinct()
    return (
        words.join(english, "word", "left_semi")
        .join(exempt, "word", "left_anti")
        .join(exempt.withColumnRenamed("word", "stripped"), "stripped", "left_anti")
        .groupBy(*keys)
        .agg(F.sum("n").alias("english_words"))
    )
