"""Column functions over Romanian text: diacritics, tokens, match keys, small numeric helpers.

Every function takes and returns a Column and stays JVM-side.  Character classes are written out instead of
``\\w`` / ``\\s`` because Java's defaults are ASCII; the same strings are valid RE2, so SQL oracles share them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------------------------
SPACE_CHARS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_PATTERN = r"[a-zA-ZăâîșțĂÂÎȘȚ]+(?:[-'][a-zA-ZăâîșțĂÂÎȘȚ]+)*"
NUMBER_PATTERN = r"[0-9]+(?:[.,][0-9]+)*"
DIACRITICS = "ăâîșț"
MATCH_PUNCTUATION = '.,;:!?"()[]{}'
# letters with diacritics, and the plain letters they stand for
ACCENTED = "ăâîșțşţĂÂÎȘȚŞŢ"
PLAIN = "aaiststAAISTST"
# --- end of fixed values -----------------------------------------------------------------------------------

SPACE = f"[{SPACE_CHARS}]"
#: The characters of ``SPACE``.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NON_SPACE = f"[^{SPACE_CHARS}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN_PATTERN = f"{WORD_PATTERN}|{NUMBER_PATTERN}|{NON_SPACE}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; keeps a costly expression from being repeated inside lambdas."""
    return F.transform(F.array(value), body)[0]


# --- diacritics --------------------------------------------------------------------------------------------
def normalize_diacritics(text: Column | str) -> Column:
    """Cedilla letters become the comma-below letters."""
    return F.translate(_col(text), "şţŞŢ", "șțȘȚ")


def strip_diacritics(text: Column | str) -> Column:
    return F.translate(_col(text), ACCENTED, PLAIN)


def has_romanian_diacritics(text: Column | str) -> Column:
    return _col(text).rlike("[ăâîșțĂÂÎȘȚşţŞŢ]")


def count_diacritics(text: Column | str) -> Column:
    """Struct with one count per letter, after lower-casing and cedilla normalization."""
    lowered = normalize_diacritics(F.lower(_col(text)))
    return F.struct(
        *[(F.char_length(lowered) - F.char_length(F.translate(lowered, ch, ""))).alias(ch) for ch in DIACRITICS]
    )


# --- tokens ------------------------------------------------------------------------------------------------
def raw_words(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(WORD_PATTERN), F.lit(0))


def tokenize_words(text: Column | str) -> Column:
    """Lower-case word list; numbers and punctuation are left out."""
    return F.transform(raw_words(text), F.lower)


def token_count(text: Column | str, n_words: Column | None = None) -> Column:
    """Number of tokens; with the number of words at hand only what lies between the words is cut up."""
    if n_words is None:
        return F.regexp_count(_col(text), F.lit(TOKEN_PATTERN))
    between = F.regexp_replace(_col(text), WORD_PATTERN, " ")
    return n_words + F.regexp_count(between, F.lit(f"{NUMBER_PATTERN}|{NON_SPACE}"))


def space_split(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), SPACE + "+"), lambda w: w != "")


def space_word_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(NON_SPACE + "+"))


def trim_space(text: Column | str) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


#: Pieces whose lengths are added up together, and such runs in turn; keeps the work on a long text from growing with its
#: square, and that on a piece to a few additions.
RUN, RUNS = 16, 64


def _runs(values: Column, size: int) -> Column:
    def cut(x: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / size).cast("int") - 1, F.lit(0)))
        return F.transform(numbers, lambda r: F.slice(x, r * size + 1, size))

    return let(values, cut)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def _inside(runs: Column, starts: Column) -> Column:
    """Running sums over all runs, of which the sums before each are known."""
    each = lambda run, at: F.transform(run, lambda _, i: at + _total(F.slice(run, 1, i + 1)))
    return F.flatten(F.transform(runs, lambda run, r: let(F.get(starts, r), lambda at: each(run, at))))


def running_ends(pieces: Column) -> Column:
    """Summed lengths of the pieces up to and including each."""

    def starts(groups: Column) -> Column:
        sums = F.aggregate(
            groups, F.array(F.lit(0)), lambda acc, group: F.concat(acc, F.array(F.element_at(acc, -1) + _total(group)))
        )
        upto = let(sums, lambda before: _inside(groups, before))
        return F.concat(F.array(F.lit(0)), upto)

    def ends(runs: Column) -> Column:
        totals = F.transform(runs, _total)
        return let(let(_runs(totals, RUNS), starts), lambda before: _inside(runs, before))

    return let(_runs(F.transform(pieces, F.char_length), RUN), ends)


def tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Token table ``(keys, pos, token, lower, start, end, is_word)``, one row per token.

    Each extracted piece is the blank run before a token plus the token, so offsets are running lengths, added up inside
    the row.
    """
    piece = F.regexp_extract_all(F.col(text), F.lit(f"({SPACE}*)({TOKEN_PATTERN})"), F.lit(0))
    token = F.ltrim("piece", F.lit(SPACES))
    placed = let(piece, lambda p: F.arrays_zip(p.alias("piece"), running_ends(p).alias("end")))
    return (
        df.select(*keys, F.posexplode(placed).alias("pos", "x"))
        .select(*keys, "pos", F.col("x.piece"), F.col("x.end"))
        .withColumn("token", token)
        .select(
            *keys,
            "pos",
            "token",
            F.lower("token").alias("lower"),
            (F.col("end") - F.char_length("token")).alias("start"),
            "end",
            F.col("token").rlike(f"^(?:{WORD_PATTERN})$").alias("is_word"),
        )
    )


def word_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, word, stripped, n)``: words pre-counted per document, so joins and shuffles carry distinct words."""
    return (
        df.select(*keys, F.explode(tokenize_words(text)).alias("word"))
        .groupBy(*keys, "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("stripped", strip_diacritics("word"))
    )


# --- match keys --------------------------------------------------------------------------------------------
def normalize_match(text: Column | str) -> Column:
    """Lower, drop comma-below diacritics, punctuation to blanks, runs of white space to one blank."""
    # one translation makes every white space a blank, so that the pattern meets only runs of blanks, not each blank
    blanks = MATCH_PUNCTUATION + SPACES.replace(" ", "")
    spaced = F.translate(F.lower(_col(text)), "ăâîșț" + blanks, "aaist" + " " * len(blanks))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def normalize_fuzzy(text: Column | str) -> Column:
    """Lower and drop diacritics for the fuzzy matcher; ţ is mapped, ş is not."""
    return F.translate(F.lower(_col(text)), "ăâîșţț", "aaistt")


def lookup_key(text: Column | str) -> Column:
    """Key used when a constraint check looks up an entity by name."""
    return F.lower(trim_space(text))


# --- labels ------------------------------------------------------------------------------------------------
DAY_NAMES = {
    "monday": "luni",
    "tuesday": "marți",
    "wednesday": "miercuri",
    "thursday": "joi",
    "friday": "vineri",
}


def day_both_languages(day: Column) -> Column:
    """Array with the lower-case day and, where known, its name in the other language."""
    d = F.lower(day)
    other = F.lit(None).cast("string")
    for en, ro in DAY_NAMES.items():
        other = F.when(d == en, ro).when(d == ro, en).otherwise(other)
    return F.array_compact(F.array(d, other))


def slot_label(slot: Column) -> Column:
    """Slot normalization of the back-to-back check."""
    s = F.lower(slot)
    return (
        F.when(s.contains("dimineata") | s.contains("dimineață") | s.contains("morning"), "morning")
        .when(s.contains("amiaza") | s.contains("afternoon"), "afternoon")
        .otherwise(s)
    )


def slot_label_restricted(slot: Column) -> Column:
    """Slot normalization of the slot-restriction check, which also knows ``după-amiază``."""
    s = F.lower(slot)
    return (
        F.when(s.contains("dimineata") | s.contains("dimineață"), "morning")
        .when(s.contains("amiaza") | s.contains("după-amiază"), "afternoon")
        .otherwise(s)
    )


def split_slot_key(key: Column | str) -> Column:
    """``day_slot`` at the first underscore; ``slot`` is null without one."""
    parts = F.split(_col(key), "_", 2)
    return F.struct(parts[0].alias("day"), F.get(parts, 1).alias("slot"))


def narrative(text: Column | str) -> Column:
    """Text before the first ``{`` that ends a line, trimmed."""
    return trim_space(F.substring_index(_col(text), "{\n", 1))


def readable_key(key: Column | str) -> Column:
    return F.initcap(F.replace(_col(key), F.lit("_"), F.lit(" ")))


# --- numeric helpers ---------------------------------------------------------------------------------------
SEVERITY = 3.0


def severity(share: Column) -> Column:
    return F.pow(share, F.lit(SEVERITY))


def decay(rate: Column, k: float) -> Column:
    return F.exp(-F.lit(k) * rate)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
