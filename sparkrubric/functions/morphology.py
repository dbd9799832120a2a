"""Romanian inflected forms as array Columns, driven by suffix tables.

A rule reads (ending pattern, letters to drop, suffixes to attach); the first matching rule applies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx

Rule = tuple[str, int, str]

# --- fixed values ------------------------------------------------------------------------------------------
WORD_RULES: list[Rule] = [
    ("(?:ica|ică|ina|ină)$", 1, "a e elor ele ii"),
    ("uia$", 1, "a e elor ele i"),
    ("[aă]$", 1, "a e elor ele ei ii"),
    ("e$", 1, "ea i ilor ile elui"),
    ("u$", 1, "ul ului ui i ii ilor"),
    ("[ioâî]$", 0, "ul ului ui i ii ilor"),
    ("", 0, "ul ului ui i ii ilor uri urile urilor"),
]
PHRASE_RULES: list[Rule] = [
    ("ul$", 2, "ului"),
    ("u$", 1, "ului ui"),
    ("a$", 1, "ei"),
    ("e$", 0, "lui i"),
    ("i$", 0, "lor"),
    ("", 0, "ului"),
]
ARTICLE_RULES: list[Rule] = [
    ("ă$", 1, "a ei ele elor"),
    ("e$", 0, "a le lui lor"),
    ("a$", 1, "aua ei ele elor"),
    ("iu$", 1, "ul ului ii ilor"),
    ("[ui]$", 0, "l lui ii ilor urile urilor ele elor"),
    ("", 0, "ul lui ului ii ilor urile urilor ele elor"),
]
GENITIVE_RULES: list[Rule] = [("(?:ica|ina|uia)$", 1, "ii"), ("[aă]$", 1, "ei"), ("ul$", 2, "ului")]
# --- end of fixed values -----------------------------------------------------------------------------------


def _apply(word: Column, rules: list[Rule]) -> Column:
    """Array of the forms the first matching rule gives; empty when none matches."""
    out = F.array().cast("array<string>")
    for pattern, drop, suffixes in reversed(rules):
        stem = F.left(word, F.char_length(word) - drop) if drop else word
        forms = F.array(*[F.concat(stem, F.lit(s)) for s in suffixes.split()])
        out = F.when(word.rlike(pattern), forms).otherwise(out) if pattern else forms
    return out


def word_forms(word: Column) -> Column:
    """A word and its articulated, plural and genitive-dative forms."""
    return F.array_distinct(F.concat(F.array(word), _apply(word, WORD_RULES)))


def article_forms(word: Column) -> Column:
    """Articulated forms of the lemma variant."""
    forms = F.array_distinct(F.concat(F.array(word), _apply(word, ARTICLE_RULES)))
    return F.when(word == "", F.array().cast("array<string>")).otherwise(forms)


def _words(term: Column) -> Column:
    return F.filter(F.split(term, " "), lambda w: w != "")


def phrase_forms(term: Column) -> Column:
    """The phrase with its last word in the genitive-dative."""

    def build(words: Column) -> Column:
        head = F.slice(words, 1, F.size(words) - 1)
        return F.transform(
            _apply(F.element_at(words, -1), PHRASE_RULES),
            lambda f: F.array_join(F.concat(head, F.array(f)), " "),
        )

    words = _words(term)
    return F.when(F.size(words) == 0, F.array(term)).otherwise(tx.let(words, build))


def coordinated_forms(term: Column, reduce_accented: bool = False) -> Column:
    """Genitive of a noun with its adjectives: first word inflected, the rest agreeing or unchanged.

    ``reduce_accented`` adds the ea → e reduction for first words in ``ă`` as well, as the lemma variant does.
    """
    none = F.array().cast("array<string>")

    def agree(word: Column) -> Column:
        stem = F.left(word, F.char_length(word) - 1)
        return F.when(word.rlike("[aă]$") & (F.char_length(word) > 2), F.concat(stem, F.lit("e"))).otherwise(word)

    def build(words: Column) -> Column:
        first = words[0]
        rest = F.slice(words, 2, F.size(words))
        agreeing = F.transform(rest, agree)
        reduced = F.transform(agreeing, lambda w: F.replace(w, F.lit("ea"), F.lit("e")))
        genitive = F.get(_apply(first, GENITIVE_RULES), F.lit(0))
        with_first = lambda tail: F.concat(genitive, F.lit(" "), F.array_join(tail, " "))
        n = F.char_length(first)
        plain = F.array(with_first(agreeing), with_first(rest))
        full = F.array(with_first(agreeing), with_first(reduced), with_first(rest))
        return (
            F.when(first.endswith("a") & (n > 2), full)
            .when(first.endswith("ul") & (n > 3), F.array(with_first(rest)))
            .when(first.endswith("ă") & (n > 2), full if reduce_accented else plain)
            .otherwise(none)
        )

    words = _words(term)
    return F.when(F.size(words) < 2, none).otherwise(F.array_distinct(tx.let(words, build)))


def _one_word_inflected(term: Column) -> Column:
    """The term with one word at a time inflected (words of two letters or more)."""

    def build(words: Column) -> Column:
        def at(word: Column, pos: Column) -> Column:
            before, after = F.slice(words, 1, pos), F.slice(words, pos + 2, F.size(words))
            forms = F.when(F.char_length(word) >= 2, word_forms(word)).otherwise(F.array().cast("array<string>"))
            return F.transform(forms, lambda f: F.array_join(F.concat(before, F.array(f), after), " "))

        return F.flatten(F.transform(words, at))

    return tx.let(_words(term), build)


def search_forms(names: Column) -> Column:
    """Every search form of an entity from its names (name first, then aliases)."""

    def of_term(term: Column) -> Column:
        return F.concat(F.array(term), _one_word_inflected(term), coordinated_forms(term), phrase_forms(term))

    return F.array_distinct(F.flatten(F.transform(F.transform(names, tx.normalize_match), of_term)))


def search_forms_articulated(names: Column) -> Column:
    """Search forms of the lemma variant: article forms put in place of a word of three letters or more, and each
    single word, which stands for its own lemma."""

    def of_term(term: Column) -> Column:
        words = F.filter(_words(term), lambda w: F.char_length(w) >= 3)
        swapped = F.flatten(
            F.transform(words, lambda w: F.transform(article_forms(w), lambda f: F.replace(term, w, f)))
        )
        lemmas = F.regexp_extract_all(term, F.lit("[A-Za-zăâîșțĂÂÎȘȚ]+"), F.lit(0))
        return F.concat(F.array(term), swapped, coordinated_forms(term, reduce_accented=True), lemmas)

    return F.array_distinct(F.flatten(F.transform(F.transform(names, tx.normalize_match), of_term)))
