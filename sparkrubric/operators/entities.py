"""Entities: resolving plan refs, mentions in text, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx
from sparkrubric.operators import windows as wn
from sparkrubric.sources.lineage import materialize

HALLUCINATION_FACTOR = 0.9


# --- resolution inside a row (a plan beside its own instance's entities) ------------------------------------
def resolve(ref: Column, entities: Column) -> Column:
    """Entity struct a ref names: exact id, else the first entity whose name or alias matches; null if none.

    ``entities`` is an array of structs with ``id, name_key, alias_keys``.
    """
    by_id = F.get(F.filter(entities, lambda e: e["id"] == ref), F.lit(0))

    def by_name(key: Column) -> Column:
        named = F.filter(entities, lambda e: (e["name_key"] == key) | F.array_contains(e["alias_keys"], key))
        return F.get(named, F.lit(0))

    return F.coalesce(by_id, tx.let(tx.lookup_key(ref), by_name))


def resolve_normalized(ref: Column, entities: Column) -> Column:
    """As ``resolve`` with match-normalized names (``match_keys``); used by the faithfulness score."""
    by_id = F.get(F.filter(entities, lambda e: e["id"] == ref), F.lit(0))

    def by_name(key: Column) -> Column:
        return F.get(F.filter(entities, lambda e: F.array_contains(e["match_keys"], key)), F.lit(0))

    return F.coalesce(by_id, tx.let(tx.normalize_match(ref), by_name))


# --- resolution by join (refs against an entity table) -------------------------------------------------------
def entity_keys(
    entities: DataFrame, scope: list[str], entity_id: str, position: str, names: Column, normalized: bool = False
) -> DataFrame:
    """``scope, lookup, entity_id``: one row per spelling, holding the entity that wins it.

    An id beats a name, and an earlier entity beats a later one.  ``names`` is the array of name and aliases.
    """
    key = tx.normalize_match if normalized else tx.lookup_key
    spelled = entities.select(
        *scope,
        F.col(entity_id).cast("string").alias("entity_id"),
        F.col(position).alias("_pos"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(0).alias("rank"), F.col(entity_id).cast("string").alias("lookup"))),
                F.transform(names, lambda n: F.struct(F.lit(1).alias("rank"), key(n).alias("lookup"))),
            )
        ).alias("s"),
    )
    return (
        spelled.groupBy(*scope, F.col("s.lookup").alias("lookup"), F.col("s.rank").alias("rank"))
        .agg(F.min_by("entity_id", "_pos").alias("entity_id"))
    )


def resolve_by_join(
    items: DataFrame, keys: DataFrame, scope: list[str], normalized: bool = False, keep_unresolved: bool = True
) -> DataFrame:
    """Add ``entity_id`` to item rows (``ref``) from ``entity_keys``.

    Both joins are equi joins on one row per spelling, so a hot name only splits on the item side.  With
    ``keep_unresolved`` the raw ref stands in for an unknown entity in ``final_id``; otherwise it stays null.
    """
    key = tx.normalize_match if normalized else tx.lookup_key
    ids = keys.where("rank = 0").select(*scope, F.col("lookup").alias("ref"), F.col("entity_id").alias("_by_id"))
    names = keys.where("rank = 1").select(*scope, F.col("lookup").alias("_key"), F.col("entity_id").alias("_by_name"))
    joined = (
        items.withColumn("_key", key("ref"))
        .join(ids, [*scope, "ref"], "left")
        .join(names, [*scope, "_key"], "left")
        .withColumn("entity_id", F.coalesce("_by_id", "_by_name"))
        .drop("_key", "_by_id", "_by_name")
    )
    final = F.coalesce("entity_id", "ref") if keep_unresolved else F.col("entity_id")
    return joined.withColumn("final_id", final)


# --- mentions ------------------------------------------------------------------------------------------------
def mentions(forms: Column, normalized_text: Column) -> Column:
    """True if any search form is a substring of the normalized text (no word boundary)."""
    return F.exists(forms, lambda f: normalized_text.contains(f))


def mentions_lemma(forms: Column, normalized_text: Column, lemmas: Column) -> Column:
    """Substring match, or a form equal to a lemma of the text."""
    return mentions(forms, normalized_text) | F.arrays_overlap(forms, lemmas)


def lemma_map(texts: DataFrame, keys: list[str], text: str, lookup: DataFrame) -> DataFrame:
    """``keys, lemmas``: distinct lemmas of each text; a word without an entry in ``(word, lemma)`` is its own lemma.

    Words are made distinct per text before the join, so a repeated word is looked up once.
    """
    letters = F.regexp_extract_all(tx.normalize_match(text), F.lit("[A-Za-zăâîșțĂÂÎȘȚ]+"), F.lit(0))
    words = texts.select(*keys, F.explode_outer(F.array_distinct(letters)).alias("word"))
    lemmas = words.join(lookup, "word", "left").select(
        *keys, F.coalesce("lemma", "word").alias("lemma")
    )
    return lemmas.groupBy(*keys).agg(F.collect_set("lemma").alias("lemmas"))


# --- faithfulness --------------------------------------------------------------------------------------------
def faithfulness(
    df: DataFrame,
    entities: str = "entities",
    refs: str = "refs",
    explanation: str = "explanation",
    lemmas: str | None = None,
) -> DataFrame:
    """Add the faithfulness columns of a plan against its explanation.

    ``entities`` holds structs with ``id, match_keys, forms``.  Each entity is searched once; planned refs then look
    their answer up.  With ``lemmas`` (array column) the lemma variant applies, which has no hallucination penalty.
    """

    def seen(e: Column, norm: Column) -> Column:
        if lemmas:
            return mentions_lemma(e["forms"], norm, F.col(lemmas))
        return mentions(e["forms"], norm)

    def looked_up(norm: Column) -> Column:
        return F.transform(
            entities,
            lambda e: F.struct(e["id"].alias("id"), e["match_keys"].alias("match_keys"), seen(e, norm).alias("seen")),
        )

    # bound once: as a column of its own the text would be normalized again for each form that is sought
    looked = df.withColumn("_seen", tx.let(tx.normalize_match(explanation), looked_up)).withColumn(
        "_planned", F.filter(F.transform(refs, lambda r: resolve_normalized(r, F.col("_seen"))), lambda e: e.isNotNull())
    )
    planned_ids = F.transform("_planned", lambda e: e["id"])
    missing = F.transform(F.filter("_planned", lambda e: ~e["seen"]), lambda e: e["id"])
    extra = F.transform(
        F.filter("_seen", lambda e: e["seen"] & ~F.array_contains(F.col("planned_ids"), e["id"])), lambda e: e["id"]
    )
    counted = (
        looked.withColumn("planned_ids", planned_ids)
        .withColumn("missing", missing)
        .withColumn("hallucinated", F.lit(None).cast("array<string>") if lemmas else extra)
        .withColumn("total_count", F.size("planned_ids"))
        .withColumn("mentioned_count", F.size("planned_ids") - F.size("missing"))
        .withColumn("hallucinated_count", F.lit(0) if lemmas else F.size("hallucinated"))
    )
    return faithfulness_score(counted, F.size(refs) == 0).drop("_seen", "_planned")


def faithfulness_score(df: DataFrame, empty: Column) -> DataFrame:
    """``F`` and ``F_linear`` from ``total_count, mentioned_count, hallucinated_count``; an empty plan scores 1."""
    share = F.when(F.col("total_count") == 0, 1.0).otherwise(F.col("mentioned_count") / F.col("total_count"))
    linear = share * F.pow(F.lit(HALLUCINATION_FACTOR), F.col("hallucinated_count"))
    return df.withColumn("F_linear", F.when(empty, 1.0).otherwise(linear)).withColumn(
        "F", tx.severity(F.col("F_linear"))
    )


# --- mentions between two tables (many texts, one list of terms) ---------------------------------------------
#: Characters in a key of a short term, inner words in a key of a long one.
CHARS, WORDS = 4, 3
#: Counters for how often the texts hold a run, and bits that say which runs are keys; neither grows with the data.
COUNTERS, KEY_BITS = 1 << 16, 1 << 22


def hashed_runs(parts: Column, size: int) -> Column:
    """Hash of each run of ``size`` neighbouring parts, in order; none when there are fewer parts."""

    def run(at: Column) -> Column:
        return F.xxhash64(*[F.get(parts, at + k) for k in range(size)])

    places = F.sequence(F.lit(0), F.size(parts) - size)
    return F.when(F.size(parts) >= size, F.transform(places, run)).otherwise(F.array().cast("array<long>"))


def term_runs(term: str) -> Column:
    """Runs that a text holds if it holds the term: inner words of three words or more, characters of shorter terms
    (``term_mentions`` asks only for those of words)."""

    def of(parts: Column, longest: int) -> Column:
        runs = F.when(F.size(parts) >= longest, hashed_runs(parts, longest))
        for size in range(1, longest):
            runs = runs.when(F.size(parts) == size, hashed_runs(parts, size))
        return runs

    by_words = tx.let(F.split(term, " "), lambda w: of(F.slice(w, 2, F.size(w) - 2), WORDS))
    by_chars = tx.let(F.split(term, ""), lambda c: of(c, CHARS))
    return F.array_distinct(F.when(n_inner(term) > 0, by_words).otherwise(by_chars))


def n_inner(term: str) -> Column:
    """Words of a term beside the first and the last."""
    return F.size(F.split(term, " ")) - 2


def text_runs(text: str, word_sizes: list[int], char_sizes: list[int]) -> Column:
    """All runs of a text that could be a key of some term."""

    def of(sizes: list[int], mark: str) -> Column:
        return tx.let(F.split(text, mark), lambda parts: F.concat(*[hashed_runs(parts, n) for n in sizes]))

    return F.concat(*[of(sizes, mark) for sizes, mark in ((word_sizes, " "), (char_sizes, "")) if sizes])


def rarest_keys(terms: DataFrame, runs: DataFrame) -> DataFrame:
    """``terms`` with ``_key``, the run of ``_runs`` that the texts hold least often by a sketch of their ``runs``."""
    counter = F.pmod("_run", F.lit(COUNTERS))
    counts = runs.select(counter.alias("_counter")).groupBy("_counter").agg(F.count(F.lit(1)).alias("_n"))
    asked = terms.withColumn("_run", F.explode("_runs")).drop("_runs").withColumn("_counter", counter)
    rank = F.struct(F.coalesce("_n", F.lit(0)), "_run")
    return asked.join(counts, "_counter", "left").groupBy(*[c for c in terms.columns if c != "_runs"]).agg(
        F.min_by("_run", rank).alias("_key")
    )


def key_bits(keys: DataFrame) -> Column:
    """``KEY_BITS`` bits as one constant array of longs, with the bit of each ``_key`` set.

    At most ``KEY_BITS / 64`` numbers come to the driver, whatever the number of keys."""
    bit = F.pmod("_key", F.lit(KEY_BITS))
    mask = F.expr(f"shiftleft(1L, cast(pmod(_key, {KEY_BITS}) % 64 AS int))").alias("mask")
    parts = keys.select(F.shiftright(bit, 6).alias("part"), mask).groupBy("part").agg(F.bit_or("mask").alias("mask"))
    bits = ["0"] * (KEY_BITS // 64)
    for part in parts.collect():
        bits[part["part"]] = str(part["mask"])
    return F.split(F.lit(",".join(bits)), ",").cast("array<long>")


def is_key(run: Column, bits: Column) -> Column:
    bit = F.pmod(run, F.lit(KEY_BITS))
    mask = F.get(bits, F.shiftright(bit, 6).cast("int"))
    return F.getbit(mask, (bit % 64).cast("int")) == 1


def term_mentions(texts: DataFrame, text_key: str, text: str, terms: DataFrame, term_key: str, term: str) -> DataFrame:
    """``text_key, term_key`` for every term that is a substring of a text, both match-normalized.

    Terms of one or two words are sought as windows of the texts' bytes, see ``short_mentions``; longer ones by runs of their
    words, see ``long_mentions``.  Both scan the texts and send on only those that hold something of a term.

    Null and empty texts and terms have no mentions.  Rows that repeat a key of either table give a result each; equal
    rows of ``terms`` count once.
    """
    normal = terms.select(F.col(term_key).alias("_id"), tx.normalize_match(term).alias("_term"))
    normal = normal.where("_term <> ''").distinct()
    inner = n_inner("_term")
    short = inner <= 0
    # a few sizes at most
    sizes = normal.agg(F.collect_set(F.when(~short, F.least(inner, F.lit(WORDS)))).alias("words"), F.max(short).alias("short")).first()
    # never null, or Spark infers a filter that normalizes every text once more before the scan's rows are spread
    body = F.coalesce(tx.normalize_match(text), F.lit(""))
    held = texts.select(F.col(text_key).alias("_text_id"), body.alias("_text"))
    out = texts.select(F.col(text_key).alias("_text_id")).join(normal.select("_id").limit(0), F.lit(False))
    if sizes["words"] and sizes["short"]:
        out = long_mentions(held, normal.where(~short), sizes["words"]).unionAll(short_mentions(held, normal.where(short)))
    elif sizes["words"]:
        out = long_mentions(held, normal, sizes["words"])
    elif sizes["short"]:
        out = short_mentions(held, normal)
    return out.select(F.col("_text_id").alias(text_key), F.col("_id").alias(term_key))


def short_mentions(held: DataFrame, terms: DataFrame) -> DataFrame:
    """``_text_id, _id``: one scan finds the windows of a text that are a term, or the end of one above ``wn.LONGEST`` bytes;
    these meet the terms in an equi join, without their text.  Only for the ends of such terms the text comes along, and
    ``contains`` decides."""
    end = F.substring(F.col("_term").cast("binary"), -wn.LONGEST, wn.LONGEST)
    names = materialize(terms.select("_id", "_term", end.alias("_window")), "names")
    found = wn.scan_windows(held, wn.marks_of(names)).join(names, "_window")
    whole = F.octet_length("_term") <= wn.LONGEST
    return found.where(whole | F.col("_text").contains(F.col("_term"))).select("_text_id", "_id")


def long_mentions(held: DataFrame, terms: DataFrame, word_sizes: list[int]) -> DataFrame:
    """``_text_id, _id`` for terms of three words or more.

    A term's key is one run that any text with the term must hold: a mention may begin and end inside a word, so it is a run
    of inner words, of three or all.  Of a term's runs, the one that is rarest in the texts is its key, so a term that begins
    with a common run doesn't meet all texts.  The scan keeps the texts with a run that is a key, up to chance hits in
    ``KEY_BITS`` bits; these meet the terms in an equi join and ``contains`` decides.
    """
    runs = text_runs("_text", sorted(word_sizes), [])
    asked = terms.select("_id", "_term", term_runs("_term").alias("_runs"))
    keys = materialize(rarest_keys(asked, held.select(F.explode(runs).alias("_run"))), "keys")

    bits = key_bits(keys)
    hits = F.array_distinct(F.filter(runs, lambda run: is_key(run, bits)))
    found = held.select("_text_id", "_text", F.explode(hits).alias("_key"))
    return found.join(keys, "_key").where(F.col("_text").contains(F.col("_term"))).select("_text_id", "_id")
