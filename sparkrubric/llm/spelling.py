"""Spelling variants of a corpus' words: one-edit neighbours by walking a trie as a table, level by level.

The trie's unary chains are merged, so its edges carry labels and a level is a branching, not a letter.  Edges are a
distributed table; the frontier is a table of states ``(word, position, node, edits)`` that joins the edges once a level.
A state without an edit only leaves its word's own path in the second half of the word: words are walked in a trie of the
words and, read backwards, in a trie of the reversed words, and one of the two finds an edit in either half.  So no state
branches at the wide nodes near the root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.storage import ready_for_python, written

#: On text whose A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One (document, run) in so many loses a letter.
ALTERED = 97
PARTIAL_COUNTS = 1 << 16
#: Powers of two by which the common beginning of two labels is measured, for labels shorter than twice the first.
SHORT_STEPS, STEPS = [16, 8, 4, 2, 1], [1 << n for n in range(30, -1, -1)]


def altered(doc_id: int | None, run: str, one_in: int) -> str:
    """The run as document ``doc_id`` spells it."""
    if not one_in or doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(one_in: int, min_chars: int):
    """``(word, n)``, added up within a task as far as ``PARTIAL_COUNTS`` words go."""

    def rows(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for run, n in Counter(RUN.findall((text.as_py() or b"").lower().decode())).items():
                    if len(run) < min_chars:
                        continue
                    word = altered(doc_id, run, one_in)
                    if len(word) >= min_chars:
                        held[word] += n
            if len(held) >= PARTIAL_COUNTS:
                yield rows(held)
                held = Counter()
        yield rows(held)

    return counts


def vocabulary(documents: DataFrame, one_in: int = ALTERED, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``(word, n)``: words of at least ``min_chars`` code points with at least ``min_count`` occurrences."""
    ready_for_python(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    found = texts.mapInArrow(_counts(one_in, min_chars), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and direction: the node of each of its prefixes, by hash, the empty one first, and the letter that
    follows it, zero after the last."""
    kinds = (pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()))

    def rows(held: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array([h[j] for h in held], kind) for j, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["spelled", "backwards", "nodes", "letters"])

    for batch in batches:
        held, size = [], 0
        for word in batch.column("word").to_pylist():
            for backwards in (False, True):
                own = word[::-1] if backwards else word
                state = xxhash.xxh3_64(b"1" if backwards else b"0")
                path = [state.intdigest()]
                for letter in own:
                    state.update(letter.encode())
                    path.append(state.intdigest())
                held.append((own, backwards, [x - (1 << 64) if x >> 63 else x for x in path], [*map(ord, own), 0]))
                size += len(path)
            if size >= PARTIAL_COUNTS:
                yield rows(held)
                held, size = [], 0
        yield rows(held)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walks and edges of distinct ``word``.

    Walks are ``(spelled, backwards, at, node, end)``, each word twice, at the last node of its own path in its first half,
    as no edit is made before, and with the node of the whole word; edges ``(node, letter, label, child, ends, onward)``,
    ``letter`` the first of ``label``, ``ends`` whether the child is a word, and ``onward`` the letters that lead on from it.
    Roots, words and nodes with several children are kept, chains between them become labels.
    """
    ready_for_python(words.sparkSession)
    schema = "spelled string, backwards boolean, nodes array<long>, letters array<int>"
    paths = written(words.select("word").mapInArrow(_prefixes, schema), "paths")
    steps = paths.select("spelled", "backwards", F.posexplode(F.arrays_zip("nodes", "letters")).alias("depth", "x"))
    steps = steps.select("spelled", "backwards", "depth", "x.*").withColumnRenamed("nodes", "node")
    letter = F.nullif("letters", F.lit(0))
    shape = steps.groupBy("node").agg(F.min("letters").alias("least"), F.min(letter).alias("low"), F.max(letter).alias("high"), F.min("depth").alias("depth"))
    kept = shape.where("least = 0 OR low < high OR depth = 0").select("node")
    own = steps.select("spelled", "backwards", "depth", "node").join(kept, "node").groupBy("spelled", "backwards")
    own = own.agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))  # as many as the word has letters
    own = written(own, "walks")
    pairs = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edges = own.select("spelled", F.explode(pairs).alias("x"))
    label = F.substring("spelled", F.col("x.a.depth") + 1, F.col("x.b.depth") - F.col("x.a.depth"))
    ends = F.col("x.b.depth") == F.length("spelled")
    edges = edges.select(F.col("x.a.node").alias("node"), label.alias("label"), F.col("x.b.node").alias("child"), ends.alias("ends"))
    edges = edges.groupBy("node", "label", "child").agg(F.max("ends").alias("ends"))
    edges = edges.select("node", F.substring("label", 1, 1).alias("letter"), "label", "child", "ends")
    onward = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_list("letter"), "").alias("onward"))  # letters differ
    edges = edges.join(onward, "child", "left").select("node", "letter", "label", "child", "ends", F.coalesce("onward", F.lit("")).alias("onward"))
    # before the place where the last letter may be left out, too
    half = F.greatest(F.lit(0), F.least(F.floor(F.length("spelled") / 2), F.length("spelled") - 2))
    start = F.element_at(F.filter("path", lambda x: x["depth"] <= half), -1)
    end = F.element_at("path", -1)["node"].alias("end")
    walks = own.select("spelled", "backwards", start["depth"].alias("at"), start["node"].alias("node"), end)
    return walks, written(edges, "edges")


def _common(label: Column, rest: Column) -> Column:
    """The length of the common beginning."""

    def longer(k: Column, step: Column) -> Column:
        fits = (k + step <= F.length(label)) & (F.substring(label, k + 1, step) == F.substring(rest, k + 1, step))
        return F.when(fits, k + step).otherwise(k)

    short, long = (F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), longer) for steps in (SHORT_STEPS, STEPS))
    return F.when(F.length(label) < 2 * SHORT_STEPS[0], short).otherwise(long)


def _level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one more edge each; ``arrived`` where one of them ends at a word one edit away."""
    size, half = F.length("spelled"), F.floor(F.length("spelled") / 2).cast("int")
    along = F.col("letter") == F.substring("spelled", F.col("at") + 1, F.lit(1))
    away = (F.col("edits") == 0) & (F.col("at") >= half)
    rest = F.substring("spelled", F.col("at") + 1, size)
    joined = states.join(edges, "node").where(along | away)
    whole = F.col("label") == F.substring(rest, F.lit(1), F.length("label"))
    # after an edit only whole labels count
    measured = along & (F.col("edits") == 0)
    joined = joined.withColumn("k", F.when(whole, F.length("label")).when(measured, _common(F.col("label"), rest)).otherwise(0))

    at, k, label, n = F.col("at"), F.col("k"), F.col("label"), F.length("label")
    free = F.col("edits") == 0

    def left(start: Column) -> Column:
        """What the label holds from place ``start`` on."""
        return F.substring(label, start + 1, n)

    def next_of(start: Column, length: Column) -> Column:
        return F.substring("spelled", at + start + 1, length)

    def state(when: Column, place: Column, edits: Column) -> Column:
        return F.when(when, F.struct(place.alias("at"), edits.alias("edits")))

    j = F.least(k, n - 1)
    late = at + k >= half
    same = state(k == n, at + n, F.col("edits"))
    replaced = state(free & late & (k < n) & (at + k < size) & (left(k + 1) == next_of(k + 1, n - k - 1)), at + n, F.lit(1))
    inserted = state(free & (at + j >= half) & (left(j + 1) == next_of(j, n - j - 1)), at + n - 1, F.lit(1))
    deleted = state(free & late & (k < n) & (left(k) == next_of(k + 1, n - k)), at + n + 1, F.lit(1))
    moved = joined.select("spelled", "backwards", "child", "ends", "onward", F.explode(F.array(same, replaced, inserted, deleted)).alias("x"))
    moved = moved.where("x IS NOT NULL").select("spelled", "backwards", "x.*", F.col("child").alias("node"), "ends", "onward")
    # an edit is left over, or it deletes the word's last letter
    done = ((F.col("edits") == 1) & (F.col("at") == size)) | ((F.col("edits") == 0) & (F.col("at") == size - 1))
    moved = moved.withColumn("arrived", F.col("ends") & done)
    # what can't go on: no edge leads on, or, after the edit, none with the next letter
    wanted = F.substring("spelled", F.col("at") + 1, F.lit(1))
    goes_on = F.when(F.col("edits") == 0, F.col("onward") != "").otherwise((F.col("at") < size) & F.col("onward").contains(wanted))
    return moved.withColumn("goes_on", goes_on).where("goes_on OR arrived").drop("onward", "ends")


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, near)``: every pair of distinct words one inserted, deleted or replaced code point apart, both ways.

    The number of levels is the largest number of branchings and words on one path; each level's frontier is a table.
    """
    walks, edges = trie(words)
    states = walks.drop("end").withColumn("edits", F.lit(0))
    found = None
    while True:
        level = written(_level(states, edges), "frontier")
        own = level.where("arrived").select("spelled", "backwards", "node")
        found = own if found is None else found.unionByName(own)
        states = level.where("goes_on").drop("arrived", "goes_on")
        if states.isEmpty():
            break

    def forwards(word: str) -> Column:
        return F.when(F.col("backwards"), F.reverse(word)).otherwise(F.col(word))

    found = found.distinct().join(walks.select(F.col("end").alias("node"), F.col("spelled").alias("near")), "node")
    return written(found.select(forwards("spelled").alias("word"), forwards("near").alias("near")).distinct(), "neighbours")


def group_forms(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a table of distinct ``word`` with its count ``n``.

    ``form`` is the near word with the largest count, the smallest in code-point order of equal ones, if that count is at
    least twice the word's; ``root`` the last word that following forms reaches.  Counts double along the way, so the way
    is short, and it is halved each round.  Null and empty words are ignored; an empty table gives an empty one.
    """
    words = written(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("x"), "near")).alias("best"))
    best = words.join(best, "word", "left")
    form_n = -F.col("best.x")
    good = form_n >= 2 * F.col("n")
    best = best.select(
        "word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, form_n).alias("form_n")
    )
    best = written(best, "forms")
    links = best.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onwards = links.select(F.col("word").alias("root"), F.col("root").alias("last"))
        jumped = links.join(onwards, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved"))
        links = written(jumped, "roots")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    rooted = best.join(links.select("word", "root"), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, one_in: int = ALTERED, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``group_forms`` of the ``vocabulary`` of ``documents(doc_id, text)``.

    Runs of letters up to U+00FF are words, A-Z in lower case.  One in ``one_in`` (document, run) pairs loses a letter, as
    ``altered`` says (none if it is zero); a null doc_id alters nothing.  Null and empty texts have no words; long texts
    are read whole; repeated rows count each; other columns are ignored; an empty table gives an empty one.
    """
    return group_forms(vocabulary(documents, one_in, min_chars, min_count))
