"""Ranked lexical search over bags of words: documents that look alike to the items are scored once.

A document is restricted to the items' vocabulary.  What is left of it, term frequencies and the length class ``m``, decides
its score for every item, so documents with the same frequencies and ``m`` form a class.  Classes are found by grouping on
the whole vector (the hash of a group key only deals the rows; equality of the vector decides), scored once against all
items, and only the best classes of an item are expanded into members, by ascending doc_id.  All sums are integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrubric.llm.storage import ready_for_python, written

#: On lower-cased UTF-8: ASCII letters, digits, and everything above ASCII.
TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Items of a block come to the driver and to every task: at most about so many bytes of text and so many items.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 1 << 16
#: Items that a task scores at a time, and the largest sum that double precision holds exactly.
ITEMS_AT_ONCE = 128
EXACT = 1 << 53
NO_ID = (1 << 63) - 1
PAIR = np.dtype([("term", "<i4"), ("tf", "<i4")])


def frequencies(text: bytes | None) -> Counter[bytes]:
    """How often each term occurs in a UTF-8 text; only A-Z are lower-cased."""
    return Counter(TERM.findall((text or b"").lower()))


def _bags(vocabulary: dict[bytes, int]):
    """The number of terms of each text, and the frequencies of its vocabulary terms, in order of the vocabulary."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.get
        for batch in batches:
            lengths, vectors = [], []
            for text in batch.column("text").cast(pa.binary()):
                counts = frequencies(text.as_py())
                own = sorted((at, tf) for term, tf in counts.items() if (at := place(term)) is not None)
                lengths.append(counts.total())
                vectors.append(np.array(own, PAIR).tobytes())
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "vector"])

    return bags


def _document_counts(size: int):
    """In how many rows of a task each vocabulary term lies."""

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            joined = b"".join(batch.column("vector").to_pylist())
            held += np.bincount(np.frombuffer(joined, PAIR)["term"], minlength=size)
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(held[terms])], ["term", "df"])

    return document_counts


class ItemBlock:
    """Some items as weighted terms: a matrix of their own terms by items."""

    def __init__(self, items: list[dict[int, int]]) -> None:
        """``items`` map a term's place to its weight in the item, repeats counted."""
        self.terms = np.array(sorted({t for item in items for t in item}), np.int64)
        at = {t: n for n, t in enumerate(self.terms.tolist())}
        exact = all(sum(item.values()) * 1_000_000 < EXACT for item in items)
        self.weights = np.zeros((len(at), len(items)), np.float64 if exact else np.int64)
        for n, item in enumerate(items):
            for term, weight in item.items():
                self.weights[at[term], n] = weight

    def scores(self, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_rows: int) -> np.ndarray:
        """Whole-numbered scores, one row for each bag; an impact is below 1,000,000, so doubles add them exactly."""
        if not len(self.terms):
            return np.zeros((n_rows, self.weights.shape[1]), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        dense = np.zeros((n_rows, len(self.terms)), self.weights.dtype)
        dense[rows[hit], at[hit]] = impacts[hit]
        return (dense @ self.weights).astype(np.int64)


def _best(items: list[dict[int, int]], k: int):
    """The ``k`` best classes of each item among a task's classes; equal scores by the smallest member."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [ItemBlock(items[at : at + ITEMS_AT_ONCE]) for at in range(0, len(items), ITEMS_AT_ONCE)]
        kept: list[list[tuple]] = [[] for _ in items]  # (-score, first, m, vector), ascending
        least = np.ones(len(items), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            vectors = batch.column("vector").to_pylist()
            first, m = (batch.column(c).to_numpy() for c in ("first", "m"))
            pairs = np.frombuffer(b"".join(vectors), PAIR)
            rows = np.repeat(np.arange(len(vectors)), [len(v) // PAIR.itemsize for v in vectors])
            tf = pairs["tf"].astype(np.int64)
            impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])
            for n, block in enumerate(blocks):
                found = block.scores(rows, pairs["term"], impacts, len(vectors))
                low = least[n * ITEMS_AT_ONCE :][: found.shape[1]]
                for column in np.flatnonzero((found >= low).any(axis=0)).tolist():
                    item, scores = n * ITEMS_AT_ONCE + column, found[:, column]
                    good = np.flatnonzero(scores >= least[item])
                    good = good[np.lexsort((first[good], -scores[good]))[:k]]
                    own = [(-int(scores[i]), int(first[i]), int(m[i]), vectors[i]) for i in good]
                    kept[item] = sorted(kept[item] + own)[:k]
                    if len(kept[item]) == k:
                        least[item] = -kept[item][-1][0]
        for start in range(0, len(kept), ITEMS_AT_ONCE):
            found = [(start + n, -s, *rest) for n, own in enumerate(kept[start : start + ITEMS_AT_ONCE]) for s, *rest in own]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "score", "first", "m", "vector"])

    return best


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def _search_block(bags: DataFrame, counts: list[Counter[bytes]], vocabulary: dict[bytes, int], k: int) -> DataFrame | None:
    """``(item, doc_id, score)``: at least the ``k`` best documents of each item of a block, by its place in ``counts``."""
    total = bags.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("length")).first()
    n_documents, length = total["n"], total["length"] or 0
    if not length:
        return None
    found = bags.select("vector").mapInArrow(_document_counts(len(vocabulary)), "term long, df long")
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    items = [{vocabulary[t]: weight(n_documents, df.get(vocabulary[t], 0)) * tf for t, tf in own.items()} for own in counts]

    m = F.lit(25) + F.expr(f"(75 * n * {n_documents}L) div {length}L")
    rows = bags.where(F.length("vector") > 0).select("vector", m.cast("long").alias("m"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    classes = rows.groupBy("m", "vector").agg(F.min("id").alias("first"))
    found = classes.select("first", "m", "vector").mapInArrow(_best(items, k), "item long, score long, first long, m long, vector binary")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "first")
    chosen = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    chosen = written(chosen, "classes")

    # members of the chosen classes: the hash finds them, the whole vector confirms; k of a class are enough
    key = F.xxhash64("m", "vector").alias("key")
    keys = chosen.select(key).distinct()  # at most k * BLOCK_ITEMS longs
    of_class = Window.partitionBy("key", "m", "vector").orderBy("id")
    members = rows.select("id", "m", "vector", key).join(F.broadcast(keys), "key", "left_semi")
    members = members.withColumn("place", F.row_number().over(of_class)).where(F.col("place") <= k).select("id", "m", "vector")
    expanded = chosen.join(members, ["m", "vector"])
    return expanded.select("item", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")


def search(documents: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best rows of ``documents(doc_id, text)`` for each row of
    ``items(item_id, text)``.

    Terms are runs of ASCII letters, digits and characters above ASCII, A-Z in lower case.  N documents hold a term, L terms
    in all; a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 25 + 75 n N div L, and its score the
    sum of weight * (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included.  Equal scores rank by ascending
    doc_id, null last.  Only scores above zero are listed, so an item without a known term has no rows, and neither has an
    empty table of either kind.  Null and empty texts have no terms.  Each row of either table counts by itself, with a null
    or repeated id too; other columns are ignored.  Texts of any length are read whole.

    Items are dealt to blocks of about ``block_bytes`` of text; a block comes to every task, and costs one pass over the
    documents.  Documents, classes and members stay distributed.
    """
    spark = documents.sparkSession
    ready_for_python(spark)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = items.select(F.monotonically_increasing_id().alias("row"), "item_id", F.col("text").cast("string").alias("text"))
    asked = written(asked.where("text IS NOT NULL"), "items")
    size = asked.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    n_blocks = max(1, -(-(size["bytes"] or 0) // block_bytes), -(-size["n"] // BLOCK_ITEMS))
    out = None
    for n in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == n).select("row", "text").collect()
        counts = [frequencies(r["text"].encode()) for r in block]
        vocabulary = {t: at for at, t in enumerate(sorted({t for own in counts for t in own}))}
        if not vocabulary:
            continue
        bags = written(texts.mapInArrow(_bags(vocabulary), "doc_id long, n long, vector binary"), "bags")
        found = _search_block(bags, counts, vocabulary, k)
        if found is None:
            continue
        places = spark.createDataFrame([(at, r["row"]) for at, r in enumerate(block)], "item long, row long")
        found = found.join(places, "item").select("row", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
