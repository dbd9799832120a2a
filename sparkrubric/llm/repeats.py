"""Substring dedup by seed and extend.

Documents meet on anchors: of every run of ``WINNOW`` overlapping word grams the one with the smallest hash.  A window of
``min_words`` words holds one such run, so equal windows have their anchor at the same place.  An anchor answers for the
windows that chose it; together they are the longest stretch, left and right of the anchor, in which a match that it seeds
can end.  Occurrences whose whole stretch is equal are one class, and a class is settled by its smallest document.  Where
an anchor has several classes, the match is extended both ways: the windows of each class's first document are compared
one by one.  A window that starts in a smaller document too is a repeat; overlapping repeats are maximal stretches that
go as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.storage import discard, ready_for_python, written

GRAM = 16
#: Low bits of a winnowing key that hold the place, so that the leftmost of equal hashes is chosen.
PLACE = np.uint64((1 << 32) - 1)
BASE = 0x9E3779B97F4A7C15
SHIFTS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in SHIFTS:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 to the 64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            factors = np.full((2, size), BASE, np.uint64)
            factors[1] = pow(BASE, -1, 1 << 64)
            factors[:, 0] = 1
            self.up, self.down = np.multiply.accumulate(factors, axis=1)
        return self.up, self.down


_POWERS = _Powers()


class WordHashes:
    """Hashes of any stretch of a text's words, from one running sum."""

    def __init__(self, words: list[bytes]) -> None:
        digest = xxhash.xxh64_intdigest
        marks = np.array([digest(w) for w in words], np.uint64)
        self.up, self.down = _POWERS.get(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(marks * self.up[: len(words)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def anchors(words: list[bytes], min_words: int, gram: int = GRAM) -> np.ndarray | None:
    """Columns ``anchor, stretch, low, high``: hash of the anchor, hash of its stretch, its first and last window."""
    n_windows = len(words) - min_words + 1
    if n_windows < 1:
        return None
    hashes = WordHashes(words)
    places = np.arange(len(words) - gram + 1)
    grams = hashes.of(places, places + gram)
    run = min_words - gram + 1
    least = (grams & ~PLACE) | places.astype(np.uint64)
    size = 1
    while 2 * size <= run:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < run:
        least = np.minimum(least[: n_windows], least[run - size : run - size + n_windows])
    chosen = (least & PLACE).astype(np.int64)
    low = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    high = np.r_[low[1:], n_windows] - 1
    place = chosen[low]
    stretch = _mixed(hashes.of(low, high + min_words) + (place - low).astype(np.uint64))
    return np.stack([grams[place].view(np.int64), stretch.view(np.int64), low, high])


OCCURRENCES = "id long, key long, anchor long, stretch long, low int, high int"


def _occurrences(min_words: int):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(x).to_numpy(zero_copy_only=False) for x in ("id", "key")), batch.column("text").cast(pa.binary()), strict=True)
            parts = []
            for doc_id, key, text in rows:
                found = anchors((text.as_py() or b"").split(), min_words)
                if found is not None:
                    parts.append(np.vstack([np.full((1, found.shape[1]), doc_id), np.full((1, found.shape[1]), key), found]))
            columns = np.concatenate(parts, axis=1) if parts else np.empty((6, 0), np.int64)
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c.astype(np.int32)) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in OCCURRENCES.split(", ")])

    return occurrences


def _windows(min_words: int):
    """The hashes of the windows that are asked for: ``spans`` holds their first and last places."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "key")
        for batch in batches:
            ids, keys, hashes, places = [], [], [], []
            rows = zip(*(batch.column(x).to_pylist() for x in names), batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True)
            for doc_id, key, text, spans in rows:
                of = WordHashes(text.as_py().split())
                starts = np.concatenate([np.arange(s["low"], s["high"] + 1) for s in spans.as_py()])
                hashes.append(of.of(starts, starts + min_words).view(np.int64))
                places.append(starts.astype(np.int32))
                ids.append(np.full(len(starts), doc_id, np.int64))
                keys.append(np.full(len(starts), key, np.int64))
            if ids:
                arrays = [pa.array(np.concatenate(x)) for x in (ids, keys, hashes, places)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "window", "low"])

    return windows


def repeats(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """``(id, key, low, high)``: places of windows of ``documents(id, key, text)`` that start in a smaller document too."""
    texts = documents.select("id", "key", "text")
    seeds = written(texts.mapInArrow(_occurrences(min_words), OCCURRENCES), "occurrences")
    shared = seeds.groupBy("anchor").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.min("stretch").alias("a"), F.max("stretch").alias("b")
    )
    shared = shared.where("first < last").select("anchor", "first", (F.col("a") == F.col("b")).alias("one"))
    shared = written(shared, "anchors")
    met = written(seeds.join(shared, "anchor"), "seeds")
    discard(seeds)

    settled = met.where("one AND id > first").select("id", "key", "low", "high")
    several = met.where("NOT one").drop("one", "first")
    classes = several.groupBy("anchor", "stretch").agg(F.min("id").alias("first"))
    several = written(several.join(written(classes, "classes"), ["anchor", "stretch"]), "several")
    settled = settled.unionByName(several.where("id > first").select("id", "key", "low", "high"))

    asked = several.where("id = first").groupBy("id", "key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    asked = written(asked, "asked")
    texts = documents.mapInArrow(_only(marked(asked), True), "id long, key long, text string").join(asked, ["id", "key"])
    windows = texts.select("id", "key", "text", "spans").mapInArrow(_windows(min_words), "id long, key long, window long, low int")
    windows = written(windows, "windows")
    first = written(windows.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"), "first")
    later = windows.join(first, "window").where("id > first").select("id", "key", "low", F.col("low").alias("high"))
    return written(settled.unionByName(later), "repeats")


#: Bits of the filter that says which rows can't have an entry: one megabyte at any size of the data.
FILTER_BITS = 1 << 23


def marked(rows: DataFrame) -> np.ndarray:
    """A bit for each ``(id, key)`` of ``rows``, set by hash, as one array of ``FILTER_BITS`` bits."""
    bit = F.pmod(F.xxhash64("id", "key"), F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from one
    parts = rows.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("n"))
    parts = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS, bool)
    for part in parts:
        own = np.unpackbits(np.frombuffer(part["bits"], np.uint8), bitorder="little")
        bits[(part["n"] - 1) * len(own) :][: len(own)] = own
    return np.packbits(bits)


def _only(bits: np.ndarray, having: bool):
    """Rows whose bit is set, or those whose bit is not: the latter are surely without an entry."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(bits).astype(bool)
        for batch in batches:
            where = batch.column("bit").to_numpy(zero_copy_only=False)
            mask = flags[where] == having
            yield batch.filter(pa.array(mask)).select(["id", "key", "text"])

    return only


KEPT = "id long, n_words long, n_removed long, text string"
NO_ID = (1 << 63) - 1


def without(words: list[bytes], spans: list[dict], min_words: int) -> list[bytes]:
    """The words that no window of ``spans`` covers."""
    edges = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        edges[span["low"]] += 1
        edges[span["high"] + min_words] -= 1
    return [w for w, covered in zip(words, np.cumsum(edges)[:-1].tolist(), strict=True) if not covered]


def _kept(min_words: int, bits: np.ndarray | None):
    """With ``bits``: only the rows that surely have no spans."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if bits is None else np.unpackbits(bits).astype(bool)
        for batch in batches:
            if flags is not None:
                batch = batch.filter(pa.array(~flags[batch.column("bit").to_numpy(zero_copy_only=False)]))
            spans = [None] * len(batch) if flags is not None else batch.column("spans").to_pylist()
            sizes, removed, left = [], [], []
            for text, own in zip(batch.column("text").cast(pa.binary()), spans, strict=True):
                words = (text.as_py() or b"").split()
                rest = without(words, own, min_words) if own else words
                sizes.append(len(words))
                removed.append(len(words) - len(rest))
                left.append(b" ".join(rest))
            counts = [pa.array(x, pa.int64()) for x in (sizes, removed)]
            columns = [batch.column("id"), *counts, pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in KEPT.split(", ")])

    return kept


def drop_repeats(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)`` of every row of ``documents(doc_id, text)``: ``text`` is the words that are
    left, joined by spaces.

    Words are what ASCII white space separates.  A word goes if a window of ``min_words`` words covers it whose words
    start, in this order, in a document with a smaller doc_id too; windows are judged on the input.  A null text has no
    words.  A null doc_id counts as the largest.  Rows with one doc_id take nothing from each other.  Other columns are
    ignored; an empty table gives an empty one.
    """
    ready_for_python(documents.sparkSession)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = documents.select(own.alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string"))
    rows = rows.withColumn("bit", F.pmod(F.xxhash64("id", "key"), F.lit(FILTER_BITS)).cast("int"))
    spans = repeats(rows, min_words).groupBy("id", "key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = written(spans, "spans")
    bits = marked(spans)
    # most rows are known to have no repeats without a shuffle of their texts
    clean = rows.mapInArrow(_kept(min_words, bits), KEPT)
    rest = rows.mapInArrow(_only(bits, True), "id long, key long, text string").join(spans, ["id", "key"], "left")
    cut = rest.select("id", "text", "spans").mapInArrow(_kept(min_words, None), KEPT)
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    return clean.unionByName(cut).select(doc_id, "n_words", "n_removed", "text")
