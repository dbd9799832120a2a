"""Exact top-k BM25 search: an inverted index for each shard, pruned dynamically by block maxima.

Documents are dealt to shards by hash.  A shard's postings carry an upper bound of their impact, and each term the largest
one in each block of ``BLOCK`` documents.  For a query, a block whose maxima together don't reach the current k-th score is
skipped as a whole.  Terms are ordered by the most that they can add; those before the pivot cannot lift a document over
that score together, so in the blocks that are left only documents with a term from the pivot on are candidates, and of
these only those whose bound reaches the threshold are scored.  Weights use statistics of all documents, so a shard's
scores are final and the shards' best merge exactly.

Where a shard has terms that lie in many of its documents, as prose does, whole texts as queries leave hardly a block to
skip.  What these terms add to every document is then taken for many queries at once, as a product of matrices; with the
lists of the other terms that bounds a document's score so closely that few more than ``k`` are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrubric.llm.storage import ready_for_python, written

TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
K1, B = 1.2, 0.75
BLOCK = 64
#: Bounds are held in single precision, rounded up, and summed in double precision; sums of ``n`` terms are off by at most
#: ``n * 2 ** -53`` of their size, so with this margin they stay bounds for texts of millions of different terms.
MARGIN = 1 + 1e-9
#: Up to so many terms of a shard, each in so many documents, are held as a matrix, and so many queries are multiplied with
#: it at a time.  Sums of so many products in single precision are off by less than this margin.
FREQUENT, FREQUENT_DOCUMENTS, TOGETHER = 384, 512, 64
SINGLE_MARGIN = 1 + 1e-4
FILTER_BITS = 1 << 23
TERMS_SCHEMA = "doc_id long, length int, terms array<long>, counts array<int>"


def text_terms(text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms, the different terms' hashes in ascending order, and how often each occurs."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(t) for t in TERM.findall((text or b"").lower())], np.uint64).view(np.int64)
    terms, counts = np.unique(hashes, return_counts=True)
    return len(hashes), terms, counts


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, all_terms, all_counts, ends = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
        for text in batch.column("text").cast(pa.binary()):
            n, own, counts = text_terms(text.as_py())
            lengths.append(n)
            all_terms.append(own)
            all_counts.append(counts)
            ends.append(ends[-1] + len(own))
        flat = [pa.array(np.concatenate(all_terms)), pa.array(np.concatenate(all_counts), pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in flat]
        columns = [batch.column("doc_id"), pa.array(lengths, pa.int32()), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "length", "terms", "counts"])


def _frequencies(bits: np.ndarray):
    """In how many rows of a batch each term lies, for terms whose bit is set."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(bits).astype(bool)
        for batch in batches:
            terms = batch.column("terms").flatten().to_numpy(zero_copy_only=False)
            terms, df = np.unique(terms[flags[terms & (FILTER_BITS - 1)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(df, pa.int64())], ["term", "df"])

    return frequencies


def _term_bits(queries: DataFrame) -> np.ndarray:
    """A bit for each term of the queries, by its low bits: one megabyte at any size of the data."""
    bit = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1  # Spark's bitmaps count from one
    parts = queries.select(F.explode("terms").alias("term")).select(bit.alias("bit"))
    parts = parts.groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(FILTER_BITS, bool)
    for part in parts.collect():
        own = np.unpackbits(np.frombuffer(part["bits"], np.uint8), bitorder="little")
        bits[(part["n"] - 1) * len(own) :][: len(own)] = own
    return np.packbits(bits)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one after another, and the ranges' lengths."""
    sizes = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()), sizes


class Shard:
    """Inverted index of some documents, with their own term lists to score candidates exactly."""

    def __init__(self, ids: list, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], mean_length: float) -> None:
        self.ids = ids
        self.norm = K1 * (1 - B + B * lengths / (mean_length or 1.0))
        self.ends = np.cumsum([0, *map(len, terms)])
        self.own_terms = np.concatenate([*terms, np.empty(0, np.int64)])
        self.own_counts = np.concatenate([*counts, np.empty(0, np.int32)])
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(self.ends))
        order = np.argsort(self.own_terms, kind="stable")
        flat, self.docs, tf = self.own_terms[order], docs[order], self.own_counts[order]
        del order, docs
        impacts = tf * (K1 + 1) / (tf + self.norm[self.docs])
        self.impacts = impacts.astype(np.float32)
        low = self.impacts < impacts
        self.impacts[low] = np.nextafter(self.impacts[low], np.float32(np.inf))
        del impacts, low
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, int)
        self.known, self.starts = flat[starts], np.r_[starts, len(flat)]
        self.most = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.empty(0, np.float32)
        blocks = self.docs // BLOCK
        change = np.r_[True, (flat[1:] != flat[:-1]) | (blocks[1:] != blocks[:-1])] if len(flat) else np.empty(0, bool)
        places = np.flatnonzero(change)
        self.block_of = blocks[places]
        self.block_most = np.maximum.reduceat(self.impacts, places) if len(places) else np.empty(0, np.float32)
        self.block_starts = np.searchsorted(places, self.starts)
        self.places = np.r_[places, len(flat)]
        self.n_blocks = -(-len(ids) // BLOCK)
        sizes = np.diff(self.starts) if len(flat) else np.empty(0, int)
        many = np.flatnonzero(sizes >= FREQUENT_DOCUMENTS)
        many = many[np.argsort(-sizes[many], kind="stable")[:FREQUENT]]
        #: By place in ``known``: the term's row in the matrix, or -1.
        self.row_of = np.full(len(self.known), -1, np.int32)
        self.row_of[many] = np.arange(len(many))
        self.frequent = np.zeros((len(many), len(ids)), np.float32)
        for row, at in enumerate(many.tolist()):
            own = slice(self.starts[at], self.starts[at + 1])
            self.frequent[row, self.docs[own]] = self.impacts[own]

    def _block_bounds(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that the terms ``at`` can add to a document, by block."""
        runs, sizes = _ranges(self.block_starts[at], self.block_starts[at + 1])
        return np.bincount(self.block_of[runs], self.block_most[runs] * np.repeat(weights, sizes), self.n_blocks)

    def _bounds(self, at: np.ndarray, weights: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """The most that the terms ``at`` add to each document; only blocks that are ``alive`` are read."""
        if alive is None:
            rows, sizes = _ranges(self.starts[at], self.starts[at + 1])
            return np.bincount(self.docs[rows], self.impacts[rows] * np.repeat(weights, sizes), len(self.ids))
        runs, sizes = _ranges(self.block_starts[at], self.block_starts[at + 1])
        kept = alive[self.block_of[runs]]
        runs, own = runs[kept], np.repeat(weights, sizes)[kept]
        rows, sizes = _ranges(self.places[runs], self.places[runs + 1])
        return np.bincount(self.docs[rows], self.impacts[rows] * np.repeat(own, sizes), len(self.ids))

    def score(self, doc: int, terms: np.ndarray, weights: np.ndarray) -> float:
        mine = slice(self.ends[doc], self.ends[doc + 1])
        own = self.own_terms[mine]
        if not len(own):
            return 0.0
        at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        hit = own[at] == terms
        tf = self.own_counts[mine][at[hit]]
        return float((weights[hit] * (tf * (K1 + 1) / (tf + self.norm[doc]))).sum())

    def find(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``known`` of the terms that the shard knows, and their weights."""
        if not len(self.known):
            return np.empty(0, int), weights[:0]
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        hit = self.known[at] == terms
        return at[hit], weights[hit]

    def tops(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """``top`` of several queries."""
        if not len(self.frequent):
            return [self.top(terms, weights, k) for terms, weights in queries]
        found = [self.find(terms, weights) for terms, weights in queries]
        matrix = np.zeros((len(queries), len(self.frequent)), np.float32)
        for i, (at, own) in enumerate(found):
            rows = self.row_of[at]
            matrix[i, rows[rows >= 0]] = own[rows >= 0]
        added = matrix @ self.frequent
        added *= np.float32(SINGLE_MARGIN)
        return [self._best(*query, *places, most, k) for query, places, most in zip(queries, found, added, strict=True)]

    def _best(self, terms: np.ndarray, weights: np.ndarray, at: np.ndarray, own: np.ndarray, added: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``top``, if ``added`` is the most that the terms of the matrix add to each document."""
        rare = self.row_of[at] < 0
        most = (self._bounds(at[rare], own[rare]) + added) * MARGIN
        n = min(k, len(most))
        best = np.argpartition(most, len(most) - n)[len(most) - n :]
        scored = {doc: self.score(doc, terms, weights) for doc in best.tolist() if most[doc] > 0}
        threshold = min(scored.values()) if len(scored) == k else 0.0
        docs = np.flatnonzero((most >= threshold) & (most > 0))
        for doc in docs[np.argsort(-most[docs])].tolist():
            if doc not in scored:
                if most[doc] < threshold:
                    break
                scored[doc] = self.score(doc, terms, weights)
                threshold = sorted(scored.values(), reverse=True)[k - 1] if len(scored) >= k else 0.0
        return self._ranked(scored, k)

    def _ranked(self, scored: dict[int, float], k: int) -> list[tuple[float, int]]:
        last = (1 << 63) - 1
        ranked = sorted((-s, last if self.ids[d] is None else self.ids[d], d) for d, s in scored.items() if s > 0)
        return [(-s, d) for s, _, d in ranked[:k]]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` best ``(score, document)`` with a score above zero, ties by id; ``terms`` ascend."""
        at, own = self.find(terms, weights)
        if not len(at):
            return []
        bound = own * self.most[at]
        order = np.argsort(bound)
        at, own, bound = at[order], own[order], bound[order]
        scored: dict[int, float] = {}

        def exact(docs: np.ndarray) -> float:
            for doc in docs.tolist():
                if doc not in scored:
                    scored[doc] = self.score(doc, terms, weights)
            return sorted(scored.values(), reverse=True)[k - 1] if len(scored) >= k else 0.0

        # a first threshold from the documents that the strongest terms point to
        sizes = self.starts[at + 1] - self.starts[at]
        strong = max(1, int(np.searchsorted(np.cumsum(sizes[::-1]), 64 * k)))
        first = self._bounds(at[-strong:], own[-strong:])
        least = min(k, len(first))
        threshold = exact(best[first[best] > 0]) if len(best := np.argpartition(-first, least - 1)[:least]) else 0.0

        pivot = int(np.searchsorted(np.cumsum(bound) * MARGIN, threshold))
        rest = self._block_bounds(at[:pivot], own[:pivot])
        alive = (rest + self._block_bounds(at[pivot:], own[pivot:])) * MARGIN >= threshold
        partial = self._bounds(at[pivot:], own[pivot:], None if alive.all() else alive)
        docs = np.flatnonzero(partial)
        most = (partial[docs] + rest[docs // BLOCK]) * MARGIN
        docs, most = docs[most >= threshold], most[most >= threshold]
        order = np.argsort(-most)
        docs, most = docs[order], most[order]
        for start in range(0, len(docs), 2 * k):
            if most[start] < threshold:
                break
            threshold = max(threshold, exact(docs[start : start + 2 * k]))
        return self._ranked(scored, k)


def _search(k: int, n: int, mean_length: float):
    names = ["query", "query_id", "doc_id", "score"]
    kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.float64())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: int | None = None
        index: Shard | None = None
        rows: list[tuple] = []
        asked: list[tuple] = []  # queries of the shard that are not answered yet

        def answers() -> pa.RecordBatch:
            tops = index.tops([(terms, weights) for _, _, terms, weights in asked], k)
            found = [(query, ident, index.ids[doc], score) for (query, ident, _, _), top in zip(asked, tops, strict=True) for score, doc in top]
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds_of)], names)

        for batch in batches:
            shards, kinds, ids, queries, lengths = (batch.column(c).to_pylist() for c in ("shard", "kind", "doc_id", "query", "length"))
            terms, counts = batch.column("terms"), batch.column("counts")
            for i in range(len(batch)):
                if shards[i] != shard:
                    if asked:
                        yield answers()
                    shard, index, rows = shards[i], None, []
                own, numbers = (x[i].values.to_numpy(zero_copy_only=False) for x in (terms, counts))
                if kinds[i] == 0:
                    rows.append((ids[i], lengths[i], own.copy(), numbers.copy()))
                    continue
                if index is None:
                    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                    rows = []
                    index = Shard(list(columns[0]), np.array(columns[1], float), columns[2], columns[3], mean_length)
                    del columns
                df = numbers.astype(float)
                asked.append((queries[i], ids[i], own.copy(), np.log1p((n - df + 0.5) / (df + 0.5))))
                if len(asked) == TOGETHER:
                    yield answers()
        if asked:
            yield answers()

    return searched


def search(documents: DataFrame, queries: DataFrame, k: int = 10, shard_documents: int = 16384) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the ``k`` best rows of ``documents(doc_id, text)`` for each row of
    ``queries(doc_id, text)``, whose whole text is the query; its different terms count once each.

    Terms are runs of ASCII letters, digits and bytes above ASCII, in lower case.  Equal scores rank by doc_id, null last.  Rows that share no
    term with a query are not listed for it; a query without terms lists none.  A null text reads as empty.  Each row of
    either table counts by itself, with a null or repeated doc_id too; other columns are ignored.
    """
    spark = documents.sparkSession
    ready_for_python(spark)
    asked = queries.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = asked.mapInArrow(_terms, TERMS_SCHEMA).where(F.size("terms") > 0)
    asked = written(asked.select(F.monotonically_increasing_id().alias("query"), "doc_id", "terms"), "queries")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(texts.mapInArrow(_terms, TERMS_SCHEMA), "terms")
    total = rows.agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
    n, mean_length = total["n"], (total["length"] or 0) / max(1, total["n"])

    # document frequencies of the queries' terms (and few others: the filter is by hash)
    frequency = rows.select("terms").mapInArrow(_frequencies(_term_bits(asked)), "term long, df long")
    frequency = written(frequency.groupBy("term").agg(F.sum("df").alias("df")), "frequency")
    pairs = asked.select("query", "doc_id", F.explode("terms").alias("term")).join(frequency, "term")
    pairs = pairs.groupBy("query").agg(
        F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("term", F.col("df").cast("int").alias("df")))).alias("pairs")
    )

    n_shards = max(1, -(-n // shard_documents))
    shard = F.pmod(F.xxhash64("doc_id", "length", "terms"), F.lit(n_shards)).cast("int")
    index_rows = rows.select(
        shard.alias("shard"), F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("long").alias("query"), "length", "terms", "counts",
    )
    query_rows = pairs.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(1).alias("kind"), "doc_id", "query",
        F.lit(None).cast("int").alias("length"), F.col("pairs.term").alias("terms"), F.col("pairs.df").alias("counts"),
    )
    dealt = index_rows.unionByName(query_rows).repartition("shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search(k, n, mean_length), "query long, query_id long, doc_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score")
