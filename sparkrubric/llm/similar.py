"""Near copies by Jaccard similarity: SimHash fingerprints and BK-trees find pairs of texts, their shingle sets decide.

A text's shingles are its runs of ``words_per_shingle`` words.  At a similarity of 0.8, 15 percent of two fingerprints' bits
differ, ten of 64; so shards are 200 blocks of 20 bits of a wide fingerprint, and a shard's BK-tree joins codes at
``RADIUS`` of 64 bits.  What part of the pairs at 0.8 that loses is in the README; no other pair is left out.

A bucket's texts are first compared with one of them, a few times over, and only texts that no chain of links has joined
by then are compared in pairs.  So a large group of near copies costs a few comparisons for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.components import components
from sparkrubric.llm.simhash import wide_buckets, wide_fingerprint
from sparkrubric.llm.storage import ready_for_python, written

#: Differing bits of two codes, up to which a BK-tree joins them.
RADIUS = 20
#: Rounds in which the texts of a bucket are compared with one of them.
STARS = 3
NO_ID = (1 << 63) - 1
PAIRS_AT_ONCE = 1 << 16


def shingles(text: bytes | None, words_per_shingle: int) -> tuple[int, np.ndarray]:
    """The hash of all words, and the sorted hashes of the different shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    whole = xxhash.xxh64_intdigest(joined, 42)
    if not words:
        return whole, np.empty(0, np.uint64)
    if len(words) < words_per_shingle:
        return whole, np.array([whole], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - words_per_shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=True)]
    return whole, np.unique(np.array(hashes, np.uint64))


def _signatures(words_per_shingle: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, sizes, codes, further = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                whole, hashes = shingles(text.as_py(), words_per_shingle)
                wholes.append(whole)
                sizes.append(len(hashes))
                code, bits = wide_fingerprint(hashes)
                codes.append(code)
                further.append(bits)
            columns = [
                batch.column("doc_id"),
                batch.column("key"),
                pa.array(np.array(wholes, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()),
                pa.array(np.array(codes, np.uint64).view(np.int64)),
                pa.array(further, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "n", "code", "further"])

    return signatures


def _cross(similarity: float):
    """Pairs of a bucket's texts in different components whose sizes and codes allow the similarity; rows come sorted by
    bucket."""

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0
        bucket = columns[0]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
        for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
            node, n, root, code = (c[start:end] for c in columns[1:])
            order = np.argsort(root, kind="stable")
            node, n, root, code = node[order], n[order], root[order], code[order].view(np.uint64)
            others = np.searchsorted(root, root, side="right")
            for i in range(end - start):
                far = slice(others[i], None)
                fits = np.minimum(n[far], n[i]) >= similarity * np.maximum(n[far], n[i]) - 1e-9
                fits &= np.bitwise_count(code[far] ^ code[i]) <= RADIUS
                partners = node[far][fits]
                found.append(np.stack([np.full(len(partners), node[i]), partners]))
                held += len(partners)
                if held >= PAIRS_AT_ONCE:
                    yield batch(found)
                    found, held = [], 0
        if held:
            yield batch(found)

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both.min(axis=0)), pa.array(both.max(axis=0))], ["a", "b"])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 5
        for batch in batches:
            columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            rest = [c[cut:] for c in columns]
            if cut:
                yield from pairs([c[:cut] for c in columns])
        if len(rest[0]):
            yield from pairs(rest)

    return cross


def _sets(words_per_shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words_per_shingle)[1].tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "held"])

    return sets


def _similar(similarity: float):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for held_a, held_b in zip(batch.column("held_a"), batch.column("held_b"), strict=True):
                own, other = (np.frombuffer(x.as_buffer(), np.uint64) for x in (held_a, held_b))
                both = len(np.intersect1d(own, other, assume_unique=True))
                mask.append(both >= similarity * (len(own) + len(other) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return similar


def _links(nodes: DataFrame, documents: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame | None:
    """``(node, root)`` of the linked nodes, or none.  ``nodes`` has ``node, first, n, code, further``."""
    # texts without a word meet no other
    shared = written(wide_buckets(nodes.where("n > 0"), RADIUS), "shared")
    held = nodes.where("n > 0").select("node", "n", "code")
    buckets = written(shared.join(held, "code").select("bucket", "node", "n", "code"), "buckets")
    compared = nodes.join(buckets.select("node").distinct(), "node").select("node", "first.*")
    compared = compared.select("node", F.col("id").alias("of"), F.col("key").alias("of_key"))
    text = F.col("text").cast("string")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    rows = rows.join(compared, (F.col("id") == F.col("of")) & (F.xxhash64("text") == F.col("of_key")))
    texts = rows.select("node", "text").dropDuplicates(["node"])
    sets = written(texts.mapInArrow(_sets(words_per_shingle), "node long, held binary"), "sets")

    edges = tested = roots = None
    for step in range(STARS + 1):
        members = buckets.withColumn("root", F.col("node"))
        if roots is not None:
            members = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        members = written(members.join(mixed.select("bucket"), "bucket").select("bucket", "node", "n", "root", "code"), "members")
        if step < STARS:
            leader = F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("x"), "node", "n", "root", "code")).alias("leader")
            pairs = members.join(members.groupBy("bucket").agg(leader), "bucket").where("root <> leader.root")
            small, large = F.least("n", "leader.n"), F.greatest("n", "leader.n")
            pairs = pairs.where(small >= F.lit(similarity) * large - F.lit(1e-9))
            pairs = pairs.where(F.bit_count(F.col("code").bitwiseXOR(F.col("leader.code"))) <= RADIUS)
            # the leader comes first: it is the one that many pairs share
            pairs = pairs.select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
        else:
            dealt = members.repartition("bucket").sortWithinPartitions("bucket")
            pairs = dealt.mapInArrow(_cross(similarity), "a long, b long")
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            if step < STARS:
                continue
            break
        turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        tested = pairs.unionByName(turned) if tested is None else tested.unionByName(pairs).unionByName(turned)
        # the join on b is the last: a is the one that many pairs share, and b spreads the comparisons
        joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("held_a")), "a")
        joined = joined.join(sets.select(F.col("node").alias("b"), F.col("held").alias("held_b")), "b")
        found = joined.select("a", "b", "held_a", "held_b").mapInArrow(_similar(similarity), "a long, b long")
        found = written(found, "found")
        edges = found if edges is None else edges.unionByName(found)
        roots = written(components(edges), "roots")
    return roots


def near_copies(documents: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, key, component)`` of every row of ``documents(doc_id, text)``: ``key`` is the text's ``xxhash64``, and
    rows have one ``component`` if a chain of texts at ``similarity`` or more connects them.

    Texts with the same words, whatever their case and spaces, are one class, so copies cost one row each; texts without
    a word are one class as well.  Other columns are ignored; an empty table gives an empty one.
    """
    ready_for_python(documents.sparkSession)
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))
    marks = rows.mapInArrow(_signatures(words_per_shingle), "doc_id long, key long, node long, n long, code long, further binary")
    marks = written(marks, "marks")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key")).alias("first")
    same = [F.first(c).alias(c) for c in ("n", "code", "further")]  # all rows of a node have the same words
    nodes = marks.groupBy("node").agg(first, *same)
    roots = _links(written(nodes, "nodes"), documents, words_per_shingle, similarity)
    if roots is None:
        return marks.select("doc_id", "key", F.col("node").alias("component"))
    return marks.join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("component"))
