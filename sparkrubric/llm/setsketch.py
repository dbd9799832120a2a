"""Near copies by SetSketch: registers of exponentially spaced, truncated minima.

Register ``i`` of a set is ``max(0, min(Q + 1, floor(1 - log_B h)))`` for the smallest of its elements' exponential values
``h`` of rate ``A``.  Sketches merge by the larger register; two sets agree on a register about as often as their
similarity.  Texts that agree on all registers of a band share a bucket; the registers' comparison gives the similarity's
likelihood, sizes being known, and what is not ruled out by far is verified on the full sets.

A bucket's texts are compared with a few leaders first; only texts that no chain of links joins by then are compared with
each other, in cells of two chunks, so neither a task nor a row holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.components import components
from sparkrubric.llm.repeats import FILTER_BITS, marked
from sparkrubric.llm.similar import shingles
from sparkrubric.llm.storage import ready_for_python, written

#: Base, rate and largest value of a register; at this base a register agrees hardly more often than the sets do.
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: At 0.85, a pair shares no band of 32 in four cases of a million; at 0.9, in one of a billion.
BANDS, ROWS = 32, 7
REGISTERS = BANDS * ROWS
#: A pair is ruled out if the least similarity wanted is less likely than the likeliest one by more than this (in nats):
#: so far from the truth lies the estimate in one case of ten million.
FAR = 14.0
LEADERS = 3
CHUNK, CHUNK_SHINGLES = 512, 1 << 18
SHINGLES_AT_ONCE = 1 << 12
PAIRS_AT_ONCE = 1 << 13
NO_ID = (1 << 63) - 1

_RNG = np.random.default_rng(85)
_ODD = _RNG.integers(0, 1 << 64, (2, REGISTERS), np.uint64, endpoint=False) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, (2, REGISTERS), np.uint64, endpoint=False) | np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of unsigned 64-bit hashes; an empty set has zeros."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE, None] * _ODD[0] + _ODD[1]
        np.minimum(least, part.min(axis=0), out=least)
    # the smallest exponential value belongs to the smallest uniform one
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(smallest) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A bucket for each band of registers."""
    mixed = (registers.astype(np.uint64) + np.uint64(1)) * _BAND[0] ^ _BAND[1]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _BAND[0]
    return mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _larger(x: np.ndarray) -> np.ndarray:
    """The probability that a register is strictly larger, given the excess share of its set."""
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def likelihood(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, share: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Log likelihood of a similarity, given how many registers of the first set are larger, smaller and equal, and
    ``share``, the first set's part of the two sizes' sum."""
    up = _larger(np.maximum(share - (1 - share) * similarity, 1e-12))
    down = _larger(np.maximum(1 - share - share * similarity, 1e-12))
    same = np.maximum(1 - up - down, 1e-12)
    return larger * np.log(up) + smaller * np.log(down) + equal * np.log(same)


def estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest similarity: the likelihood is concave, so thirds close in on it."""
    share = n_a / (n_a + n_b)
    low, high = np.zeros(len(share)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(larger, smaller, equal, share, a) < likelihood(larger, smaller, equal, share, b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2


def fewest(least: float) -> float:
    """So many registers agree at a similarity of ``least``, but for one case in a trillion."""
    return REGISTERS * least - 7 * np.sqrt(REGISTERS * least * (1 - least))


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """For rows of registers: whether a similarity of ``least`` or more isn't ruled out."""
    fits = np.minimum(n_a, n_b) >= least * np.maximum(n_a, n_b) - 1e-9
    equal = (a == b).sum(axis=1)
    # few agreeing registers rule a pair out without the likelihood's search
    fits &= equal >= fewest(least)
    at = np.flatnonzero(fits)
    if len(at):
        counts = (a[at] > b[at]).sum(axis=1), (a[at] < b[at]).sum(axis=1), equal[at]
        sizes = n_a[at].astype(float), n_b[at].astype(float)
        share = sizes[0] / (sizes[0] + sizes[1])
        best = estimate(*counts, *sizes)
        wanted = np.minimum(np.maximum(best, least), np.minimum(*sizes) / np.maximum(*sizes))
        fits[at] = likelihood(*counts, share, best) - likelihood(*counts, share, wanted) <= FAR
    return fits


def _sketches(words_per_shingle: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, registers, buckets = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                whole, hashes = shingles(text.as_py(), words_per_shingle)
                own = sketch(hashes)
                nodes.append(whole)
                sizes.append(len(hashes))
                registers.append(own.tobytes() if len(hashes) else b"")
                buckets.append(band_keys(own) if len(hashes) else np.empty(0, np.int64))
            columns = [
                batch.column("doc_id"),
                batch.column("key"),
                pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()),
                pa.array(registers, pa.binary()),
                pa.array(buckets, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "n", "registers", "buckets"])

    return sketches


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(least: float):
    """Pairs that are worth a look at the full sets."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            mask = plausible(*(_registers(batch.column(c)) for c in ("registers_a", "registers_b")), *sizes, least)
            yield batch.filter(pa.array(mask)).select(["a", "b"])

    return likely


def _cells(percent: int):
    """Links between components within a cell: of its two sides, or of its one side.  Rows come sorted by cell.

    A pair is judged in the first band that it shares, by registers, likelihood and full sets in turn.  Of the links that
    join the same components one is enough, so a cell returns fewer links than it has rows.
    """
    least = percent / 100

    def links(columns: list) -> Iterator[pa.RecordBatch]:
        cell, side, *_ = columns
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        found: list[tuple[int, int]] = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            second = start + int((side[start:end] == 0).sum())
            found += cell_links([c[start:end] for c in columns[2:]], second - start)
        both = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def cell_links(columns: list, second: int) -> list[tuple[int, int]]:
        band, node, n, root, registers, members = columns
        pairs = []
        for i in range(second):
            first = second if second < len(node) else i + 1
            fits = (root[first:] != root[i]) & (n[first:] >= n[i] * least - 1e-6) & (n[first:] * least <= n[i] + 1e-6)
            far = first + np.flatnonzero(fits)
            equal = registers[far] == registers[i]
            earliest = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            far = far[(equal.sum(axis=1) >= fewest(least)) & (earliest == band[i])]
            pairs.append(np.stack([np.full(len(far), i), far]))
        one, other = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), int)
        good = np.zeros(len(one), bool)
        for at in range(0, len(one), PAIRS_AT_ONCE):
            part = slice(at, at + PAIRS_AT_ONCE)
            good[part] = plausible(registers[one[part]], registers[other[part]], n[one[part]], n[other[part]], least)
        one, other = one[good], other[good]

        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        found = []
        for i in np.unique(one).tolist():
            own = np.frombuffer(members[i], np.uint64)
            for j in other[one == i].tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x != y and _similar(own, np.frombuffer(members[j], np.uint64), percent):
                    parent[max(x, y)] = min(x, y)
                    found.append((int(node[i]), int(node[j])))
        return found

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list | None = None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(c).to_numpy() for c in ("cell", "side", "band", "node", "n", "root")]
            columns += [_registers(batch.column("registers")), np.array(batch.column("members").to_pylist(), object)]
            columns = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            rest = [c[cut:] for c in columns]
            if cut:
                yield from links([c[:cut] for c in columns])
        if rest is not None:
            yield from links(rest)

    return cells


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union."""
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(words_per_shingle: int, bits: np.ndarray):
    """The full set of each text whose bit is set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(bits).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(flags[batch.column("bit").to_numpy(zero_copy_only=False)]))
            found = [shingles(text.as_py(), words_per_shingle) for text in batch.column("text").cast(pa.binary())]
            nodes = pa.array(np.array([whole for whole, _ in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([nodes, pa.array([x.tobytes() for _, x in found], pa.binary())], ["node", "members"])

    return sets


def _verified(percent: int):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for a, b in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                mask.append(_similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent))
            yield batch.filter(pa.array(mask, pa.bool_())).select(["a", "b"])

    return verified


def _leader_pairs(buckets: DataFrame, least: float) -> DataFrame:
    """Each text with at most ``LEADERS`` leaders of its buckets."""
    leaders = [F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("x"), "node", "n")).alias(f"leader{step}") for step in range(LEADERS)]
    led = buckets.groupBy("bucket").agg(*leaders)
    # of its buckets' leaders of one order, a text is compared with the first: a group's texts mostly agree on it
    firsts = buckets.join(led, "bucket").groupBy("node", "n").agg(*[F.min(f"leader{step}").alias(f"leader{step}") for step in range(LEADERS)])
    pairs = firsts.select("node", "n", F.explode(F.array(*[f"leader{step}" for step in range(LEADERS)])).alias("leader")).where("node <> leader.node")
    pairs = pairs.where(F.least("n", "leader.n") >= F.lit(least) * F.greatest("n", "leader.n") - F.lit(1e-9))
    ends = [f(F.col("leader.node"), F.col("node")).alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
    return pairs.select(*ends).distinct()


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components, with the ``root`` of each."""
    members = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return members.join(mixed.select("bucket"), "bucket").select("bucket", "band", "node", "n", "root")


def _dealt(members: DataFrame) -> DataFrame:
    """The cells of each bucket: ``(cell, side, band, node, n, root)``.

    The component that most texts of a bucket belong to needs no comparison within, so a bucket's other texts are compared
    with each other and with those, chunk by chunk.  A chunk has about ``CHUNK`` texts and ``CHUNK_SHINGLES`` shingles.
    """
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("count"), F.sum("n").alias("shingles")).groupBy("bucket")
    sizes = sizes.agg(
        F.sum("count").alias("total"), F.sum("shingles").alias("all_shingles"), F.max(F.struct("count", "root", "shingles")).alias("main")
    )
    dealt = members.join(sizes, "bucket").withColumn("is_main", F.col("root") == F.col("main.root"))

    def chunks(rows: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(rows / F.lit(CHUNK), shingles / F.lit(CHUNK_SHINGLES))).cast("int")

    dealt = dealt.withColumn("n_main", chunks(F.col("main.count"), F.col("main.shingles")))
    dealt = dealt.withColumn("n_other", chunks(F.col("total") - F.col("main.count"), F.col("all_shingles") - F.col("main.shingles")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_other"))).cast("int"))

    def cell(kind: int, x: Column, y: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))

    own = F.col("own")
    with_main = F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda i: cell(1, i, own, F.lit(1)))
    with_other = F.transform(F.sequence(F.lit(0), F.col("n_other") - 1), lambda i: cell(0, F.least(i, own), F.greatest(i, own), i < own))
    of_main = F.transform(F.sequence(F.lit(0), F.col("n_other") - 1), lambda i: cell(1, own, i, F.lit(0)))
    places = F.when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_other))
    dealt = dealt.select("bucket", "band", "node", "n", "root", F.explode(places).alias("x"))
    return dealt.select(F.xxhash64("bucket", "x.kind", "x.x", "x.y").alias("cell"), F.col("x.side").alias("side"), "band", "node", "n", "root")


def _links(nodes: DataFrame, rows: DataFrame, words_per_shingle: int, percent: int) -> DataFrame:
    """``(node, root)`` of the linked nodes but the root itself."""
    least = percent / 100
    buckets = nodes.select("node", "n", F.posexplode("buckets").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").count().where("count > 1").select("bucket")
    buckets = written(buckets.join(shared, "bucket").select("bucket", "band", "node", "n"), "buckets")

    def sets(asked: DataFrame) -> DataFrame:
        """The full sets of some nodes: of the texts, only one for each of these is looked at."""
        bits = marked(asked.distinct().join(nodes.select("node", "first.*"), "node").select("id", "key"))
        found = rows.mapInArrow(_sets(words_per_shingle, bits), "node long, members binary")
        return written(found.dropDuplicates(["node"]), "sets")

    def both(pairs: DataFrame, table: DataFrame) -> DataFrame:
        """``pairs`` with the columns of ``table`` for either end."""
        for x in ("b", "a"):
            pairs = pairs.join(table.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in table.columns if c != "node"]), x)
        return pairs.select("a", "b", *[f"{c}_{x}" for c in table.columns if c != "node" for x in ("a", "b")])

    pairs = _leader_pairs(buckets, least)
    likely = both(pairs, nodes.select("node", "n", "registers")).mapInArrow(_likely(least), "a long, b long")
    likely = written(likely, "likely")
    found = both(likely, sets(likely.select(F.explode(F.array("a", "b")).alias("node")))).mapInArrow(_verified(percent), "a long, b long")
    found = written(found, "found")
    roots = written(components(found), "roots")
    members = written(_mixed(buckets, roots), "members")
    if members.isEmpty():
        return roots
    dealt = _dealt(members).join(nodes.select("node", "registers"), "node").join(sets(members.select("node")), "node")
    dealt = dealt.select("cell", "side", "band", "node", "n", "root", "registers", "members").repartition("cell")
    more = written(dealt.sortWithinPartitions("cell", "side").mapInArrow(_cells(percent), "a long, b long"), "more")
    return roots if more.isEmpty() else written(components(found.unionByName(more)), "roots")


def near_duplicates(documents: DataFrame, words_per_shingle: int = 5, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``documents(doc_id, text)``.

    A text's set holds its different runs of ``words_per_shingle`` words, A-Z in lower case; a shorter text is one run.
    Texts link if their sets share ``percent`` of their union or more; ``component_id`` is the smallest doc_id reachable,
    ``kept`` whether it is the row's own.  Texts with the same words are one class, so copies cost one row each.  Null,
    empty and blank texts have no set and link with nothing.  A repeated doc_id gives a row each time; a null one is never
    the smallest, its row isn't kept, and its component is null if it has null ids only.  Texts of any length are read whole;
    other columns are ignored; an empty table gives an empty one.
    """
    ready_for_python(documents.sparkSession)
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))
    schema = "doc_id long, key long, node long, n long, registers binary, buckets array<long>"
    marks = written(rows.mapInArrow(_sketches(words_per_shingle), schema), "marks")
    own_id = F.coalesce("doc_id", F.lit(NO_ID)).alias("id")
    nodes = marks.where("n > 0").groupBy("node").agg(
        F.min(F.struct(own_id, "key")).alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("buckets").alias("buckets")
    )
    nodes = written(nodes, "nodes")
    bit = F.pmod(F.xxhash64("id", "key"), F.lit(FILTER_BITS)).cast("int").alias("bit")
    placed = rows.select(own_id, "key", "text").select(bit, "text")
    roots = _links(nodes, placed, words_per_shingle, percent)
    grouped = nodes.select("node", F.col("first.id").alias("id")).join(roots, "node", "left")
    grouped = written(grouped.select("node", "id", F.coalesce("root", "node").alias("root")), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("id").alias("least"))
    known = written(grouped.join(smallest, "root").select("node", "least"), "known")
    found = marks.select("doc_id", "node", "n").join(known, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("least", F.lit(NO_ID)))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
