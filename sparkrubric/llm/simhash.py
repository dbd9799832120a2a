"""Near-duplicate documents: SimHash fingerprints linked through BK-trees.

Fingerprints are 64-bit majority votes over the XXH64 hashes of 3-word shingles.  Two fingerprints that differ in at most
three bits agree on one of any four disjoint blocks of bits, so each distinct fingerprint goes to four shards, one for
each block value, and a BK-tree finds the links of a shard.  A shard above ``shard_limit`` fingerprints is dealt again by
four blocks of its remaining bits.  Trees are built where their shard's rows land: all trees together grow with the data,
so broadcasting them would have no size bound.

For a wide radius (``wide_buckets``), where no four blocks hold a link, the same votes are taken on further bits made of
the same hashes; 200 blocks of 20 of those bits are the shards, and the BK-tree of a shard finds what lies near in the code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.components import components
from sparkrubric.llm.storage import ready_for_python, written

#: Bits of a code at each refinement, and the width of its four blocks.
LEVELS = ((64, 16), (48, 12), (36, 9))
HASHES_AT_ONCE = 1 << 16
#: Words of 64 bits in a wide fingerprint (the first is the code), and the blocks that are drawn from the others.
WIDE, BLOCKS, BLOCK_BITS = 24, 200, 20
WIDE_AT_ONCE = 1 << 12
SHARD_ROWS_AT_ONCE = 1 << 16

_DRAWN = np.random.default_rng(42)
_ODD = _DRAWN.integers(0, 1 << 64, (2, WIDE - 1), np.uint64, endpoint=False) | np.uint64(1)
#: Blocks of one permutation share no bit.
_PLACES = np.concatenate([_DRAWN.permutation(64 * (WIDE - 1))[: 50 * BLOCK_BITS].reshape(50, -1) for _ in range(BLOCKS // 50)])


def fingerprint(text: bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a UTF-8 text; zero if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - words_per_shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    codes = np.array(hashes, dtype="<u8")
    for at in range(0, len(codes), HASHES_AT_ONCE):
        part = codes[at : at + HASHES_AT_ONCE].view(np.uint8)
        votes += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(codes), bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, bytes]:
    """The code of a text by the hashes of its shingles, and its further bits."""
    votes = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), WIDE_AT_ONCE):
        part = hashes[at : at + WIDE_AT_ONCE, None]
        more = part * _ODD[0] + _ODD[1]
        more ^= more >> np.uint64(32)
        more *= _ODD[1]
        more ^= more >> np.uint64(29)
        bits = np.unpackbits(np.hstack([part, more]).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):
            votes += bits[row : row + 255].sum(axis=0, dtype=np.uint8)
    packed = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(packed[:8].view("<u8")[0]), packed[8:].tobytes()


def block_values(further: list[bytes]) -> np.ndarray:
    """A row for each text: the values of the blocks of its further bits."""
    packed = np.frombuffer(b"".join(further), np.uint8).reshape(len(further), 8 * (WIDE - 1))
    bits = np.unpackbits(packed, axis=1, bitorder="little")
    values = np.zeros((len(further), BLOCKS), np.int64)
    for bit in range(BLOCK_BITS):
        values |= bits[:, _PLACES[:, bit]].astype(np.int64) << bit
    return values


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        codes = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        columns = [batch.column("doc_id"), batch.column("key"), pa.array(codes.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "code"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``(doc_id, key, code)`` of every document: the text's ``xxhash64``, and the fingerprint's bits as a long."""
    ready_for_python(documents.sparkSession)
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, key long, code long")


class BKTree:
    """Codes in a tree whose edges carry the Hamming distance of child to parent."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parents: list[int] = []
        #: Codes at a node and below it that ``take`` hasn't taken.
        self.live: list[int] = []
        self.taken: list[bool] = []

    def add(self, code: int) -> int:
        at = len(self.codes)
        self.codes.append(code)
        self.children.append({})
        self.live.append(1)
        self.taken.append(False)
        node = -1
        if at:
            node = 0
            while (d := (code ^ self.codes[node]).bit_count()) in self.children[node]:
                self.live[node] += 1
                node = self.children[node][d]
            self.live[node] += 1
            self.children[node][d] = at
        self.parents.append(node)
        return at

    def within(self, code: int, radius: int) -> list[int]:
        """Places of the codes at ``radius`` or less: only edges whose distance can lead there are followed."""
        found, stack = [], [0] if self.codes else []
        while stack:
            node = stack.pop()
            d = (code ^ self.codes[node]).bit_count()
            if d <= radius:
                found.append(node)
            stack += [child for edge, child in self.children[node].items() if d - radius <= edge <= d + radius]
        return found


    def take(self, code: int, radius: int) -> list[int]:
        """As ``within``, for codes that aren't taken yet; they are taken now.  Branches without any left are passed by."""
        found, stack = [], [0] if self.codes and self.live[0] else []
        while stack:
            node = stack.pop()
            d = (code ^ self.codes[node]).bit_count()
            if d <= radius and not self.taken[node]:
                found.append(node)
            stack += [child for edge, child in self.children[node].items() if self.live[child] and d - radius <= edge <= d + radius]
        for at in found:
            self.taken[at] = True
            while at >= 0:
                self.live[at] -= 1
                at = self.parents[at]
        return found


def tree_groups(codes: list[int], radius: int) -> list[int]:
    """For each of different codes, the first code of those that chains of codes at ``radius`` or less lead to.  A code
    leaves the tree when it is found, so a large group of near codes costs few steps for each."""
    tree, first = BKTree(), list(codes)
    for code in codes:
        tree.add(code)
    for place, code in enumerate(codes):
        if tree.taken[place]:
            continue
        reached = tree.take(code, radius)
        while reached:
            at = reached.pop()
            first[at] = code
            reached += tree.take(codes[at], radius)
    return first


def shard_links(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """One ``(code, root)`` row for each code that a shard's tree joins to an earlier one, through any number of links."""
    tree, parent = BKTree(), list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for code in codes:
        near = tree.within(code, radius)
        at = tree.add(code)
        for other in near:
            x, y = root(at), root(other)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(codes[x], codes[r]) for x in range(len(codes)) if (r := root(x)) != x]


def _tree_links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 2

        def shards(columns: list[np.ndarray]) -> pa.RecordBatch:
            shard, code = columns
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            sizes = np.diff(np.r_[starts, len(shard)])
            found: list[tuple[int, int]] = []
            for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                found += shard_links(code[at : at + n].view(np.uint64).tolist(), radius)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            rest = [c[cut:] for c in columns]
            if cut:
                yield shards([c[:cut] for c in columns])
        if len(rest[0]):
            yield shards(rest)

    return links


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            shards = block_values(batch.column("further").to_pylist()) + (np.arange(BLOCKS) << BLOCK_BITS)
            codes = np.repeat(batch.column("code").to_numpy(zero_copy_only=False), BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(shards.ravel()), pa.array(codes)], ["shard", "code"])


def _tree_buckets(radius: int, shard_limit: int):
    """``(shard, root, code)`` of the codes that a shard's tree joins to another row; rows come sorted by shard."""

    def of(shard: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        sizes = np.diff(np.r_[starts, len(shard)])
        # a tree of two codes is one distance
        two = starts[sizes == 2]
        two = two[np.bitwise_count(code[two] ^ code[two + 1]) <= radius]
        columns = [[np.r_[shard[two], shard[two]]], [np.r_[code[two], code[two]]], [np.r_[code[two], code[two + 1]]]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            codes, rows = np.unique(code[at : at + n], return_counts=True)
            if n > shard_limit:
                root = np.zeros(len(codes), np.uint64)
            else:
                root = np.array(tree_groups(codes.tolist(), radius), np.uint64)
            roots, group = np.unique(root, return_inverse=True)
            joined = np.bincount(group, rows, len(roots))[group] > 1
            for column, values in zip(columns, (np.full(len(codes), shard[at]), root, codes), strict=True):
                column.append(values[joined])
        shards, roots, codes = map(np.concatenate, columns)
        found = [pa.array(shards), pa.array(roots.view(np.int64)), pa.array(codes.view(np.int64))]
        return pa.RecordBatch.from_arrays(found, ["shard", "root", "code"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, wanted = 0, SHARD_ROWS_AT_ONCE
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < wanted:
                continue
            shard, code = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(shard, shard[-1]))
            if cut:
                yield of(shard[:cut], code[:cut].view(np.uint64))
            held, rows = [[shard[cut:], code[cut:]]], len(shard) - cut
            wanted = max(SHARD_ROWS_AT_ONCE, 2 * rows)
        if rows:
            shard, code = (np.concatenate(c) for c in zip(*held, strict=True))
            yield of(shard, code.view(np.uint64))

    return buckets


def wide_buckets(marks: DataFrame, radius: int, shard_limit: int = 4096) -> DataFrame:
    """``(bucket, code)`` from ``marks(code, further)``: codes that agree on a block of the further bits go to one shard,
    and those that its BK-tree joins at ``radius`` or less share a bucket.  Codes without a partner have no row; a code
    that several rows of a shard have is its own partner.

    Of a pair whose bits differ with chance p, a block finds it with chance (1 - p) ** 20.  A shard above ``shard_limit``
    rows, which only near copies fill, is one bucket without a tree: a superset, so no pair is lost.
    """
    dealt = marks.select("code", "further").mapInArrow(_deal, "shard long, code long")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(_tree_buckets(radius, shard_limit), "shard long, root long, code long")
    return found.select(F.xxhash64("shard", "root").alias("bucket"), "code")


def _blocks(code: Column, bits: int, width: int) -> Column:
    """The four blocks of ``code``: ``(block, value, rest)``, ``rest`` without the block."""

    def block(n: int) -> Column:
        value = F.shiftrightunsigned(code, n * width).bitwiseAND(F.lit((1 << width) - 1))
        above = F.lit(0).cast("long")
        if (n + 1) * width < bits:
            above = F.shiftleft(F.shiftrightunsigned(code, (n + 1) * width), n * width)
        below = code.bitwiseAND(F.lit((1 << n * width) - 1))
        return F.struct(F.lit(n).alias("block"), value.alias("value"), above.bitwiseOR(below).alias("rest"))

    return F.array(*[block(n) for n in range(4)])


def links(codes: DataFrame, radius: int = 3, shard_limit: int = 4096) -> DataFrame:
    """``codes`` has one row for each distinct ``code``.  Returns edges ``(a, b)`` that connect exactly the codes which
    chains of codes at ``radius`` (3 at most) or less connect."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks hold every link only up to a radius of three")
    rows = codes.select("code", F.col("code").alias("rest"), F.lit(0).cast("long").alias("shard"))
    ready: list[DataFrame] = []
    for depth, (bits, width) in enumerate(LEVELS):
        dealt = rows.withColumn("x", F.explode(_blocks(F.col("rest"), bits, width)))
        shard = F.xxhash64("shard", "x.block", "x.value")
        dealt = dealt.select("code", F.col("x.rest").alias("rest"), shard.alias("shard"))
        if depth == len(LEVELS) - 1:
            ready.append(dealt)
            break
        large = written(dealt.groupBy("shard").count().where(F.col("count") > shard_limit).select("shard"), "shards")
        if large.isEmpty():
            ready.append(dealt)
            break
        ready.append(dealt.join(large, "shard", "left_anti"))
        rows = dealt.join(large, "shard", "left_semi")
    out = None
    for part in ready:
        part = part.select("shard", "code").repartition("shard").sortWithinPartitions("shard")
        found = part.mapInArrow(_tree_links(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(documents: DataFrame, radius: int = 3, shard_limit: int = 4096) -> DataFrame:
    """``(doc_id, key, code, component_id, component)`` of every row of ``documents(doc_id, text)``.

    Rows link at ``radius`` differing bits or fewer; ``component_id`` is the smallest doc_id reachable, ``component`` a
    code that stands for the group even where ids repeat.  Equal codes are one class, so copies cost one row each.  Null and empty texts have code zero, linked like any other.  A repeated doc_id
    gives a row each time.  A null doc_id is never the smallest; its component is null if it has null ids only.  Other
    columns are ignored; an empty table gives an empty one.
    """
    marks = written(fingerprints(documents), "codes")
    classes = written(marks.groupBy("code").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes.select("code"), radius, shard_limit)).withColumnRenamed("node", "code")
    tagged = classes.join(roots, "code", "left").select("code", "first_id", F.coalesce("root", "code").alias("root"))
    tagged = written(tagged, "tagged")
    smallest = tagged.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = tagged.join(smallest, "root").select("code", "component_id", F.col("root").alias("component"))
    known = written(known, "known")
    return marks.join(known, "code").select("doc_id", "key", "code", "component_id", "component")


def one_of_each(documents: DataFrame, radius: int = 3) -> DataFrame:
    """One document of each group, with all columns: the one with the smallest doc_id (of several texts of that id, the one
    with the smallest hash; of equal rows, one).  Rows without an id can't be told apart and stay."""
    return first_of_each(documents, near_duplicates(documents, radius))


def first_of_each(documents: DataFrame, grouped: DataFrame) -> DataFrame:
    """``one_of_each`` for groups ``(doc_id, key, component)`` that are known already."""
    kept = grouped.where("doc_id IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    doc_id, key = F.col("row.doc_id").cast("long"), F.xxhash64(F.col("row.text").cast("string"))
    first = rows.join(kept, (doc_id == F.col("kept_id")) & (key == F.col("kept_key"))).dropDuplicates(["kept_id", "kept_key"])
    return first.select("row.*").unionByName(documents.where("doc_id IS NULL"))
