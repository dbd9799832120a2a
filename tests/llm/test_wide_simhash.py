"""Wide SimHash fingerprints and the BK-trees that give the pipeline's near-dedup its pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from sparkrubric.llm import similar, simhash
from tests.llm.test_linked_operators import groups, jaccard_groups, near_rows


def test_code_is_the_five_word_fingerprint():
    for _, text, *_ in near_rows():
        code, further = simhash.wide_fingerprint(similar.shingles((text or "").encode(), 5)[1])
        words = (text or "").lower().split()
        if len({" ".join(words[i : i + 5]) for i in range(len(words) - 4)}) == max(len(words) - 4, 0):
            assert code == simhash.fingerprint((text or "").encode(), 5)
        assert simhash.block_values([further]).shape == (1, simhash.BLOCKS)


def test_trees_join_what_chains_join():
    rng = random.Random(4)
    for _ in range(20):
        base, codes = rng.getrandbits(64), set()
        for _ in range(80):
            code = rng.getrandbits(64) if rng.random() < 0.3 else base
            for bit in rng.sample(range(64), rng.randrange(14)):
                code ^= 1 << bit
            codes.add(code)
        codes = list(codes)
        assert simhash.tree_groups(codes, 10) == [codes[i] for i in groups(codes, 10)]


def test_pairs_at_the_bound_are_found():
    """600 pairs at exactly 0.8: what the calculation allows to be missed is below one of them."""
    rng = np.random.default_rng(5)
    missed = 0
    for n in (9, 90, 270) * 200:
        hashes = rng.integers(0, 1 << 64, n + n // 9, np.uint64, endpoint=False)
        (a, x), (b, y) = (simhash.wide_fingerprint(h) for h in (hashes[:n], hashes[n // 9 :]))
        x, y = simhash.block_values([x, y])
        missed += not (x == y).any() or (a ^ b).bit_count() > similar.RADIUS
    assert missed <= 3


@pytest.mark.parametrize("limit", [3, 4096])
def test_linked_texts_share_a_bucket_of_a_tree(spark, limit):
    texts = sorted({r[1] for r in near_rows() if r[1] and len(r[1].split()) > 20 and r[1] == r[1].lower()})
    marks = [simhash.wide_fingerprint(similar.shingles(t.encode(), 5)[1]) for t in texts]
    codes = np.array([m[0] for m in marks], np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(c, bytearray(m[1])) for c, m in zip(codes, marks, strict=True)], "code long, further binary")
    simhash.ready_for_python(spark)
    held = defaultdict(set)
    for bucket, code in simhash.wide_buckets(rows, similar.RADIUS, limit).collect():
        held[bucket].add(code)
    root = {c: {c} for c in codes}
    for members in held.values():
        together = set().union(*(root[c] for c in members))
        for code in together:
            root[code] = together
    found = [root[c] for c in codes]
    for place, first in enumerate(jaccard_groups(texts)):
        assert found[place] is found[first]
    # texts that share nothing stay apart
    assert len({id(f) for f in found}) > 10
