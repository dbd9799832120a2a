"""SetSketch near-dedup, bag search and spelling variants against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkrubric.llm import bags, setsketch, similar, spelling
from tests.llm import cases


def brute_sets(texts):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set()))
    return out


def brute_components(data):
    """``(doc_id, n_shingles, component_id, kept)`` of every row."""
    sets = brute_sets([r[1] for r in data])
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), math.inf), r[0])
    rows = []
    for i, r in enumerate(data):
        component = least.get(find(i)) if sets[i] else r[0]
        rows.append((r[0], len(sets[i]), component, r[0] is not None and r[0] == component))
    return Counter(rows)


def near_rows():
    """Copies at 0.8 to 0.95, chains, a hot group, texts that share half of their words, and odd rows."""
    rng = random.Random(21)
    texts = []
    for n in range(12):
        old = cases.words(rng, 150)
        texts.append(" ".join(old))
        for changes in (1, 2, 3, 4, 5, 8):
            new = list(old)
            for k in range(changes):
                new[5 + k * 17] = f"changed{n}x{k}"
            texts.append(" ".join(new))
    chain = cases.words(rng, 200)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = [*chain[12:], *cases.words(rng, 12)]
    hot = cases.words(rng, 120)
    for n in range(90):
        new = list(hot)
        for at in rng.sample(range(120), 1 + n % 3):
            new[at] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(new))
    for _ in range(40):
        texts.append(" ".join(hot[:60] + cases.words(rng, 60)))
    texts += [None, "", " \n", "one two", "One  TWO", "one two three", texts[0].upper(), " ".join(cases.words(rng, 30000))]
    rows = [(i, t, "en", "src0", 1) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0], "en", "src0", 1), (None, "all by itself", None, None, None), (3, texts[3], "en", "s", 1), (4, "other", "en", "s", 1)]


@pytest.mark.parametrize("chunk", [512, 4])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(setsketch, "CHUNK", chunk)
    monkeypatch.setattr(setsketch, "CHUNK_SHINGLES", chunk << 9)
    data = near_rows()
    found = setsketch.near_duplicates(cases.table(spark, data, clashes=True))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(tuple(r) for r in found.collect()) == brute_components(data)


def test_links_that_only_cells_find(spark, monkeypatch):
    """With the first text of a bucket as its only leader, pairs beside it are left to the cells."""
    monkeypatch.setattr(setsketch, "LEADERS", 1)
    monkeypatch.setattr(setsketch, "CHUNK", 3)
    rng = random.Random(22)
    data = []
    for n in range(6):
        old = cases.words(rng, 100)
        for k in range(12):  # pairs link, their common beginning alone doesn't
            own = old[:78] + [f"p{n}q{k // 2}r{i}" for i in range(22)]
            if k % 2:
                own[90] = "x"
            data.append((len(data), " ".join(own), "en", "s", 1))
    found = setsketch.near_duplicates(cases.table(spark, data))
    assert Counter(tuple(r) for r in found.collect()) == brute_components(data)


def test_near_duplicates_of_few_rows(spark):
    assert setsketch.near_duplicates(cases.table(spark, [])).count() == 0
    data = [(1, None, None, None, None), (2, "a b c d e f", None, None, None)]
    assert Counter(tuple(r) for r in setsketch.near_duplicates(cases.table(spark, data)).collect()) == brute_components(data)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 4000, np.uint64, endpoint=False)
    a, b = np.unique(pool[:3000]), np.unique(pool[500:3400])
    assert (setsketch.merge(setsketch.sketch(a), setsketch.sketch(b)) == setsketch.sketch(np.union1d(a, b))).all()
    for similarity in (0.0, 0.3, 0.6, 0.85, 0.95, 1.0):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 64, 1000, np.uint64, endpoint=False)
            both = round(1000 * similarity)
            one = both + (1000 - both) // 3
            x = np.sort(pool[:one])
            y = np.sort(np.concatenate([pool[:both], pool[one:]]))
            p, q = setsketch.sketch(x)[None], setsketch.sketch(y)[None]
            counts = [c.sum(axis=1) for c in (p > q, p < q, p == q)]
            sizes = np.array([len(x)]), np.array([len(y)])
            errors.append(setsketch.estimate(*counts, *sizes)[0] - similarity)
            if similarity >= 0.85 and min(len(x), len(y)) >= 0.85 * max(len(x), len(y)):
                assert setsketch.plausible(p, q, *sizes, 0.85).all()
            if similarity <= 0.3:
                assert not setsketch.plausible(p, q, *sizes, 0.85).any()
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_bands_hold_what_the_threshold_asks():
    """Measured recall of the bands at exactly 0.85: a text's bucket is shared in all of 3,000 pairs."""
    rng = np.random.default_rng(6)
    for _ in range(3000):
        pool = rng.integers(0, 1 << 64, 200, np.uint64, endpoint=False)
        x, y = np.sort(pool[:185]), np.sort(np.concatenate([pool[:170], pool[185:]]))
        keys = setsketch.band_keys(setsketch.sketch(x)), setsketch.band_keys(setsketch.sketch(y))
        assert (keys[0] == keys[1]).any()


def test_shingles_of_odd_texts():
    for text in (None, "", " \n", "One", "one TWO", "É é É", "a b c d", "x\x0by\x0cz\x1fw\xa0v q", "A b " * 50000):
        assert len(similar.shingles(None if text is None else text.encode(), 5)[1]) == len(brute_sets([text])[0])


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(data, items, k):
    bag = [Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in data]
    n_documents, length = sum(1 for b in bag if b), sum(b.total() for b in bag)
    df = Counter(t for b in bag for t in b)
    out = Counter()
    for item_id, text in items:
        asked = Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scores = []
        for (doc_id, *_), own in zip(data, bag, strict=True):
            if not length:
                continue
            m = 25 + (75 * own.total() * n_documents) // length
            score = 0
            for t, repeats in asked.items():
                if own[t]:
                    w = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df[t] + 1)))
                    score += repeats * w * ((10**9 * own[t]) // (1000 * own[t] + 8 * m))
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        out.update((item_id, n + 1, doc_id, -s) for n, (s, _, doc_id) in enumerate(sorted(scores, key=lambda x: x[:2])[:k]))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_bag_search(spark, block_bytes):
    data = cases.rows(23, 150)
    rng = random.Random(24)
    copies = data[20][1]
    data += [(1000 + i, copies, "en", "src0", 1) for i in range(40)]  # a class larger than k
    data += [(2000 + i, " ".join(rng.sample(copies.split(), len(copies.split()))), "en", "s", 1) for i in range(5)]
    data += [(3000, "The THE the É É", "en", "s", 1), (3001, copies + " !!! ...", "en", "s", 1)]
    items = [(i, " ".join(cases.words(rng, 25))) for i in range(12)]
    items += [(20, copies), (20, copies), (None, "the étoile"), (21, None), (22, ""), (23, "unknownterm"), (24, "É THE"), (25, "the " * 3000)]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS row", "3 AS rank", "'x' AS vector")
    found = bags.search(cases.table(spark, data, clashes=True), table.repartition(3), k=10, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == brute_search(data, items, 10)
    assert bags.search(cases.table(spark, []), table).count() == 0
    assert bags.search(cases.table(spark, [(1, None, None, None, None), (2, "...", None, None, None)]), table).count() == 0
    assert bags.search(cases.table(spark, data), table.limit(0)).count() == 0


def test_scores_beyond_double_precision():
    block = bags.ItemBlock([{0: 9_100_000_001, 1: 7}, {1: 5}])
    assert block.weights.dtype == np.int64
    found = block.scores(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([999_999, 3, 2]), 2)
    assert found.tolist() == [[9_100_000_001 * 999_999 + 21, 15], [14, 10]]


def brute_spelling(data, one_in=97, min_count=3):
    n = Counter()
    for doc_id, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if doc_id is not None and one_in:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % one_in == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_forms(n):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    rows = {}
    for w, c in n.items():
        near = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_length.get(size, []) if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 2 * c else None
        rows[w] = [w, form, w, c, len(near), n[form] if form else None]
    for row in rows.values():
        while rows[row[2]][1] is not None:
            row[2] = rows[row[2]][1]
    return {tuple(r) for r in rows.values()}


def test_spelling_variants(spark):
    data = cases.rows(25, 200)
    rng = random.Random(26)
    stems = ["onwards", "aaaaaa", "étoiles", "abcabc", "rotator"]
    texts = []
    for _ in range(400):
        word = list(rng.choice(stems))
        for _ in range(rng.randrange(0, 3)):
            at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
            if kind == 0:
                word.insert(at, rng.choice("abcé"))
            elif at < len(word):
                word[at : at + 1] = [] if kind == 1 else [rng.choice("abcé")]
        texts.append("".join(word) + " ")
    data += [(5000, "".join(texts) * 3, "fr", "s", 1), (5001, "z" * 3000 + " " + "z" * 2999 + "y " + "Z" * 2999, "fr", "s", 1)]
    data += [(5001, data[-1][1], "fr", "s", 1)] * 2
    n = brute_spelling(data)
    found = spelling.spelling_variants(cases.table(spark, data, clashes=True)).collect()
    assert found[0].__fields__ == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_forms(n)
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert any(r[1] and r[1] != r[2] for r in want)
    assert spelling.spelling_variants(cases.table(spark, [])).count() == 0
    assert spelling.spelling_variants(cases.table(spark, [(1, None, None, None, None), (2, "123 . \n", None, None, None)])).count() == 0


def test_forms_of_ties_and_chains(spark):
    n = {"worda": 3, "wordb": 6, "wordbc": 12, "wordbcd": 24, "wordc": 6, "loner": 9, "xordb": 6, "ab": 1, "a": 5, "b": 5}
    table = spark.createDataFrame([*n.items(), (None, 4), ("", 2)], "word string, n long")
    assert {tuple(r) for r in spelling.group_forms(table).collect()} == brute_forms(n)
