"""Approximate mentions against a plain version that scores every window."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from sparkrubric.operators import approximate as ap

SCHEMA = "doc_id long, text string"
NAMES = [
    (1, 0, "Muzeul Antipa"), (1, 1, "muzeul de istorie naturală"), (2, 0, "Parcul Herăstrău"), (3, 0, "Ateneul"),
    (4, 0, "Țara"), (5, 0, "ab"), (6, 0, "x"), (7, 0, ""), (8, 0, None), (9, 0, "aaaaaaaaaaaaaaaa"),
    (10, 0, "Palatul Parlamentului din București"),
]


def plain(text):
    return text.lower().translate(str.maketrans("ăâîșţț", "aaistt"))


def common(a, b):
    row = [0] * (len(a) + 1)
    for c in b:
        last = 0
        for j, d in enumerate(a, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (c == d))
    return row[-1]


def part_score(short, long):
    n = len(short)
    parts = [long[i : i + n] for i in range(len(long) - n + 1)] + [long[:k] for k in range(1, n)] + [long[-k:] for k in range(1, n)]
    return max(200 * common(short, p) / (n + len(p)) for p in parts)


def window_score(needle, window):
    best = part_score(needle, window)
    return max(best, part_score(window, needle)) if len(needle) == len(window) else best


def brute(texts, names, threshold=85):
    out = set()
    for doc_id, text in texts:
        for entity, position, name in names:
            if not text or not name:
                continue
            h, n = plain(text), plain(name)
            scores = [window_score(n, h[i : i + len(n) + 5]) for i in range(len(h) - len(n) + 1)]
            if scores and max(scores) >= threshold - 1e-9:
                i = scores.index(max(scores))
                around = text[max(0, i - 50) : i + len(n) + 50]
                negated = re.search(r"\bnu\b|\bfără\b|\bevit|\bexclus|\bam\s+ales\s+să\s+nu|\bam\s+decis\s+să\s+nu", around, re.IGNORECASE)
                out.add((doc_id, entity, position, round(max(scores), 6), i, i + len(n), negated is None))
    return out


def texts():
    rng = random.Random(31)
    filler = "vom merge apoi spre centru unde este liniște mare și soare iar seara ne plimbăm pe malul apei".split()
    negations = ["nu", "Nu", "fără", "evităm", "excluse", "am ales să nu", "numai", "nuanțe", "AM  DECIS SĂ NU"]
    out = []
    for i in range(40):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 20))]
        for _ in range(rng.randrange(0, 3)):
            name = [*rng.choice([n for _, _, n in NAMES if n])]
            for _ in range(rng.randrange(0, 4)):
                at, kind = rng.randrange(len(name)), rng.randrange(3)
                name[at : at + 1] = [[], [rng.choice("aeiorst ")], [name[at], "q"]][kind]
                name = name or ["z"]
            words.insert(rng.randrange(len(words) + 1), "".join(name))
        if i % 3 == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(negations))
        out.append((i, " ".join(words)))
    out += [(100, None), (101, ""), (102, "Ateneu"), (103, "teneul"), (104, "xAteneu"), (105, "a" * 100), (106, "Muzeul Antip"), (107, "PARCUL HERASTRAU")]
    return out


@pytest.mark.parametrize(("threshold", "cells", "block"), [(85.0, 1 << 22, 1 << 16), (70.0, 150, 40)])
def test_against_every_window(spark, monkeypatch, threshold, cells, block):
    monkeypatch.setattr(ap, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(ap, "BLOCK_LETTERS", block)
    data = texts()
    docs = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS score", "'x' AS start").repartition(3)
    names = spark.createDataFrame(NAMES, "entity long, position int, name string").selectExpr("*", "'x' AS text")
    found = ap.approximate_mentions(docs, "doc_id", "text", names, "entity", "position", "name", threshold)
    assert found.columns == ["doc_id", "entity", "position", "score", "start", "stop", "positive"]
    rows = {(r[0], r[1], r[2], round(r[3], 6), *r[4:]) for r in found.collect()}
    want = brute(data, NAMES, threshold)
    assert rows == want and len({r[6] for r in want}) == 2 and any(r[3] < 100 for r in want)
    best = {(r["doc_id"], r["entity"]): r["position"] for r in ap.best_mentions(found, "doc_id", "entity", "position").collect()}
    order = {}
    for r in sorted(want, key=lambda r: (-r[3], r[2], r[4])):
        order.setdefault((r[0], r[1]), r[2])
    assert best == order


def test_long_texts_and_empty_tables(spark):
    name = "Grădina Botanică"
    long = "cuvinte fara rost " * 3000 + "gradina botnica" + " si altele" * 2000
    docs = spark.createDataFrame([(1, long)], SCHEMA)
    names = spark.createDataFrame([(1, 0, name)], "entity long, position int, name string")
    found = ap.approximate_mentions(docs, "doc_id", "text", names, "entity", "position", "name").collect()
    assert len(found) == 1 and abs(found[0]["start"] - long.index("gradina")) <= 6 and found[0]["score"] >= 90
    assert ap.approximate_mentions(docs.limit(0), "doc_id", "text", names, "entity", "position", "name").count() == 0
    assert ap.approximate_mentions(docs, "doc_id", "text", names.limit(0), "entity", "position", "name").count() == 0


def test_parts_of_a_text(monkeypatch):
    """Scans and alignments in small parts find the same as whole ones."""
    name, text = plain("Parcul Herăstrău"), plain(" ".join(t or "" for _, t in texts()[:40]) + " parcul herastra")
    whole = list(ap.Terms(len(name), [(7, name)], 70.0).mentions(ap._letters(text)))
    monkeypatch.setattr(ap, "CELLS_AT_ONCE", 60)
    assert whole and list(ap.Terms(len(name), [(7, name)], 70.0).mentions(ap._letters(text))) == whole


def test_alignment():
    letters = lambda x: np.array([*map(ord, x)], np.int32)
    lengths, _ = ap.common_lengths(letters("xabyc"), letters("abc"))
    assert lengths[1].tolist() == [0, 1, 2, 2] and lengths[2].tolist() == [0, 1, 1, 2]


@pytest.mark.parametrize(("threshold", "cells", "pairs"), [(85.0, 1 << 22, 1 << 20), (75.0, 1000, 50)])
def test_all_lengths_are_sought_at_once(monkeypatch, threshold, cells, pairs):
    """One scan for names of all lengths up to 64 letters and for many texts, with the results of the scan by length."""
    monkeypatch.setattr(ap, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(ap, "PAIRS", pairs)
    longer = "calea victoriei de la piata revolutiei pana la piata unirii si inapoi "
    names = [plain(n) for _, _, n in NAMES if n] + [longer[:64], longer[:63], longer[:66], "ateneu", "nu"]
    bodies = [plain(t) for _, t in texts() if t] + ["de pe " + longer[:40] + "x" + longer[42:] + "acasa", longer[:62]]
    groups = ap.grouped(list(enumerate(names)), threshold)
    assert [type(g) for g in groups] == [ap.ShortTerms, ap.LongTerms]
    letters = [ap._letters(t) for t in bodies]
    got = {(k, number, round(score, 6), at) for g in groups for k, number, score, at in g.mentions(letters)}
    one_by_one = [ap.Terms(len(n), [(i, n)], threshold) for i, n in enumerate(names)]
    want = {(k, i, round(score, 6), at) for k, text in enumerate(letters) for t in one_by_one for i, score, at in t.mentions(text)}
    assert got == want and len(want) > 40 and {len(names[i]) for _, i, *_ in want} >= {2, 7, 63, 64, 66}


def test_few_pairs_are_aligned(monkeypatch):
    """Of places in prose without a mention, few are left to be scored; one that has a mention is still found at any edge."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioutnrslcdm") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    names = [" ".join(rng.sample(words, 4))[:20] for _ in range(64)]
    body = " ".join(rng.choice(words) for _ in range(1500))
    followed = []
    scored = ap.ShortTerms.stretches

    def counted(self, at, rows, *rest):
        followed.append(len(rows))
        return scored(self, at, rows, *rest)

    monkeypatch.setattr(ap.ShortTerms, "stretches", counted)
    edges = [names[0][2:] + " " + body, body + " " + names[1][:-2], body + names[2][:9] + names[2][10:] + body]
    (group,) = ap.grouped(list(enumerate(names)), 85.0)
    found = {(k, number) for k, number, *_ in group.mentions([ap._letters(t) for t in [body, *edges]])}
    assert {(1, 0), (2, 1), (3, 2)} <= found
    letters = len(body) + sum(map(len, edges))
    assert sum(followed) < 0.004 * letters * len(names)


@pytest.mark.parametrize("threshold", [70.0, 85.0, 95.0])
def test_least_pairs_is_a_bound(threshold):
    """No match keeps fewer runs than its first letter allows, or just as many in a longer stretch than it says."""
    rng = random.Random(5)
    reached = 0
    for _ in range(20000):
        n = rng.randrange(1, 30)
        out = sorted(rng.sample(range(n), min(n - 1, rng.randrange(0, 7))))
        left = [j for j in range(n) if j not in out]
        extra = rng.randrange(0, len(out) + 1)  # a stretch is no longer than its term
        stretch = [*left]
        for _ in range(extra):
            stretch.insert(rng.randrange(1, len(stretch) + 1), -1)
        if 200 * len(left) / (n + len(stretch)) < threshold:
            continue
        kept = sum(b == a + 1 and a >= 0 for a, b in zip(stretch, stretch[1:], strict=False))
        least, letters = ap.least_pairs(n, threshold, left[0])
        assert kept >= least and letters and (kept > least or len(stretch) <= letters)
        reached += kept == least
    assert reached > 100
    assert ap.least_pairs(20, 85.0, 0) == (9, 15) and ap.least_pairs(20, 85.0, 6) == (20, 0)
