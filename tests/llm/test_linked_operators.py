"""SimHash, pieces, classifier, search and the pipeline against brute force, the library and held-out rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkrubric.llm import classifier, components, language, lines, mixing, pieces, search, similar, simhash
from tests.llm import cases


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(codes, radius=3):
    """The smallest place of each code's group."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(codes))]


def test_fingerprint_of_odd_texts():
    for text in (None, "", " \n", "One", "one TWO", "É é É", "a b c d", "x\x0by\x0cz\x1fw\xa0v", "A b " * 50000):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_near_duplicates(spark):
    data = cases.rows(5, 120)
    found = simhash.near_duplicates(cases.table(spark, data, clashes=True)).collect()
    codes = [brute_fingerprint(r[1]) for r in data]
    roots = groups(codes)
    smallest = {}
    for r, (doc_id, *_) in zip(roots, data, strict=True):
        if doc_id is not None:
            smallest[r] = min(smallest.get(r, math.inf), doc_id)
    assert any(smallest[r] != d[0] for d, r in zip(data, roots, strict=True) if d[0] is not None)
    want = Counter((d[0], c, smallest.get(r)) for d, c, r in zip(data, codes, roots, strict=True))
    assert Counter((r["doc_id"], r["code"] % (1 << 64), r["component_id"]) for r in found) == want
    kept = simhash.one_of_each(cases.table(spark, data, clashes=True))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(smallest.values()) and ids.count(None) == 2
    assert simhash.near_duplicates(cases.table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_of_chains_and_refined_shards(spark, limit):
    rng = random.Random(6)
    codes = {0, (1 << 64) - 1}
    for _ in range(6):
        code = rng.getrandbits(64)
        for _ in range(25):  # a chain whose ends are far apart
            codes.add(code)
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                code ^= 1 << b
    codes |= {rng.getrandbits(64) for _ in range(60)}
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "code long").repartition(4)
    found = components.components(simhash.links(table, 3, limit)).collect()
    root = {r["node"]: r["root"] for r in found}
    mine = [root.get(c, c) for c in signed]
    theirs = groups(codes)
    assert len({*zip(mine, theirs, strict=True)}) == len(set(mine)) == len(set(theirs))


def test_components_of_a_long_path(spark):
    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1).selectExpr("900L", "900L"))
    found = components.components(path.union(spark.range(1).selectExpr("500L", "501L"))).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(1, 201)} | {(501, 500)}
    assert components.components(path.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def odd_texts():
    rng = random.Random(7)
    letters = "aaeinorst  \n\t  éñ日本▁=-_09#€\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    texts += ["".join(rng.choice("abcdet") for _ in range(1500)), " " * 333, "ab" * 400, "=" * 500 + " x " + "-" * 200, "the " * 300]
    return texts + [None, "", " ", "x"]


@pytest.mark.parametrize("chunk", [40, 150, 32768])
def test_pieces_equal_the_library(spark, library, chunk):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None, 1)], cases.SCHEMA)
    docs = docs.selectExpr("*", "1 AS row", "2 AS chunk", "3 AS ids").repartition(3)
    encoded = pieces.encode(docs, chunk_chars=chunk)
    rows = encoded.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[0 if r["doc_id"] is None else r["doc_id"]]
        assert r["ids"] == (None if text is None else library.encode(text))
        assert r["n_tokens"] == len(r["ids"] or [])
        assert r["round_trip"] is (None if text is None else "▁" not in text)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded.where("doc_id IS NOT NULL")).collect()}
    assert back == {i: None if t is None else t.replace("▁", " ") for i, t in enumerate(texts)}


def test_pieces_of_an_empty_table(spark):
    assert pieces.encode(cases.table(spark, [])).count() == 0


def labelled(n=240):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        w = cases.words(rng, rng.randrange(20, 80))
        bad = i % 4 == 0
        rows.append((i, " ".join(x + "&&&" for x in w) if bad and i % 8 else " ".join([w[0]] * 40 if bad else w), "en", "s", 1))
    return rows


def test_classifier_on_held_out_rows(spark):
    data = [*labelled(), (None, None, None, None, None), (None, "", None, None, None), (3, "the of and", None, None, None)]
    docs = cases.table(spark, data, clashes=True)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.train(docs, labels, F.col("doc_id") % 3 != 1)
    found = classifier.score(docs, model).collect()
    assert len(found) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] % 3 == 1]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.9 * len(held)
    other = classifier.score(docs, classifier.train(docs.repartition(5), labels, F.col("doc_id") % 3 != 1)).collect()
    assert sorted(r["score"] for r in found) == pytest.approx(sorted(r["score"] for r in other), abs=1e-6)
    one_kind = classifier.train(docs, labels.where("quality = 1"), F.lit(True))
    assert {r["score"] for r in classifier.score(docs, one_kind).collect()} == {1.0}
    none = classifier.train(cases.table(spark, []), labels.limit(0), F.lit(True))
    assert {r["score"] for r in classifier.score(docs, none).collect()} == {0.5}


def test_temperature_and_pooling():
    words = classifier.WordVectors(np.empty(0, np.uint64), np.empty((0, classifier.DIM)))
    assert not words.pool(None)[: classifier.DIM].any() and not words.pool(b"  \n").any()
    one, twice = words.pool(b"stone"), words.pool(b"stone stone")
    assert np.allclose(one[: classifier.DIM], twice[: classifier.DIM]) and np.isclose(np.linalg.norm(one[: classifier.DIM]), 1, atol=0.5)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    noisy = (x[:, 0] + rng.normal(0, 1, 500) > 0).astype(float)
    network = classifier.train_network(x, noisy)
    assert abs(network.scores(x).mean() - noisy.mean()) < 0.1


@pytest.mark.parametrize("shard", [16, 16384])
def test_search(spark, shard):
    data = cases.rows(9, 150)
    docs = cases.table(spark, data, clashes=True)
    asked = docs.where("doc_id % 10 = 0 OR doc_id IS NULL")
    found = search.search(docs, asked, k=5, shard_documents=shard).collect()
    parsed = [search.text_terms((r[1] or "").encode()) for r in data]
    mean = sum(n for n, _, _ in parsed) / len(data)
    df = Counter(t for _, terms, _ in parsed for t in terms.tolist())
    want = Counter()
    for (doc_id, *_), (_, terms, _) in zip(data, parsed, strict=True):
        if doc_id is not None and doc_id % 10:
            continue
        idf = {t: math.log1p((len(data) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()}
        scores = []
        for (other, *_), (n, own, counts) in zip(data, parsed, strict=True):
            s = sum(idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)) for t, c in zip(own.tolist(), counts.tolist(), strict=True) if t in idf)
            if s > 0:
                scores.append((-round(s, 7), math.inf if other is None else other, other))
        want.update((doc_id, rank + 1, -s, other) for rank, (s, _, other) in enumerate(sorted(scores, key=lambda x: x[:2])[:5]))
    assert Counter((r["query_id"], r["rank"], round(r["score"], 7), r["doc_id"]) for r in found) == want
    assert search.search(docs.limit(0), asked).count() == 0
    assert search.search(docs, asked.limit(0)).count() == 0


def test_bounds_of_long_texts():
    """Bounds stay above exact scores where thousands of terms add up, and near ties lose nothing."""
    rng = np.random.default_rng(7)
    terms = np.sort(rng.choice(1 << 40, 6000, replace=False)).astype(np.int64)
    own = [np.sort(rng.choice(terms, n, replace=False)) for n in [*[6000] * 40, *[5990] * 60, *[30] * 100]]
    counts = [rng.integers(1, 4, len(t)).astype(np.int32) for t in own]
    shard = search.Shard(list(range(len(own))), np.array([c.sum() for c in counts], float), own, counts, 5000.0)
    for weights in (rng.uniform(1, 12, len(terms)), np.full(len(terms), 11.7)):
        exact = [shard.score(d, terms, weights) for d in range(len(own))]
        at = np.arange(len(shard.known))
        most = shard._bounds(at, weights[np.searchsorted(terms, shard.known)]) * search.MARGIN
        assert (most >= exact).all()
        assert shard.top(terms, weights, 10) == sorted(((s, d) for d, s in enumerate(exact)), key=lambda x: (-x[0], x[1]))[:10]


def test_queries_are_multiplied_together(monkeypatch):
    """Prose with terms in many documents: all queries of a shard at once give the exact best, and few documents are scored."""
    monkeypatch.setattr(search, "FREQUENT_DOCUMENTS", 30)
    monkeypatch.setattr(search, "FREQUENT", 25)
    rng = np.random.default_rng(11)
    drawn = [np.unique(np.minimum(rng.zipf(1.4, n), 5000), return_counts=True) for n in rng.integers(0, 120, 700)]
    own, counts = [t.astype(np.int64) for t, _ in drawn] * 2, [c.astype(np.int32) for _, c in drawn] * 2  # each twice: ties
    ids = [None, *rng.permutation(len(own) - 1).tolist()]
    shard = search.Shard(ids, np.array([c.sum() for c in counts], float), own, counts, 60.0)
    weight = rng.uniform(0.1, 9, 5001)
    queries = [own[d] for d in range(100)] + [np.array([1, 2]), np.array([7000]), np.empty(0, np.int64), np.arange(1, 5001)]
    queries = [(t, weight[t] if t.max(initial=0) <= 5000 else np.ones(len(t))) for t in queries]
    score, scored = shard.score, []
    shard.score = lambda *args: (scored.append(args[0]), score(*args))[1]
    found = shard.tops(queries, 10)
    assert len(shard.frequent) == 25 and len(scored) <= 24 * len(queries)
    for (terms, weights), got in zip(queries, found, strict=True):
        exact = sorted((-score(d, terms, weights), math.inf if ids[d] is None else ids[d], d) for d in range(len(own)))
        assert got == [(-s, d) for s, _, d in exact[:10] if s < 0]


def test_blocks_are_skipped():
    """A shard whose blocks differ: the skipped ones hold no hit."""
    rng = np.random.default_rng(8)
    terms = np.arange(50, dtype=np.int64)
    own = [terms if d // search.BLOCK == 3 else terms[d // search.BLOCK :][:2] for d in range(10 * search.BLOCK)]
    counts = [rng.integers(1, 9, len(t)).astype(np.int32) for t in own]
    shard = search.Shard(list(range(len(own))), np.full(len(own), 50.0), own, counts, 50.0)
    read = []
    bounds = shard._bounds
    shard._bounds = lambda at, weights, alive=None: (read.append(alive), bounds(at, weights, alive))[1]
    exact = [shard.score(d, terms, np.ones(50)) for d in range(len(own))]
    assert shard.top(terms, np.ones(50), 10) == sorted(((s, d) for d, s in enumerate(exact)), key=lambda x: (-x[0], x[1]))[:10]
    assert read[-1].tolist() == [b == 3 for b in range(10)]


def test_pipeline_against_brute_force(spark, tmp_path, library):
    data = [r for r in cases.rows(10, 150) if r[0] is not None][:-2]
    cases.table(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = cases.table(spark, data)
    prototypes = language.train(docs, F.col("lang"))
    stays = {r["doc_id"] for r in language.predict(docs, prototypes).where("lang_pred <> 'und' AND cosine >= 0.05").collect()}
    kept = [r for r in data if r[0] in stays]
    assert {r[0] for r in data} - stays == {150, 151, 152, 154}  # null, empty, blank, without a letter
    from tests.llm.test_text_operators import brute_lines

    texts = {r[0]: r[1] for r in brute_lines(kept, min_texts=10) if r[3] == 0 or re.search("[^\x20\x09-\x0d]", r[1])}
    ids = sorted(texts)
    roots = jaccard_groups([texts[i] for i in ids])
    single = {i for n, i in enumerate(ids) if roots[n] == n}
    assert len(single) < len(ids)
    left = spark.createDataFrame([(i, texts[i], None, next(r[3] for r in data if r[0] == i), 1) for i in single], cases.SCHEMA)
    copies = Counter(r["doc_id"] for r in mixing.mix(left).collect())
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == copies
    assert found == {i: library.encode(texts[i]) for i in copies}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "encoding"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    cases.table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lines_default_is_used_by_the_pipeline(spark):
    docs = cases.table(spark)
    staged = corpus_pipeline.line_dedup(spark, docs, "")
    assert staged.columns == corpus_pipeline.COLUMNS
    assert staged.count() <= lines.drop_templates(docs).count()


def jaccard_groups(texts, least=0.8):
    """The smallest place of each text's group."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 10 * least * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_rows():
    """Texts with copies at 0.8 to 0.95 of them, just below, chains, a hot group and odd rows."""
    rng = random.Random(11)
    texts = []
    for n in range(12):
        old = cases.words(rng, 150)
        texts.append(" ".join(old))
        for changes in (1, 2, 3, 4, 8):
            new = list(old)
            for k in range(changes):
                new[5 + k * 17] = f"changed{n}x{k}"
            texts.append(" ".join(new))
        texts.append(" ".join([*old[20:], *cases.words(rng, 20)]))
    chain = cases.words(rng, 200)
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = [*chain[15:], *cases.words(rng, 15)]
    hot = cases.words(rng, 120)
    for _ in range(60):
        new = list(hot)
        for at in rng.sample(range(120), 3):
            new[at] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(new))
    texts += [None, "", " \n", "one two", "One  TWO", "one two three", texts[0].upper()]
    return [(i, t, "en", "src0", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "src0", 1)]


def test_near_copies_of_the_pipeline(spark):
    data = near_rows()
    roots = jaccard_groups([r[1] for r in data])
    single = sorted({data[r][0] for r in roots})
    found = similar.near_copies(cases.table(spark, data, clashes=True)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in data)
    group = {r["doc_id"]: r["component"] for r in found if r["doc_id"] is not None}
    pairs = {(group[i], roots[i]) for i in group}
    assert len(pairs) == len(set(group.values())) == len(set(roots))
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, cases.table(spark, data), "").collect()]
    assert sorted(x for x in kept if x is not None) == single and kept.count(None) == 1
    assert corpus_pipeline.near_dedup(spark, cases.table(spark, []), "").count() == 0
