"""Document quality from random-indexing word vectors and a two-layer network.

A word's index vector has a few entries of +1 and -1, all read off its hash.  The vector of a vocabulary word adds the
index vectors of its neighbours in the training sample to its own; any other word keeps its index vector.  A document is
the mean of its words' unit vectors, with the mean's length, the logarithm of the number of words, and the shares of words
outside the vocabulary, of different words and of words that repeat the one before.  A network with one hidden layer scores it, and a temperature fitted on rows that the network didn't
see makes the scores probabilities.  Vectors and pooling run in tasks; only pooled rows of the sample come to the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.storage import ready_for_python, written

#: Runs of letters (any byte above ASCII counts as one), of digits and of other characters are words of their own.
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")
DIM = 128
NONZERO = 8
REACH = 2
WORDS_AT_ONCE = 1 << 16


def word_hashes(text: bytes | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in WORD.findall(text or b"")], np.uint64)


def _entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors: seven bits of the hash for each place, one for each sign."""
    k = np.arange(NONZERO, dtype=np.uint64)
    places = (hashes[:, None] >> (k * np.uint64(7))) & np.uint64(DIM - 1)
    signs = ((hashes[:, None] >> (k + np.uint64(56))) & np.uint64(1)).astype(np.int8) * 2 - 1
    return places.astype(np.int64), signs


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    places, signs = _entries(hashes)
    out = np.zeros((len(hashes), DIM), np.int32)
    np.add.at(out, (np.arange(len(hashes))[:, None], places), signs)
    return out


@dataclass
class WordVectors:
    """Unit vectors of the vocabulary; ``known`` is sorted."""

    known: np.ndarray
    vectors: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 outside."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def pool(self, text: bytes | None) -> np.ndarray:
        hashes = word_hashes(text)
        total, outside = np.zeros(DIM), 0
        for at in range(0, len(hashes), WORDS_AT_ONCE):
            part = hashes[at : at + WORDS_AT_ONCE]
            places = self.places(part)
            rows, counts = np.unique(places[places >= 0], return_counts=True)
            total += counts @ self.vectors[rows]
            rare = part[places < 0]
            spots, signs = _entries(rare)
            total += np.bincount(spots.ravel(), signs.ravel() / NONZERO**0.5, DIM)
            outside += len(rare)
        n = max(1, len(hashes))
        mean = total / n
        again = float((hashes[1:] == hashes[:-1]).mean()) if len(hashes) > 1 else 0.0
        shares = [outside / n, len(np.unique(hashes)) / n, again, again**0.5]
        return np.concatenate([mean, [np.linalg.norm(mean), np.log1p(len(hashes)) / 10], shares])


def train_vectors(sample: DataFrame, vocabulary: int = 8192) -> WordVectors:
    """From the texts of a bounded ``sample``: its ``vocabulary`` most frequent words get context vectors."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").cast(pa.binary()):
                seen.update(word_hashes(text.as_py()).tolist())
            words = np.fromiter(seen, np.uint64, len(seen)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    words = sample.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(vocabulary).select("word").collect()
    known = np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    vocab = WordVectors(known, np.empty((0, DIM)))

    def listed(words: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(words) + 1) * DIM, pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel().astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), lists], ["word", "vector"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(known) * DIM)
        for batch in batches:
            # all texts of the batch in a row, with gaps that are no word's neighbours
            parts = [word_hashes(text.as_py()) for text in batch.column("text").cast(pa.binary())]
            gap = np.zeros(REACH, np.uint64)
            hashes = np.concatenate([x for p in parts for x in (p, gap)] or [gap])
            real = np.concatenate([x for p in parts for x in (np.ones(len(p), bool), gap.astype(bool))] or [gap.astype(bool)])
            for at in range(0, len(hashes), WORDS_AT_ONCE):
                part, there = hashes[at : at + WORDS_AT_ONCE + REACH], real[at : at + WORDS_AT_ONCE + REACH]
                places, (spots, signs) = np.where(there, vocab.places(part), -1), _entries(part)
                signs = signs * there[:, None]
                for step in range(1, REACH + 1):
                    n = max(0, min(WORDS_AT_ONCE, len(part) - step))
                    left, right = np.arange(n), np.arange(n) + step
                    for word, other in ((left, right), (right, left)):
                        word, other = word[places[word] >= 0], other[places[word] >= 0]
                        keys = places[word][:, None] * DIM + spots[other]
                        sums += np.bincount(keys.ravel(), signs[other].ravel(), len(sums))
        table = sums.reshape(-1, DIM)
        rows = np.flatnonzero(table.any(axis=1))
        yield listed(rows, table[rows])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            table = batch.column("vector").flatten().to_numpy().reshape(-1, DIM)
            for word, vector in zip(batch.column("word").to_pylist(), table, strict=True):
                sums[word] = sums[word] + vector if word in sums else vector.copy()
        yield listed(np.array(list(sums), np.int64), np.array(list(sums.values()) or np.empty((0, DIM))))

    schema = "word long, vector array<long>"
    parts = sample.select("text").mapInArrow(contexts, schema).repartition("word").mapInArrow(added, schema)
    vectors = index_vectors(known).astype(float) / NONZERO**0.5
    for row in parts.collect():
        context = np.array(row["vector"], float)
        vectors[row["word"]] += context / max(1.0, np.linalg.norm(context))
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return WordVectors(known, (vectors / np.maximum(lengths, 1e-9)).astype(np.float32))


@dataclass
class Network:
    """``score = sigmoid((relu(z a + b) c + d) / temperature)``, ``z`` the rows in units of the training spread, within
    three of its mean."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -3, 3)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(self.inputs(x) @ a + b, 0) @ c + d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, steps: int = 1500, decay: float = 3e-3, seed: int = 5) -> Network:
    """Adam on the log loss with weight decay; every fifth row is left out and fits the temperature."""
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 25 else np.zeros(len(y), bool)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    fit_x, fit_y = np.clip((x - mean) / scale, -3, 3)[~held], y[~held]
    size = x.shape[1]
    weights = [rng.normal(0, (2 / size) ** 0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    batch = 128
    for _ in range(max(epochs, steps * batch // len(fit_y))):
        order = rng.permutation(len(fit_y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            z = fit_x[rows] @ weights[0] + weights[1]
            h = np.maximum(z, 0)
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -500, 500))) - fit_y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (z > 0)
            step += 1
            for n, gradient in enumerate((fit_x[rows].T @ back, back.sum(axis=0), h.T @ error, error.sum(keepdims=True))):
                gradient = gradient + decay * weights[n]
                first[n] = 0.9 * first[n] + 0.1 * gradient
                second[n] = 0.999 * second[n] + 0.001 * gradient**2
                weights[n] = weights[n] - 0.003 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, weights, 1.0)
    if held.any():
        logits, truth = network.logits(x[held]), y[held]

        def loss(t: float) -> float:
            return float(np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean())

        network.temperature = min(np.geomspace(0.25, 16, 121), key=loss)
    return network


@dataclass
class Model:
    words: WordVectors
    network: Network | None
    base_rate: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.base_rate)
        return self.network.scores(np.array([self.words.pool(t) for t in texts]))


def train(documents: DataFrame, labels: DataFrame, usable: Column, sample: int = 12000, seed: int = 3) -> Model:
    """Learn ``labels.quality`` from about ``sample`` texts at most, chosen by a hash of their ids.

    ``usable`` is a condition on ``doc_id``.  Null labels and ids are not used; an id with both labels counts as 0.  With no
    label, or one kind only, the model scores every text with the share of 1 (one half if there is none).
    """
    ready_for_python(documents.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    chosen = chosen.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(usable)
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = chosen.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = written(chosen.where(drawn < min(1.0, sample / max(1, n))), "chosen")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(texts.join(chosen, "doc_id"), "sample")
    words = train_vectors(rows)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [words.pool(t.as_py()).tolist() for t in batch.column("text").cast(pa.binary())]
            columns = [batch.column("doc_id"), batch.column("quality"), pa.array(vectors, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "vector"])

    found = rows.mapInArrow(pooled, "doc_id long, quality int, vector array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["vector"]))
    y = np.array([float(r["quality"]) for r in found])
    network = train_network(np.array([r["vector"] for r in found]), y) if len(set(y.tolist())) == 2 else None
    return Model(words, network, float(y.mean()) if len(y) else 0.5)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``documents(doc_id, text)``.

    A null text reads as empty and is scored too; rows with a null or repeated doc_id stay; other columns are ignored.
    """
    ready_for_python(documents.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores([t.as_py() for t in batch.column("text").cast(pa.binary())])
            predicted = pa.array((found >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), predicted], ["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        scored, "doc_id long, score double, predicted int"
    )
