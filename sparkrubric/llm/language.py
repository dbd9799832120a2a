"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies) its letters' vectors, rotated by
their place; a text bundles (adds) its trigrams' vectors; a language's prototype bundles its training texts.  A text gets
the language whose prototype has the highest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrubric.llm.storage import ready_for_python

UNKNOWN = "und"
CACHED_TRIGRAMS = 1 << 16
LETTERS_AT_ONCE = 1 << 20


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Encoder:
    """Bundles texts into vectors of ``dim`` whole numbers; a cache of trigram vectors is emptied when full."""

    def __init__(self, dim: int, seed: int) -> None:
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self._empty()

    def _empty(self) -> None:
        self.places: dict[int, int] = {}
        self.vectors = np.empty((1024, self.dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            drawn = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[code] = drawn * np.int8(2) - np.int8(1)
        return self.letters[code]

    def _place(self, key: int) -> int:
        at = len(self.places)
        if at == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        a, b, c = (self.letter(key >> shift & 0x1FFFFF) for shift in (42, 21, 0))
        self.vectors[at] = np.roll(a, 2) * np.roll(b, 1) * c
        self.places[key] = at
        return at

    def bundle(self, text: str) -> np.ndarray | None:
        """The sum of the text's trigram vectors, or None if it has no letter.  Runs of other characters are one gap, and so
        are the seams of a text that is bundled in parts."""
        total = None
        for at in range(0, len(text), LETTERS_AT_ONCE):
            codes = np.frombuffer(text[at : at + LETTERS_AT_ONCE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            kept = _is_letter()[codes]
            if not kept.any():
                continue
            kept_or_gap = kept.copy()
            kept_or_gap[1:] |= kept[:-1]
            symbols = np.where(kept, codes, 0)[kept_or_gap].astype(np.int64)
            symbols = np.concatenate([[0] * bool(symbols[0]), symbols, [0] * bool(symbols[-1])]).astype(np.int64)
            if len(symbols) < 3:
                continue
            keys, counts = np.unique(symbols[:-2] << 42 | symbols[1:-1] << 21 | symbols[2:], return_counts=True)
            total = self._sum(keys, counts) if total is None else total + self._sum(keys, counts)
        return total

    def _sum(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dim)
        for at in range(0, len(keys), 4096):
            if len(self.places) > CACHED_TRIGRAMS:
                self._empty()
            get = self.places.get
            rows = [x if (x := get(k)) is not None else self._place(k) for k in keys[at : at + 4096].tolist()]
            total += counts[at : at + 4096].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


@lru_cache(4)
def _encoder(dim: int, seed: int) -> Encoder:
    return Encoder(dim, seed)


def train(
    documents: DataFrame, languages: Column, dim: int = 1024, seed: int = 1, sample_per_language: int = 2000
) -> dict[str, np.ndarray]:
    """Prototypes of unit length by language, from ``text`` and the ``languages`` column (null: not used).

    Fitted on a sample of about ``sample_per_language`` texts of each language, chosen by a hash of their ids.  What comes
    to the driver is a count and a vector for each language.
    """
    labelled = documents.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), languages.cast("string").alias("lang")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.create_map(
        *[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_per_language / n))]
    )
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(drawn < share[F.col("lang")]).select("text", "lang")
    ready_for_python(documents.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, totals = _encoder(dim, seed), {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                vector = encoder.bundle(text.as_py())
                if vector is not None:
                    lang = lang.as_py()
                    totals[lang] = totals[lang] + vector if lang in totals else vector
        vectors = [v.astype(np.int64).tolist() for v in totals.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array(vectors, pa.list_(pa.int64()))], ["lang", "vector"]
        )

    parts = sample.mapInArrow(sums, "lang string, vector array<long>")
    rows = parts.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    prototypes: dict[str, np.ndarray] = {}
    for row in rows.collect():
        prototypes.setdefault(row["lang"], np.zeros(dim))[row["place"]] = row["x"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(prototypes.items()) if np.linalg.norm(v)}


def predict(
    documents: DataFrame, prototypes: dict[str, np.ndarray], dim: int = 1024, seed: int = 1, temperature: float = 0.05
) -> DataFrame:
    """Every row of ``documents`` with ``lang_pred``, ``score`` and ``cosine`` (columns of those names are replaced).

    ``cosine`` is that of the best language; ``score`` is its share of ``exp(cosine / temperature)`` over all languages.
    A null text, a text without a letter and a run without prototypes give ``und`` with zeros.  Equal cosines go to the
    first language by name.  Repeated rows and rows without an id stay.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[x] for x in names]).reshape(len(names), dim)
    ready_for_python(documents.sparkSession)

    def guess(text: str | None) -> tuple[str, float, float]:
        vector = _encoder(dim, seed).bundle(text) if text and names else None
        if vector is None or not (length := np.linalg.norm(vector)):
            return UNKNOWN, 0.0, 0.0
        cosines = np.clip(matrix @ vector / length, -1, 1)
        best = int(np.argmax(cosines))
        return names[best], float(1 / np.exp((cosines - cosines[best]) / temperature).sum()), max(0.0, float(cosines[best]))

    given = documents.drop("lang_pred", "score", "cosine")
    given = given.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType(list(given.schema.fields))
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cosine", T.DoubleType())):
        schema = schema.add(name, kind)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guess(x.as_py()) for x in batch.column("text")]
            kinds = (pa.string(), pa.float64(), pa.float64())
            columns = [pa.array([x[n] for x in found], kind) for n, kind in enumerate(kinds)]
            names = [*batch.schema.names, "lang_pred", "score", "cosine"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return given.mapInArrow(predicted, schema)
