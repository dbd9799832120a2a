"""SentencePiece encoding and decoding of documents of any length.

A BPE encoding is the only cut of a text into pieces in which no two neighbours could merge first (each pair, encoded
by itself, gives itself).  So a path through the lattice of pieces weighs 0 if all its neighbours fit and minus infinity if
not, and the encoding is the one best path, in the max-plus sense.  A document longer than a chunk is cut near every
``chunk_chars`` characters.  Each cut has states, the places where a piece may end: one where a word begins, since no
piece goes on over the start of a word, else as many as the longest piece has characters.  Each chunk yields a matrix over
the states of its two cuts, the matrices are combined in order, the best states are traced back, and each chunk is
encoded by itself between its two states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.storage import ready_for_python, written

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NONE = float("-inf")
#: Characters read at either end of a chunk before its pieces are compared with those of the whole chunk.
EDGE_CHARS = 256


class Pieces:
    """A BPE model that normalizes nothing but spaces, with its prefix space added here instead of by the library."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        plain = not spec.normalizer_spec.precompiled_charsmap and not spec.normalizer_spec.remove_extra_whitespaces
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not plain or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and without normalization is needed")
        pieces = [p.piece for p in spec.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL]
        self.cut_at_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.longest = max(map(len, pieces))
        self.prefix = SPACE if spec.normalizer_spec.add_dummy_prefix else ""
        spec.normalizer_spec.add_dummy_prefix = False
        self.library = SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.fits = lru_cache(1 << 16)(self._fits)

    def spaced(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, spaced: str) -> list[int]:
        return self.library.encode(spaced)

    def decode(self, ids: list[int], first: bool = True) -> str:
        text = self.library.decode(ids)
        return text[len(self.prefix) :] if first else text

    def surfaces(self, spaced: str) -> list[str]:
        """The pieces of a text as they stand in it; a character without a piece is one."""
        return [p.surface for p in self.library.encode(spaced, return_type="proto").pieces if p.surface]

    def _fits(self, left: str, right: str) -> bool:
        return self.surfaces(left + right) == [left, right]

    def states(self, spaced: str, at: int, until: int) -> list[int]:
        """Places at ``at`` or after it, one of which ends a piece: the start of a word before ``until``, if there is one."""
        if self.cut_at_words:
            place = spaced.find(SPACE, at, until)
            while place > 0 and spaced[place - 1] == SPACE:
                place = spaced.find(SPACE, place + 1, until)
            if place > 0:
                return [place]
        return list(range(at, min(at + self.longest, len(spaced) + 1)))

    def transfer(self, text: str, starts: list[int], ends: list[int]) -> list[list[tuple[str, str]]]:
        """First and last piece of the text between each start and each end."""
        whole = _offsets(self.surfaces(text[starts[0] : ends[-1]]), starts[0])

        def meeting(run: list[tuple[int, str]], step: int) -> int | None:
            shared = sorted(set(run) & set(whole))
            return shared[0 if step > 0 else -1][0] if shared else None

        heads = [_offsets(self.surfaces(text[i : i + EDGE_CHARS]), i)[:-1] for i in starts]
        tails = [_offsets(self.surfaces(text[max(0, j - EDGE_CHARS) : j]), max(0, j - EDGE_CHARS))[1:] for j in ends]
        table = []
        for i, head in zip(starts, heads, strict=True):
            row = []
            for j, tail in zip(ends, tails, strict=True):
                a, b = meeting(head, 1), meeting(tail, -1)
                if a is not None and b is not None and a < b:
                    row.append((head[0][1], tail[-1][1]))
                else:
                    run = self.surfaces(text[i:j])
                    row.append((run[0], run[-1]))
            table.append(row)
        return table


def _offsets(surfaces: list[str], at: int) -> list[tuple[int, str]]:
    found = []
    for s in surfaces:
        found.append((at, s))
        at += len(s)
    return found


@lru_cache(4)
def _pieces(digest: str, model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> tuple[str, bytes]:
    """The model file, read on the driver and shipped with the tasks."""
    model = Path(path).read_bytes()
    return hashlib.sha256(model).hexdigest(), model


def _whole(model: tuple[str, bytes]):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(*model)
        for batch in batches:
            ids, same = [], []
            for text in batch.column("text"):
                text = text.as_py()
                ids.append(None if text is None else pieces.encode(pieces.spaced(text)))
                same.append(None if text is None else pieces.decode(ids[-1]) == text)
            columns = [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "round_trip"])

    return encoded


CHUNK_SCHEMA = "row long, doc_id long, chunk int, text string, starts array<int>, ends array<int>, spaces boolean"


def _cut(model: tuple[str, bytes], chunk_chars: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(*model)
        ints = pa.list_(pa.int32())
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), ints, ints, pa.bool_())
        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(x) for x in ("row", "doc_id", "text")), strict=True):
                text = text.as_py()
                spaced = pieces.spaced(text)
                cuts = [[0]]
                for at in range(chunk_chars, len(spaced) - chunk_chars // 2, chunk_chars):
                    cuts.append(pieces.states(spaced, at, at + chunk_chars // 4))
                cuts.append([len(spaced)])
                made = [
                    (row.as_py(), doc_id.as_py(), n, spaced[a[0] : b[-1]], [x - a[0] for x in a], [x - a[0] for x in b], SPACE not in text)
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                ]
                columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def _transfers(model: tuple[str, bytes]):
    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(*model)
        for batch in batches:
            tables = []
            for text, starts, ends in zip(*(batch.column(x).to_pylist() for x in ("text", "starts", "ends")), strict=True):
                one = len(starts) == len(ends) == 1
                table = [[("", "")]] if one else pieces.transfer(text, starts, ends)
                tables.append([[list(cell) for cell in row] for row in table])
            kind = pa.list_(pa.list_(pa.list_(pa.string())))
            columns = [batch.column(x) for x in ("row", "chunk", "starts", "ends")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tables, kind)], ["row", "chunk", "starts", "ends", "cells"])

    return transfers


def trace(tables: list[list[list[tuple[str, str]]]], fits) -> list[int]:
    """The state of each cut on the best path through the chunks' matrices.

    A cell is 0 with its first and last piece; two chunks meet at 0 if those fit, else at minus infinity.  A cut with one
    state is the start of a word, where any two pieces fit.
    """
    best: list[tuple[float, str]] = [(0.0, "")]
    back: list[list[int]] = []
    for table in tables:
        forced, reached, came = len(best) == 1, [], []
        for end in range(len(table[0])):
            ways = [
                (w + (0.0 if forced or w == NONE or fits(last, row[end][0]) else NONE), -n, row[end][1])
                for n, ((w, last), row) in enumerate(zip(best, table, strict=True))
            ]
            w, n, last = max(ways)
            reached.append((w, last))
            came.append(-n)
        best = reached
        back.append(came)
    if best[0][0] == NONE:
        raise ValueError("no path fits: the model's pieces don't merge by score alone")
    states = [0]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def _paths(model: tuple[str, bytes]):
    def paths(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("chunk")
        states = trace([[[tuple(c) for c in row] for row in table] for table in chunks["cells"]], _pieces(*model).fits)
        starts = [int(s[x]) for s, x in zip(chunks["starts"], states[:-1], strict=True)]
        ends = [int(e[x]) for e, x in zip(chunks["ends"], states[1:], strict=True)]
        return pd.DataFrame({"row": chunks["row"], "chunk": chunks["chunk"], "start": starts, "end": ends})

    return paths


def _parts(model: tuple[str, bytes]):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(*model)
        for batch in batches:
            ids, same = [], []
            for chunk, text, start, end, spaces in zip(*(batch.column(x).to_pylist() for x in ("chunk", "text", "start", "end", "spaces")), strict=True):
                text = text[start:end]
                ids.append(pieces.encode(text))
                plain = text[len(pieces.prefix) if chunk == 0 else 0 :].replace(SPACE, " ")
                same.append(spaces and pieces.decode(ids[-1], chunk == 0) == plain)
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("chunk")]
            arrays = [*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "chunk", "ids", "round_trip"])

    return parts


def encode(documents: DataFrame, model_path: str = DEFAULT_MODEL, chunk_chars: int = 32768) -> DataFrame:
    """``(doc_id, ids, n_tokens, round_trip)`` of every row of ``documents(doc_id, text)``.

    ``ids`` are those that the library gives for the whole text.  ``round_trip`` tells whether they decode to the text:
    always, unless the text itself holds the character that stands for spaces.  A null text has null ids, no tokens and a
    null round trip; an empty text has empty ids.  Null ids of documents and repeated rows stay; other columns are
    ignored; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    ready_for_python(spark)
    model = read_model(model_path)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    long = F.coalesce(F.length("text") > 2 * chunk_chars, F.lit(False))
    whole = texts.where(~long).mapInArrow(_whole(model), "doc_id long, ids array<int>, round_trip boolean")

    chunks = texts.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = chunks.mapInArrow(_cut(model, chunk_chars), CHUNK_SCHEMA).repartition("row", "chunk")
    chunks = written(chunks, "chunks")
    cells = chunks.select("row", "chunk", "text", "starts", "ends").mapInArrow(
        _transfers(model), "row long, chunk int, starts array<int>, ends array<int>, cells array<array<array<string>>>"
    )
    paths = cells.groupBy("row").applyInPandas(_paths(model), "row long, chunk int, start int, end int")
    parts = chunks.join(paths, ["row", "chunk"]).select("row", "doc_id", "chunk", "text", "start", "end", "spaces")
    parts = parts.mapInArrow(_parts(model), "row long, doc_id long, chunk int, ids array<int>, round_trip boolean")
    joined = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"),
        F.bool_and("round_trip").alias("round_trip"),
    )
    joined = joined.select("doc_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), "round_trip")
    n_tokens = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids"))
    return whole.unionByName(joined).select("doc_id", "ids", n_tokens.alias("n_tokens"), "round_trip")


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; null ids give a null text."""
    model = read_model(model_path)
    ready_for_python(encoded.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(*model)
        for batch in batches:
            texts = [None if x.as_py() is None else pieces.decode(x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(decoded, "doc_id long, text string")
