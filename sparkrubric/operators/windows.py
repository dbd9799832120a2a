"""Short byte strings in many texts: one scan in numpy that tells which of them a text holds.

A text holds a string if one of its windows of that many bytes equals it.  The scan doesn't know the strings, only two
tables of fixed size made from them: the lengths that strings with a given beginning have, and bits of whole strings.  What
passes both is returned as it stands in the text, so that a join on equality decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrubric.sources.lineage import ship_package

#: Bytes of the longest window; a window's length is a bit of a word.
LONGEST = 64
#: Bytes of a beginning, slots for beginnings, bits for whole strings; none grows with the data.
HEAD, HEAD_BITS, KEY_BITS = 4, 16, 22
#: Bytes of text that are scanned together.
STRETCH = 1 << 17
#: Windows that are held, repeats included, before they are made distinct.
AT_ONCE = 1 << 20


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [base] * (STRETCH + LONGEST), np.uint64))


_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


class Marks:
    """What the scan knows of the strings: lengths by slot of the beginning, and bits of whole strings."""

    def __init__(self, lengths: np.ndarray, bits: np.ndarray) -> None:
        self.lengths, self.bits = lengths, bits
        every = int(np.bitwise_or.reduce(lengths))
        self.heads: list[tuple[int, list[int], np.ndarray]] = []
        for head in range(1, HEAD + 1):
            sizes = [size for size in range(1, LONGEST + 1) if every >> size - 1 & 1 and min(size, HEAD) == head]
            if sizes:
                self.heads.append((head, sizes, (lengths & np.uint64(sum(1 << size - 1 for size in sizes))) != 0))


class Stretch:
    """Some bytes, followed by so many more that a window may begin at each of the first ``n``."""

    def __init__(self, data: np.ndarray, n: int) -> None:
        self.data = np.zeros(n + LONGEST, np.uint8)
        self.data[: len(data)] = data[: n + LONGEST]
        codes = np.empty(-(-n // HEAD) * HEAD, np.uint32)
        for k in range(HEAD):
            codes[k::HEAD] = self.data[k : k + len(codes)].view("<u4")
        self._codes = codes[:n]
        self._sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(self.data * _POWERS[: len(self.data)], out=self._sums[1:])

    def slots(self, size: int) -> np.ndarray:
        """Slot of the ``size`` bytes, four at most, that begin at each place; one or two bytes are their own slot."""
        codes = self._codes if size == HEAD else self._codes & np.uint32((1 << 8 * size) - 1)
        return codes if 8 * size <= HEAD_BITS else codes * np.uint32(0x9E3779B1) >> np.uint32(32 - HEAD_BITS)

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes at some places; the same wherever these bytes stand."""
        keys = (self._sums[at + size] - self._sums[at]) * _INVERSES[at] + np.uint64(size)
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0xD6E8FEB86659FD93)
        return keys ^ keys >> np.uint64(32)

    def marked(self, marks: Marks) -> Iterator[tuple[int, np.ndarray]]:
        """Lengths and places of the windows that pass both tables."""
        for head, sizes, begins in marks.heads:
            slots = self.slots(head)
            begun = np.flatnonzero(begins[slots])
            lengths = marks.lengths[slots[begun]]
            for size in sizes:
                at = begun[lengths & np.uint64(1 << size - 1) != 0]
                if 8 * size > HEAD_BITS:
                    keys = self.keys(at, size)
                    words = marks.bits[(keys >> np.uint64(6) & np.uint64((1 << KEY_BITS - 6) - 1)).astype(np.int64)]
                    at = at[words >> (keys & np.uint64(63)) & np.uint64(1) != 0]
                if len(at):
                    yield size, at

    def rows_and_windows(self, rows: np.ndarray, at: np.ndarray, size: int) -> pa.Table:
        """``row, window`` of places; windows of four bytes or less, which come often, once for each row."""
        if size <= HEAD:
            pairs = np.unique(rows.astype(np.uint64) << np.uint64(32) | self._codes[at] & np.uint32((1 << 8 * size) - 1))
            rows = (pairs >> np.uint64(32)).astype(np.int64)
            windows = pairs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        else:
            windows = self.data[at[:, None] + np.arange(size)]
        flat = pa.py_buffer(np.ascontiguousarray(windows))
        windows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, flat]).cast(pa.binary())
        return pa.table({"row": rows, "window": windows})


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings of a column without nulls as one run of bytes, and where each begins and the last ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def held_windows(texts: pa.Array, marks: Marks) -> pa.Table:
    """``row, window``: the marked windows that each text holds, once each."""
    data, ends = _bytes(texts)
    found = pa.table({"row": pa.array([], pa.int64()), "window": pa.array([], pa.binary())})
    parts, held = [found], 0
    for low in range(0, len(data), STRETCH):
        stretch = Stretch(data[low : low + STRETCH + LONGEST], min(STRETCH, len(data) - low))
        for size, at in stretch.marked(marks):
            rows = np.searchsorted(ends, low + at, "right") - 1
            inside = low + at + size <= ends[rows + 1]
            parts.append(stretch.rows_and_windows(rows[inside], at[inside], size))
            held += parts[-1].num_rows
        # not more repeats at a time than there are distinct rows, or ``AT_ONCE``
        if held > max(AT_ONCE, found.num_rows) or low + STRETCH >= len(data):
            found = pa.concat_tables(parts).group_by(["row", "window"], use_threads=False).aggregate([])
            parts, held = [found.select(["row", "window"])], 0
    return found


def _scan(marks: Marks):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held_windows(batch.column("_text"), marks).combine_chunks()
            rows, windows = found["row"], found["window"]
            texts = batch.column("_text").cast(pa.large_string())
            long = pc.equal(pc.binary_length(windows), LONGEST)
            kept = texts.take(pc.if_else(long, rows, None))
            out = pa.table({"_text_id": batch.column("_text_id").take(rows), "_text": kept, "_window": windows})
            yield from out.to_batches()

    return scan


def _marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(w), Stretch(np.frombuffer(w, np.uint8), 1)) for w in batch.column("_window").to_pylist()]
        slots = [int(one.slots(min(size, HEAD))[0]) for size, one in rows]
        keys = [one.keys(np.zeros(1, np.int64), size).astype(np.int64)[0] for size, one in rows]
        sizes = pa.array([size for size, _ in rows], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), sizes, pa.array(keys, pa.int64())], ["slot", "size", "key"])


def _filled(rows: DataFrame, slot: str, bit: str, n: int) -> np.ndarray:
    """``n`` words of 64 bits with the bits of all rows set; no more numbers than words come to the driver."""
    words = rows.select(F.expr(slot).alias("slot"), F.expr(f"shiftleft(1L, cast({bit} AS int))").alias("word"))
    out = np.zeros(n, np.int64)
    for row in words.groupBy("slot").agg(F.bit_or("word").alias("word")).collect():
        out[row["slot"]] = row["word"]
    return out.view(np.uint64)


def marks_of(strings: DataFrame) -> Marks:
    """The marks of a column ``_window`` of binary strings of 1 to ``LONGEST`` bytes."""
    ship_package(strings.sparkSession)
    rows = strings.select("_window").mapInArrow(_marks_of, "slot int, size int, key long")
    lengths = _filled(rows, "slot", "size - 1", 1 << HEAD_BITS)
    bits = _filled(rows, f"shiftright(pmod(key, {1 << KEY_BITS}), 6)", "pmod(key, 64)", 1 << KEY_BITS - 6)
    return Marks(lengths, bits)


def scan_windows(texts: DataFrame, marks: Marks) -> DataFrame:
    """``_text_id, _text, _window`` from ``_text_id, _text`` without null texts: what each text holds of the marked strings,
    and some windows more by chance.  The text comes along only with windows of ``LONGEST`` bytes, which may be the end
    of a longer string."""
    ship_package(texts.sparkSession)
    kind = texts.schema["_text_id"].dataType.simpleString()
    return texts.select("_text_id", "_text").mapInArrow(_scan(marks), f"_text_id {kind}, _text string, _window binary")
