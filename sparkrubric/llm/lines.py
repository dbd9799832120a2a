"""Line dedup with a log-template tree.

The tree has a fixed depth: token count, then the leading tokens, each token with a digit read as a wildcard.  In a leaf,
the token that most lines hold at a place is that place's constant; other places are variable.  A line that agrees with
enough of its leaf's constants has the leaf's template, any other line is its own template (with wildcards for tokens
with digits).  Templates that recur in enough different texts are dropped, except where they occur first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.storage import ready_for_python, written

WILDCARD = b"<*>"
DIGITS = b"0123456789"
DIGIT = re.compile(rb"[0-9]")
FILTER_BITS = 1 << 23
LINE_SCHEMA = "doc_id long, text_key long, line int, n_tokens int, leaf long, masked long"
MEMBER_SCHEMA = "text_key long, line int, leaf long, tail string"


def _tokens(line: bytes) -> list[bytes]:
    tokens = line.split()
    if len(line.translate(None, DIGITS)) < len(line):
        has_digit = DIGIT.search
        tokens = [WILDCARD if has_digit(x) else x for x in tokens]
    return tokens


def _leaf(tokens: list[bytes], depth: int) -> int:
    return xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:depth]))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lines(depth: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in LINE_SCHEMA.split(", ")]
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            ids, keys, places, sizes, leaves, masked = ([] for _ in names)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                text = text.as_py()
                before = len(places)
                for n, line in enumerate(text.split(b"\n")):
                    tokens = _tokens(line)
                    if tokens.count(WILDCARD) == len(tokens):
                        continue
                    places.append(n)
                    sizes.append(len(tokens))
                    leaves.append(_leaf(tokens, depth))
                    masked.append(digest(b" ".join(tokens)))
                found = len(places) - before
                ids += [doc_id] * found
                keys += [digest(text, 42)] * found
            small = [pa.array(x, pa.int32()) for x in (places, sizes)]
            columns = [pa.array(ids, pa.int64()), _longs(keys), *small, _longs(leaves), _longs(masked)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return lines


def _members(depth: int, bits: np.ndarray):
    """The lines whose leaf's bit is set, with their tokens after the leading ones."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEMBER_SCHEMA.split(", ")]
        flags = np.unpackbits(bits).tobytes()
        for batch in batches:
            keys, places, leaves, tails = ([] for _ in names)
            for text in batch.column("text").cast(pa.binary()):
                text = text.as_py()
                before = len(places)
                for n, line in enumerate(text.split(b"\n")):
                    tokens = _tokens(line)
                    if len(tokens) <= depth or tokens.count(WILDCARD) == len(tokens):
                        continue
                    leaf = _leaf(tokens, depth)
                    if flags[leaf & (FILTER_BITS - 1)]:
                        places.append(n)
                        leaves.append(leaf)
                        tails.append(b" ".join(tokens[depth:]))
                if len(places) > before:
                    keys += [xxhash.xxh64_intdigest(text, 42)] * (len(places) - before)
            tails = pa.array(tails, pa.binary()).cast(pa.string())
            columns = [_longs(keys), pa.array(places, pa.int32()), _longs(leaves), tails]
            yield pa.RecordBatch.from_arrays(columns, names)

    return members


def _leaf_bits(leaves: DataFrame) -> np.ndarray:
    """A bit for each leaf, by its low bits: one megabyte at any size of the data."""
    bit = F.col("leaf").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1  # Spark's bitmaps count from one
    parts = leaves.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("n"))
    parts = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(FILTER_BITS, bool)
    for part in parts.collect():
        own = np.unpackbits(np.frombuffer(part["bits"], np.uint8), bitorder="little")
        bits[(part["n"] - 1) * len(own) :][: len(own)] = own
    return np.packbits(bits)


def line_templates(documents: DataFrame, depth: int = 3, agreement: float = 0.6, min_texts: int = 10) -> DataFrame:
    """``(doc_id, text_key, line, template)`` of every line that has a token besides wildcards; ``text_key`` is the text's
    ``xxhash64``.  Only leaves that hold lines of ``min_texts`` texts, and not one line alone, are generalised: no
    template of another leaf can recur more often than its lines do.  Tokens are compared whole, and only lines of such
    leaves carry them."""
    ready_for_python(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    lines = written(texts.mapInArrow(_lines(depth), LINE_SCHEMA), "lines")
    leaves = lines.where(F.col("n_tokens") > depth).select("leaf", "text_key", "masked").distinct()
    leaves = leaves.groupBy("leaf").agg(
        F.approx_count_distinct("text_key").alias("texts"), F.min("masked").alias("low"), F.max("masked").alias("high")
    )
    # the approximate count only decides which leaves are worth a look, with a wide margin
    busy = written(leaves.where((F.col("texts") * 2 >= min_texts) & (F.col("low") < F.col("high"))).select("leaf"), "leaves")
    members = texts.select("text").mapInArrow(_members(depth, _leaf_bits(busy)), MEMBER_SCHEMA).join(busy, "leaf")
    members = written(members.select("text_key", "line", "leaf", F.split("tail", " ").alias("tail")), "members")
    counts = members.select("leaf", F.posexplode("tail").alias("place", "token"))
    counts = counts.groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    sizes = members.groupBy("leaf").agg(F.count("*").alias("lines"))
    constants = counts.join(sizes, "leaf").where("2 * n > lines").groupBy("leaf")
    constants = written(constants.agg(F.collect_list(F.struct("place", "token")).alias("constants")), "constants")
    agreeing = F.size(F.filter("constants", lambda c: F.get("tail", c["place"]) == c["token"]))
    general = members.join(constants, "leaf").where(agreeing / F.size("tail") >= agreement)
    general = written(general.select("text_key", "line", "leaf").distinct(), "general")
    general = general.select("text_key", "line", F.xxhash64("leaf").alias("general"))
    template = F.coalesce("general", "masked").alias("template")
    return lines.drop("n_tokens", "leaf").join(general, ["text_key", "line"], "left").select("doc_id", "text_key", "line", template)


def drop_templates(
    documents: DataFrame, depth: int = 3, agreement: float = 0.6, min_texts: int = 10
) -> DataFrame:
    """``documents`` without the lines whose template recurs in ``min_texts`` different texts or more, with ``n_lines`` and
    ``n_dropped``.

    A recurring template stays where it occurs first (smallest doc_id, then line), so text that was copied as a whole is
    not lost.  Copies of one text count as one text.  Lines are what newlines separate; lines without a token besides
    wildcards (blank lines, rows of numbers) stay.  A null text stays null with no lines; an empty text has one empty
    line; a null doc_id counts as the largest; repeated rows are treated alike.  Other columns are kept, except that
    columns named ``n_lines`` and ``n_dropped`` are replaced.
    """
    templates = written(line_templates(documents, depth, agreement, min_texts), "templates")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "line")
    recurring = templates.groupBy("template").agg(F.countDistinct("text_key").alias("texts"), F.min(order).alias("first"))
    recurring = written(recurring.where(F.col("texts") >= min_texts).select("template", "first"), "recurring")
    later = templates.join(recurring, "template").where(~order.eqNullSafe(F.col("first")))
    later = later.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("dropped"))
    later = written(later.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "dropped"), "dropped")

    rows = documents.select(F.struct(*documents.columns).alias("row"))
    text = F.col("row.text").cast("string")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("of")) & (F.xxhash64(text) == F.col("key"))
    joined = rows.join(later, same, "left")
    parts = F.split(text, "\n", -1)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(parts))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: parts[i]), "\n"))
    own = [kept.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in documents.columns if c not in ("n_lines", "n_dropped")]
    dropped = F.coalesce(F.size("dropped"), F.lit(0))
    return joined.select(*own, n_lines.alias("n_lines"), F.greatest(dropped, F.lit(0)).alias("n_dropped"))
