"""Positions and ordered choices that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx


def range_bucket(df: DataFrame, column: str, rows_per_bucket: int = 1 << 20) -> Column:
    """A bucket number that rises with a numeric column, from its range and the number of rows: about
    ``rows_per_bucket`` rows each where values are even, and 65,536 buckets at most, so that neither a bucket nor the list
    of a key's buckets outgrows a task."""
    found = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, min(1 << 16, -(-found["n"] // rows_per_bucket)))
    if found["low"] is None or n == 1:
        return F.lit(0)
    width = (float(found["high"]) - float(found["low"])) / n or 1.0
    return F.coalesce(F.floor((F.col(column) - F.lit(found["low"])) / F.lit(width)).cast("int"), F.lit(-1))


def running_index(
    df: DataFrame, keys: list[str], bucket: Column | str, order: list[str], name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row within its key and the key's row count (``{name}_of``).

    ``bucket`` must not decrease along ``order``; a column name stands for ``range_bucket`` of it.  Rows are ranked within
    (key, bucket), and bucket sizes, summed on the map side, give the offset; so a hot key is spread over its buckets
    instead of being sorted in one task.
    """
    marked = df.withColumn("_bucket", range_bucket(df, bucket) if isinstance(bucket, str) else bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{name}_of"),
    )
    same = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    ranked = marked.withColumn("_inside", inside).join(offsets, same)
    return ranked.withColumn(name, F.col("_offset") + F.col("_inside")).drop(
        "_bucket", "_k_bucket", "_offset", "_inside", *[f"_k_{k}" for k in keys]
    )


def round_robin(position: Column, days: Column | int) -> Column:
    """Day 1..n of the item at a 0-based position."""
    n = F.lit(days) if isinstance(days, int) else days
    return position % n + 1


def difficulty_by_position(position: Column, total: Column) -> Column:
    """First 40% easy, next 40% medium, the rest hard."""
    return F.when(position < total * 0.4, "easy").when(position < total * 0.8, "medium").otherwise("hard")


def disambiguate(df: DataFrame, keys: list[str], name: str, bucket: Column | str, order: list[str]) -> DataFrame:
    """Add ``unique_name``: names that repeat within a key get their running number."""
    indexed = running_index(df, [*keys, name], bucket, order, "_nth")
    numbered = F.concat(F.col(name), F.lit(" ("), (F.col("_nth") + 1).cast("string"), F.lit(")"))
    return indexed.withColumn(
        "unique_name", F.when(F.col("_nth_of") > 1, numbered).otherwise(F.col(name))
    ).drop("_nth", "_nth_of")


def best_row(df: DataFrame, keys: list[str], order: list[Column], name: str = "best") -> DataFrame:
    """One struct per key: the row that sorts first.  An aggregate, so it reduces before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias(name))


def first_feasible(candidates: DataFrame, keys: list[str], attempt: str, feasible: Column) -> DataFrame:
    """The first feasible attempt per key, and how many attempts were spent before it."""
    return candidates.where(feasible).groupBy(*keys).agg(F.min(attempt).alias(attempt))


def trigrams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, pos, trigram`` over lower-case words, built inside the row."""

    def triples(words: Column) -> Column:
        each = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
        return F.slice(each, 1, F.greatest(F.size(words) - 2, F.lit(0)))

    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(tx.WORD_CHAR + "+"), F.lit(0))
    return df.select(*keys, F.posexplode(tx.let(words, triples)).alias("pos", "trigram"))


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a repeatable random order."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy(
        "shuffle_key", key
    )
