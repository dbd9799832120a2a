"""Mixing sources to target weights by Poisson replication.

A document of a source with repetition rate r is repeated k times, k the value of a Poisson distribution with mean r at a
hash of the document's id.  The copies are shuffled globally by a hash key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.llm.storage import written

#: Mean of one inverted distribution; a higher rate is the sum of several independent ones.
LARGEST_MEAN = 500.0


def _hash(digits: int, *parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, digits), 16, 10).cast("long")


def repetition_rates(
    documents: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, size: float = 1.0
) -> DataFrame:
    """``(source, n, rate)`` for each source, null included.

    ``weights`` are the target shares (sources that it doesn't name get none); without them a source's weight is its
    number of documents to the power ``exponent``.  The mixture has about ``size`` times the documents there are.
    """
    counts = written(documents.groupBy(F.col("source").cast("string")).agg(F.count("*").alias("n")), "sources")
    if weights is None:
        counts = counts.withColumn("weight", F.sqrt("n") if exponent == 0.5 else F.pow("n", F.lit(float(exponent))))
    else:
        named = documents.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "name string, weight double")
        counts = counts.join(named, F.col("source") == F.col("name"), "left").drop("name").fillna(0.0, ["weight"])
    total = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(total["weight"]) * F.lit(size * total["n"]) / F.col("n")
    return counts.select("source", "n", rate.alias("rate"))


def _cumulative(mean: Column) -> Column:
    """The distribution function at 0, 1, ... up to where it is 1 to double precision."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["sums"])


def mix(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    size: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """``documents(doc_id, text, source)`` repeated to the target weights, with ``copy`` (1, 2, ...) and ``shuffle_key``.

    Rows are dealt over the partitions by ``shuffle_key`` and sorted by it there; ordering by it gives one global order for
    any number of partitions.  A null source is a source of its own.  A null doc_id is drawn by its text, a null text
    reads as empty; repeated rows are drawn alike.  Other columns stay, except ``copy`` and ``shuffle_key``, which
    are replaced.  An empty table, or no weight above zero, gives no rows.
    """
    rates = repetition_rates(documents, weights, exponent, size).where("rate > 0")
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    rates = rates.select(F.col("source").alias("of"), parts.alias("parts"), _cumulative(F.col("rate") / parts).alias("sums"))
    rates = written(rates, "rates")

    rows = documents.select(F.struct(*documents.columns).alias("row"))
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    joined = rows.join(rates, F.col("row.source").cast("string").eqNullSafe(F.col("of")))

    def drawn(part: Column) -> Column:
        u = _hash(13, F.lit(f"{seed}:"), key, F.lit(":"), part.cast("string")) / float(1 << 52)
        return F.size(F.filter(F.col("sums"), lambda x: x <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), drawn), F.lit(0), lambda a, b: a + b)
    copies = joined.withColumn("n", count).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    order = _hash(15, F.lit(f"{seed}#"), key, F.lit(":"), F.col("copy").cast("string"))
    own = [F.col(f"row.`{c}`") for c in documents.columns if c not in ("copy", "shuffle_key")]
    mixed = copies.select(*own, "copy", order.alias("shuffle_key"))
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
