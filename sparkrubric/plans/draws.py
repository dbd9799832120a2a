"""Repeatable draws from a seed column.

Every draw hashes ``seed:label``, so it depends on nothing but the row and any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 4294967296.0


class Draw:
    """Draws for one seed column; each use names its own label."""

    def __init__(self, seed: Column | str) -> None:
        self.seed = (F.col(seed) if isinstance(seed, str) else seed).cast("string")

    def digest(self, label: str, item: Column | None = None) -> Column:
        parts = [self.seed, F.lit(f":{label}")]
        if item is not None:
            parts += [F.lit(":"), item.cast("string")]
        return F.md5(F.concat(*parts))

    def unit(self, label: str, item: Column | None = None) -> Column:
        """Uniform in [0, 1)."""
        return F.conv(F.left(self.digest(label, item), F.lit(8)), 16, 10).cast("double") / RANGE

    def chance(self, label: str, p: Column | float) -> Column:
        return self.unit(label) < p

    def integer(self, label: str, low: int, high: int, item: Column | None = None) -> Column:
        """Uniform integer, both ends included."""
        return (F.lit(low) + F.floor(self.unit(label, item) * (high - low + 1))).cast("int")

    def choice(self, label: str, values: list | Column, item: Column | None = None) -> Column:
        options = F.array(*[F.lit(v) for v in values]) if isinstance(values, list) else values
        return F.get(options, F.floor(self.unit(label, item) * F.size(options)).cast("int"))

    def shuffle(self, label: str, items: Column) -> Column:
        """The items in random order."""
        keyed = F.transform(items, lambda x, n: F.struct(self.digest(label, n).alias("k"), n.alias("n"), x.alias("x")))
        in_order = F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        return F.transform(in_order, lambda s: s["x"])

    def sample(self, label: str, items: Column, count: Column) -> Column:
        return F.slice(self.shuffle(label, items), 1, F.least(count, F.size(items)))
