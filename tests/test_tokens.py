"""Offsets of tokens, against running lengths in Python, across the sizes at which lengths are added up."""

import random

from pyspark.sql import functions as F

from sparkrubric.functions import text as tx


def test_running_ends(spark):
    rng = random.Random(5)
    sizes = [0, 1, tx.RUN - 1, tx.RUN, tx.RUN + 1, tx.RUN * tx.RUNS - 1, tx.RUN * tx.RUNS, tx.RUN * tx.RUNS + 1, 5000]
    rows = [(n, ["x" * rng.randint(0, 9) for _ in range(n)]) for n in sizes]
    found = spark.createDataFrame(rows, "n int, pieces array<string>").select("n", tx.running_ends(F.col("pieces")).alias("ends"))
    want = {n: [sum(map(len, pieces[: i + 1])) for i in range(n)] for n, pieces in rows}
    assert {r["n"]: r["ends"] for r in found.collect()} == want


def test_every_space_is_trimmed(spark):
    assert tx.RUN <= 16  # additions for a token, on average half of these
    text = "a" + "".join(f"{c}b" for c in tx.SPACES) + f"{tx.SPACES}é 1,5 ă-b"
    got = tx.tokens(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").orderBy("pos").collect()
    assert [r["token"] for r in got] == ["a", *["b"] * len(tx.SPACES), "é", "1,5", "ă-b"]
    assert all(text[r["start"] : r["end"]] == r["token"] for r in got)
    matched = spark.range(1).select(F.regexp_count(F.lit(tx.SPACES), F.lit(tx.SPACE)).alias("n")).first()["n"]
    assert matched == len(tx.SPACES)
