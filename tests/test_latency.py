"""Exact percentiles from bracketed ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrubric.operators import reports as rp


def test_latency_percentiles(spark):
    rng = np.random.default_rng(4)
    groups = {
        "one": [3.5], "two": [2.0, 9.0], "three": [1.0, 1.0, 5.0], "ties": [7.0] * 900 + [8.0] * 100, None: [1.0, 2.0, 4.0],
        "long": rng.lognormal(1, 2, 30_000).tolist(), "few": rng.integers(0, 40, 5_000).astype(float).tolist(),
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("two", None), ("none", None)]
    df = spark.createDataFrame(rows, "run string, latency double").repartition(7)
    got = {r["run"]: r for r in rp.latency_summary(df, ["run"]).collect()}
    assert set(got) == {*groups, "none"}
    assert got["none"]["n"] == 0 and got["none"]["p50_latency"] is None and got["none"]["max_latency"] is None
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs)
        for q in (50, 95, 99):
            assert got[g][f"p{q}_latency"] == pytest.approx(np.percentile(xs, q), rel=1e-12)
    empty = rp.latency_summary(df.where(F.lit(False)), ["run"])
    assert empty.collect() == [] and empty.columns[-1] == "p99_latency"
