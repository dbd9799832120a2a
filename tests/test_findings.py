"""Findings of a run: whole, and worked out from one pass over the metrics."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from sparkrubric.operators import quality as ql
from sparkrubric.operators import reports as rp

TEXTS = [
    ("a", "Ana are mere .Si pere", ["A1", "A2"]), ("a", "Ana are mere .Si pere", ["A1"]), ("b", None, None), ("c", "", []),
    ("d", "the most important thing about this is the weather", ["A2", None]), (None, "Azi  mergem la piata", ["A1"]),
    ("e", "casa noastra este mare si frumoasa " * 40, []),
]


def test_findings_score_a_text_once(spark):
    texts = spark.createDataFrame(TEXTS, "id string, text string, missing array<string>").repartition(2)
    results = spark.createDataFrame([("a", "c1", False), ("a", "c2", True), ("b", "c1", None), (None, "c2", False)], "id string, check_fn string, satisfied boolean")
    scored = ql.text_quality(texts, "text", english=["the", "most", "about", "this", "weather"])
    metrics = scored.withColumn("G", F.when(~F.col("id").eqNullSafe("d"), F.col("G")))  # an unscored one has no notes
    found = rp.findings(metrics, results, ["id"])
    assert found.columns == ["id", "kind", "subject"]

    want = Counter({("a", "check", "c1"): 1, (None, "check", "c2"): 1})
    for r in metrics.collect():
        want.update((r["id"], "missing entity", m) for m in r["missing"] or [])
        noted = {
            "missing diacritics": r["dia_missing"] > 0, "English words": r["english_words"] > 0, "punctuation": r["total_issues"] > 0,
            "mostly English": r["is_likely_english"], "too short": r["is_too_short"],
        }
        if r["G"] is not None and r["G"] < rp.QUALITY_NOTE_BELOW:
            want.update((r["id"], "quality", name) for name, holds in noted.items() if holds)
    assert Counter(map(tuple, found.collect())) == want and {k for _, k, _ in want} == {"check", "missing entity", "quality"}
    # texts are searched as often as for the metrics alone, not again in a filter for each part of the score
    searches = [df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") for df in (found, metrics)]
    assert 0 < searches[0] <= searches[1]
