"""The table of sources keeps sources that its list doesn't name."""

from workload import record_queries as rq


def test_model_table_keeps_other_sources(spark):
    rows = [(3, "src0", 0.5), (3, "src99", 0.25), (4, None, 0.75), (5, "new.one", 1.0)]
    found = rq.wide_by_source(spark.createDataFrame(rows, "words int, source string, G double"))
    assert found.columns == ["words", *rq.SOURCES, "new.one", "null", "src99"]
    got = {r["words"]: {c: v for c, v in r.asDict().items() if c != "words" and v is not None} for r in found.collect()}
    assert got == {3: {"src0": 0.5, "src99": 0.25}, 4: {"null": 0.75}, 5: {"new.one": 1.0}}
    assert rq.wide_by_source(spark.createDataFrame(rows[:1], "words int, source string, G double")).columns == ["words", *rq.SOURCES]
