"""Findings and their texts, against a plain lookup in Python."""

import unicodedata

from sparkrubric.operators import grammar as gr

FINDINGS, TEXT = "doc_id long, rule_id string, issue_type string, offset int, length int", "doc_id long, text string"


def plain(rule, offset, length, text):
    if None in (rule, offset, length, text) or gr.SPELLING_RULE not in rule or length <= 0 or not 0 <= offset < len(text):
        return False
    return unicodedata.category(text[offset]) in ("Lu", "Lt")


def test_findings_meet_texts_in_groups(spark):
    long = "Ana are Șase mere. " * 2000
    texts = [(1, long), (2, "Țara 😀 Mare"), (2, "țara 😀 Mare"), (3, ""), (4, None), (None, "Ana"), (5, "Ana")]
    offsets = [None, 0, 5, 7, 8, 12, gr.STRETCH - 1, gr.STRETCH, gr.STRETCH + 6, 38_000, 10**6]
    findings = [
        (d, rule, "misspelling", offset, length)
        for d in (1, 2, 3, 4, 6, None)
        for rule in ("MORFOLOGIK_RULE_RO", "RO_AGREEMENT", None)
        for offset in offsets
        for length in (0, 3, None)
    ]
    findings += findings[:40]
    marked = gr.filter_findings(spark.createDataFrame(findings, FINDINGS), spark.createDataFrame(texts, TEXT), "doc_id", "text")
    assert marked.columns == ["doc_id", "rule_id", "issue_type", "offset", "length", "skipped"]
    want = [(*f, plain(f[1], f[3], f[4], text)) for f in findings for d, text in texts if f[0] == d and d is not None]
    assert sorted(map(repr, map(tuple, marked.collect()))) == sorted(map(repr, want))
    # no finding carries its text: they are in groups when they meet
    assert "collect_list" in marked._jdf.queryExecution().optimizedPlan().toString()


def test_offsets_counted_from_the_end(spark):
    found = spark.createDataFrame([(1, "MORFOLOGIK", "style", -4, 3), (1, "MORFOLOGIK", "style", -2, 3)], FINDINGS)
    marked = gr.filter_findings(found, spark.createDataFrame([(1, "ana Are")], TEXT), "doc_id", "text")
    assert {r["offset"]: r["skipped"] for r in marked.collect()} == {-4: True, -2: False}
