"""Short terms in texts: the scan of windows against a plain search."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx
from sparkrubric.operators import entities as en
from sparkrubric.operators import windows as wn
from tests.test_mentions import TERM, TEXT, check


def marks_in_driver(strings):
    lengths, bits = np.zeros(1 << wn.HEAD_BITS, np.uint64), np.zeros(1 << wn.KEY_BITS - 6, np.uint64)
    for batch in wn._marks_of([pa.RecordBatch.from_arrays([pa.array(strings, pa.binary())], ["_window"])]):
        for row in batch.to_pylist():
            key = row["key"] % (1 << wn.KEY_BITS)
            lengths[row["slot"]] |= np.uint64(1 << row["size"] - 1)
            bits[key >> 6] |= np.uint64(1 << key % 64)
    return wn.Marks(lengths, bits)


def test_all_held_windows_are_found(monkeypatch):
    rng = random.Random(5)
    letters = ["a", "b", " ", "ș", "é", "😀", "\0"]
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 3, 50, 900]))) for _ in range(120)]
    strings = {t.encode()[at : at + rng.randint(1, wn.LONGEST)] for t in texts for at in [rng.randint(0, 40)]} - {b""}
    want = {(row, s) for row, text in enumerate(texts) for s in strings if s in text.encode()}
    # stretches shorter than texts and than windows, parts made distinct early, an array that is a slice of another
    for stretch, at_once in ((wn.STRETCH, wn.AT_ONCE), (50, 10), (257, 1)):
        monkeypatch.setattr(wn, "STRETCH", stretch)
        monkeypatch.setattr(wn, "AT_ONCE", at_once)
        found = wn.held_windows(pa.array(["ab a", *texts, "b b"])[1:-1], marks_in_driver(sorted(strings))).to_pylist()
        got = [(r["row"], r["window"]) for r in found if r["window"] in strings]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
        assert len(found) <= 1.05 * len(want)  # few by chance
    none = wn.held_windows(pa.array([], pa.string()), marks_in_driver([b"a"]))
    assert none.num_rows == 0


def test_terms_above_the_longest_window(spark):
    a, b, c = "x" * 70, "y" * 64 + "z", "căsuța" * 12
    texts = [(1, f"an {a} {b} end"), (1, f"{a}{b}"), (2, f"{a[1:]} {b}"), (3, b[1:]), (4, "q" + c), (5, c[1:]), (None, f"{b} {a}"), (6, None), (7, "")]
    terms = [(1, a), (2, b), (3, f"{a} {b}"), (4, c), (4, c), (5, b[1:]), (None, "an " + a), (6, "q" + b), (7, "x"), (8, f"an {a} {b}")]
    assert len(check(spark, texts, terms)) == 20


def test_short_terms_send_no_text_and_hash_no_characters(spark):
    texts = spark.createDataFrame([(n, f"see the zoo {n}") for n in range(50)], TEXT)
    terms = spark.createDataFrame([(1, "the zoo"), (2, "the"), (3, "zebra")], TERM)
    found = en.term_mentions(texts, "doc_id", "text", terms, "item_id", "term")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "xxhash64" not in plan and "split(" not in plan
    assert found.count() == 100
    held = texts.select(F.col("doc_id").alias("_text_id"), F.col("text").alias("_text"))
    windows = wn.scan_windows(held, wn.marks_of(terms.select(F.col("term").cast("binary").alias("_window"))))
    assert windows.where("_text IS NOT NULL").count() == 0 and windows.count() >= 100


def test_match_key_is_a_fold_of_all_white_space(spark):
    """As lower case, plain letters, blanks for punctuation and one blank for a run of white space, step by step."""
    rng = random.Random(2)
    parts = [*tx.SPACES, *tx.MATCH_PUNCTUATION, *" .,", *"aĂâÎșȚţéΣİ😀", "\u200b", "-"]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 30))),) for _ in range(500)] + [(None,), ("",), (tx.SPACES,)]
    spaced = F.translate(F.translate(F.lower("t"), "ăâîșț", "aaist"), tx.MATCH_PUNCTUATION, " " * len(tx.MATCH_PUNCTUATION))
    steps = F.trim(F.regexp_replace(spaced, tx.SPACE + "+", " "))
    got = spark.createDataFrame(rows, "t string").select(tx.normalize_match("t").alias("got"), steps.alias("want"))
    assert got.where("NOT (got <=> want)").count() == 0
    assert got.where("contains(want, ' ')").count() > 300
