"""Mentions of many terms in many texts, against a plain search in every text."""

import random

from pyspark.sql import functions as F

from sparkrubric.functions import text as tx
from sparkrubric.operators import entities as en

TEXT, TERM = "doc_id long, text string", "item_id long, term string"


def normalized(spark, rows, schema):
    key, value = (part.split()[0] for part in schema.split(", "))
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(key, tx.normalize_match(value)).collect()]


def check(spark, texts, terms):
    got = en.term_mentions(spark.createDataFrame(texts, TEXT), "doc_id", "text", spark.createDataFrame(terms, TERM), "item_id", "term")
    assert got.columns == ["doc_id", "item_id"]
    bodies, wanted = normalized(spark, texts, TEXT), set(normalized(spark, terms, TERM))
    want = [(d, i) for d, body in bodies for i, term in wanted if body and term and term in body]
    rows = [tuple(r) for r in got.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    assert sorted(rows, key=order) == sorted(want, key=order)
    return rows


def test_against_plain_search(spark):
    rng = random.Random(3)
    words = ["the", "of", "Piața", "vechi", "muzeul", "a", "casă", "și", "parc", "ş", "x1"]
    texts = [(n, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for n in range(150)]
    terms = [(n, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for n in range(60)]
    terms += [(100 + n, t[rng.randint(0, 9) :][: rng.randint(1, 40)]) for n, (_, t) in enumerate(texts[:40])]
    assert len(check(spark, texts, terms)) > 500


def test_edges(spark):
    texts = [
        (1, "The other, the one."), (1, "the"), (2, None), (3, ""), (None, "a the b"), (5, "th"),
        (6, "zz" + "the old town hall of the old town " * 3000 + "end"), (7, "over the old town hall offside"), (8, "😀 the ț"),
    ]
    terms = [
        (1, "the"), (1, "The!"), (2, "the one"), (3, None), (4, ""), (5, "?!"), (None, "othe"), (7, "he old town hall off"),
        (7, "end"), (8, "e"), (9, "old town hall of the old town hall"), (10, "😀"), (11, "t"),
    ]
    check(spark, texts, terms)
    for none in ([], terms[3:6]):
        assert check(spark, texts, none) == []
    assert check(spark, [], terms) == []


def test_a_common_beginning_is_no_key(spark):
    """Every text holds "the ", which both terms begin with; only texts with the rare end reach the join."""
    texts = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 0, "see the zoo").otherwise("see the town").alias("text"))
    terms = spark.createDataFrame([(1, "the zoo"), (2, "the zebra")], TERM)
    runs = texts.select(F.explode(en.text_runs("text", [], [4])).alias("_run"))
    keyed = en.rarest_keys(terms.withColumn("_runs", en.term_runs("term")), runs)
    common = {r[0] for r in texts.where("doc_id = 1").select(F.explode(en.text_runs("text", [], [4]))).collect()}
    assert not common & {r["_key"] for r in keyed.collect()}
    assert en.term_mentions(texts, "doc_id", "text", terms, "item_id", "term").count() == 4
