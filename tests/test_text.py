import math

import pytest
from pyspark.sql import functions as F

from sparkrubric.functions import morphology as mo
from sparkrubric.functions import text as tx
from sparkrubric.operators import quality as ql


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def one(spark, text, expression):
    return frame(spark, text).select(expression.alias("x")).first().x


def test_tokens_and_offsets(spark):
    rows = tx.tokens(frame(spark, "Aceasta este o propoziție."), ["id"], "t").orderBy("pos").collect()
    assert len(rows) == 5 and not rows[-1].is_word
    assert [(r.start, r.end) for r in rows] == [(0, 7), (8, 12), (13, 14), (15, 25), (25, 26)]
    mixed = tx.tokens(frame(spark, " într-o  zi 3.14 lei! "), ["id"], "t").orderBy("pos").collect()
    assert [r.token for r in mixed] == ["într-o", "zi", "3.14", "lei", "!"]


def test_diacritic_functions(spark):
    assert one(spark, "ăâîșț", tx.strip_diacritics("t")) == "aaist"
    assert one(spark, "şţ", tx.normalize_diacritics("t")) == "șț"
    assert one(spark, "Piața Mare, (Sibiu)!", tx.normalize_match("t")) == "piata mare sibiu"


def test_diacritic_scores(spark):
    texts = [
        "Aceasta este o propoziție în limba română și este corectă.",
        "Aceasta este o propozitie in limba romana si este corecta.",
        "Eu merg in oras si cumpar paine.",
        "",
    ]
    rows = ql.diacritics(frame(spark, *texts), "t").orderBy("id").collect()
    assert rows[0].diacritic_score > 0.8
    assert rows[1].diacritic_score < 0.5 and rows[1].missing_diacritics > 0
    assert rows[2].missing_diacritics >= 2 and "in → în" in rows[2].missing_examples
    assert rows[3].diacritic_score == 1.0 and rows[3].total_checkable == 0


def test_code_switching(spark):
    ten = "the unu doi trei patru cinci noua zece casa lup"
    texts = ["This is a sentence in the English language.", "Nu voi merge pe stradă de dimineață.", ten]
    rows = ql.code_switching(frame(spark, *texts), "t").orderBy("id").collect()
    assert rows[0].english_rate > 0.3 and rows[0].codeswitch_score < 0.5
    assert rows[1].english_words == 0
    assert rows[2].codeswitch_score == pytest.approx(math.exp(-2))
    own = ql.code_switching(frame(spark, "un flurb bun"), "t", english=["flurb"]).first()
    assert own.english_words == 1


def test_report_values(spark):
    words = " ".join(["casă"] * 27)
    row = ql.text_quality(frame(spark, words), "t").first()
    assert row.G_len == pytest.approx(0.485) and row.G == pytest.approx(0.92275)
    english = ql.text_quality(frame(spark, "I suggest the following itinerary for the trip to Cluj."), "t").first()
    assert english.is_likely_english and english.G < 0.5 and english.G_cs == 0.1


def test_punctuation_and_repetition(spark):
    row = ql.punctuation(frame(spark, "unu doi , trei patru cinci sase sapte opt noua"), "t").first()
    assert row.space_before_punct == 1 and row.punctuation_score == pytest.approx(0.5)
    assert ql.punctuation(frame(spark, "  "), "t").first().punctuation_score == 1.0
    text = "a b c " * 4
    row = ql.repetition(frame(spark, text), "t").first()
    assert row.repeated_phrases == 3 and row.repetition_score == pytest.approx(0.35)


def test_forms(spark):
    forms = one(spark, "Grădina Botanică", mo.search_forms(F.array("t")))
    assert {"gradina botanica", "gradinii botanice", "gradina botanicii", "gradina botanicei"} <= set(forms)
    forms = one(spark, "Biserica Neagră", mo.search_forms(F.array("t")))
    assert "bisericii negre" in forms and "bisericii neagra" in forms
    assert "parcului central" in one(spark, "Parcul Central", mo.search_forms(F.array("t")))
