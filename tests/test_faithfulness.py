"""The text of an output is normalized once, however many forms are sought in it."""

from pyspark.sql import functions as F

from sparkrubric.operators import entities as en

SCHEMA = "explanation string, refs array<string>, entities array<struct<id:string,match_keys:array<string>,forms:array<string>>>, lemmas array<string>"
ENTITIES = [("A1", ["parc"], ["parc", "parcul"]), ("A2", ["muzeul vechi"], ["muzeului vechi", "muzeul vechi"]), ("A3", ["far"], ["far"])]
ROWS = [
    ("Mergem la  PARCUL, apoi la far", ["A1", "Muzeul Vechi!", "x"], ENTITIES, ["merge"]),
    (None, ["A1"], ENTITIES, ["parc"]),
    ("", [], ENTITIES, []),
]


def test_text_is_bound_once(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for lemmas in (None, "lemmas"):
        found = en.faithfulness(rows, lemmas=lemmas)
        plan = found.select("missing")._jdf.queryExecution().optimizedPlan().toString()
        assert "contains(trim(" not in plan.lower() and "contains(lambda" in plan.lower()
        first = found.where(F.col("explanation").startswith("Mergem")).first()
        assert (first["planned_ids"], first["missing"]) == (["A1", "A2"], ["A2"])
        assert first["hallucinated"] == (None if lemmas else ["A3"])
