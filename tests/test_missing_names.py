"""The names of what documents left out, over all items that they plan."""

import __spark_entry__ as entry

DOCS = [(0, "the old mill"), (1, "a red barn and the old mill"), (4, "nothing here"), (6, None)]
ITEMS = [(0, "Old mill"), (1, "red barn"), (4, "new bridge"), (5, "the old mill"), (6, "blue door"), (6, "blue door")]


def test_documents_plan_all_items_of_their_residue(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = entry.queries()["missing_entity_names"](spark, str(tmp_path)).collect()
    got = sorted((r["doc_id"], r["item_id"], r["name"] == "(unknown entity)") for r in rows)
    want = [(d, -1, True) for d, _ in DOCS]
    want += [(d, i, False) for d, t in DOCS for i, n in ITEMS if d % 4 == i % 4 and n.lower() not in (t or "")]
    assert got == sorted(want)
    assert (4, 4, False) in got  # planned without being mentioned
