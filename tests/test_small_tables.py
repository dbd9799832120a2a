"""Queries over small files run in more than one task, and trigrams are dealt once."""

from workload import corpus_queries, record_queries


def test_search_forms_are_made_in_parallel(spark, tmp_path):
    rows = [(n, f"blue bolt{n}", "Brand#7") for n in range(40)] + [(None, None, None), (1, "blue bolt1", "Brand#7")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = corpus_queries.reg.queries["search_forms"](spark, str(tmp_path))
    assert found.count() == 42
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()


def test_trigrams_are_dealt_once(spark, tmp_path):
    texts = [(1, "a b c a b c"), (1, "A b c"), (2, "a b c"), (None, "a b c d"), (3, None), (4, "a b")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = record_queries.reg.queries["word_trigrams"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = {("a b c", 5, 2), ("b c a", 1, 1), ("c a b", 1, 1), ("b c d", 1, 0)}
    assert {tuple(r) for r in found.collect()} == want


def test_findings_work_out_the_checks_once(spark, tmp_path, monkeypatch):
    lines = [(o, 1 + (o + n) % 4, n, "A", "OF"[n % 2], 3.0 + 5 * n, 0.05 * n) for o in range(1, 9) for n in range(1, o)]
    lines.append((None, 1, 1, "A", "O", 5.0, 0.1))
    tables = {
        "orders": ([(o, "1-URGENT") for o in (*range(1, 9), None)], "o_orderkey long, o_orderpriority string"),
        "part": (
            [(p, f"blue p{p}", "Brand#1", "PROMO", 10 * p, 900.0 * p) for p in range(1, 4)],
            "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        ),
        "lineitem": (
            lines,
            "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_discount double",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    made = []
    kept = record_queries.order_check_results
    monkeypatch.setattr(record_queries, "order_check_results", lambda *a: made.append(a) or kept(*a))
    found = record_queries.reg.queries["findings"](spark, str(tmp_path))
    assert len(made) == 1
    got = {r["subject"]: r["n"] for r in found.collect()}
    monkeypatch.undo()
    failed = record_queries.order_metrics(spark, str(tmp_path)).where("NOT (U >= 0.7 AND R >= 0.7 AND F >= 0.7)")
    bad = {r["instance_id"] for r in failed.collect()}
    want: dict[str, int] = {}
    for r in kept(spark, str(tmp_path)).where("NOT satisfied").collect():
        if r["o_orderkey"] in bad:
            want[r["check_fn"]] = want.get(r["check_fn"], 0) + 1
    assert got == want and got
