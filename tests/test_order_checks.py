"""Checks of all orders: what is exchanged between tasks, and the verdicts."""

import __spark_entry__ as entry

LINES = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string"
PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_items_meet_by_order_before_they_are_paired_with_checks(spark, tmp_path):
    lines = [(1, 1, 1, "A", "O"), (1, 2, 2, "N", "F"), (1, 2, 2, "N", "F"), (2, 1, 1, "R", "O"), (None, 1, 1, "A", "O")]
    parts = [(1, "a", "Brand#1", "PROMO", 10, 4000.0), (2, "b", "Brand#2", "SMALL", 50, 900.0)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, PARTS).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    results = entry.queries()["checks_by_name"](spark, str(tmp_path))
    exchanges = [x for x in results._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert exchanges and not any("check_id" in x.split("hashpartitioning(")[1] for x in exchanges)
    got = {(r["o_orderkey"], r["check_id"]): r["satisfied"] for r in results.collect()}
    assert len(got) == 4 * 7
    assert [got[1, c] for c in ("budget", "per_day", "types", "family", "unique")] == [False, False, False, False, False]
    assert [got[2, c] for c in ("budget", "per_day", "types", "family", "unique")] == [True, True, False, True, True]
    assert got[3, "budget"] and not got[3, "unknown"]
