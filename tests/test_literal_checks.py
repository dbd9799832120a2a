"""Side-by-side evaluation of checks against one at a time."""

import random

from pyspark.sql import functions as F

from sparkrubric.functions import outputs as op
from sparkrubric.operators import checks as ck
from sparkrubric.operators import scoring as sc

SPECS = {
    "check_budget_limit": {"max_budget": 60},
    "check_max_activities_per_day": {"max_per_day": 1},
    "check_min_activities_per_day": {"min_per_day": 1, "num_days": 2},
    "check_type_diversity": {"min_types": 2},
    "check_must_include_type": {"type_required": "a"},
    "check_max_outdoor_per_day": {"max_outdoor": 1},
    "check_budget_per_day": {"max_budget_per_day": 40},
    "check_no_duplicates": {},
    "check_days_non_empty": {"num_days": 2},
    "check_all_family_friendly": {},
    "check_first_day_constraint": {"indoor_only": True},
}


def test_side_by_side_equals_one_at_a_time(spark):
    rng = random.Random(3)
    plans = []
    for n in range(40):
        days = [[f"p{rng.randrange(6)}" for _ in range(rng.randrange(4))] for _ in range(rng.randrange(4))]
        cells = ", ".join(f'"day{d + 1}": [{", ".join(chr(34) + x + chr(34) for x in items)}]' for d, items in enumerate(days))
        plans.append((n, "text {" + cells + "}" if n % 9 else "no plan"))
    parsed = sc.parse_run(spark.createDataFrame(plans, "id int, output string"))
    parts = spark.createDataFrame(
        [(f"p{i}", "abc"[i % 3], i % 2 == 0, i % 4 != 1, 10.0 * i) for i in range(5)],
        "ref string, type string, indoor boolean, family_friendly boolean, cost_lei double",
    )
    items = op.plan_items(parsed, ["id"]).join(parts.withColumn("entity_id", F.col("ref")), "ref", "left")
    items = items.cache()
    wide = {r["id"]: r for r in ck.run_literal_checks(items, ["id"], SPECS).collect()}
    assert len(wide) == 40
    for name, params in SPECS.items():
        one = {r["id"]: r["satisfied"] for r in ck.run_check(items, ["id"], name, **params).collect()}
        assert one == {i: r[name] for i, r in wide.items()}, name
        assert len(set(one.values())) == 2, name
