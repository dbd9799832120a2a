"""Plan checks over orders as plans: lines are plan items, parts are entities, line numbers are days."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrubric.operators import checks as ck
from workload.base import Registry, quote, table

reg = Registry()

# style of plan key: travel day lists, schedule day_slot cells, recipe day_meal cells
def _slot():
    return F.when(F.col("l_linestatus") == "O", "dimineață").otherwise("după-amiază")


def _meal():
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "mic_dejun").when(flag == "N", "pranz").otherwise("cina")


def _level():
    rest = F.col("p_size") % 3
    return F.when(rest == 0, "high").when(rest == 1, "medium").otherwise("low")


def order_items(spark, sf, style: str = "travel"):
    """Item rows of every order, plus one empty row per order, so an order without lines is an empty plan.

    The empty rows come by union, not by an outer join: nothing has to meet on the order key but partial sums.
    """
    day = F.concat(F.lit("day"), F.col("l_linenumber").cast("string"))
    tail = {"travel": None, "schedule": _slot(), "recipe": _meal()}[style]
    key = day if tail is None else F.concat(day, F.lit("_"), tail)
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    parts = table(spark, sf, "part")
    size = F.col("p_size")
    items = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_orderkey").alias("o_orderkey"),
        key.alias("key"),
        day.alias("day"),
        (F.lit(None).cast("string") if tail is None else tail).alias("slot"),
        F.lit("list" if tail is None else "string").alias("kind"),
        F.lit(1).alias("n_values"),
        F.lit(True).alias("truthy"),
        F.lit(False).alias("is_null_word"),
        F.lit(0).alias("item_pos"),
        F.col("l_partkey").cast("string").alias("ref"),
        F.col("p_partkey").cast("string").alias("entity_id"),
        F.col("p_name").alias("name"),
        F.array(F.concat("p_brand", F.lit(" "), "p_name")).alias("aliases"),
        F.col("p_type").alias("type"),
        (size % 2 == 0).alias("indoor"),
        (size <= 40).alias("family_friendly"),
        (size.cast("decimal(9,1)") / 10).cast("decimal(9,1)").alias("duration_hours"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("cost_lei"),
        _level().alias("priority"),
        F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6", "Brand#7").alias("vegan"),
        (~F.col("p_brand").isin("Brand#8", "Brand#9")).alias("vegetarian"),
        F.col("p_brand").isin("Brand#10", "Brand#11").alias("contains_gluten"),
        F.col("p_brand").isin("Brand#12").alias("contains_lactose"),
        size.cast("double").alias("prep_time_min"),
        (size * 20).cast("double").alias("calories"),
    )
    empty = table(spark, sf, "orders").select("o_orderkey")
    return items.unionByName(empty, allowMissingColumns=True)


_IT = """
    it AS (SELECT l_orderkey AS o, l_linenumber AS day, l_linestatus AS slot, l_returnflag AS meal, l_partkey AS part,
                  p_partkey IS NOT NULL AS res, p_name, p_brand, p_type, p_size, p_size % 2 = 0 AS indoor,
                  (p_retailprice)::DECIMAL(18,2) AS cost, (p_size / 10.0)::DECIMAL(9,1) AS hours, p_size * 20 AS kcal,
                  CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level
           FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
"""


def whole(expr: str) -> str:
    """Verdict from one aggregate over all items of an order."""
    return f"""WITH {_IT} SELECT o_orderkey, {expr} AS satisfied FROM orders LEFT JOIN it ON o = o_orderkey
               GROUP BY o_orderkey"""


def per_day(value: str, bad: str, where: str = "true", extra: str = "") -> str:
    """Verdict from day totals ``x``: satisfied when no day is bad."""
    return f"""WITH {_IT}, d AS (SELECT o, day, {value} AS x{extra} FROM it WHERE {where} GROUP BY o, day)
               SELECT o_orderkey, count(*) FILTER (WHERE o IS NOT NULL AND {bad}) = 0 AS satisfied
               FROM orders LEFT JOIN d ON o = o_orderkey GROUP BY o_orderkey"""


def days_met(good: str, days: int, values: str) -> str:
    """Verdict from the number of days 1..n that meet a condition."""
    return f"""WITH {_IT}, d AS (SELECT o, day, {values} FROM it WHERE day <= {days} GROUP BY o, day)
               SELECT o_orderkey, count(*) FILTER (WHERE o IS NOT NULL AND {good}) = {days} AS satisfied
               FROM orders LEFT JOIN d ON o = o_orderkey GROUP BY o_orderkey"""


_MEALS = ", ".join(
    f"coalesce(sum(kcal) FILTER (WHERE meal = '{flag}'), 0) AS {name}"
    for flag, name in (("A", "b"), ("N", "l"), ("R", "d"))
)
_BREAKFAST = "FILTER (WHERE meal = 'A')"
_VALID = [str(n) for n in range(0, 150)]
_VEGAN = "p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6','Brand#7')"

# check name, plan style, parameters, SQL
CHECKS: list[tuple[str, str, dict, str]] = [
    ("must_include_type", "travel", {"type_required": "PROMO"},
     whole("count(*) FILTER (WHERE p_type = 'PROMO') > 0")),
    ("must_exclude_type", "travel", {"type_forbidden": "PROMO"},
     whole("count(*) FILTER (WHERE p_type = 'PROMO') = 0")),
    ("exact_type_count", "travel", {"type_required": "SMALL", "exact_count": 1},
     whole("count(*) FILTER (WHERE p_type = 'SMALL') = 1")),
    ("all_family_friendly", "travel", {}, whole("count(*) FILTER (WHERE p_size > 40) = 0")),
    ("type_diversity", "travel", {"min_types": 3}, whole("count(DISTINCT p_type) >= 3")),
    ("must_include_specific", "travel", {"entity_name": "Red Widget"},
     whole("count(*) FILTER (WHERE lower(p_name) = 'red widget' OR lower(p_brand || ' ' || p_name) = 'red widget') > 0")),
    ("budget_limit", "travel", {"max_budget": 5000}, whole("coalesce(sum(cost), 0) <= 5000")),
    ("max_total_cost", "travel", {"max_cost": 4000}, whole("coalesce(sum(cost), 0) <= 4000")),
    ("max_outdoor_per_day", "travel", {"max_outdoor": 1},
     per_day("count(*) FILTER (WHERE NOT indoor)", "x > 1")),
    ("min_activities_per_day", "travel", {"min_per_day": 2}, per_day("count(*)", "x < 2")),
    ("max_activities_per_day", "travel", {"max_per_day": 1}, per_day("count(*)", "x > 1")),
    ("max_duration_per_day", "travel", {"max_hours": 5.0}, per_day("sum(hours)", "x > 5.0")),
    ("budget_per_day", "travel", {"max_budget_per_day": 2000}, per_day("sum(cost)", "x > 2000")),
    ("min_total_activities", "travel", {"min_total": 4}, whole("count(o) >= 4")),
    ("first_day_constraint", "travel", {"indoor_only": True, "max_activities": 1},
     whole("count(*) FILTER (WHERE day = 1) <= 1 AND count(*) FILTER (WHERE day = 1 AND NOT indoor) = 0")),
    ("last_day_constraint", "travel", {"num_days": 3, "must_have_outdoor": True, "max_cost": 2500},
     whole("count(*) FILTER (WHERE day = 3 AND NOT indoor) > 0 "
           "AND coalesce(sum(cost) FILTER (WHERE day = 3), 0) <= 2500")),
    ("no_consecutive_same_type", "travel", {},
     f"""WITH {_IT}, d AS (SELECT o, day, list_sort(list_distinct(list(p_type) FILTER (WHERE res))) AS types
                           FROM it GROUP BY o, day),
         r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY day) = day AS run,
                      lag(types) OVER (PARTITION BY o ORDER BY day) = types AND len(types) > 0 AS same FROM d)
         SELECT o_orderkey, count(*) FILTER (WHERE run AND same) = 0 AS satisfied
         FROM orders LEFT JOIN r ON o = o_orderkey GROUP BY o_orderkey"""),
    ("days_non_empty", "travel", {"num_days": 2},
     whole("count(DISTINCT day) FILTER (WHERE day <= 2) = 2")),
    ("no_duplicates", "travel", {}, whole("count(part) = count(DISTINCT part)")),
    ("valid_entity_ids", "travel", {"valid_ids": _VALID}, whole("count(*) FILTER (WHERE part >= 150) = 0")),
    ("max_appointments_per_day", "schedule", {"max_per_day": 1}, per_day("count(*)", "x > 1")),
    ("no_back_to_back", "schedule", {}, per_day("count(DISTINCT slot)", "x >= 2")),
    ("max_total_appointments", "schedule", {"max_total": 4}, whole("count(o) <= 4")),
    ("min_total_appointments", "schedule", {"min_total": 3}, whole("count(o) >= 3")),
    ("spread_across_days", "schedule", {"min_days_with_appointments": 3}, whole("count(DISTINCT day) >= 3")),
    ("priority_day_restriction", "schedule", {"priority": "medium", "forbidden_days": ["Day1", "day2"]},
     whole("count(*) FILTER (WHERE level = 'medium' AND day IN (1, 2)) = 0")),
    ("slot_type_restriction", "schedule", {"type_keyword": "Widget", "allowed_slots": ["dimineață", "morning"]},
     whole("count(*) FILTER (WHERE contains(lower(p_name), 'widget') AND slot <> 'O') = 0")),
    ("no_slot_overlaps", "schedule", {}, whole("count(*) >= 0")),
    ("all_vegetarian", "recipe", {}, whole("count(*) FILTER (WHERE p_brand IN ('Brand#8', 'Brand#9')) = 0")),
    ("all_vegan", "recipe", {}, whole(f"count(*) FILTER (WHERE res AND NOT ({_VEGAN})) = 0")),
    ("no_gluten", "recipe", {}, whole("count(*) FILTER (WHERE p_brand IN ('Brand#10', 'Brand#11')) = 0")),
    ("no_lactose", "recipe", {}, whole("count(*) FILTER (WHERE p_brand = 'Brand#12') = 0")),
    ("max_daily_calories", "recipe", {"max_calories": 1200}, per_day("sum(kcal)", "x > 1200", "res")),
    ("min_daily_calories", "recipe", {"min_calories": 300}, per_day("sum(kcal)", "x < 300", "res")),
    ("calorie_range", "recipe", {"min_calories": 200, "max_calories": 1500},
     per_day("sum(kcal)", "(x < 200 OR x > 1500)", "res")),
    ("max_prep_time_per_day", "recipe", {"max_prep_time": 60}, per_day("sum(p_size)", "x > 60", "res")),
    ("all_meals_filled", "recipe", {"num_days": 2, "meals": ["mic_dejun", "pranz"]},
     whole("count(DISTINCT day || meal) FILTER (WHERE day <= 2 AND meal IN ('A', 'N')) = 4")),
    ("lunch_heaviest_meal", "recipe", {"num_days": 1}, days_met("l > b AND l > d", 1, _MEALS)),
    ("dinner_lightest", "recipe", {"num_days": 1}, days_met("d < b AND d < l", 1, _MEALS)),
    ("breakfast_variety", "recipe", {}, whole(f"count(part) {_BREAKFAST} = count(DISTINCT part) {_BREAKFAST}")),
    ("max_high_calorie_meals", "recipe", {"calorie_threshold": 400, "max_high_calorie": 2},
     whole("count(*) FILTER (WHERE kcal > 400) <= 2")),
    ("quick_breakfast", "recipe", {"max_prep_time": 20},
     whole("count(*) FILTER (WHERE meal = 'A' AND p_size > 20) = 0")),
]


def _register(check: str, style: str, params: dict, sql: str) -> None:
    @reg.add(f"check_{check}", sql)
    def _(spark, sf):
        rows = order_items(spark, sf, style)
        return ck.run_check(rows, ["o_orderkey"], f"check_{check}", **params)


for _entry in CHECKS:
    _register(*_entry)


# --- checks that start from the entities: every part of the order is an entity, kept when its line is open ------
def order_entities(spark, sf):
    items = order_items(spark, sf, "schedule")
    kept = F.col("slot") == "dimineață"
    return items.select(
        "o_orderkey",
        "priority",
        F.col("entity_id").isNotNull().alias("is_entity"),
        kept.alias("kept"),
    )


@reg.add("check_keep_high_priority", whole("count(*) FILTER (WHERE level = 'high' AND res AND slot <> 'O') = 0"))
def _(spark, sf):
    return ck.run_check(order_entities(spark, sf), ["o_orderkey"], "check_keep_high_priority")


_KEPT = {lv: f"count(*) FILTER (WHERE res AND level = '{lv}' AND slot = 'O')" for lv in ("low", "medium")}
_LOST = {lv: f"count(*) FILTER (WHERE res AND level = '{lv}' AND slot <> 'O')" for lv in ("medium", "high")}


@reg.add(
    "check_must_drop_lowest_priority",
    whole(
        f"({_KEPT['low']} = 0 OR ({_LOST['high']} = 0 AND {_LOST['medium']} = 0)) "
        f"AND ({_KEPT['medium']} = 0 OR {_LOST['high']} = 0)"
    ),
)
def _(spark, sf):
    return ck.run_check(order_entities(spark, sf), ["o_orderkey"], "check_must_drop_lowest_priority")


# --- fact checks: a customer answers with a nation name, the facts are the names of its region's nations --------
_FACTS = """
    facts AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1),
    ans AS (SELECT c_custkey, 'In ' || replace(n_name, '_', '_' || (c_custkey % 2)) AS answer, n_name,
                   (n_regionkey + c_custkey % 3) % 5 AS region
            FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def answers(spark, sf):
    """One fact-world item per customer: a fixed number of nations makes the facts of a region."""
    nation = table(spark, sf, "nation")
    facts = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("facts"))
    spelled = F.concat(
        F.lit("In "),
        F.replace("n_name", F.lit("_"), F.concat(F.lit("_"), (F.col("c_custkey") % 2).cast("string"))),
    )
    asked = (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey", "n_name", spelled.alias("ref"), ((F.col("n_regionkey") + F.col("c_custkey") % 3) % 5).alias("r")
        )
    )
    return asked.join(facts, F.col("r") == F.col("n_regionkey")).select(
        "c_custkey", "n_name", "facts", "ref", F.lit("answer").alias("key"), F.lit("string").alias("kind"),
        F.lit(True).alias("truthy"),
    )


_FACT_MATCH = "contains(lower(answer), lower(f)) OR contains(lower(f), lower(answer))"


@reg.add(
    "check_answer_matches_context",
    f"""WITH {_FACTS} SELECT c_custkey, len(list_filter(names, lambda f: {_FACT_MATCH})) > 0 AS satisfied
        FROM ans JOIN facts ON region = n_regionkey""",
)
def _(spark, sf):
    return ck.run_check(answers(spark, sf), ["c_custkey"], "check_answer_matches_context")


@reg.add(
    "check_exact_answer_value",
    f"WITH {_FACTS} SELECT c_custkey, contains(lower(answer), 'nation_11') OR contains('nation_11', lower(answer)) "
    "AS satisfied FROM ans",
)
def _(spark, sf):
    return ck.run_check(answers(spark, sf), ["c_custkey"], "check_exact_answer_value", expected=" NATION_11 ")


@reg.add(
    "check_no_hallucinated_facts",
    f"""WITH {_FACTS} SELECT c_custkey, n_name IN ('NATION_1', 'NATION_2') OR contains('nation_20', lower(n_name))
        OR contains('nation_17', lower(n_name)) AS satisfied FROM ans""",
)
def _(spark, sf):
    rows = answers(spark, sf).withColumn("ref", F.concat(F.lit(" "), "n_name"))
    facts = {"a": "NATION_1", "b": "NATION_2", "c": "Nation_20 ", "d": "nation_17"}
    return ck.run_check(rows, ["c_custkey"], "check_no_hallucinated_facts", fact_db=facts)


# --- all checks of a plan at once, parameters read from a specification table ------------------------------------
_SPEC = [
    ("budget", "check_budget_limit", {"max_budget": 5000}),
    ("per_day", "check_max_activities_per_day", {"max_per_day": 1}),
    ("types", "check_type_diversity", {"min_types": 3}),
    ("family", "check_all_family_friendly", {}),
    ("unique", "check_no_duplicates", {}),
    ("same_type", "check_no_consecutive_same_type", {}),
    ("unknown", "check_priority_slot_restriction", {"priority": "high"}),
]


def order_check_results(spark, sf):
    """Every order against the specification, paired row by row."""
    specs = F.array(
        *[
            F.struct(F.lit(n).alias("check_id"), F.lit(fn).alias("check_fn"), *ck.unpacked(ck.describe_params(p)))
            for n, fn, p in _SPEC
        ]
    )
    # items meet by order before they are paired, so no pair is exchanged by any of the steps that follow
    items = order_items(spark, sf, "travel").repartition("o_orderkey")
    rows = items.withColumn("spec", F.explode(specs)).select("*", "spec.*").drop("spec")
    return ck.run_checks(rows, ["o_orderkey"], [fn for _, fn, _ in _SPEC])


_ALL = {n: sql for c, _, _, sql in CHECKS for n, fn, _ in _SPEC if fn == f"check_{c}"}
_ALL_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, {quote(n)} AS check_id, {quote(fn)} AS check_fn, "
    + (f"satisfied, NULL::VARCHAR AS error FROM ({_ALL[n]})" if n in _ALL else
       f"false AS satisfied, 'Unknown constraint function: {fn}' AS error FROM orders")
    for n, fn, _ in _SPEC
)


@reg.add("checks_by_name", _ALL_SQL)
def _(spark, sf):
    return order_check_results(spark, sf)
