"""Generated instances scored end to end, and feasibility against brute force."""

import itertools
import random
import time

from pyspark.sql import functions as F

from sparkrubric.operators import scoring as sc
from sparkrubric.plans import corpus as co
from sparkrubric.plans import feasibility as fe
from sparkrubric.sources import tables as tb


def test_corpus_end_to_end(spark, tmp_path):
    corpus = co.build_corpus(spark, {"travel": 3, "schedule": 3, "fact": 2, "recipe": 2}, seed_start=5)
    tb.write_json(co.as_instances(corpus), str(tmp_path / "instances"))
    instances = tb.read_instances(spark, str(tmp_path / "instances"))
    assert instances.count() == 10
    outputs = co.baseline_outputs(instances).where("instance_id <> 'fact_000011'")
    tb.write_json(outputs.coalesce(1), str(tmp_path / "outputs"))
    raw = tb.read_outputs(spark, str(tmp_path / "outputs")).withColumn("run_id", F.lit("base"))
    metrics = sc.evaluate_run(raw, instances, runs=["base"])
    rows = {r.instance_id: r for r in metrics.collect()}
    assert len(rows) == 10 and rows["fact_000011"].missing and rows["fact_000011"].U == 0
    assert all(r.F == 1.0 for r in rows.values() if not r.missing)
    assert all(r.format_satisfied == 5 for r in rows.values() if not r.missing)
    assert rows["fact_000012"].U == 1.0


def brute_travel(pool, days, budget, kinds):
    for pick in itertools.permutations(pool, days):
        if sum(p[3] for p in pick) <= budget and pick[0][2] and not pick[-1][2] and len({p[1] for p in pick}) >= kinds:
            return True
    return False


def test_travel_feasibility_matches_brute_force(spark):
    rng = random.Random(7)
    cases = []
    for n in range(60):
        pool = [
            (f"n{k}", rng.choice("abc"), rng.random() < 0.5, float(rng.randint(0, 30))) for k in range(rng.randint(2, 6))
        ]
        cases.append((n, pool, rng.choice([2, 3]), rng.randint(10, 60), rng.randint(1, 3)))
    rows = [
        (n, [(a, b, c, True, 1.0, d) for a, b, c, d in pool], days, f'{{"max_budget": {budget}}}', f'{{"min_types": {kinds}}}')
        for n, pool, days, budget, kinds in cases
    ]
    df = spark.createDataFrame(
        rows,
        "id int, pool array<struct<name:string,type:string,indoor:boolean,family_friendly:boolean,"
        "duration_hours:double,cost_lei:double>>, days int, budget string, kinds string",
    )
    def rule(check, params):
        return F.struct(F.lit(check).alias("check_fn"), params.alias("params"))

    rules = F.array(
        rule("check_budget_limit", F.col("budget")),
        rule("check_type_diversity", F.col("kinds")),
        rule("check_first_day_constraint", F.lit('{"indoor_only": true}')),
        rule("check_last_day_constraint", F.lit('{"must_have_outdoor": true}')),
    )
    got = {r.id: r.ok for r in df.select("id", fe.travel_feasible(F.col("pool"), F.col("days"), rules).alias("ok")).collect()}
    assert got == {n: brute_travel(pool, days, budget, kinds) for n, pool, days, budget, kinds in cases}


def _constraints(**checks):
    return F.array(*[F.struct(F.lit(f"check_{n}").alias("check_fn"), F.lit(p).alias("params")) for n, p in checks.items()])


def test_wide_schedules(spark):
    meeting = F.array(F.struct(F.lit("a").alias("name"), F.lit("high").alias("priority")))
    for n in (2, 12, 13, 30):
        days = [f"d{i}" for i in range(n)]
        banned = ", ".join(f'"{d}"' for d in days[:-1])
        for forbidden, want in ((banned, True), (f'{banned}, "{days[-1]}"', False)):
            rules = _constraints(
                keep_high_priority="{}", priority_day_restriction=f'{{"priority": "high", "forbidden_days": [{forbidden}]}}'
            )
            ok = fe.schedule_feasible(meeting, F.array(*[F.lit(d) for d in days]), F.array(F.lit("m"), F.lit("e")), rules)
            assert spark.range(1).select(ok.alias("ok")).first().ok is want


def brute_schedule(meetings, days, slots, rules):
    cells = list(itertools.product(days, slots))

    def accepted(kept):
        n = {p: meetings.count(p) for p in ("high", "medium", "low")}
        k = {p: sum(meetings[i] == p for i, _ in kept) for p in n}
        if rules.get("keep") and k["high"] < n["high"] or len(kept) > rules.get("max", 99):
            return False
        if rules.get("drop") and (k["high"] < n["high"] or (k["low"] and k["medium"] < n["medium"])):
            return False
        return bool(rules.get("drop")) if not kept else len({cells[c][0] for _, c in kept}) >= rules.get("spread", 1)

    def search(i, kept):
        if i == len(meetings):
            return accepted(kept)
        if search(i + 1, kept):
            return True
        for c, (day, slot) in enumerate(cells):
            taken = [cells[x] for _, x in kept]
            if (day, slot) in taken or sum(d == day for d, _ in taken) >= rules.get("cap", 2):
                continue
            if meetings[i] == "medium" and day in rules.get("ban", ()):
                continue
            if meetings[i] == "high" and "slots" in rules and slot not in rules["slots"]:
                continue
            if search(i + 1, [*kept, (i, c)]):
                return True
        return False

    return search(0, [])


def test_schedule_feasibility_matches_brute_force(spark):
    rng = random.Random(1)
    options = {
        "keep": ("check_keep_high_priority", lambda: (1, "{}")),
        "drop": ("check_must_drop_lowest_priority", lambda: (1, "{}")),
        "max": ("check_max_total_appointments", lambda: (n := rng.randrange(1, 4), f'{{"max_total": {n}}}')),
        "spread": ("check_spread_across_days", lambda: (n := rng.randrange(1, 4), f'{{"min_days_with_appointments": {n}}}')),
        "ban": ("check_priority_day_restriction", lambda: (["d0"], '{"priority": "medium", "forbidden_days": ["D0"]}')),
        "slots": ("check_priority_slot_restriction", lambda: (["m"], '{"required_slots": ["m"]}')),
        "cap": ("check_max_appointments_per_day", lambda: (1, '{"max_per_day": 1}')),
    }
    rows, want = [], {}
    for n in range(80):
        meetings = [rng.choice(("high", "medium", "low")) for _ in range(rng.randrange(1, 5))]
        days, slots = [f"d{i}" for i in range(rng.randrange(1, 4))], ["m", "e"][: rng.randrange(1, 3)]
        chosen = {k: (check, *make()) for k, (check, make) in options.items() if rng.random() < 0.5}
        want[n] = brute_schedule(meetings, days, slots, {k: v for k, (_, v, _) in chosen.items()})
        rows.append((n, [("x", m) for m in meetings], days, slots, [(check, text) for check, _, text in chosen.values()]))
    df = spark.createDataFrame(
        rows,
        "id int, m array<struct<name:string,priority:string>>, days array<string>, slots array<string>, "
        "rules array<struct<check_fn:string,params:string>>",
    )
    ok = fe.schedule_feasible(F.col("m"), F.col("days"), F.col("slots"), F.col("rules"))
    assert {r.id: r.ok for r in df.select("id", ok.alias("ok")).collect()} == want
    assert 0 < sum(want.values()) < len(want)


def test_recipes_without_repeats(spark):
    fields = "meal vegetarian vegan contains_gluten contains_lactose prep_time_min calories".split()

    def dishes(sizes):
        return F.array(
            *[
                F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, (m, True, True, False, False, 10, c), strict=True)])
                for m, cs in zip(("mic_dejun", "pranz", "cina"), sizes, strict=True)
                for c in cs
            ]
        )

    def feasible(sizes, days, **rules):
        rules = _constraints(no_duplicates="{}", **rules)
        return fe.recipe_feasible(spark.range(1), dishes(sizes), F.lit(days), rules, "ok").first().ok

    for n in (18, 22, 25):  # 54, 66 and 75 dishes
        assert feasible([range(300, 300 + n)] * 3, 2)
    assert not feasible([[1], [1, 2], [1, 2]], 2)
    # the lightest menus collide: only the crossed pairs stay within the limit
    limit = '{"max_calories": 13}'
    assert feasible([[1, 9], [1, 2], [2, 10]], 2, max_daily_calories=limit)
    assert not feasible([[1, 9], [1, 3], [2, 10]], 2, max_daily_calories='{"max_calories": 11}')


def brute_menus(meals, days, low, high, prep, heavy):
    """Some order of lunches and dinners beside some breakfasts meets every day's limits."""

    def day(b, n, d):
        return low <= b[0] + n[0] + d[0] <= high and b[1] + n[1] + d[1] <= prep

    for first in itertools.combinations(meals[0], days):
        for second in itertools.permutations(meals[1], days):
            for third in itertools.permutations(meals[2], days):
                menus = list(zip(first, second, third, strict=True))
                if all(day(*m) for m in menus) and sum(x[0] > 400 for m in menus for x in m) <= heavy:
                    return True
    return False


def test_menu_search_against_brute_force(spark):
    rng = random.Random(11)
    fields = "meal string, vegetarian boolean, vegan boolean, contains_gluten boolean, contains_lactose boolean, prep_time_min int, calories int"
    cases = []
    for n in range(250):
        # few different values, so that interchangeable dishes occur
        meals = [[(rng.choice([250, 350, 390, 410, 450, 600]), rng.choice([10, 20, 40])) for _ in range(rng.randint(2, 4))] for _ in range(3)]
        cases.append((n, meals, rng.choice([2, 3]), rng.choice([900, 1050]), rng.choice([1150, 1250, 1400]), rng.choice([60, 80]), rng.randint(0, 4)))
    rows = [
        (n, days, [(m, True, True, False, False, p, c) for m, ds in zip(("mic_dejun", "pranz", "cina"), meals, strict=True) for c, p in ds],
         f'{{"min_calories": {low}, "max_calories": {high}}}', f'{{"max_prep_time": {prep}}}', f'{{"max_high_calorie": {heavy}, "calorie_threshold": 400}}')
        for n, meals, days, low, high, prep, heavy in cases
    ]
    df = spark.createDataFrame(rows, f"id int, days int, dishes array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>, kcal string, prep string, heavy string")

    def rule(check, params):
        return F.struct(F.lit(check).alias("check_fn"), params.alias("params"))

    rules = F.array(
        rule("check_no_duplicates", F.lit("{}")),
        rule("check_calorie_range", F.col("kcal")),
        rule("check_max_prep_time_per_day", F.col("prep")),
        rule("check_max_high_calorie_meals", F.col("heavy")),
    )
    got = {r.id: r.ok for r in fe.recipe_feasible(df, F.col("dishes"), F.col("days"), rules, "ok").collect()}
    want = {n: brute_menus(meals, *rest) for n, meals, *rest in cases}
    assert got == want
    assert 30 < sum(want.values()) < 220


def test_menu_search_ends_early():
    """27 dishes over 7 days, and more, with plans and without."""
    exists = fe.plan_search()
    rng = random.Random(5)
    begun, outcomes = time.perf_counter(), []
    for n in range(40):
        dishes = 9 if n < 30 else 12
        kcal = [[rng.randint(250, 600) for _ in range(dishes)] for _ in range(3)]
        width = rng.choice([20, 40, 80, 150])
        menus = [
            (sum(x > 400 for x in (b, s, d)), i, 100 + j, 200 + k)
            for i, b in enumerate(kcal[0]) for j, s in enumerate(kcal[1]) for k, d in enumerate(kcal[2])
            if 1275 - width <= b + s + d <= 1275 + width
        ]
        outcomes.append(exists(menus, 7, rng.choice([8, 10, 12, 1e18])))
    assert time.perf_counter() - begun < 40
    assert any(outcomes) and not all(outcomes)
    # every dish fits every other: dishes are interchangeable, and the tenth day finds no breakfast
    full = [(0, i, 100 + j, 200 + k) for i in range(9) for j in range(12) for k in range(12)]
    assert exists(full, 9, 0) and not exists(full, 10, 0)
    # more breakfasts than Python's recursion goes deep
    assert not exists([(1, i, 5000 + i % 2, 6000) for i in range(3000)], 2, 9)


def test_infeasible_ids_are_flagged(spark, monkeypatch):
    tried = []

    def build(requests, hard):
        tried.extend(r.seed for r in requests.collect())
        return requests.withColumn("feasible", F.col("seed").isin(1, 12, 10_003))

    monkeypatch.setitem(co.wd.WORLDS, "travel", build)
    asked = spark.createDataFrame([("a", 1, "easy"), ("b", 2, "easy"), ("c", 9, "hard"), ("d", 50, "hard")], "instance_id string, seed long, difficulty string")
    base = {r.instance_id: (r.seed, r.feasible, r.attempts) for r in co.generate_feasible(asked, "travel", max_retries=4).collect()}
    assert base == {"a": (1, True, 0), "b": (10_003, True, 2), "c": (10_011, False, 3), "d": (10_052, False, 3)}
    hard = {r.instance_id: (r.seed, r.feasible, r.attempts) for r in co.generate_feasible(asked, "travel", True).collect()}
    assert hard == {"a": (1, True, 0), "b": (11, False, 9), "c": (12, True, 3), "d": (59, False, 9)}
    tried.clear()
    assert co.generate_feasible(asked, "travel", max_retries=1).count() == 4 and len(tried) == 4
