"""Task instances of the four worlds, built row by row from ``(instance_id, seed, difficulty)``.

Every world function returns the same columns: ``instance_id, seed, difficulty, world_type, payload, constraints, goals,
entities, meta, prompt_ro, prompt_en, feasible``; payload, meta, attributes and parameters are JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx
from sparkrubric.plans import catalogs as cat
from sparkrubric.plans import constraints as cn
from sparkrubric.plans import feasibility as fe
from sparkrubric.plans.draws import Draw

COLUMNS = [
    "instance_id", "seed", "difficulty", "world_type", "payload", "constraints", "goals", "entities", "meta",
    "prompt_ro", "prompt_en", "feasible",
]


# --- catalogs as literal columns -----------------------------------------------------------------------------
def _structs(records: list[dict]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in records])


def _attractions() -> tuple[list[tuple[str, str]], list[list[dict]]]:
    cities: dict[tuple[str, str], list[dict]] = {}
    for city, city_en, name, name_en, kind, kind_en, place, audience, hours, lei in cat.rows(cat.ATTRACTIONS):
        record = {
            "name": name, "name_en": name_en, "type": kind, "type_en": kind_en, "indoor": place == "indoor",
            "family_friendly": audience == "family", "duration_hours": float(hours), "cost_lei": int(lei),
        }
        cities.setdefault((city, city_en), []).append(record)
    return list(cities), list(cities.values())


def _dishes(meal: str) -> list[dict]:
    out = []
    for kind, kind_en, name, name_en, tags, minutes, kcal in cat.rows(cat.DISHES):
        if kind == meal:
            has = tags.split()
            out.append({
                "name": name, "name_en": name_en, "type": kind, "type_en": kind_en, "vegetarian": "vegetarian" in has,
                "vegan": "vegan" in has, "contains_gluten": "gluten" in has, "contains_lactose": "lactose" in has,
                "prep_time_min": int(minutes), "calories": int(kcal),
            })
    return out


def _facts() -> list[dict]:
    names = ("category", "key", "question_ro", "question_en", "answer", "misbelief")
    return [
        {n: (None if v == "-" else v) for n, v in zip(names, r, strict=True)} for r in cat.rows(cat.FACTS)
    ]


# --- shared pieces -------------------------------------------------------------------------------------------
def _numbered(items: Column, letter: str, fields: list[str]) -> Column:
    """Items with an id ``A1, A2, ...``."""
    return F.transform(
        items,
        lambda x, n: F.struct(
            F.concat(F.lit(letter), (n + 1).cast("string")).alias("id"), *[x[f].alias(f) for f in fields]
        ),
    )


def _ids(items: Column) -> Column:
    return F.transform(items, lambda x: x["id"])


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def _rules_text(constraints: Column, field: str, empty: str | None = None) -> Column:
    listed = F.array_join(F.transform(constraints, lambda c: F.concat(F.lit("  - "), c[field])), "\n")
    return listed if empty is None else F.when(F.size(constraints) == 0, F.lit(empty)).otherwise(listed)


def _number_text(value: Column) -> Column:
    return value.cast("string")


def _total(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x[field].cast("double"))


def _count(items: Column, condition) -> Column:
    return F.size(F.filter(items, condition))


def _entity(x: Column, name: Column, aliases: Column, attributes: Column) -> Column:
    return F.struct(x["id"].alias("id"), name.alias("name"), aliases.alias("aliases"), attributes.alias("attributes"))


# --- travel --------------------------------------------------------------------------------------------------
def travel_worlds(seeds: DataFrame, hard: bool = False) -> DataFrame:
    d = Draw("seed")
    cities, pools = _attractions()
    level = F.col("difficulty")
    fields = list(pools[0][0])
    city_no = F.floor(d.unit("city") * len(cities)).cast("int")
    pool = F.get(F.array(*[_structs(p) for p in pools]), F.col("city_no"))
    if hard:
        days, picks = d.choice("days", [3, 4]), pool
    else:
        days = F.when(level == "easy", d.choice("days", [2, 3])).otherwise(d.choice("days", [3, 4]))
        picks = d.sample("attraction", pool, d.integer("attractions", 4, 6))
    base = (
        seeds.withColumn("city_no", city_no)
        .withColumn("city", F.get(F.array(*[F.lit(c[0]) for c in cities]), F.col("city_no")))
        .withColumn("city_en", F.get(F.array(*[F.lit(c[1]) for c in cities]), F.col("city_no")))
        .withColumn("num_days", days)
        .withColumn("attractions", _numbered(picks, "A", fields))
        .withColumn("total_cost", _total(F.col("attractions"), "cost_lei"))
    )
    items = F.col("attractions")
    family = d.chance("family", 0.5)
    ruled = base.withColumn("constraints", _hard_travel_rules(d) if hard else _travel_rules(d, family))
    goals = F.array(
        cn.goal("fill_days", {"num_days": F.col("num_days")}),
        cn.goal("hard_valid_ids" if hard else "valid_ids", {"valid_ids": _ids(items)}),
    )

    def entity(a: Column) -> Column:
        lowered = F.lower(a["name"])
        plain = F.translate(lowered, "ăâîșț", "aaist")
        aliases = F.array(lowered, plain, a["name_en"], F.lower(a["name_en"]))
        return _entity(a, a["name"], aliases, F.to_json(F.struct(*[a[f].alias(f) for f in fields])))

    payload = F.to_json(F.struct("city", "city_en", "num_days", "attractions"))
    meta = {
        "difficulty": F.lit("hard") if hard else level,
        "family_trip": fe.has_rule(F.col("constraints"), "check_all_family_friendly") if hard else family,
        "num_attractions": F.size(items),
    }
    if hard:
        meta["num_constraints"] = F.size("constraints")
    return _finish(
        ruled, "travel", payload, goals, F.transform(items, entity), meta,
        _travel_prompt("ro"), _travel_prompt("en"),
        fe.travel_feasible(items, F.col("num_days"), F.col("constraints")),
    )


def _travel_rules(d: Draw, family: Column) -> Column:
    items, level = F.col("attractions"), F.col("difficulty")
    harder, hardest = level.isin("medium", "hard"), level == "hard"
    kind = lambda name: F.exists(items, lambda a: a["type"] == name)
    outdoor = F.when(hardest, 1).otherwise(d.choice("outdoor", [1, 2]))
    budget = F.floor(F.col("total_cost") * (F.lit(0.5) + F.lit(0.25) * d.unit("budget"))).cast("int")
    mean = _total(items, "duration_hours") / F.size(items)
    hours = F.round(mean * 2 + mean * d.unit("hours"), 1)
    kinds = F.array_distinct(F.transform(items, lambda a: a["type"]))
    required = F.array_compact(
        F.array(F.when(kind("monument"), F.lit("monument")), F.when(kind("muzeu"), F.lit("muzeu")))
    )
    single = F.filter(
        kinds,
        lambda k: (F.size(F.filter(items, lambda a: a["type"] == k)) == 1)
        & (F.size(kinds) > 2)
        & ~F.array_contains(required, k),
    )
    dropped = d.choice("exclude", single)
    words = {
        "n": outdoor,
        "word_ro": F.when(outdoor == 1, "activitate").otherwise("activități"),
        "word_en": F.when(outdoor == 1, "activity").otherwise("activities"),
    }
    return cn.listed(
        (kind("monument"), cn.constraint("must_monument", {"type_required": F.lit("monument")})),
        (kind("muzeu") & harder, cn.constraint("must_museum", {"type_required": F.lit("muzeu")})),
        (None, cn.constraint("max_outdoor", {"max_outdoor": outdoor}, words)),
        (family, cn.constraint("family")),
        (harder & (F.col("total_cost") > 50), cn.constraint("budget", {"max_budget": budget}, {"n": budget})),
        (harder & d.chance("duplicates", 0.3), cn.constraint("no_duplicates")),
        (hardest, cn.constraint("max_duration", {"max_hours": hours}, {"n": hours})),
        (hardest & (F.size(kinds) >= 3), cn.constraint("diversity", {"min_types": F.lit(3)})),
        (
            hardest & (F.size(single) > 0) & d.chance("exclude it", 0.5),
            cn.constraint("exclude", {"type_forbidden": dropped}, cn.type_names(dropped)),
        ),
    )


def _hard_travel_rules(d: Draw) -> Column:
    items, days = F.col("attractions"), F.col("num_days")
    kind = lambda name: F.exists(items, lambda a: a["type"] == name)
    kin = _count(items, lambda a: a["family_friendly"])
    indoor, outdoor = _count(items, lambda a: a["indoor"]), _count(items, lambda a: ~a["indoor"])
    monument = d.chance("monument", 0.5)
    budget = F.floor(F.col("total_cost") * (F.lit(0.55) + F.lit(0.15) * d.unit("budget"))).cast("int")
    coin = d.chance("family or outdoor", 0.5)
    family = coin & (kin >= days)
    kinds = F.array_distinct(F.transform(items, lambda a: a["type"]))
    can_first, can_last = (indoor >= 1) & ~family, outdoor >= 1
    both = d.chance("both ends", 0.5) & can_first & can_last
    which = d.chance("which end", 0.5)
    named = d.choice(
        "named", F.when(family, F.filter(items, lambda a: a["family_friendly"])).otherwise(items)
    )
    last = {"num_days": days, "must_have_outdoor": F.lit(True)}
    return cn.listed(
        (
            kind("monument") & (monument | ~kind("muzeu")),
            cn.constraint("hard_monument", {"type_required": F.lit("monument")}),
        ),
        (
            kind("monument") & kind("muzeu") & ~monument,
            cn.constraint("hard_museum", {"type_required": F.lit("muzeu")}),
        ),
        (None, cn.constraint("hard_budget", {"max_budget": budget}, {"n": budget})),
        (None, cn.constraint("hard_no_dup")),
        (family, cn.constraint("hard_family")),
        (~coin & (indoor >= days), cn.constraint("hard_outdoor", {"max_outdoor": F.lit(1)})),
        (F.size(kinds) >= 3, cn.constraint("hard_diversity", {"min_types": F.lit(3)})),
        (both | (~both & which & can_first), cn.constraint("first_day", {"indoor_only": F.lit(True)})),
        (both | (~both & ~which & can_last), cn.constraint("last_day", last)),
        (
            d.chance("name it", 0.7) & named["name"].isNotNull(),
            cn.constraint(
                "must_specific", {"entity_name": named["name"]}, {"name": named["name"], "name_en": named["name_en"]}
            ),
        ),
    )


def _travel_prompt(lang: str) -> Column:
    ro = lang == "ro"
    priced = F.exists(F.col("constraints"), lambda c: c["id"] == "C_BUDGET")

    def line(a: Column) -> Column:
        lei = _number_text(a["cost_lei"])
        if ro:
            place = F.when(a["indoor"], "interior").otherwise("exterior")
            kids = F.when(a["family_friendly"], "potrivit pentru copii").otherwise("nu este potrivit pentru copii mici")
            price = F.when(priced, F.concat(F.lit(", "), lei, F.lit(" lei"))).otherwise("")
            head = [F.lit("  • "), a["name"], F.lit(" ("), a["type"]]
        else:
            place = F.when(a["indoor"], "indoor").otherwise("outdoor")
            kids = F.when(a["family_friendly"], "suitable for children").otherwise("not suitable for small children")
            price = F.when(a["cost_lei"] > 0, F.concat(F.lit(", "), lei, F.lit(" lei"))).otherwise(", free")
            head = [F.lit("  - "), a["name_en"], F.lit(" ("), a["type_en"]]
        return F.concat(*head, F.lit(", "), place, F.lit(", "), kids, price, F.lit(")"))

    return cn.fill(
        cat.PROMPT_TRAVEL_RO if ro else cat.PROMPT_TRAVEL_EN,
        {
            "city": F.col("city" if ro else "city_en"),
            "num_days": F.col("num_days"),
            "options": _lines(F.col("attractions"), line),
            "constraints": _rules_text(F.col("constraints"), f"description_{lang}"),
        },
    )


# --- schedule ------------------------------------------------------------------------------------------------
def schedule_worlds(seeds: DataFrame, hard: bool = False) -> DataFrame:
    d = Draw("seed")
    level = F.col("difficulty")
    meetings = _structs([{"name_ro": ro, "name_en": en} for ro, en in cat.rows(cat.MEETINGS)])
    slots_ro, slots_en = [F.array(*[F.lit(s) for s in t.split()]) for t in (cat.SLOTS_RO, cat.SLOTS_EN)]
    all_ro, all_en = [F.array(*[F.lit(s) for s in t.split()]) for t in (cat.DAYS_RO, cat.DAYS_EN)]
    if hard:
        days, count = d.choice("days", [3, 4]), d.integer("appointments", 6, 8)
    else:
        days = F.when(level == "easy", 2).otherwise(d.choice("days", [2, 3]))
        count = d.integer("appointments", 3, 5)
    base = (
        seeds.withColumn("num_days", days)
        .withColumn("n_apt", count)
        .withColumn("days_ro", F.slice(all_ro, 1, F.col("num_days")))
        .withColumn("days_en", F.slice(all_en, 1, F.col("num_days")))
        .withColumn("slots_ro", slots_ro)
        .withColumn("slots_en", slots_en)
    )
    if hard:
        index = F.sequence(F.lit(0), F.col("n_apt") - 1)
        base = base.withColumn("picked", F.transform(index, lambda n: d.choice("meeting", meetings, n))).withColumn(
            "levels",
            d.shuffle(
                "levels",
                F.concat(
                    F.array_repeat(F.lit("high"), 2),
                    F.array_repeat(F.lit("medium"), F.col("n_apt") - 4),
                    F.array_repeat(F.lit("low"), 2),
                ),
            ),
        )
    else:
        base = base.withColumn("picked", d.sample("meeting", meetings, F.col("n_apt")))

    def appointment(m: Column, n: Column) -> Column:
        if hard:
            priority = F.get("levels", n)
            open_days = F.when(priority == "medium", F.col("num_days") - 1).otherwise(F.col("num_days"))
            same = lambda upto: F.size(
                F.filter(F.slice("picked", 1, upto), lambda x: x["name_ro"] == m["name_ro"])
            )
            number = F.concat(F.lit(" ("), same(n + 1).cast("string"), F.lit(")"))
            tail = F.when(same(F.size("picked")) > 1, number).otherwise("")
        else:
            priority, open_days, tail = d.choice("priority", ["high", "medium", "low"], n), F.col("num_days"), F.lit("")
        day = F.floor(d.unit("day", n) * open_days).cast("int")
        slot = F.floor(d.unit("slot", n) * 2).cast("int")
        return F.struct(
            F.concat(F.lit("M"), (n + 1).cast("string")).alias("id"),
            F.concat(m["name_ro"], tail).alias("name_ro"),
            F.concat(m["name_en"], tail).alias("name_en"),
            F.get("days_ro", day).alias("day_ro"),
            F.get("days_en", day).alias("day_en"),
            F.get("slots_ro", slot).alias("slot_ro"),
            F.get("slots_en", slot).alias("slot_en"),
            priority.alias("priority"),
        )

    full = base.withColumn("appointments", F.transform("picked", appointment))
    items = F.col("appointments")
    ruled = full.withColumn("constraints", _hard_schedule_rules(d) if hard else _schedule_rules(d))
    goals = F.array(
        cn.goal("hard_no_overlaps" if hard else "no_overlaps", {"days": F.col("days_ro"), "slots": F.col("slots_ro")}),
        cn.goal("hard_schedule_ids" if hard else "valid_ids", {"valid_ids": _ids(items)}),
    )

    def entity(a: Column, n: Column) -> Column:
        aliases = F.array(F.lower(a["name_ro"]))
        if hard:
            plain = F.get("picked", n)
            aliases = F.array(*[F.lower(x) for x in (a["name_ro"], a["name_en"], plain["name_ro"], plain["name_en"])])
        fields = ["id", "name_ro", "name_en", "day_ro", "day_en", "slot_ro", "slot_en", "priority"]
        return _entity(a, a["name_ro"], aliases, F.to_json(F.struct(*[a[f].alias(f) for f in fields])))

    payload = F.to_json(F.struct("days_ro", "days_en", "slots_ro", "slots_en", "appointments"))
    meta = {
        "difficulty": F.lit("extreme") if hard else level,
        "num_appointments": F.size(items),
        "num_days": F.col("num_days"),
    }
    if hard:
        meta["num_constraints"] = F.size("constraints")
    named = F.transform(items, lambda a: F.struct(a["name_ro"].alias("name"), a["priority"].alias("priority")))
    return _finish(
        ruled, "schedule", payload, goals, F.transform(items, entity), meta,
        _schedule_prompt("ro"), _schedule_prompt("en"),
        fe.schedule_feasible(named, F.col("days_ro"), F.col("slots_ro"), F.col("constraints")),
    )


def _last_day() -> tuple[dict, dict]:
    ro, en = F.element_at("days_ro", -1), F.element_at("days_en", -1)
    return {"priority": F.lit("medium"), "forbidden_days": F.array(ro, en)}, {"day_ro": ro, "day_en": en}


def _schedule_rules(d: Draw) -> Column:
    items, level = F.col("appointments"), F.col("difficulty")
    hardest = level == "hard"
    per_day = F.when(level == "easy", d.choice("per day", [2, 3])).otherwise(2)
    total = F.greatest(F.lit(2), F.size(items) - 1)
    params, values = _last_day()
    has = lambda lv: F.exists(items, lambda a: a["priority"] == lv)
    return cn.listed(
        (None, cn.constraint("max_per_day", {"max_per_day": per_day}, {"n": per_day})),
        (has("high"), cn.constraint("keep_high")),
        (hardest, cn.constraint("no_back_to_back")),
        (hardest, cn.constraint("max_total", {"max_total": total}, {"n": total})),
        (hardest & has("medium") & d.chance("medium day", 0.5), cn.constraint("medium_day", params, values)),
    )


def _hard_schedule_rules(d: Draw) -> Column:
    items, days = F.col("appointments"), F.col("num_days")
    total = F.least(days * 2, F.size(items) - 1)
    spread = F.least(F.lit(2), days)
    params, values = _last_day()
    medical = F.exists(items, lambda a: F.lower(a["name_ro"]).rlike("medical|control"))
    morning = F.array(F.lit("dimineață"), F.lit("morning"))
    return cn.listed(
        (None, cn.constraint("max_per_day", {"max_per_day": F.lit(2)}, {"n": F.lit(2)})),
        (None, cn.constraint("hard_keep_high")),
        (None, cn.constraint("hard_max_total", {"max_total": total}, {"n": total})),
        (None, cn.constraint("drop_order")),
        (None, cn.constraint("spread", {"min_days_with_appointments": spread}, {"n": spread})),
        (medical, cn.constraint("medical_morning", {"type_keyword": F.lit("control"), "allowed_slots": morning})),
        (None, cn.constraint("hard_medium_day", params, values)),
        (
            d.chance("high morning", 0.5),
            cn.constraint("high_morning", {"priority": F.lit("high"), "required_slots": morning}),
        ),
    )


def _schedule_prompt(lang: str) -> Column:
    ro = lang == "ro"
    labels = {"high": "înaltă", "medium": "medie", "low": "scăzută"}

    def line(a: Column) -> Column:
        level = a["priority"]
        if ro:
            for name, label in labels.items():
                level = F.when(a["priority"] == name, label).otherwise(level)
        words = ("prioritate", "programat") if ro else ("priority", "scheduled")
        return F.concat(
            F.lit("  • "), a[f"name_{lang}"], F.lit(f" ({words[0]}: "), level, F.lit(f", {words[1]}: "),
            a[f"day_{lang}"], F.lit(" "), a[f"slot_{lang}"], F.lit(")"),
        )

    return cn.fill(
        cat.PROMPT_SCHEDULE_RO if ro else cat.PROMPT_SCHEDULE_EN,
        {
            "days": F.array_join(f"days_{lang}", ", "),
            "slots": F.array_join(f"slots_{lang}", ", "),
            "options": _lines(F.col("appointments"), line),
            "constraints": _rules_text(F.col("constraints"), f"description_{lang}"),
        },
    )


# --- fact ----------------------------------------------------------------------------------------------------
def fact_worlds(seeds: DataFrame, hard: bool = False) -> DataFrame:
    d = Draw("seed")
    level = F.col("difficulty")
    records = [f for f in _facts() if f["misbelief"] or not hard]
    pool = F.array(
        *[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in r.items()]) for r in records]
    )
    if hard:
        count = d.integer("facts", 5, 7)
        false_share = F.lit(1.0)
    else:
        count = (
            F.when(level == "easy", d.integer("facts", 3, 5))
            .when(level == "medium", d.integer("facts", 4, 6))
            .otherwise(d.integer("facts", 5, 8))
        )
        false_share = F.when(level == "medium", 0.4).when(level == "hard", 0.8).otherwise(0.0)
    base = seeds.withColumn("picked", d.sample("fact", pool, count)).withColumn(
        "facts",
        F.transform(
            "picked",
            lambda f, n: tx.let(
                f["misbelief"].isNotNull() & (d.unit("false", n) < false_share),
                lambda trap: F.struct(
                    F.concat(F.lit("F"), (n + 1).cast("string")).alias("id"),
                    f["category"].alias("category"),
                    f["key"].alias("key"),
                    f["question_ro"].alias("question_ro"),
                    f["question_en"].alias("question_en"),
                    F.when(trap, f["misbelief"]).otherwise(f["answer"]).alias("answer"),
                    f["answer"].alias("true_answer"),
                    trap.alias("trap"),
                ),
            ),
        ),
    )
    items = F.col("facts")
    traps = F.filter(items, lambda f: f["trap"])
    asked = items[0] if hard else F.coalesce(F.try_element_at(traps, F.lit(-1)), items[0])
    known = F.map_from_entries(F.transform(items, lambda f: F.struct(f["key"], f["answer"])))
    full = base.withColumn("asked", asked).withColumn("fact_db", known)
    if hard:
        rules = cn.listed(
            (None, cn.constraint("hard_from_context")),
            (None, cn.constraint("exact_value", {"expected": F.col("asked.answer")})),
        )
    else:
        rules = cn.listed((None, cn.constraint("from_context")))
    ruled = full.withColumn("constraints", rules)
    goals = F.array(cn.goal("hard_no_hallucination" if hard else "no_hallucination", {"fact_db": F.col("fact_db")}))

    def entity(f: Column) -> Column:
        fields = ["question_ro", "question_en", "answer", "category"]
        return _entity(f, f["key"], F.array(f["key"]), F.to_json(F.struct(*[f[x].alias(x) for x in fields])))

    scripts = F.transform(
        traps,
        lambda f: F.struct(
            f["id"].alias("fact_id"), f["question_ro"].alias("question_ro"), f["question_en"].alias("question_en"),
            f["answer"].alias("context_answer"), f["true_answer"].alias("real_world_answer"), F.lit(True).alias("is_trap"),
        ),
    )
    question = F.struct("asked.question_ro", "asked.question_en", F.col("asked.answer").alias("expected_answer"))
    payload = F.to_json(
        F.struct(F.col("fact_db").alias("facts"), scripts.alias("misbelief_scripts"), question.alias("question"))
    )
    meta = {
        "difficulty": F.lit("extreme") if hard else level,
        "num_facts": F.size(items),
        "num_traps": F.size(traps),
        "has_misbelief": F.size(traps) > 0,
    }
    if hard:
        meta["trap_rate"] = F.lit(1.0)
    return _finish(
        ruled, "fact", payload, goals, F.transform(items, entity), meta, _fact_prompt("ro"), _fact_prompt("en"),
        F.lit(True),
    )


def _fact_prompt(lang: str) -> Column:
    ro = lang == "ro"
    line = lambda f: F.concat(F.lit("  • "), tx.readable_key(f["key"]), F.lit(": "), f["answer"])
    empty = "  - Răspunde pe baza faptelor date." if ro else "  - Answer based on the given facts."
    return cn.fill(
        cat.PROMPT_FACT_RO if ro else cat.PROMPT_FACT_EN,
        {
            "options": _lines(F.col("facts"), line),
            "question": F.col(f"asked.question_{lang}"),
            "constraints": _rules_text(F.col("constraints"), f"description_{lang}", empty),
        },
    )


# --- recipe --------------------------------------------------------------------------------------------------
MEALS = {"mic_dejun": "breakfast", "pranz": "lunch", "cina": "dinner"}


def recipe_worlds(seeds: DataFrame, hard: bool = False) -> DataFrame:
    d = Draw("seed")
    level = F.col("difficulty")
    if hard:
        days = d.choice("days", [3, 4])
        chosen = [_structs(_dishes(m)) for m in MEALS]
    else:
        days = F.when(level == "easy", 2).otherwise(d.choice("days", [2, 3]))
        chosen = [d.sample(f"{m} dish", _structs(_dishes(m)), d.integer(f"{m} dishes", 3, 5)) for m in MEALS]
    fields = list(_dishes("pranz")[0])
    base = (
        seeds.withColumn("num_days", days)
        .withColumn("meals_per_day", F.array(*[F.lit(m) for m in MEALS]))
        .withColumn("meals_per_day_en", F.array(*[F.lit(m) for m in MEALS.values()]))
        .withColumn("dishes", _numbered(F.concat(*chosen), "D", fields))
    )
    items = F.col("dishes")
    ruled = base.withColumn("constraints", _hard_recipe_rules(d) if hard else _recipe_rules(d))
    goals = F.array(
        cn.goal("hard_meals" if hard else "meals_filled", {"num_days": F.col("num_days"), "meals": F.col("meals_per_day")}),
        cn.goal("hard_dishes" if hard else "valid_dishes", {"valid_ids": _ids(items)}),
    )

    def entity(x: Column) -> Column:
        aliases = F.array(F.lower(x["name"]), x["name_en"], F.lower(x["name_en"]))
        return _entity(x, x["name"], aliases, F.to_json(F.struct(*[x[f].alias(f) for f in fields])))

    by_meal = F.struct(*[_ids(_of_meal(items, m)).alias(m) for m in MEALS])
    payload = F.to_json(
        F.struct("num_days", "meals_per_day", "meals_per_day_en", by_meal.alias("available_dishes"), "dishes")
    )
    diets = F.filter(F.col("constraints"), lambda c: c["id"].startswith("C_DIET"))
    meta = {"difficulty": F.lit("hard") if hard else level, "num_dishes": F.size(items)}
    if hard:
        meta |= {"num_constraints": F.size("constraints"), "has_dietary_constraint": F.size(diets) > 0}
    else:
        meta["dietary_constraints"] = F.transform(
            diets, lambda c: F.regexp_replace(c["check_fn"], "^check_(?:all_)?", "")
        )
    typed = F.transform(
        items, lambda x: F.struct(x["type"].alias("meal"), *[x[f].alias(f) for f in fields if f not in ("type", "type_en")])
    )
    tested = fe.recipe_feasible(ruled, typed, F.col("num_days"), F.col("constraints"))
    return _finish(
        tested, "recipe", payload, goals, F.transform(items, entity), meta, _recipe_prompt("ro"), _recipe_prompt("en"),
        F.col("feasible"),
    )


def _of_meal(dishes: Column, meal: str) -> Column:
    return F.filter(dishes, lambda x: x["type"] == meal)


def _recipe_rules(d: Draw) -> Column:
    items, level = F.col("dishes"), F.col("difficulty")
    hardest, harder = level == "hard", level.isin("medium", "hard")
    n_diets = F.when(level == "easy", 0).when(level == "medium", 1).otherwise(d.integer("diets", 1, 2))
    diets = F.array(*[cn.constraint(k) for k in ("vegetarian", "no_gluten", "no_lactose")])
    picked = F.transform(
        d.sample("diet", diets, n_diets),
        lambda c, n: F.struct(
            F.concat(F.lit("C_DIET_"), n.cast("string")).alias("id"),
            *[c[f].alias(f) for f in ("type", "description_ro", "description_en", "check_fn", "params")],
        ),
    )
    kcal = d.choice("calories", [1500, 1800, 2000])
    mean = _total(items, "prep_time_min") / F.size(items)
    prep = F.greatest(F.lit(60), F.least(F.lit(120), F.floor(mean * 3.5).cast("int")))
    some_vegan = F.exists(items, lambda x: x["vegan"])
    rest = cn.listed(
        (harder, cn.constraint("max_calories", {"max_calories": kcal}, {"n": kcal})),
        (hardest | ((level == "medium") & d.chance("variety", 0.5)), cn.constraint("variety")),
        (hardest, cn.constraint("max_prep", {"max_prep_time": prep}, {"n": prep})),
        (hardest, cn.constraint("lunch", {"num_days": F.col("num_days")})),
        (hardest & d.chance("vegan", 0.5) & some_vegan, cn.constraint("vegan")),
    )
    return F.concat(picked, rest)


def _hard_recipe_rules(d: Draw) -> Column:
    days = F.col("num_days")
    diet = d.chance("diet", 0.7)
    which = d.choice("which diet", [0, 1, 2])
    kcal = d.choice("calories", [1600, 1800, 2000])
    prep = d.choice("prep", [90, 100, 120])
    order, lunch = d.chance("order", 0.5), d.chance("lunch", 0.5)
    quick = d.choice("quick", [15, 20])
    diets = ("hard_vegetarian", "hard_no_gluten", "hard_no_lactose")
    return cn.listed(
        *[(diet & (which == n), cn.constraint(k)) for n, k in enumerate(diets)],
        (None, cn.constraint("hard_dish_no_dup")),
        (~diet & d.chance("limit", 0.5), cn.constraint("hard_calories", {"max_calories": kcal}, {"n": kcal})),
        (d.chance("limit prep", 0.6), cn.constraint("hard_prep", {"max_prep_time": prep}, {"n": prep})),
        (order & lunch, cn.constraint("hard_lunch", {"num_days": days})),
        (order & ~lunch, cn.constraint("dinner_light", {"num_days": days})),
        (d.chance("be quick", 0.3), cn.constraint("quick_breakfast", {"max_prep_time": quick}, {"n": quick})),
    )


def _recipe_prompt(lang: str) -> Column:
    ro = lang == "ro"
    titles = ("Mic dejun", "Prânz", "Cină") if ro else ("Breakfast", "Lunch", "Dinner")
    gluten, lactose = ("conține gluten", "conține lactoză") if ro else ("contains gluten", "contains lactose")
    mark, name = ("    • ", "name") if ro else ("    - ", "name_en")
    empty = "  - Nicio restricție specială." if ro else "  - No special restrictions."

    def line(x: Column) -> Column:
        tags = F.array_compact(
            F.array(
                F.when(x["vegetarian"], "vegetarian"),
                F.when(x["vegan"], "vegan"),
                F.when(x["contains_gluten"], gluten),
                F.when(x["contains_lactose"], lactose),
                F.concat(x["calories"].cast("string"), F.lit(" kcal")),
            )
        )
        return F.concat(F.lit(mark), x[name], F.lit(" ("), F.array_join(tags, ", "), F.lit(")"))

    def section(meal: str, title: str) -> Column:
        mine = _of_meal(F.col("dishes"), meal)
        return F.when(F.size(mine) > 0, F.concat(F.lit(f"  {title}:\n"), _lines(mine, line)))

    sections = F.array_compact(F.array(*[section(m, t) for m, t in zip(MEALS, titles, strict=True)]))
    return cn.fill(
        cat.PROMPT_RECIPE_RO if ro else cat.PROMPT_RECIPE_EN,
        {
            "num_days": F.col("num_days"),
            "options": F.array_join(sections, "\n\n"),
            "constraints": _rules_text(F.col("constraints"), f"description_{lang}", empty),
        },
    )


# --- assembly ------------------------------------------------------------------------------------------------
def _finish(df, world_type, payload, goals, entities, meta, prompt_ro, prompt_en, feasible) -> DataFrame:
    return (
        df.withColumn("world_type", F.lit(world_type))
        .withColumn("payload", payload)
        .withColumn("goals", goals)
        .withColumn("entities", entities)
        .withColumn("meta", F.to_json(F.struct(*[c.alias(n) for n, c in meta.items()])))
        .withColumn("prompt_ro", prompt_ro)
        .withColumn("prompt_en", prompt_en)
        .withColumn("feasible", feasible)
        .select(*COLUMNS)
    )


WORLDS = {"travel": travel_worlds, "schedule": schedule_worlds, "fact": fact_worlds, "recipe": recipe_worlds}
