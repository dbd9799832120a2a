"""Plan checks by name.

A check is described by Columns over *item rows* (one row per plan ref, with the resolved entity's attributes):
values to sum per unit (a day or the whole plan), an optional token to count distinct, a test per unit, and the
verdict over the unit totals.  All checks of all plans are then evaluated by two grouped aggregations with
map-side partials, whatever their number.  New checks register a builder under their name.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx

ITEM_COLUMNS = {
    "key": "string",
    "day": "string",
    "slot": "string",
    "kind": "string",
    "n_values": "int",
    "truthy": "boolean",
    "is_null_word": "boolean",
    "item_pos": "int",
    "ref": "string",
    "entity_id": "string",
    "name": "string",
    "aliases": "array<string>",
    "type": "string",
    "indoor": "boolean",
    "family_friendly": "boolean",
    "duration_hours": "double",
    "cost_lei": "double",
    "priority": "string",
    "vegetarian": "boolean",
    "vegan": "boolean",
    "contains_gluten": "boolean",
    "contains_lactose": "boolean",
    "prep_time_min": "double",
    "calories": "double",
    "is_entity": "boolean",
    "kept": "boolean",
    "facts": "array<string>",
}

# --- fixed values ------------------------------------------------------------------------------------------
MEAL_NAMES = {"mic_dejun": "breakfast", "pranz": "lunch", "cina": "dinner"}
BREAKFAST_KEYS = ("_mic_dejun", "_breakfast")
# --- end of fixed values -----------------------------------------------------------------------------------


def with_item_columns(df: DataFrame) -> DataFrame:
    """Add the item columns the input lacks as typed nulls."""
    missing = {n: F.lit(None).cast(t) for n, t in ITEM_COLUMNS.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


# --- parameters --------------------------------------------------------------------------------------------
class LiteralParams:
    """Parameters known when the query is built."""

    def __init__(self, values: dict) -> None:
        self.values = values

    def num(self, name: str, default: float | None = None) -> Column:
        return F.lit(self.values.get(name, default)).cast("double")

    def text(self, name: str, default: str | None = None) -> Column:
        return F.lit(self.values.get(name, default)).cast("string")

    def flag(self, name: str) -> Column:
        return F.lit(bool(self.values.get(name, False)))

    def names(self, name: str, default: tuple[str, ...] = ()) -> Column:
        values = self.values.get(name, list(default))
        values = list(values.values()) if isinstance(values, dict) else values
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")


class VariantParams:
    """Parameters read from a VARIANT column, one set per row."""

    def __init__(self, column: str) -> None:
        self.column = F.col(column)

    def _get(self, name: str, kind: str) -> Column:
        return F.try_variant_get(self.column, f"$.{name}", kind)

    def num(self, name: str, default: float | None = None) -> Column:
        return F.coalesce(self._get(name, "double"), F.lit(default).cast("double"))

    def text(self, name: str, default: str | None = None) -> Column:
        return F.coalesce(self._get(name, "string"), F.lit(default).cast("string"))

    def flag(self, name: str) -> Column:
        return F.coalesce(self._get(name, "boolean"), F.lit(False))

    def names(self, name: str, default: tuple[str, ...] = ()) -> Column:
        fallback = F.array(*[F.lit(v) for v in default]).cast("array<string>")
        mapped = F.map_values(self._get(name, "map<string,string>"))
        return F.coalesce(self._get(name, "array<string>"), mapped, fallback)


class TypedParams(VariantParams):
    """Item-level access: known parameters were unpacked into the ``param`` struct once per check specification."""

    KNOWN = {
        "double": "exact_count max_budget max_cost max_outdoor min_per_day max_per_day max_hours max_budget_per_day "
        "min_total max_activities num_days max_total min_types min_days_with_appointments max_calories min_calories "
        "max_prep_time calorie_threshold max_high_calorie",
        "string": "type_required type_forbidden entity_name priority type_keyword expected",
        "boolean": "indoor_only outdoor_only must_have_outdoor",
        "array<string>": "forbidden_days allowed_slots meals valid_ids",
        "map<string,string>": "fact_db",
    }
    TYPES = {name: kind for kind, names in KNOWN.items() for name in names.split()}

    def __init__(self) -> None:
        super().__init__("_variant")

    def _get(self, name: str, kind: str) -> Column:
        if kind == "map<string,string>" and self.TYPES.get(name) != kind:
            return F.lit(None).cast(kind)
        if kind == "array<string>" and self.TYPES.get(name, kind) != kind:
            return F.lit(None).cast(kind)
        if self.TYPES.get(name) == kind:
            return F.col(f"param.{name}")
        return F.try_variant_get(F.try_parse_json("params_json"), f"$.{name}", kind)


def unpacked(params: Column) -> list[Column]:
    """``params_json`` and ``param`` for a check specification; compute them once per specification."""
    typed = [F.try_variant_get(params, f"$.{n}", t).alias(n) for n, t in TypedParams.TYPES.items()]
    return [F.to_json(params).alias("params_json"), F.struct(*typed).alias("param")]


# --- check description -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Check:
    """``ok`` gets the totals ``v`` (list), ``tokens``, ``bad``, ``good``; ``bad``/``good`` get one unit's ``v``."""

    ok: Callable[[SimpleNamespace], Column]
    values: list[Column] = field(default_factory=list)
    token: Column | None = None
    unit: Column | None = None
    bad: Callable[[SimpleNamespace], Column] | None = None
    good: Callable[[SimpleNamespace], Column] | None = None
    error: Column | None = None


Builder = Callable[[SimpleNamespace, "LiteralParams | VariantParams"], Check]
REGISTRY: dict[str, Builder] = {}


def register_check(name: str, builder: Builder) -> None:
    REGISTRY[name] = builder


def _check(name: str) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        register_check(name, builder)
        return builder

    return add


def item_view() -> SimpleNamespace:
    """Columns of an item row plus the derived ones checks share."""
    c = {n: F.col(n) for n in ITEM_COLUMNS}
    i = SimpleNamespace(**c)
    element = (i.kind == "list") & i.item_pos.isNotNull()
    i.first = F.coalesce(i.item_pos, F.lit(0)) == 0
    i.truthy = F.coalesce(i.truthy, F.lit(False))
    i.null_word = F.coalesce(i.is_null_word, F.lit(False))
    i.filled = i.truthy & ~i.null_word
    i.present = (i.kind != "null") & ~i.null_word
    i.planned = element | ((i.kind == "string") & i.filled)
    i.resolved = i.entity_id.isNotNull()
    i.hit = i.planned & i.resolved
    i.final_id = F.coalesce(i.entity_id, i.ref)
    i.is_day = i.key.startswith("day")
    i.day_unit = F.when(i.is_day, i.key)
    i.meal_unit = F.when(i.is_day & i.slot.isNotNull() & i.day.startswith("day"), i.day)
    i.outdoor = i.resolved & ~F.coalesce(i.indoor, F.lit(True))
    i.is_entity_row = F.coalesce(i.is_entity, F.lit(False))
    # one count per list element, the length of a string value
    i.size = F.when(element, 1).when((i.kind == "string"), i.n_values).otherwise(0)
    i.not_iterable = i.kind.isin("null", "other")
    i.not_text = i.truthy & i.kind.isin("list", "other")
    i.breakfast = i.key.contains(BREAKFAST_KEYS[0]) | i.key.contains(BREAKFAST_KEYS[1])
    return i


def one(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as not holding)."""
    return F.when(condition, 1).otherwise(0)


def amount(condition: Column, value: Column) -> Column:
    return F.when(condition, F.coalesce(value, F.lit(0))).otherwise(F.lit(0))


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _none(column: Column) -> Check:
    """Satisfied when no row has the property."""
    return Check(values=[one(column)], ok=lambda s: s.v[0] == 0)


# --- travel ------------------------------------------------------------------------------------------------
@_check("check_must_include_type")
def _must_include_type(i, p):
    t = p.text("type_required")
    return Check(values=[one(i.hit & (i.type == t))], ok=lambda s: _blank(t) | (s.v[0] > 0))


@_check("check_must_exclude_type")
def _must_exclude_type(i, p):
    t = p.text("type_forbidden")
    return Check(values=[one(i.hit & (i.type == t))], ok=lambda s: _blank(t) | (s.v[0] == 0))


@_check("check_exact_type_count")
def _exact_type_count(i, p):
    t = p.text("type_required")
    return Check(
        values=[one(i.hit & (i.type == t))], ok=lambda s: _blank(t) | (s.v[0] == p.num("exact_count", 1))
    )


@_check("check_all_family_friendly")
def _all_family_friendly(i, p):
    return _none(i.hit & ~F.coalesce(i.family_friendly, F.lit(False)))


@_check("check_type_diversity")
def _type_diversity(i, p):
    return Check(token=F.when(i.hit & (i.type != ""), i.type), ok=lambda s: s.tokens >= p.num("min_types", 3))


@_check("check_must_include_specific")
def _must_include_specific(i, p):
    wanted = F.lower(p.text("entity_name", ""))
    named = (F.lower(i.name) == wanted) | F.array_contains(F.transform(i.aliases, F.lower), wanted)
    return Check(values=[one(i.hit & named)], ok=lambda s: _blank(wanted) | (s.v[0] > 0))


@_check("check_budget_limit")
def _budget_limit(i, p):
    limit = p.num("max_budget", 0)
    return Check(values=[amount(i.hit, i.cost_lei)], ok=lambda s: (limit <= 0) | (s.v[0] <= limit))


@_check("check_max_total_cost")
def _max_total_cost(i, p):
    return Check(values=[amount(i.hit, i.cost_lei)], ok=lambda s: s.v[0] <= p.num("max_cost", 1000))


def _per_day(i, value: Column, bad: Callable[[Column], Column]) -> Check:
    return Check(
        unit=i.day_unit,
        values=[F.when(i.is_day, value).otherwise(F.lit(0))],
        bad=lambda u: bad(u.v[0]),
        error=i.is_day & i.not_iterable,
        ok=lambda s: s.bad == 0,
    )


@_check("check_max_outdoor_per_day")
def _max_outdoor_per_day(i, p):
    return _per_day(i, one(i.outdoor), lambda v: v > p.num("max_outdoor", 1))


@_check("check_min_activities_per_day")
def _min_activities_per_day(i, p):
    return _per_day(i, i.size, lambda v: v < p.num("min_per_day", 1))


@_check("check_max_activities_per_day")
def _max_activities_per_day(i, p):
    return _per_day(i, i.size, lambda v: v > p.num("max_per_day", 3))


@_check("check_max_duration_per_day")
def _max_duration_per_day(i, p):
    return _per_day(i, amount(i.resolved, i.duration_hours), lambda v: v > p.num("max_hours", 8.0))


@_check("check_budget_per_day")
def _budget_per_day(i, p):
    return _per_day(i, amount(i.resolved, i.cost_lei), lambda v: v > p.num("max_budget_per_day", 50))


@_check("check_min_total_activities")
def _min_total_activities(i, p):
    return Check(
        values=[F.when(i.is_day, i.size).otherwise(0)],
        error=i.is_day & i.not_iterable,
        ok=lambda s: s.v[0] >= p.num("min_total", 1),
    )


@_check("check_first_day_constraint")
def _first_day(i, p):
    at = i.key == "day1"
    limit = p.num("max_activities")
    return Check(
        values=[
            F.when(at, i.size).otherwise(0),
            one(at & i.outdoor),
            one(at & i.resolved & F.coalesce(i.indoor, F.lit(True))),
        ],
        error=at & i.not_iterable,
        ok=lambda s: (limit.isNull() | (s.v[0] <= limit))
        & (~p.flag("indoor_only") | (s.v[1] == 0))
        & (~p.flag("outdoor_only") | (s.v[2] == 0)),
    )


@_check("check_last_day_constraint")
def _last_day(i, p):
    at = i.key == F.concat(F.lit("day"), p.num("num_days", 2).cast("int").cast("string"))
    limit = p.num("max_cost")
    return Check(
        values=[amount(at & i.resolved, i.cost_lei), one(at & i.outdoor)],
        error=at & i.not_iterable,
        ok=lambda s: (~p.flag("must_have_outdoor") | (s.v[1] > 0)) & (limit.isNull() | (s.v[0] <= limit)),
    )


# --- schedule ----------------------------------------------------------------------------------------------
@_check("check_max_appointments_per_day")
def _max_appointments_per_day(i, p):
    return Check(
        unit=i.day,
        values=[one(i.first & i.present)],
        bad=lambda u: u.v[0] > p.num("max_per_day", 2),
        ok=lambda s: s.bad == 0,
    )


@_check("check_no_back_to_back")
def _no_back_to_back(i, p):
    return Check(
        unit=i.day,
        token=F.when(i.filled & i.slot.isNotNull(), tx.slot_label(i.slot)),
        bad=lambda u: u.tokens >= 2,
        ok=lambda s: s.bad == 0,
    )


@_check("check_max_total_appointments")
def _max_total_appointments(i, p):
    return Check(values=[one(i.first & i.filled)], ok=lambda s: s.v[0] <= p.num("max_total", 4))


@_check("check_min_total_appointments")
def _min_total_appointments(i, p):
    return Check(values=[one(i.first & i.filled)], ok=lambda s: s.v[0] >= p.num("min_total", 1))


@_check("check_spread_across_days")
def _spread_across_days(i, p):
    return Check(
        token=F.when(i.filled, i.day), ok=lambda s: s.tokens >= p.num("min_days_with_appointments", 2)
    )


@_check("check_priority_day_restriction")
def _priority_day_restriction(i, p):
    days = F.transform(p.names("forbidden_days"), F.lower)
    there = i.filled & F.arrays_overlap(tx.day_both_languages(i.day), days)
    return Check(
        values=[one(there & i.resolved & (i.priority == p.text("priority", "medium")))],
        error=there & i.not_text,
        ok=lambda s: (F.size(days) == 0) | (s.v[0] == 0),
    )


@_check("check_slot_type_restriction")
def _slot_type_restriction(i, p):
    word = F.lower(p.text("type_keyword", ""))
    allowed = F.transform(p.names("allowed_slots"), F.lower)
    here = F.array_contains(allowed, tx.slot_label_restricted(i.slot)) | F.array_contains(allowed, F.lower(i.slot))
    return Check(
        values=[one(i.filled & i.resolved & F.lower(i.name).contains(word) & i.slot.isNotNull() & ~here)],
        error=i.not_text,
        ok=lambda s: _blank(word) | (F.size(allowed) == 0) | (s.v[0] == 0),
    )


def _unhashable(i) -> Column:
    return i.truthy & (i.kind == "list")


@_check("check_keep_high_priority")
def _keep_high_priority(i, p):
    return Check(
        values=[one(i.is_entity_row & (i.priority == "high") & ~i.kept)],
        error=_unhashable(i),
        ok=lambda s: s.v[0] == 0,
    )


@_check("check_must_drop_lowest_priority")
def _must_drop_lowest_priority(i, p):
    level = F.coalesce(i.priority, F.lit("low"))
    kept, lost = i.is_entity_row & i.kept, i.is_entity_row & ~i.kept
    return Check(
        values=[
            one(kept & (level == "low")),
            one(kept & (level == "medium")),
            one(lost & (level == "medium")),
            one(lost & (level == "high")),
        ],
        error=_unhashable(i),
        ok=lambda s: ((s.v[0] == 0) | ((s.v[2] == 0) & (s.v[3] == 0))) & ((s.v[1] == 0) | (s.v[3] == 0)),
    )


# --- fact --------------------------------------------------------------------------------------------------
def answer_text(i) -> Column:
    return F.lower(tx.trim_space(F.when((i.key == "answer") & (i.kind == "string") & i.truthy, i.ref)))


@_check("check_answer_matches_context")
def _answer_matches_context(i, p):
    a = answer_text(i)
    facts = F.coalesce(i.facts, F.array().cast("array<string>"))
    found = F.exists(
        F.transform(facts, lambda f: F.lower(tx.trim_space(f))), lambda f: a.contains(f) | f.contains(a)
    )
    return Check(
        values=[one(a.isNotNull() & (found | (F.size(facts) == 0)))], ok=lambda s: s.v[0] > 0
    )


@_check("check_exact_answer_value")
def _exact_answer_value(i, p):
    a, e = answer_text(i), p.text("expected", "")
    wanted = F.lower(tx.trim_space(e))
    return Check(
        values=[one(a.contains(wanted) | wanted.contains(a))], ok=lambda s: _blank(e) | (s.v[0] > 0)
    )


@_check("check_no_hallucinated_facts")
def _no_hallucinated_facts(i, p):
    a = answer_text(i)
    found = F.exists(p.names("fact_db"), lambda f: F.lower(tx.trim_space(f)).contains(a))
    return Check(values=[one(a.isNotNull() & found)], ok=lambda s: s.v[0] > 0)


# --- recipe ------------------------------------------------------------------------------------------------
@_check("check_all_vegetarian")
def _all_vegetarian(i, p):
    return _none(i.hit & ~F.coalesce(i.vegetarian, F.lit(False)))


@_check("check_all_vegan")
def _all_vegan(i, p):
    return _none(i.hit & ~F.coalesce(i.vegan, F.lit(False)))


@_check("check_no_gluten")
def _no_gluten(i, p):
    return _none(i.hit & F.coalesce(i.contains_gluten, F.lit(False)))


@_check("check_no_lactose")
def _no_lactose(i, p):
    return _none(i.hit & F.coalesce(i.contains_lactose, F.lit(False)))


def _per_meal_day(i, value: Column, bad: Callable[[Column], Column]) -> Check:
    """Day totals over resolved dishes; a day without one has no total."""
    dish = i.meal_unit.isNotNull() & i.truthy & i.resolved
    return Check(
        unit=i.meal_unit,
        values=[amount(dish, value), one(dish)],
        bad=lambda u: (u.v[1] > 0) & bad(u.v[0]),
        error=i.meal_unit.isNotNull() & i.not_text,
        ok=lambda s: s.bad == 0,
    )


@_check("check_max_daily_calories")
def _max_daily_calories(i, p):
    return _per_meal_day(i, i.calories, lambda v: v > p.num("max_calories", 2000))


@_check("check_min_daily_calories")
def _min_daily_calories(i, p):
    return _per_meal_day(i, i.calories, lambda v: v < p.num("min_calories", 1200))


@_check("check_calorie_range")
def _calorie_range(i, p):
    return _per_meal_day(
        i, i.calories, lambda v: (v < p.num("min_calories", 1200)) | (v > p.num("max_calories", 2000))
    )


@_check("check_max_prep_time_per_day")
def _max_prep_time_per_day(i, p):
    return _per_meal_day(i, i.prep_time_min, lambda v: v > p.num("max_prep_time", 90))


def meal_name(slot: Column) -> Column:
    """Meal key in its Romanian form."""
    out = slot
    for ro, en in MEAL_NAMES.items():
        out = F.when(slot == en, ro).otherwise(out)
    return out


def _day_in_range(day: Column, num_days: Column) -> Column:
    n = F.regexp_extract(day, "^day([1-9][0-9]*)$", 1)
    return (n != "") & (n.try_cast("int") <= num_days)


@_check("check_all_meals_filled")
def _all_meals_filled(i, p):
    meals, days = p.names("meals", tuple(MEAL_NAMES)), p.num("num_days", 2)
    meal = meal_name(i.slot)
    wanted = i.truthy & _day_in_range(i.day, days) & F.array_contains(meals, meal)
    return Check(token=F.when(wanted, F.concat(i.day, meal)), ok=lambda s: s.tokens == days * F.size(meals))


def _meal_order(i, p, good: Callable[[Column, Column, Column], Column]) -> Check:
    """Compare the three meals of each day; the Romanian key wins over the English one."""
    days = p.num("num_days", 2)
    dish = i.truthy & i.resolved & _day_in_range(i.day, days)
    values = [amount(dish & (i.slot == k), i.calories) for ro_en in MEAL_NAMES.items() for k in ro_en]

    def fine(u: SimpleNamespace) -> Column:
        breakfast, lunch, dinner = [F.when(u.v[n] > 0, u.v[n]).otherwise(u.v[n + 1]) for n in (0, 2, 4)]
        return good(breakfast, lunch, dinner)

    return Check(
        unit=F.when(_day_in_range(i.day, days), i.day),
        values=values,
        good=fine,
        error=i.not_text & _day_in_range(i.day, days) & meal_name(i.slot).isin(*MEAL_NAMES),
        ok=lambda s: s.good == days,
    )


@_check("check_lunch_heaviest_meal")
def _lunch_heaviest_meal(i, p):
    return _meal_order(i, p, lambda b, lunch, d: (lunch > b) & (lunch > d))


@_check("check_dinner_lightest")
def _dinner_lightest(i, p):
    return _meal_order(i, p, lambda b, lunch, d: (d < b) & (d < lunch))


@_check("check_breakfast_variety")
def _breakfast_variety(i, p):
    at = i.breakfast & i.truthy
    return Check(
        values=[one(at)], token=F.when(at, i.final_id), error=at & i.not_text, ok=lambda s: s.v[0] == s.tokens
    )


@_check("check_max_high_calorie_meals")
def _max_high_calorie_meals(i, p):
    heavy = i.hit & (F.coalesce(i.calories, F.lit(0)) > p.num("calorie_threshold", 400))
    return Check(values=[one(heavy)], ok=lambda s: s.v[0] <= p.num("max_high_calorie", 2))


@_check("check_quick_breakfast")
def _quick_breakfast(i, p):
    at = i.breakfast & i.truthy
    slow = at & i.resolved & (F.coalesce(i.prep_time_min, F.lit(0)) > p.num("max_prep_time", 20))
    return Check(values=[one(slow)], error=at & i.not_text, ok=lambda s: s.v[0] == 0)


# --- structural goals --------------------------------------------------------------------------------------
@_check("check_days_non_empty")
def _days_non_empty(i, p):
    days = p.num("num_days", 2)
    filled = i.kind.isin("list", "string") & i.truthy & i.slot.isNull() & _day_in_range(i.key, days)
    return Check(token=F.when(filled, i.key), ok=lambda s: s.tokens == days)


@_check("check_no_duplicates")
def _no_duplicates(i, p):
    return Check(values=[one(i.planned)], token=F.when(i.planned, i.final_id), ok=lambda s: s.v[0] == s.tokens)


@_check("check_valid_entity_ids")
def _valid_entity_ids(i, p):
    return _none(i.planned & ~F.coalesce(F.array_contains(p.names("valid_ids"), i.final_id), F.lit(False)))


@_check("check_no_slot_overlaps")
def _no_slot_overlaps(i, p):
    return Check(ok=lambda s: F.lit(True))


CONSECUTIVE = "check_no_consecutive_same_type"


def consecutive_same_type(rows: DataFrame, group: list[str], max_days: int | None = None) -> DataFrame:
    """``group, satisfied``: no two consecutive days with the same non-empty set of types.

    Days count from day1 up to the first missing one; ``max_days`` (nine in the published scores) ends them earlier.  A
    day's set holds distinct types only.
    """
    i = item_view()
    number = F.regexp_extract("key", "^day([1-9][0-9]*)$", 1).try_cast("int")
    if max_days is not None:
        number = F.when(number <= max_days, number)
    days = (
        rows.withColumn("_day", number)
        .groupBy(*group, "_day")
        .agg(
            F.sort_array(F.collect_set(F.when(i.resolved, F.coalesce(i.type, F.lit(""))))).alias("_types"),
            F.max(one(i.not_iterable)).alias("_error"),
        )
    )
    plan = Window.partitionBy(*group).orderBy(F.col("_day").asc_nulls_last())
    run = days.withColumn("_run", F.row_number().over(plan) == F.col("_day")).withColumn(
        "_same", (F.lag("_types").over(plan) == F.col("_types")) & (F.size("_types") > 0)
    )
    return run.groupBy(*group).agg(
        (F.max(one(F.col("_run") & (F.col("_same") | (F.col("_error") == 1)))) == 0).alias("satisfied")
    )


# --- evaluation --------------------------------------------------------------------------------------------
def run_check(rows: DataFrame, keys: list[str], name: str, **params) -> DataFrame:
    """``keys, satisfied`` for one named check with given parameters.

    ``rows`` are item rows; a plan without items contributes one row with null item columns.
    """
    rows = with_item_columns(rows)
    if name == CONSECUTIVE:
        return consecutive_same_type(rows, keys)
    if name not in REGISTRY:
        raise ValueError(f"Unknown constraint function: {name}")
    check = REGISTRY[name](item_view(), LiteralParams(params))
    return _evaluate(rows, keys, [(None, check)]).select(*keys, "satisfied")


def run_literal_checks(rows: DataFrame, keys: list[str], specs: dict[str, dict]) -> DataFrame:
    """``keys`` and one boolean column per check, for checks whose parameters are the same for every plan.

    Checks are columns side by side, so item rows are neither multiplied nor is a parameter parsed again.  The items of a
    plan are brought together once; checks over the whole plan then take one aggregation, checks over a unit two, and
    none of them a further exchange.  For plans too large for one task use ``run_checks``, which adds up partial sums.
    """
    i = item_view()
    rows = with_item_columns(rows).repartition(*keys)
    by_unit: dict[str, list[tuple[str, Check]]] = {}
    for name, params in specs.items():
        check = REGISTRY[name](i, LiteralParams(params))
        by_unit.setdefault("" if check.unit is None else str(check.unit), []).append((name, check))
    out = None
    for unit, checks in by_unit.items():
        found = _side_by_side(rows, keys, checks, checks[0][1].unit if unit else None)
        out = found if out is None else out.join(found, keys)
    return out


def _side_by_side(rows: DataFrame, keys: list[str], checks: list[tuple[str, Check]], unit: Column | None) -> DataFrame:
    columns, merged, flags = {}, [], []
    for n, (_, check) in enumerate(checks):
        columns |= {f"_v{n}_{m}": value for m, value in enumerate(check.values)}
        columns[f"_e{n}"] = one(check.error) if check.error is not None else F.lit(0)
        if check.token is not None:
            columns[f"_t{n}"] = check.token
    prepared = rows.select(*keys, *([unit.alias("_unit")] if unit is not None else []), *[c.alias(x) for x, c in columns.items()])

    def totals(n: int) -> SimpleNamespace:
        tokens = F.col(f"_t{n}") if checks[n][1].token is not None else F.lit(0)
        return SimpleNamespace(v=[F.col(f"_v{n}_{m}") for m in range(len(checks[n][1].values))], tokens=tokens)

    for x in columns:
        add = {"_v": F.sum, "_e": F.max, "_t": F.count_distinct}[x[:2]]
        merged.append(add(x).alias(x))
    if unit is not None:
        per_unit = prepared.groupBy(*keys, "_unit").agg(*merged)
        inside = F.col("_unit").isNotNull()
        for n, (_, check) in enumerate(checks):
            for label, test in (("_b", check.bad), ("_g", check.good)):
                per_unit = per_unit.withColumn(f"{label}{n}", one(inside & test(totals(n))) if test else F.lit(0))
                flags.append(F.sum(f"{label}{n}").alias(f"{label}{n}"))
        again = [(F.max(x) if x[:2] == "_e" else F.sum(x)).alias(x) for x in columns]
        per_plan = per_unit.groupBy(*keys).agg(*again, *flags)
    else:
        per_plan = prepared.groupBy(*keys).agg(*merged)
    verdicts = []
    for n, (name, check) in enumerate(checks):
        s = totals(n)
        s.bad, s.good = (F.col(f"_b{n}"), F.col(f"_g{n}")) if unit is not None else (F.lit(0), F.lit(0))
        verdicts.append(((F.col(f"_e{n}") == 0) & F.coalesce(check.ok(s), F.lit(False))).alias(name))
    return per_plan.select(*keys, *verdicts)


def run_checks(rows: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """``keys, check_id, check_fn, satisfied, error`` for rows that pair every item with every check of its plan.

    ``rows`` carry ``check_id, check_fn`` and the ``unpacked`` parameters.  A name that is not registered is
    unsatisfied, with an error text.  ``names`` limits the generated expression to the checks the specification can hold.
    """
    rows = with_item_columns(rows)
    used = {n: REGISTRY[n] for n in REGISTRY if names is None or n in names}
    i = item_view()
    at_items = [(name, build(i, TypedParams())) for name, build in used.items()]
    at_totals = [(name, build(i, VariantParams("params"))) for name, build in used.items()]
    group = [*keys, "check_id", "check_fn"]
    # the verdict reads the parameters again, so they are grouped on as text
    ordinary = rows.where(F.col("check_fn") != CONSECUTIVE)
    named = _evaluate(ordinary, [*group, "params_json"], at_items, at_totals)
    known = F.col("check_fn").isin(*used)
    out = named.select(
        *group,
        F.when(known, F.col("satisfied")).otherwise(False).alias("satisfied"),
        F.when(~known, F.concat(F.lit("Unknown constraint function: "), F.col("check_fn"))).alias("error"),
    )
    if names is not None and CONSECUTIVE not in names:
        return out
    runs = consecutive_same_type(rows.where(F.col("check_fn") == CONSECUTIVE), group)
    return out.unionByName(runs.withColumn("error", F.lit(None).cast("string")))


def _pick(checks: list[tuple[str | None, Check]], get: Callable[[Check], Column | None], default: Column) -> Column:
    """One Column that takes each check's own expression, by ``check_fn``."""
    if len(checks) == 1 and checks[0][0] is None:
        own = get(checks[0][1])
        return default if own is None else own
    out = None
    for name, check in checks:
        own = get(check)
        if own is not None:
            match = F.col("check_fn") == name
            out = F.when(match, own) if out is None else out.when(match, own)
    return default if out is None else out.otherwise(default)


def _evaluate(
    rows: DataFrame,
    group: list[str],
    checks: list[tuple[str | None, Check]],
    at_totals: list[tuple[str | None, Check]] | None = None,
) -> DataFrame:
    """Sums and distinct tokens per unit, then per plan, then the verdict.

    ``at_totals`` are the same checks reading their parameters from the grouped text.
    """
    at_totals = at_totals or checks
    width = max([len(c.values) for _, c in checks] + [0])
    many = checks[0][0] is not None
    whole_plan = F.lit("")
    value = lambda n: _pick(checks, lambda c: c.values[n] if n < len(c.values) else None, F.lit(0))
    prepared = rows.select(
        *group,
        _pick(checks, lambda c: c.unit if c.unit is not None else whole_plan, whole_plan).alias("_unit"),
        *[value(n).alias(f"_v{n}") for n in range(width)],
        _pick(checks, lambda c: c.token, F.lit(None).cast("string")).alias("_token"),
        one(_pick(checks, lambda c: c.error, F.lit(False))).alias("_error"),
    )
    has_token = any(c.token is not None for _, c in checks)
    per_unit = prepared.groupBy(*group, "_unit").agg(
        *[F.sum(f"_v{n}").alias(f"_v{n}") for n in range(width)],
        (F.count_distinct("_token") if has_token else F.lit(0)).alias("_tokens"),
        F.max("_error").alias("_error"),
    )
    if many:
        per_unit = per_unit.withColumn("params", F.parse_json("params_json"))
    totals = SimpleNamespace(v=[F.col(f"_v{n}") for n in range(width)], tokens=F.col("_tokens"))
    in_unit = F.col("_unit").isNotNull()
    never = F.lit(False)
    flagged = per_unit.withColumn(
        "_bad", one(in_unit & _pick(at_totals, lambda c: c.bad(totals) if c.bad else None, never))
    ).withColumn("_good", one(in_unit & _pick(at_totals, lambda c: c.good(totals) if c.good else None, never)))
    per_plan = flagged.groupBy(*group).agg(
        *[F.sum(f"_v{n}").alias(f"_v{n}") for n in range(width)],
        F.sum("_tokens").alias("_tokens"),
        F.sum("_bad").alias("_bad"),
        F.sum("_good").alias("_good"),
        F.max("_error").alias("_error"),
    )
    if many:
        per_plan = per_plan.withColumn("params", F.parse_json("params_json"))
    totals.bad, totals.good = F.col("_bad"), F.col("_good")
    verdict = _pick(at_totals, lambda c: c.ok(totals), F.lit(False))
    return per_plan.withColumn("satisfied", (F.col("_error") == 0) & F.coalesce(verdict, F.lit(False)))


def describe_params(params: dict) -> Column:
    """A literal VARIANT for building check rows by hand."""
    return F.parse_json(F.lit(json.dumps(params, ensure_ascii=False)))
