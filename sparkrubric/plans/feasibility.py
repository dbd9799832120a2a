"""Does a plan exist that meets all constraints of an instance?

Each test works on one row: the candidates of an instance are a short array, and a fold keeps the set of reachable
states, merged after every step; menus without repeats are searched depth first instead.  Candidates that cannot matter are dropped first, so long candidate lists reduce to
a bounded one (``cheapest_per_class``).  Constraints are recognized by check name.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx

INFINITE = 1e18


def rule(constraints: Column, check: str) -> Column:
    """Parameters (VARIANT) of the first constraint with that check; null when absent."""
    return F.try_parse_json(F.get(F.filter(constraints, lambda c: c["check_fn"] == check), F.lit(0))["params"])


def has_rule(constraints: Column, check: str) -> Column:
    return F.exists(constraints, lambda c: c["check_fn"] == check)


def number(constraints: Column, check: str, name: str, default: float) -> Column:
    value = F.try_variant_get(rule(constraints, check), f"$.{name}", "double")
    return F.coalesce(value, F.lit(float(default)))


def flag(constraints: Column, check: str, name: str) -> Column:
    return F.coalesce(F.try_variant_get(rule(constraints, check), f"$.{name}", "boolean"), F.lit(False))


def texts(constraints: Column, check: str, name: str) -> Column:
    """That parameter of every constraint with the check."""
    mine = F.filter(constraints, lambda c: c["check_fn"] == check)
    return F.array_compact(
        F.transform(mine, lambda c: F.try_variant_get(F.try_parse_json(c["params"]), f"$.{name}", "string"))
    )


def bound(values: dict[str, Column], body) -> Column:
    """Evaluate ``values`` once and hand them to ``body`` by name, so folds do not repeat them per state."""
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    return tx.let(packed, lambda x: body(SimpleNamespace(**{n: x[n] for n in values})))


def _first_of_runs(states: Column, key) -> Column:
    """Sorted states reduced to the first of each run with equal key."""
    return tx.let(
        F.array_sort(states),
        lambda a: F.filter(a, lambda s, n: (n == 0) | (key(F.get(a, n - 1)) != key(s))),
    )


# --- travel --------------------------------------------------------------------------------------------------
def travel_feasible(candidates: Column, days: Column, constraints: Column) -> Column:
    """One distinct attraction per day under the constraints.

    ``candidates`` are structs with ``name, type, indoor, family_friendly, duration_hours, cost_lei``.  A state holds
    how many days are filled, whether the first and last day are, the named item, the set of types, and the least
    cost that reaches all this; costlier ways to the same state are dropped.
    """
    c = constraints
    rules = {
        "candidates": candidates,
        "days": days.cast("int"),
        "daily": number(c, "check_budget_per_day", "max_budget_per_day", INFINITE),
        "hours": number(c, "check_max_duration_per_day", "max_hours", INFINITE),
        "outdoor": number(c, "check_max_outdoor_per_day", "max_outdoor", INFINITE),
        "budget": F.least(
            number(c, "check_budget_limit", "max_budget", INFINITE),
            number(c, "check_max_total_cost", "max_cost", INFINITE),
        ),
        "family": has_rule(c, "check_all_family_friendly"),
        "excluded": texts(c, "check_must_exclude_type", "type_forbidden"),
        "needed": texts(c, "check_must_include_type", "type_required"),
        "named": F.transform(texts(c, "check_must_include_specific", "entity_name"), F.lower),
        "first_in": flag(c, "check_first_day_constraint", "indoor_only"),
        "last_out": flag(c, "check_last_day_constraint", "must_have_outdoor"),
        "min_types": number(c, "check_type_diversity", "min_types", 0),
    }
    return bound(rules, _travel_search)


def _travel_search(r: SimpleNamespace) -> Column:
    days, named = r.days, r.named
    usable = F.filter(
        r.candidates,
        lambda a: (~r.family | a["family_friendly"])
        & (a["cost_lei"].cast("double") <= r.daily)
        & (a["duration_hours"].cast("double") <= r.hours)
        & (a["indoor"] | (r.outdoor >= 1))
        & ~F.array_contains(r.excluded, a["type"]),
    )

    def state(n, first, last, names, types, cost):
        return F.struct(
            n.alias("n"), first.alias("first"), last.alias("last"), names.alias("names"), types.alias("types"),
            cost.alias("cost"),
        )

    none = F.array().cast("array<string>")
    start = F.array(state(F.lit(0), F.lit(False), F.lit(False), none, none, F.lit(0.0)))

    def key(s: Column) -> Column:
        return F.struct(s["n"], s["first"], s["last"], s["names"], s["types"])

    def extend(acc: Column, a: Column) -> Column:
        def use(s: Column, as_first: bool, as_last: bool) -> Column:
            lowered = F.lower(a["name"])
            names = F.when(
                F.array_contains(named, lowered), F.array_sort(F.array_union(s["names"], F.array(lowered)))
            ).otherwise(s["names"])
            return state(
                s["n"] + 1,
                F.lit(True) if as_first else s["first"],
                F.lit(True) if as_last else s["last"],
                names,
                F.array_sort(F.array_union(s["types"], F.array(a["type"]))),
                s["cost"] + a["cost_lei"].cast("double"),
            )

        room = lambda s: s["n"] < days
        fits_first = ~r.first_in | a["indoor"]
        fits_last = ~r.last_out | ~a["indoor"]
        inner = lambda s: (s["n"] - s["first"].cast("int") - s["last"].cast("int")) < days - 2
        grown = F.transform(
            acc,
            lambda s: F.array_compact(
                F.array(
                    s,
                    F.when(room(s) & ~s["first"] & fits_first & (days > 1), use(s, True, False)),
                    F.when(room(s) & ~s["last"] & fits_last & (days > 1), use(s, False, True)),
                    F.when((days == 1) & room(s) & fits_first & fits_last, use(s, True, True)),
                    F.when(room(s) & inner(s), use(s, False, False)),
                )
            ),
        )
        return _first_of_runs(F.flatten(grown), key)

    def accept(states: Column) -> Column:
        return F.exists(
            states,
            lambda s: (s["n"] == days)
            & (F.size(F.array_except(r.needed, s["types"])) == 0)
            & (F.size(F.array_except(named, s["names"])) == 0)
            & (F.size(s["types"]) >= r.min_types)
            & (s["cost"] <= r.budget),
        )

    return F.aggregate(usable, start, extend, accept)


def cheapest_per_class(
    candidates: DataFrame, group: list[str], classes: list[str], cost: str, order: list[str], keep: int
) -> DataFrame:
    """Drop candidates that cannot matter: within a class only the ``keep`` cheapest can be part of a best choice.

    The rank limit is applied before and after the shuffle, so a group with very many candidates stays small.
    """
    window = Window.partitionBy(*group, *classes).orderBy(cost, *order)
    return candidates.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= keep).drop("_rank")


# --- schedule ------------------------------------------------------------------------------------------------
def schedule_feasible(appointments: Column, days: Column, slots: Column, constraints: Column) -> Column:
    """A choice of appointments and free slots under the constraints.

    ``appointments`` are structs with ``name, priority``; ``days`` and ``slots`` are label arrays of any length.  Slots
    that every rule treats alike form a class, and so do days; a state holds how many slots of each class each day has
    used, days in sorted order, and how many appointments of each priority are kept.  Interchangeable choices fall
    together, so states grow with the kinds of days and not with the subsets of cells.
    """
    c = constraints
    restriction = rule(c, "check_priority_day_restriction")
    slot_rule = rule(c, "check_slot_type_restriction")
    high_rule = rule(c, "check_priority_slot_restriction")
    per_day = number(c, "check_max_appointments_per_day", "max_per_day", 2)

    def lowered(parameters: Column, name: str) -> Column:
        values = F.try_variant_get(parameters, f"$.{name}", "array<string>")
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), F.lower)

    rules = {
        "appointments": appointments,
        "days": F.transform(days, F.lower),
        "slots": F.transform(slots, F.lower),
        "cap": F.when(has_rule(c, "check_no_back_to_back"), F.least(per_day, F.lit(1.0))).otherwise(per_day),
        "max_total": number(c, "check_max_total_appointments", "max_total", INFINITE),
        "keep_high": has_rule(c, "check_keep_high_priority"),
        "drop_order": has_rule(c, "check_must_drop_lowest_priority"),
        "spread": number(c, "check_spread_across_days", "min_days_with_appointments", 1),
        "level": F.coalesce(F.try_variant_get(restriction, "$.priority", "string"), F.lit("medium")),
        "banned": lowered(restriction, "forbidden_days"),
        "word": F.lower(F.coalesce(F.try_variant_get(slot_rule, "$.type_keyword", "string"), F.lit(""))),
        "allowed": lowered(slot_rule, "allowed_slots"),
        "high_slots": lowered(high_rule, "required_slots"),
        "n_high": at_level(appointments, "high"),
        "n_medium": at_level(appointments, "medium"),
    }
    return F.when(F.size(appointments) == 0, True).otherwise(bound(rules, _schedule_classes))


def at_level(appointments: Column, level: str) -> Column:
    return F.size(F.filter(appointments, lambda a: F.coalesce(a["priority"], F.lit("low")) == level))


def _schedule_classes(r: SimpleNamespace) -> Column:
    """Slots by whether they suit high priorities (2) and the restricted word (1), days by whether they are banned."""

    def matches(slot: Column, wanted: Column) -> Column:
        return F.exists(wanted, lambda w: slot.contains(w) | w.contains(slot))

    def suits(slot: Column, wanted: Column) -> Column:
        return (F.size(wanted) == 0) | matches(slot, wanted)

    of_slot = F.transform(r.slots, lambda s: suits(s, r.high_slots).cast("int") * 2 + suits(s, r.allowed).cast("int"))
    values = {
        "sizes": F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.size(F.filter(of_slot, lambda x: x == k))),
        "start": F.array_sort(
            F.transform(
                r.days,
                lambda d: F.struct(
                    F.array_contains(r.banned, d).alias("banned"), F.array_repeat(F.lit(0), 4).alias("used")
                ),
            )
        ),
    }
    return bound(values, lambda x: _schedule_search(r, x))


def _schedule_search(r: SimpleNamespace, x: SimpleNamespace) -> Column:
    def added(day: Column) -> Column:
        return F.aggregate(day["used"], F.lit(0), lambda a, b: a + b)

    def state(days: Column, high: Column, medium: Column, low: Column) -> Column:
        return F.struct(days.alias("days"), high.alias("high"), medium.alias("medium"), low.alias("low"))

    def total(s: Column) -> Column:
        return s["high"] + s["medium"] + s["low"]

    def place(states: Column, a: Column) -> Column:
        priority = F.coalesce(a["priority"], F.lit("low"))
        special = (r.word != "") & F.lower(a["name"]).contains(r.word)
        # classes of slots that take this appointment
        kinds = F.filter(
            F.sequence(F.lit(0), F.lit(3)), lambda k: ((priority != "high") | (k >= 2)) & (~special | (k % 2 == 1))
        )
        one = lambda *levels: F.when(priority.isin(*levels), 1).otherwise(0)
        lowest = F.when(priority.isin("high", "medium"), 0).otherwise(1)

        def moved(s: Column, i: Column, k: Column) -> Column:
            def day(d: Column, j: Column) -> Column:
                used = F.transform(d["used"], lambda u, kk: F.when((j == i) & (kk == k), u + 1).otherwise(u))
                return F.struct(d["banned"].alias("banned"), used.alias("used"))

            days = F.array_sort(F.transform(s["days"], day))
            return state(days, s["high"] + one("high"), s["medium"] + one("medium"), s["low"] + lowest)

        def moves(s: Column) -> Column:
            days = s["days"]

            def open_day(i: Column) -> Column:
                first = (i == 0) | (F.get(days, i) != F.get(days, i - 1))  # of equal days one will do
                allowed = ~((priority == r.level) & F.get(days, i)["banned"])
                return first & allowed & (added(F.get(days, i)) < r.cap)

            places = F.filter(F.sequence(F.lit(0), F.size(days) - 1), open_day)
            free = lambda i: F.filter(kinds, lambda k: F.get(F.get(days, i)["used"], k) < F.get(x.sizes, k))
            return F.flatten(F.transform(places, lambda i: F.transform(free(i), lambda k: moved(s, i, k))))

        def grown(s: Column) -> Column:
            may = (total(s) < r.max_total) & (F.size(s["days"]) > 0)
            return F.concat(F.array(s), F.when(may, moves(s)).otherwise(F.slice(F.array(s), 1, 0)))

        return F.array_distinct(F.flatten(F.transform(states, grown)))

    def accept(states: Column) -> Column:
        def ok(s: Column) -> Column:
            all_high, all_medium = s["high"] == r.n_high, s["medium"] == r.n_medium
            ordered = all_high & ((s["low"] == 0) | all_medium)
            in_use = F.size(F.filter(s["days"], lambda d: added(d) > 0))
            enough = F.when(total(s) == 0, r.drop_order).otherwise(in_use >= r.spread)
            return (~r.keep_high | all_high) & (~r.drop_order | ordered) & enough

        return F.exists(states, ok)

    zero = F.lit(0)
    return F.aggregate(r.appointments, F.array(state(x.start, zero, zero, zero)), place, accept)


# --- recipe --------------------------------------------------------------------------------------------------
def recipe_feasible(df: DataFrame, dishes: Column, days: Column, constraints: Column, name: str = "feasible") -> DataFrame:
    """``df`` with a boolean ``name``: can each day have one dish per meal under the constraints?

    ``dishes`` are structs with ``meal, vegetarian, vegan, contains_gluten, contains_lactose, prep_time_min, calories``,
    meal being mic_dejun / pranz / cina.  Valid day menus are listed first.  Without a repeat rule the lightest menu
    serves every day.  With it, taking the lightest menu that shares no dish with those before is tried first; where that
    finds no plan, the listed menus go to ``plan_search``, a Python function that holds one instance at a time.  Rows that
    are settled before carry no menus there.
    """
    exists = plan_search()  # made here, so that it travels to the tasks by itself

    @F.pandas_udf("boolean")
    def searched(settled: pd.Series, menus: pd.Series, days: pd.Series, limit: pd.Series) -> pd.Series:
        rows = zip(settled, menus, days, limit, strict=True)
        return pd.Series([s if m is None else exists(m, int(d), h) for s, m, d, h in rows], dtype=object)

    # a column of its own: Spark can't hand nested lambdas to a Python function in one expression
    space = f"_{name}_space"
    listed = df.withColumn(space, recipe_space(dishes, days, constraints))
    parts = [F.col(space)[field] for field in ("settled", "menus", "days", "limit")]
    return listed.withColumn(name, searched(*parts)).drop(space)


def recipe_space(dishes: Column, days: Column, constraints: Column) -> Column:
    """``settled`` (does a plan exist; null if only a search can tell), ``menus`` to search, ``days``, ``limit``."""
    c = constraints
    rules = {
        "dishes": dishes,
        "days": days.cast("int"),
        "low": F.greatest(
            number(c, "check_min_daily_calories", "min_calories", 0),
            number(c, "check_calorie_range", "min_calories", 0),
        ),
        "high": F.least(
            number(c, "check_max_daily_calories", "max_calories", INFINITE),
            number(c, "check_calorie_range", "max_calories", INFINITE),
        ),
        "prep": number(c, "check_max_prep_time_per_day", "max_prep_time", INFINITE),
        "quick": number(c, "check_quick_breakfast", "max_prep_time", INFINITE),
        "heavy_limit": number(c, "check_max_high_calorie_meals", "max_high_calorie", INFINITE),
        "heavy_from": number(c, "check_max_high_calorie_meals", "calorie_threshold", 400),
        "lunch_rule": has_rule(c, "check_lunch_heaviest_meal"),
        "dinner_rule": has_rule(c, "check_dinner_lightest"),
        "no_repeat": has_rule(c, "check_no_duplicates"),
        "vegetarian": has_rule(c, "check_all_vegetarian"),
        "vegan": has_rule(c, "check_all_vegan"),
        "no_gluten": has_rule(c, "check_no_gluten"),
        "no_lactose": has_rule(c, "check_no_lactose"),
    }
    none = F.lit(None)
    empty = _verdict(F.lit(True), none, none, none)
    return F.when(F.size(dishes) == 0, empty).otherwise(bound(rules, _recipe_meals))


def _recipe_meals(r: SimpleNamespace) -> Column:
    valid = F.filter(
        r.dishes,
        lambda d: (~r.vegetarian | d["vegetarian"])
        & (~r.vegan | d["vegan"])
        & (~r.no_gluten | ~d["contains_gluten"])
        & (~r.no_lactose | ~d["contains_lactose"]),
    )
    numbered = F.transform(
        valid,
        lambda d, n: F.struct(
            d["meal"].alias("meal"),
            d["calories"].cast("double").alias("kcal"),
            d["prep_time_min"].cast("double").alias("prep"),
            n.alias("no"),
            (d["calories"].cast("double") > r.heavy_from).cast("int").alias("heavy"),
        ),
    )

    def by_meal(items: Column) -> Column:
        meal = lambda name: F.filter(items, lambda d: d["meal"] == name)
        values = {
            "b": F.filter(meal("mic_dejun"), lambda d: d["prep"] <= r.quick),
            "n": meal("pranz"),
            "d": meal("cina"),
        }
        return bound(values, lambda m: _recipe_menus(r, m))

    return tx.let(numbered, by_meal)


def _recipe_menus(r: SimpleNamespace, m: SimpleNamespace) -> Column:
    def day_ok(b: Column, n: Column, d: Column) -> Column:
        return (
            (b["kcal"] + n["kcal"] + d["kcal"]).between(r.low, r.high)
            & (b["prep"] + n["prep"] + d["prep"] <= r.prep)
            & (~r.lunch_rule | ((n["kcal"] > b["kcal"]) & (n["kcal"] > d["kcal"])))
            & (~r.dinner_rule | ((d["kcal"] < b["kcal"]) & (d["kcal"] < n["kcal"])))
        )

    def menu(b: Column, n: Column, d: Column) -> Column:
        return F.struct(
            (b["heavy"] + n["heavy"] + d["heavy"]).alias("heavy"),
            b["no"].alias("first"),
            F.array(n["no"], d["no"]).alias("others"),
        )

    def dinners(b: Column, n: Column) -> Column:
        return F.transform(F.filter(m.d, lambda d: day_ok(b, n, d)), lambda d: menu(b, n, d))

    values = {
        "menus": F.flatten(F.flatten(F.transform(m.b, lambda b: F.transform(m.n, lambda n: dinners(b, n))))),
        "enough": (F.size(m.b) >= r.days) & (F.size(m.n) >= r.days) & (F.size(m.d) >= r.days),
    }
    return bound(values, lambda x: _recipe_days(r, x))


def _recipe_days(r: SimpleNamespace, x: SimpleNamespace) -> Column:
    """``settled`` where a short argument decides, else the menus that ``plan_search`` is to choose from."""
    lightest = F.array_min(F.transform(x.menus, lambda v: v["heavy"]))
    repeated = (F.size(x.menus) > 0) & (lightest * r.days <= r.heavy_limit)
    none = F.array().cast("array<int>")

    def take(s: Column, v: Column) -> Column:
        fits = (s["n"] < r.days) & ~F.array_contains(s["used"], v["first"]) & ~F.arrays_overlap(s["used"], v["others"])
        chosen = F.struct(
            (s["n"] + 1).alias("n"),
            (s["heavy"] + v["heavy"]).alias("heavy"),
            F.concat(s["used"], F.array(v["first"]), v["others"]).alias("used"),
        )
        return F.when(fits, chosen).otherwise(s)

    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("heavy"), none.alias("used"))
    greedy = F.aggregate(F.array_sort(x.menus), first, take, lambda s: (s["n"] == r.days) & (s["heavy"] <= r.heavy_limit))
    settled = F.when(~x.enough, False).when(~r.no_repeat, F.coalesce(repeated, F.lit(False))).when(greedy, True)
    packed = F.transform(x.menus, lambda v: F.concat(F.array(v["heavy"], v["first"]), v["others"]))
    return tx.let(settled, lambda known: _verdict(known, F.when(known.isNull(), packed), r.days, r.heavy_limit))


def _verdict(settled: Column, menus: Column, days: Column, limit: Column) -> Column:
    return F.struct(
        settled.cast("boolean").alias("settled"),
        menus.cast("array<array<int>>").alias("menus"),
        days.cast("int").alias("days"),
        limit.cast("double").alias("limit"),
    )


def plan_search() -> Callable[[list, int, float], bool]:
    """A function ``(menus, days, limit)``: are there ``days`` menus without a common dish, with at most ``limit`` heavy
    dishes together?  A menu is ``(heavy, breakfast, lunch, dinner)``.

    Depth first over breakfasts.  A branch ends where some meal has too few dishes left in menus that are still open, or
    where the lightest menus of the dishes it needs are too heavy together; where the same lunches and dinners were used
    before with as much weight left; and where of dishes that fit into the same menus not the first free one is taken.
    """

    def exists(menus: list, days: int, limit: float) -> bool:
        menus = [tuple(int(v) for v in menu) for menu in menus]
        fits: dict[tuple[int, int], set] = {}
        for heavy, b, n, d in menus:
            fits.setdefault((2, n), set()).add((heavy, b, d))
            fits.setdefault((3, d), set()).add((heavy, b, n))
        bit, before, last = {}, {}, {}
        for place, dish in enumerate(sorted(fits)):
            kind = (dish[0], frozenset(fits[dish]))
            bit[dish], before[dish] = 1 << place, last.get(kind, 0)
            last[kind] = 1 << place
        groups: dict[int, list] = {}
        for heavy, b, n, d in sorted(menus):
            uses, after = bit[2, n] | bit[3, d], before[2, n] | before[3, d]
            groups.setdefault(b, []).append((heavy, b, n, d, uses, after))
        order = sorted(groups.values(), key=len)
        failed: dict[tuple[int, int], float] = {}  # by next breakfast and dishes used: the most weight left that failed

        def open_for(level: int, used: int, need: int, slack: float) -> list | None:
            """Open menus of this breakfast; null if no plan can follow."""
            live = [menu for group in order[level:] for menu in group if not menu[4] & used]
            for meal in (1, 2, 3):
                lightest: dict[int, int] = {}
                for menu in live:
                    lightest[menu[meal]] = min(menu[0], lightest.get(menu[meal], menu[0]))
                if len(lightest) < need or sum(sorted(lightest.values())[:need]) > slack:
                    return None
            return [menu for menu in order[level] if not menu[4] & used]

        def found(level: int, used: int, need: int, slack: float) -> bool:
            if not need:
                return True
            at = level
            while at <= len(order) - need and failed.get((at, used), -1.0) < slack:
                choices = open_for(at, used, need, slack)
                if choices is None:
                    break
                for heavy, _, _, _, uses, after in choices:
                    if after & ~used == 0 and heavy <= slack and found(at + 1, used | uses, need - 1, slack - heavy):
                        return True
                at += 1
            failed.update({(k, used): slack for k in range(level, at + 1)})
            return False

        return found(0, 0, days, float(limit))

    return exists
