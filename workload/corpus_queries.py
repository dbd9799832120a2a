"""Queries that build worlds from order seeds and test feasibility, and forms of entity names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrubric.functions import morphology as mo
from sparkrubric.functions import text as tx
from sparkrubric.plans import feasibility as fe
from sparkrubric.plans import worlds as wd
from workload.base import Registry, planted, planted_sql, quote, spread, table, words_sql

reg = Registry()


# --- worlds, one per order ---------------------------------------------------------------------------------------
def order_seeds(spark, sf):
    level = (
        F.when(F.col("o_orderpriority").rlike("^[12]"), "hard")
        .when(F.col("o_orderpriority").startswith("3"), "medium")
        .otherwise("easy")
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("instance_id"),
        F.col("o_orderkey").alias("seed"),
        level.alias("difficulty"),
    )


def _register(world: str, hard: bool) -> None:
    @reg.add(f"generate_{'hard_' if hard else ''}{world}")
    def _(spark, sf):
        made = wd.WORLDS[world](order_seeds(spark, sf), hard)
        return made.select(
            "instance_id",
            "difficulty",
            F.size("entities").alias("entities"),
            F.size("constraints").alias("constraints"),
            F.md5("payload").alias("payload"),
            F.char_length("prompt_ro").alias("prompt_ro_chars"),
            F.char_length("prompt_en").alias("prompt_en_chars"),
        )


for _world in wd.WORLDS:
    for _hard in (False, True):
        _register(_world, _hard)


# the draws behind a world, repeated in SQL: day count, appointment count and first priorities of a schedule
def _unit_sql(label: str) -> str:
    return f"(('0x' || left(md5(o_orderkey || ':{label}'), 8))::BIGINT / 4294967296.0)"


_PRIO = "['high','medium','low'][1 + floor(%s * 3)::INT]"


@reg.add(
    "schedule_draws",
    f"""SELECT 'order_' || o_orderkey AS instance_id,
               (3 + floor({_unit_sql('appointments')} * 3))::INT AS appointments,
               CASE WHEN o_orderpriority LIKE '4%' OR o_orderpriority LIKE '5%' THEN 2
                    ELSE [2, 3][1 + floor({_unit_sql('days')} * 2)::INT] END::INT AS num_days,
               {_PRIO % _unit_sql('priority:0')} AS first_priority, {_PRIO % _unit_sql('priority:1')} AS second_priority
        FROM orders""",
)
def _(spark, sf):
    payload = F.try_parse_json("payload")
    made = wd.schedule_worlds(order_seeds(spark, sf)).select("instance_id", payload.alias("p"))
    items = F.try_variant_get("p", "$.appointments", "array<struct<priority string>>")
    return made.select(
        "instance_id",
        F.size(items).alias("appointments"),
        F.size(F.try_variant_get("p", "$.days_ro", "array<string>")).alias("num_days"),
        items[0]["priority"].alias("first_priority"),
        items[1]["priority"].alias("second_priority"),
    )


# --- feasibility over order lines ----------------------------------------------------------------------------------
def _rules(**checks: str):
    """Constraint array from check name and JSON parameters."""
    return F.array(*[F.struct(F.lit(f"check_{n}").alias("check_fn"), F.lit(p).alias("params")) for n, p in checks.items()])


@reg.add(
    "feasible_travel",
    """WITH c AS (SELECT DISTINCT l_orderkey AS o, p_partkey AS k, p_type AS t, p_size % 2 = 0 AS i,
                         p_retailprice::DECIMAL(18,2) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey),
       ok AS (SELECT DISTINCT a.o FROM c a JOIN c b ON a.o = b.o AND a.k <> b.k
              JOIN c d ON d.o = a.o AND d.k <> a.k AND d.k <> b.k
              WHERE a.i AND NOT d.i AND a.cost + b.cost + d.cost <= 3600
                AND len(list_distinct([a.t, b.t, d.t])) >= 2)
       SELECT o_orderkey, o IS NOT NULL AS feasible FROM orders LEFT JOIN ok ON o = o_orderkey""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    options = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "o_orderkey",
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
        (F.col("p_size") % 2 == 0).alias("indoor"),
        F.lit(True).alias("family_friendly"),
        F.lit(1.0).alias("duration_hours"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("cost_lei"),
    )
    fields = ["name", "type", "indoor", "family_friendly", "duration_hours", "cost_lei"]
    pools = options.groupBy("o_orderkey").agg(F.collect_list(F.struct(*fields)).alias("pool"))
    rules = _rules(
        budget_limit='{"max_budget": 3600}',
        first_day_constraint='{"indoor_only": true}',
        last_day_constraint='{"must_have_outdoor": true}',
        type_diversity='{"min_types": 2}',
    )
    orders = table(spark, sf, "orders").select("o_orderkey")
    tested = pools.select("o_orderkey", fe.travel_feasible(F.col("pool"), F.lit(3), rules).alias("feasible"))
    return orders.join(tested, "o_orderkey", "left").na.fill(False, ["feasible"])


def order_meetings(spark, sf):
    """``o_orderkey, meetings``: one appointment per order line, its priority from the part's size."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low")]), (F.col("p_size") % 3 + 1).cast("int"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), level.alias("priority"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(part, "l_partkey")
    meeting = F.struct(F.lit("m").alias("name"), "priority")
    return lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(meeting)).alias("meetings"))


def _labels(*names: str):
    return F.array(*[F.lit(n) for n in names])


def _for_all_orders(spark, sf, tested):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.join(tested, "o_orderkey", "left").na.fill(True, ["feasible"])


def _each_problem_once(spark, sf, feasible):
    """Many orders ask the same: each set of appointments is tested once."""
    meetings = order_meetings(spark, sf)
    tested = meetings.select("meetings").distinct().select("meetings", feasible.alias("feasible"))
    return _for_all_orders(spark, sf, meetings.join(tested, "meetings").select("o_orderkey", "feasible"))


@reg.add(
    "feasible_schedule",
    """SELECT o_orderkey, n = 0 OR (h <= 3 AND (h >= 2 OR (h = 1 AND n >= 2) OR (h = 0 AND n >= 2 AND l >= 1))) AS feasible
       FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (WHERE p_size % 3 = 0) AS h,
                    count(*) FILTER (WHERE p_size % 3 = 2) AS l
             FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)""",
)
def _(spark, sf):
    rules = _rules(
        keep_high_priority="{}",
        max_total_appointments='{"max_total": 3}',
        spread_across_days='{"min_days_with_appointments": 2}',
        priority_day_restriction='{"priority": "medium", "forbidden_days": ["marți"]}',
    )
    days, slots = _labels("Luni", "Marți"), _labels("dimineață", "după-amiază")
    return _each_problem_once(spark, sf, fe.schedule_feasible(F.col("meetings"), days, slots, rules))


# thirteen days of two slots, two appointments at most; high priorities fit on the last day only
@reg.add(
    "feasible_schedule_wide",
    """SELECT o_orderkey, n = 0 OR h <= 2 AS feasible
       FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (WHERE p_size % 3 = 0) AS h
             FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)""",
)
def _(spark, sf):
    names = [f"ziua {n}" for n in range(1, 14)]
    banned = ", ".join(f'"{n}"' for n in names[:-1])
    rules = _rules(
        keep_high_priority="{}",
        max_total_appointments='{"max_total": 2}',
        priority_day_restriction=f'{{"priority": "high", "forbidden_days": [{banned}]}}',
    )
    return _each_problem_once(
        spark, sf, fe.schedule_feasible(F.col("meetings"), _labels(*names), _labels("dimineață", "seara"), rules)
    )


def dish(size):
    """A dish of a part's size: its preparation time, and twenty times as many calories."""
    return F.struct(
        "meal",
        *[F.lit(v).alias(n) for n, v in {"vegetarian": True, "vegan": True, "contains_gluten": False,
                                         "contains_lactose": False}.items()],
        F.col(size).alias("prep_time_min"),
        (F.col(size) * 20).alias("calories"),
    )


def line_dishes(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    meal = F.when(F.col("l_returnflag") == "A", "mic_dejun").when(F.col("l_returnflag") == "N", "pranz")
    lines = table(spark, sf, "lineitem").join(part, "l_partkey")
    return lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", meal.otherwise("cina").alias("meal"), "p_size")


@reg.add(
    "feasible_recipe",
    """WITH c AS (SELECT DISTINCT l_orderkey AS o, l_returnflag AS f, p_size AS s FROM lineitem JOIN part ON l_partkey = p_partkey),
       ok AS (SELECT DISTINCT a.o FROM c a JOIN c n ON n.o = a.o JOIN c r ON r.o = a.o
              WHERE a.f = 'A' AND n.f = 'N' AND r.f = 'R' AND (a.s + n.s + r.s) * 20 BETWEEN 600 AND 2000
                AND n.s > a.s AND n.s > r.s AND a.s + n.s + r.s <= 90)
       SELECT o_orderkey, ok.o IS NOT NULL OR NOT EXISTS (SELECT 1 FROM c WHERE c.o = o_orderkey) AS feasible
       FROM orders LEFT JOIN ok ON ok.o = o_orderkey""",
)
def _(spark, sf):
    rules = _rules(
        calorie_range='{"min_calories": 600, "max_calories": 2000}',
        max_prep_time_per_day='{"max_prep_time": 90}',
        lunch_heaviest_meal="{}",
    )
    menus = line_dishes(spark, sf).groupBy("o_orderkey").agg(F.collect_list(dish("p_size")).alias("dishes"))
    tested = fe.recipe_feasible(menus, F.col("dishes"), F.lit(1), rules)
    return _for_all_orders(spark, sf, tested.select("o_orderkey", "feasible"))


# two days of three different dishes each, out of all that a customer has ordered (often more than 56); light enough
# menus exist if the two lightest dishes of each meal can be paired up
@reg.add(
    "feasible_recipe_wide",
    """WITH c AS (SELECT DISTINCT o_custkey AS k, l_returnflag AS f, l_partkey AS p, p_size AS s FROM orders
                  JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
       two AS (SELECT k, f, min(s) AS a, CASE WHEN count(*) > 1 THEN list_sort(list(s))[2] END AS b FROM c GROUP BY k, f),
       m AS (SELECT k, max(a) FILTER (WHERE f = 'A') AS a1, max(b) FILTER (WHERE f = 'A') AS a2,
                    max(a) FILTER (WHERE f = 'N') AS n1, max(b) FILTER (WHERE f = 'N') AS n2,
                    max(a) FILTER (WHERE f = 'R') AS r1, max(b) FILTER (WHERE f = 'R') AS r2 FROM two GROUP BY k)
       SELECT k AS o_custkey, coalesce(least(
           CASE WHEN a2 + n2 + r2 IS NOT NULL THEN greatest(a1 + n1 + r1, a2 + n2 + r2) END,
           CASE WHEN a2 + n2 + r2 IS NOT NULL THEN greatest(a1 + n1 + r2, a2 + n2 + r1) END,
           CASE WHEN a2 + n2 + r2 IS NOT NULL THEN greatest(a1 + n2 + r1, a2 + n1 + r2) END,
           CASE WHEN a2 + n2 + r2 IS NOT NULL THEN greatest(a1 + n2 + r2, a2 + n1 + r1) END) <= 30, false) AS feasible
       FROM m""",
)
def _(spark, sf):
    rules = _rules(no_duplicates="{}", max_daily_calories='{"max_calories": 600}')
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = line_dishes(spark, sf).join(orders, "o_orderkey").select("o_custkey", "l_partkey", "meal", "p_size").distinct()
    menus = lines.groupBy("o_custkey").agg(F.collect_list(dish("p_size")).alias("dishes"))
    return fe.recipe_feasible(menus, F.col("dishes"), F.lit(2), rules).select("o_custkey", "feasible")


# --- inflected forms ---------------------------------------------------------------------------------------------------
def _forms_sql(word: str, rules: list[mo.Rule]) -> str:
    """CASE over the rule table: list of forms for a word."""
    out = "CASE "
    for pattern, drop, suffixes in rules:
        stem = f"left({word}, length({word}) - {drop})" if drop else word
        forms = "[" + ", ".join(f"{stem} || {quote(s)}" for s in suffixes.split()) + "]"
        out += f"WHEN regexp_matches({word}, {quote(pattern or '.*')}) THEN {forms} "
    return out + "END"


@reg.add(
    "word_forms",
    f"""SELECT w AS word, md5(array_to_string(list_sort(list_distinct(list_append({_forms_sql('w', mo.WORD_RULES)}, w))), ' '))
          AS forms FROM (SELECT DISTINCT unnest({words_sql(planted_sql())}) AS w FROM documents) WHERE length(w) >= 2""",
)
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.array_distinct(tx.tokenize_words(planted("text")))).alias("word"))
    forms = F.array_join(F.array_sort(mo.word_forms(F.col("word"))), " ")
    return words.where("char_length(word) >= 2").distinct().select("word", F.md5(forms).alias("forms"))


@reg.add(
    "article_forms",
    f"""SELECT w AS word, md5(array_to_string(list_sort(list_distinct(list_append({_forms_sql('w', mo.ARTICLE_RULES)}, w))), ' '))
          AS forms FROM (SELECT DISTINCT unnest({words_sql(planted_sql())}) AS w FROM documents) WHERE length(w) >= 3""",
)
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.array_distinct(tx.tokenize_words(planted("text")))).alias("word"))
    forms = F.array_join(F.array_sort(mo.article_forms(F.col("word"))), " ")
    return words.where("char_length(word) >= 3").distinct().select("word", F.md5(forms).alias("forms"))


@reg.add(
    "phrase_forms",
    f"""SELECT p_partkey, array_to_string(list_sort(list_transform({_forms_sql('split_part(n, chr(32), 2)', mo.PHRASE_RULES)},
               lambda f: split_part(n, ' ', 1) || ' ' || f)), ',') AS forms
        FROM (SELECT p_partkey, p_name || ['', 'ul', 'a', 'e', 'i'][1 + p_partkey % 5] AS n FROM part)""",
)
def _(spark, sf):
    endings = F.array(*[F.lit(e) for e in ("", "ul", "a", "e", "i")])
    name = F.concat("p_name", F.get(endings, (F.col("p_partkey") % 5).cast("int")))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.array_sort(mo.phrase_forms(name)), ",").alias("forms")
    )


# a part "blue bolt" of brand "Brand#7" is searched for as "bluea boltea" and "brand#7": the endings that words in -a, in
# -ea and in a digit take, written down per kind of form
_SEARCH_FORMS_SQL = """
    WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y, lower(p_brand) AS b FROM part),
    shared AS (
        SELECT *, x || 'a ' || y || 'ea' AS t,
            [x || 'ei ' || y || 'ee', x || 'ei ' || replace(y || 'ee', 'ea', 'e'), x || 'ei ' || y || 'ea'] AS coordinated FROM n
    )
    SELECT p_partkey,
        array_to_string(list_sort(list_distinct([t, b, x || 'a ' || y || 'eei'] || coordinated
            || list_transform(['a', 'e', 'elor', 'ele', 'ei', 'ii'], lambda s: x || s || ' ' || y || 'ea')
            || list_transform(['a', 'e', 'elor', 'ele', 'ei', 'ii'], lambda s: x || 'a ' || y || 'e' || s)
            || list_transform(['ul', 'ului', 'ui', 'i', 'ii', 'ilor', 'uri', 'urile', 'urilor'], lambda s: b || s))), '|') AS forms,
        array_to_string(list_sort(list_distinct([t, b, x || 'a', y || 'ea', 'brand'] || coordinated
            || list_transform(['aua', 'ei', 'ele', 'elor'], lambda s: x || s || ' ' || y || 'ea')
            || list_transform(['aua', 'ei', 'ele', 'elor'], lambda s: x || 'a ' || y || 'e' || s)
            || list_transform(['ul', 'lui', 'ului', 'ii', 'ilor', 'urile', 'urilor', 'ele', 'elor'], lambda s: b || s))), '|') AS articulated
    FROM shared"""


@reg.add("search_forms", _SEARCH_FORMS_SQL)
def _(spark, sf):
    names = F.array(F.concat(F.split("p_name", " ")[0], F.lit("a "), F.split("p_name", " ")[1], F.lit("ea")), "p_brand")
    return spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")).select(
        "p_partkey",
        F.array_join(F.array_sort(mo.search_forms(names)), "|").alias("forms"),
        F.array_join(F.array_sort(mo.search_forms_articulated(names)), "|").alias("articulated"),
    )
