"""Constraint texts of the generated worlds and the Columns that build constraint entries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrubric.plans.catalogs import rows

# --- fixed values ------------------------------------------------------------------------------------------
# key | id | check | text_ro | text_en ; {name} marks a value
TEXTS = """
must_monument | C_MUST_MONUMENT | check_must_include_type | Trebuie să incluzi cel puțin un monument istoric în întregul plan. | You must include at least one historic monument in the entire plan.
must_museum | C_MUST_MUSEUM | check_must_include_type | Trebuie să incluzi cel puțin un muzeu în întregul plan. | You must include at least one museum in the entire plan.
max_outdoor | C_MAX_OUTDOOR_PER_DAY | check_max_outdoor_per_day | Maxim {n} {word_ro} în aer liber pe zi. | At most {n} outdoor {word_en} per day.
family | C_FAMILY_FRIENDLY | check_all_family_friendly | Nu include activități care nu sunt potrivite pentru copii mici. | Do not include activities that are not suitable for small children.
budget | C_BUDGET | check_budget_limit | Bugetul total pentru activități nu trebuie să depășească {n} lei. | The total budget for activities must not exceed {n} lei.
no_duplicates | C_NO_DUPLICATES | check_no_duplicates | Nu vizita același loc de două ori. | Do not visit the same place twice.
max_duration | C_MAX_DURATION | check_max_duration_per_day | Timpul total de vizită pe zi nu trebuie să depășească {n} ore. | The total visit time per day must not exceed {n} hours.
diversity | C_TYPE_DIVERSITY | check_type_diversity | Planul trebuie să includă cel puțin 3 tipuri diferite de activități (ex: muzeu, parc, monument). | The plan must include at least 3 different types of activities (e.g., museum, park, monument).
exclude | C_EXCLUDE_TYPE | check_must_exclude_type | Nu include {type_ro} în plan. | Do not include {type_en} in the plan.
hard_monument | C_MUST_MONUMENT | check_must_include_type | Trebuie să incluzi cel puțin un monument istoric în plan. | You must include at least one historic monument.
hard_museum | C_MUST_MUSEUM | check_must_include_type | Trebuie să incluzi cel puțin un muzeu în plan. | You must include at least one museum.
hard_budget | C_BUDGET_TOTAL | check_budget_limit | Bugetul total nu trebuie să depășească {n} lei. | Total budget must not exceed {n} lei.
hard_no_dup | C_NO_DUP | check_no_duplicates | Nu vizita același loc de două ori. | Do not visit the same place twice.
hard_family | C_FAMILY | check_all_family_friendly | Toate activitățile trebuie să fie potrivite pentru copii. | All activities must be suitable for children.
hard_outdoor | C_MAX_OUTDOOR | check_max_outdoor_per_day | Maxim 1 activitate în aer liber pe zi. | At most 1 outdoor activity per day.
hard_diversity | C_DIVERSITY | check_type_diversity | Planul trebuie să includă cel puțin 3 tipuri diferite de activități. | The plan must include at least 3 different activity types.
first_day | C_FIRST_DAY | check_first_day_constraint | Prima zi trebuie să conțină doar activități de interior. | The first day must contain only indoor activities.
last_day | C_LAST_DAY | check_last_day_constraint | Ultima zi trebuie să includă cel puțin o activitate în aer liber. | The last day must include at least one outdoor activity.
must_specific | C_MUST_SPECIFIC | check_must_include_specific | Trebuie să vizitezi "{name}". | You must visit "{name_en}".
max_per_day | C_MAX_PER_DAY | check_max_appointments_per_day | Maxim {n} programări pe zi. | At most {n} appointments per day.
keep_high | C_KEEP_HIGH_PRIORITY | check_keep_high_priority | Trebuie să păstrezi toate programările cu prioritate înaltă. | You must keep all high-priority appointments.
no_back_to_back | C_NO_BACK_TO_BACK | check_no_back_to_back | Nu programa două întâlniri în aceeași zi (nu poți avea atât dimineață cât și după-amiază ocupate). | Do not schedule two appointments on the same day (you cannot have both morning and afternoon occupied).
max_total | C_MAX_TOTAL | check_max_total_appointments | Poți avea maxim {n} programări în total pe săptămână. | You can have at most {n} appointments total for the week.
medium_day | C_PRIORITY_DAY_RESTRICTION | check_priority_day_restriction | Programările cu prioritate medie nu pot fi programate {day_ro}. | Medium priority appointments cannot be scheduled on {day_en}.
hard_keep_high | C_KEEP_HIGH | check_keep_high_priority | Trebuie să păstrezi toate programările cu prioritate înaltă. | You must keep all high-priority appointments.
hard_max_total | C_MAX_TOTAL | check_max_total_appointments | Poți programa maxim {n} întâlniri în total. | You can schedule at most {n} appointments total.
drop_order | C_DROP_ORDER | check_must_drop_lowest_priority | Dacă trebuie să renunți la programări, renunță mai întâi la cele cu prioritate joasă. | If you must drop appointments, drop low priority ones first.
spread | C_SPREAD | check_spread_across_days | Programările trebuie distribuite în cel puțin {n} zile diferite. | Appointments must be spread across at least {n} different days.
medical_morning | C_MEDICAL_MORNING | check_slot_type_restriction | Controalele medicale trebuie programate dimineața. | Medical checkups must be scheduled in the morning.
hard_medium_day | C_MED_RESTRICT | check_priority_day_restriction | Programările cu prioritate medie nu pot fi în {day_ro}. | Medium priority appointments cannot be on {day_en}.
high_morning | C_HIGH_MORNING | check_priority_slot_restriction | Programările cu prioritate înaltă trebuie să fie dimineața. | High priority appointments must be in the morning.
from_context | C_ANSWER_FROM_CONTEXT | check_answer_matches_context | Răspunde DOAR pe baza informațiilor din contextul dat, nu din cunoștințele tale generale. | Answer ONLY based on the information in the given context, not from your general knowledge.
hard_from_context | C_ANSWER_FROM_CONTEXT | check_answer_matches_context | Răspunde DOAR pe baza informațiilor din contextul dat, chiar dacă par incorecte sau diferite de cunoștințele tale. | Answer ONLY based on the given context, even if it seems incorrect or different from your knowledge.
exact_value | C_EXACT_VALUE | check_exact_answer_value | Răspunsul trebuie să conțină valoarea exactă din context, fără reformulări. | The answer must contain the exact value from the context, without rephrasing.
vegetarian | C_DIET | check_all_vegetarian | Toate preparatele trebuie să fie vegetariene. | All dishes must be vegetarian.
no_gluten | C_DIET | check_no_gluten | Persoana are intoleranță la gluten - evită preparatele cu gluten. | The person has gluten intolerance - avoid dishes with gluten.
no_lactose | C_DIET | check_no_lactose | Persoana are intoleranță la lactoză - evită preparatele cu lactoză. | The person has lactose intolerance - avoid dishes with lactose.
max_calories | C_MAX_CALORIES | check_max_daily_calories | Totalul caloriilor pe zi nu trebuie să depășească {n} kcal. | The total daily calories must not exceed {n} kcal.
variety | C_VARIETY | check_no_duplicates | Nu repeta același preparat în meniu. | Do not repeat the same dish in the menu.
max_prep | C_MAX_PREP_TIME | check_max_prep_time_per_day | Timpul total de preparare pe zi nu trebuie să depășească {n} de minute. | The total preparation time per day must not exceed {n} minutes.
lunch | C_LUNCH_HEAVIEST | check_lunch_heaviest_meal | Prânzul trebuie să fie masa principală - să aibă mai multe calorii decât micul dejun și cina. | Lunch must be the main meal - it should have more calories than breakfast and dinner.
vegan | C_VEGAN | check_all_vegan | Toate preparatele trebuie să fie vegane (fără produse de origine animală). | All dishes must be vegan (no animal products).
hard_vegetarian | C_DIET_0 | check_all_vegetarian | Toate preparatele trebuie să fie vegetariene. | All dishes must be vegetarian.
hard_no_gluten | C_DIET_0 | check_no_gluten | Evită preparatele cu gluten. | Avoid dishes with gluten.
hard_no_lactose | C_DIET_0 | check_no_lactose | Evită preparatele cu lactoză. | Avoid dishes with lactose.
hard_dish_no_dup | C_NO_DUP | check_no_duplicates | Nu repeta același preparat în meniu. | Do not repeat the same dish.
hard_calories | C_MAX_CALORIES | check_max_daily_calories | Caloriile zilnice nu trebuie să depășească {n} kcal. | Daily calories must not exceed {n} kcal.
hard_prep | C_PREP_TIME | check_max_prep_time_per_day | Timpul total de preparare pe zi nu trebuie să depășească {n} minute. | Total prep time per day must not exceed {n} minutes.
hard_lunch | C_LUNCH_HEAVY | check_lunch_heaviest_meal | Prânzul trebuie să fie masa principală (mai multe calorii decât micul dejun și cina). | Lunch must be the main meal (more calories than breakfast and dinner).
dinner_light | C_DINNER_LIGHT | check_dinner_lightest | Cina trebuie să fie masa cea mai ușoară (mai puține calorii decât micul dejun și prânzul). | Dinner must be the lightest meal (fewer calories than breakfast and lunch).
quick_breakfast | C_QUICK_BREAKFAST | check_quick_breakfast | Micul dejun trebuie să poată fi preparat în maxim {n} minute. | Breakfast must be preparable in at most {n} minutes.
"""

# key | id | check | text
GOALS = """
fill_days | G_FILL_DAYS | check_days_non_empty | Each day must have at least one activity
valid_ids | G_VALID_IDS | check_valid_entity_ids | All referenced IDs must exist in the world
hard_valid_ids | G_VALID_IDS | check_valid_entity_ids | All referenced IDs must exist
no_overlaps | G_NO_OVERLAPS | check_no_slot_overlaps | No slot can have more than one appointment
hard_no_overlaps | G_NO_OVERLAPS | check_no_slot_overlaps | No slot overlaps
hard_schedule_ids | G_VALID_IDS | check_valid_entity_ids | All IDs valid
no_hallucination | G_NO_HALLUCINATION | check_no_hallucinated_facts | All provided answers must match the fact database
hard_no_hallucination | G_NO_HALLUCINATION | check_no_hallucinated_facts | Answer must match fact database
meals_filled | G_ALL_MEALS_FILLED | check_all_meals_filled | Each meal slot must have a dish
valid_dishes | G_VALID_DISHES | check_valid_entity_ids | All referenced dishes must exist in the menu
hard_meals | G_ALL_MEALS | check_all_meals_filled | All meal slots filled
hard_dishes | G_VALID_DISHES | check_valid_entity_ids | All dishes valid
"""

TYPE_NAMES = """
monument | monumente | monuments
parc | parcuri | parks
muzeu | muzee | museums
sport | activități sportive | sports activities
transport | transport turistic | tourist transport
piață | piețe | squares
plajă | plaje | beaches
"""
# --- end of fixed values -----------------------------------------------------------------------------------

_TEXTS = {r[0]: r[1:] for r in rows(TEXTS)}
_GOALS = {r[0]: r[1:] for r in rows(GOALS)}


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with ``{name}`` replaced; doubled braces are literal ones."""
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{[a-z_]+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{[a-z_]+\}", piece):
            parts.append(values[piece[1:-1]].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _json(params: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in params.items()])) if params else F.lit("{}")


def constraint(
    key: str, params: dict[str, Column] | None = None, values: dict[str, Column] | None = None, ident: Column | None = None
) -> Column:
    """Struct of an instruction constraint; parameters stay JSON text until the instance is assembled."""
    name, check, ro, en = _TEXTS[key]
    return F.struct(
        (F.lit(name) if ident is None else ident).alias("id"),
        F.lit("instruction").alias("type"),
        fill(ro, values or {}).alias("description_ro"),
        fill(en, values or {}).alias("description_en"),
        F.lit(check).alias("check_fn"),
        _json(params or {}).alias("params"),
    )


def goal(key: str, params: dict[str, Column]) -> Column:
    name, check, text = _GOALS[key]
    return F.struct(
        F.lit(name).alias("id"),
        F.lit("structural").alias("type"),
        F.lit(text).alias("description"),
        F.lit(check).alias("check_fn"),
        _json(params).alias("params"),
    )


def listed(*entries: tuple[Column | None, Column]) -> Column:
    """Array of the entries whose condition holds (no condition: always)."""
    return F.array_compact(F.array(*[e if c is None else F.when(c, e) for c, e in entries]))


def type_names(kind: Column) -> dict[str, Column]:
    ro, en = kind, kind
    for name, plural_ro, plural_en in rows(TYPE_NAMES):
        ro = F.when(kind == name, plural_ro).otherwise(ro)
        en = F.when(kind == name, plural_en).otherwise(en)
    return {"type_ro": ro, "type_en": en}
