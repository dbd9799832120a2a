"""Batch evaluation end to end: an instance and an output of one of the four worlds for every document.

The explanation is the document's text.  The first entity is named by the text's first word, so the text mentions it, and
the second by words that no text holds; so all scores follow from tables written down below.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.operators import entities as en
from sparkrubric.operators import reports as rp
from sparkrubric.operators import scoring as sc
from sparkrubric.sources import tables as tb
from sparkrubric.sources.lineage import materialize
from workload.base import Registry, documents, quote, r6, trim_sql
from workload.text_queries import DOCS, report_sql

reg = Registry()

NEVER = "Zxqwk Vbnmk"
FIRST = "@first@"
WORLDS = ("travel", "schedule", "fact", "recipe")


def _check(check_fn: str, kind: str = "instruction", **params) -> dict:
    return {"id": f"C_{check_fn.upper()}", "type": kind, "description_ro": f"RO {check_fn}", "description_en": f"EN {check_fn}",
            "check_fn": f"check_{check_fn}", "params": params}


def _entities(first: dict, second: dict) -> dict:
    named = (("A1", FIRST, first), ("A2", NEVER, second))
    return {i: {"id": i, "name": n, "aliases": [], "attributes": a} for i, n, a in named}


#: World: payload, scored and unscored constraints, structural goals, entities.
INSTANCES = {
    "travel": {
        "payload": {"num_days": 2},
        "constraints": [
            _check("must_include_type", type_required="museum"),
            _check("budget_limit", max_budget=60),
            _check("min_total_activities", kind="preference", min_total=9),
        ],
        "goals": [{"id": "G_DAYS", "type": "structural", "description": "days", "check_fn": "check_days_non_empty", "params": {"num_days": 2}}],
        "canonical_entities": _entities({"type": "park", "cost_lei": 30}, {"type": "museum", "cost_lei": 40}),
    },
    "schedule": {
        "payload": {"days_ro": ["luni", "marti"], "slots_ro": ["am", "pm"]},
        "constraints": [_check("keep_high_priority"), _check("max_total_appointments", max_total=1)],
        "goals": [],
        "canonical_entities": _entities({"priority": "high"}, {"priority": "low"}),
    },
    "fact": {
        "payload": {"facts": {"f1": "Abc def"}},
        "constraints": [_check("answer_matches_context")],
        "goals": [{"id": "G_STYLE", "type": "style", "description": "style", "check_fn": "check_no_duplicates", "params": {}}],
        "canonical_entities": {},
    },
    "recipe": {
        "payload": {"num_days": 1},
        "constraints": [_check("all_vegetarian"), _check("all_meals_filled", num_days=1)],
        "goals": [],
        "canonical_entities": _entities({"vegetarian": True, "calories": 300}, {"vegetarian": False, "calories": 500}),
    },
}

#: (world, variant): the plan, checks met of all, format checks met of five, entities planned, missing, hallucinated.
OUTPUTS = {
    ("travel", 0): ('{"day1": ["A1"], "day2": ["A2"]}', 2, 3, 5, 2, 1, 0),
    ("travel", 1): ('{"day1": ["A1"]}', 1, 3, 4, 1, 0, 0),
    ("travel", 2): ('{"day1": ["A2"], "day2": [],}', 2, 3, 4, 1, 1, 1),
    ("schedule", 0): (f'{{"luni_am": "{FIRST}", "luni_pm": null, "marti_am": null, "marti_pm": null}}', 2, 2, 5, 1, 0, 0),
    ("schedule", 1): (f'{{"luni_am": "{NEVER}", "luni_pm": null, "marti_am": null, "marti_pm": null}}', 1, 2, 5, 1, 1, 1),
    ("schedule", 2): (f'{{"luni_am": "{FIRST}", "marti_am": "{NEVER}"}}', 1, 2, 4, 2, 1, 0),
    ("fact", 0): ('{"answer": "abc"}', 1, 1, 5, 0, 0, 0),
    ("fact", 1): ('{"answer": "Nope"}', 0, 1, 5, 0, 0, 0),
    ("fact", 2): ('{"answer": "Abc def", "extra": "x"}', 1, 1, 4, 0, 0, 0),
    ("recipe", 0): ('{"day1_mic_dejun": "A1", "day1_pranz": "A2", "day1_cina": null}', 0, 2, 5, 2, 1, 0),
    ("recipe", 1): ('{"day1_mic_dejun": "A1", "day1_pranz": "A1", "day1_cina": "A1"}', 2, 2, 5, 3, 0, 0),
    ("recipe", 2): (None, 1, 2, 3, 0, 0, 1),  # an empty plan has F 1 whatever the text names
}
VARIANTS = 3
NO_OUTPUT = "doc_id % 50 = 49"


def cases(spark, sf) -> DataFrame:
    """``doc_id, world, variant, first, ro_text``."""
    docs = documents(spark, sf)
    world = F.element_at(F.array(*[F.lit(w) for w in WORLDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(
        "doc_id",
        world.alias("world"),
        (F.floor(F.col("doc_id") / 4) % VARIANTS).cast("int").alias("variant"),
        F.regexp_extract("ro_text", r"\p{L}+", 0).alias("first"),
        "ro_text",
    )


def _filled(template: str) -> Column:
    return F.replace(F.lit(template), F.lit(FIRST), F.col("first"))


def instances(spark, sf) -> DataFrame:
    """Instances as the reader parses them from JSON lines."""
    line = None
    for world, parts in INSTANCES.items():
        text = json.dumps({"instance_id": "@id@", "world": {"world_type": world, **parts}})
        one = F.when(F.col("world") == world, _filled(text))
        line = one if line is None else F.coalesce(line, one)
    ident = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    lines = cases(spark, sf).select(F.replace(line, F.lit("@id@"), ident).alias("line"))
    return lines.select(F.from_json("line", tb.INSTANCE_SCHEMA).alias("i")).select("i.*")


def outputs(spark, sf) -> DataFrame:
    """Outputs in two lines for an id now and then, of which the later counts, and none for some ids."""
    plan = None
    for (world, variant), (text, *_) in OUTPUTS.items():
        if text is not None:
            one = F.when((F.col("world") == world) & (F.col("variant") == variant), _filled(f"\n```json\n{text}\n```"))
            plan = one if plan is None else F.coalesce(plan, one)
    rows = cases(spark, sf).where(f"NOT ({NO_OUTPUT})").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("instance_id"),
        F.lit("base").alias("run_id"),
        F.concat("ro_text", F.coalesce(plan, F.lit(""))).alias("output"),
        F.lit(1).alias("row_pos"),
    )
    earlier = rows.where(F.col("instance_id").endswith("7")).withColumns({"output": F.lit("{}"), "row_pos": F.lit(0)})
    return rows.unionByName(earlier)


_VALUES = ", ".join(
    f"({WORLDS.index(w)}, {v}, {ok}, {n}, {fmt}, {total}, {missing}, {extra}, {plan is not None})"
    for (w, v), (plan, ok, n, fmt, total, missing, extra) in OUTPUTS.items()
)
_METRICS = (
    report_sql()
    + f""",
    expected(world, variant, ok, n, fmt, total, missed, extra, planned) AS (VALUES {_VALUES}),
    metrics AS (
        SELECT doc_id, ['travel', 'schedule', 'fact', 'recipe'][world + 1] AS world_type, {NO_OUTPUT} AS missing, ok, n, fmt,
            length({trim_sql('ro_text')}) < 50 AS late, total, missed, extra, g,
            pow(CASE WHEN total = 0 THEN 1.0 ELSE (total - missed) / total * pow(0.9, extra) END, 3) AS f
        FROM (SELECT doc_id, ro_text, (doc_id % 4)::INT AS w, ((doc_id // 4) % {VARIANTS})::INT AS v FROM {DOCS})
        JOIN expected ON world = w AND variant = v JOIN report USING (doc_id)
    ),
    scored AS (
        SELECT doc_id, world_type, missing, ok, n, fmt, late, total, missed, extra,
            CASE WHEN missing THEN 0 ELSE (0.85 * pow(ok / n, 3) + 0.15 * pow(fmt / 5, 3)) * CASE WHEN late THEN 0.5 ELSE 1 END END AS u,
            CASE WHEN missing THEN 0 ELSE pow(fmt / 5, 3) END AS r, CASE WHEN missing THEN 0 ELSE g END AS g,
            CASE WHEN missing THEN 0 ELSE f END AS f
        FROM metrics
    )
    """
)


def evaluated(spark, sf) -> DataFrame:
    return sc.evaluate_run(outputs(spark, sf), instances(spark, sf), runs=["base"])


@reg.add(
    "evaluate_run",
    _METRICS
    + """SELECT 'doc_' || doc_id AS instance_id, missing, round(u, 6) AS "U", round(r, 6) AS "R", round(g, 6) AS "G",
        round(f, 6) AS "F", CASE WHEN NOT missing THEN ok END AS constraints_satisfied,
        CASE WHEN NOT missing THEN n END AS constraints_total, CASE WHEN NOT missing THEN fmt END AS format_satisfied,
        CASE WHEN NOT missing THEN late END AS format_violation, CASE WHEN NOT missing THEN total END AS total_count,
        CASE WHEN NOT missing THEN total - missed END AS mentioned_count,
        CASE WHEN NOT missing THEN extra END AS hallucinated_count FROM scored""",
)
def _(spark, sf):
    counts = ["constraints_satisfied", "constraints_total", "format_satisfied", "total_count", "mentioned_count", "hallucinated_count"]
    return evaluated(spark, sf).select(
        "instance_id", "missing", *[r6(c).alias(c) for c in "URGF"], *[F.col(c).cast("int").alias(c) for c in counts], "format_violation"
    )


@reg.add(
    "evaluate_run_averages",
    _METRICS
    + """SELECT world_type, count(*) AS n, round(avg(u), 6) AS "avg_U", round(avg(r), 6) AS "avg_R", round(avg(g), 6) AS "avg_G",
        round(avg(f), 6) AS "avg_F", count(*) FILTER (WHERE missing) AS missing FROM scored GROUP BY 1""",
)
def _(spark, sf):
    made = instances(spark, sf).select("instance_id", F.col("world.world_type").alias("of"))
    rows = evaluated(spark, sf).join(made, "instance_id")
    return rows.groupBy(F.col("of").alias("world_type")).agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(f"avg_{c}") for c in "URGF"], F.count_if("missing").alias("missing")
    )


_NAMES = {
    w: [c["check_fn"] for c in parts["constraints"] if c["type"] == "instruction"] + [g["check_fn"] for g in parts["goals"] if g["type"] == "structural"]
    for w, parts in INSTANCES.items()
}
#: Which of a world's scored checks a variant meets.
MET = {
    "travel": [(True, False, True), (False, True, False), (True, True, False)],
    "schedule": [(True, True), (False, True), (True, False)],
    "fact": [(True,), (False,), (True,)],
    "recipe": [(False, False), (True, True), (True, False)],
}
_CHECK_ROWS = ", ".join(
    f"({WORLDS.index(w)}, {v}, {quote(name)}, {ok})" for w in WORLDS for v in range(VARIANTS) for name, ok in zip(_NAMES[w], MET[w][v], strict=True)
)


@reg.add(
    "check_results",
    f"""WITH expected(w, v, check_fn, satisfied) AS (VALUES {_CHECK_ROWS})
        SELECT 'doc_' || doc_id AS instance_id, check_fn, satisfied FROM documents
        JOIN expected ON w = doc_id % 4 AND v = (doc_id // 4) % {VARIANTS} WHERE NOT ({NO_OUTPUT})""",
)
def _(spark, sf):
    latest = tb.latest(outputs(spark, sf), ["run_id", "instance_id"], ["row_pos"])
    results = sc.check_results(sc.parse_run(latest), tb.prepare_instances(instances(spark, sf)), ["run_id", "instance_id"])
    return results.select("instance_id", "check_fn", "satisfied")


@reg.add(
    "failing_descriptions",
    f"""WITH expected(w, v, check_fn, satisfied) AS (VALUES {_CHECK_ROWS})
        SELECT 'doc_' || doc_id AS instance_id, CASE WHEN check_fn = 'check_days_non_empty' THEN 'days'
            ELSE CASE WHEN lang = 'en' THEN 'EN ' ELSE 'RO ' END || substr(check_fn, 7) END AS description
        FROM documents JOIN expected ON w = doc_id % 4 AND v = (doc_id // 4) % {VARIANTS}
        WHERE NOT satisfied AND NOT ({NO_OUTPUT})""",
)
def _(spark, sf):
    """Descriptions of unmet checks, in the language of the run."""
    latest = tb.latest(outputs(spark, sf), ["run_id", "instance_id"], ["row_pos"])
    prepared = tb.prepare_instances(instances(spark, sf))
    results = sc.check_results(sc.parse_run(latest), prepared, ["run_id", "instance_id"]).where("NOT satisfied")
    texts = prepared.select("instance_id", F.inline("checks")).select("instance_id", "check_id", "description_ro", "description_en")
    spoken = documents(spark, sf).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("instance_id"), "lang")
    joined = results.join(texts, ["instance_id", "check_id"]).join(spoken, "instance_id")
    description = F.when(F.col("lang") == "en", F.col("description_en")).otherwise(F.col("description_ro"))
    return joined.select("instance_id", description.alias("description"))


@reg.add(
    "faithfulness_in_row",
    _METRICS + """SELECT 'doc_' || doc_id AS instance_id, total AS total_count, missed AS missing_count, extra AS hallucinated_count,
        round(f, 6) AS "F" FROM scored WHERE NOT missing""",
)
def _(spark, sf):
    latest = tb.latest(outputs(spark, sf), ["run_id", "instance_id"], ["row_pos"])
    joined = sc.parse_run(latest).join(tb.prepare_instances(instances(spark, sf)).select("instance_id", "entities"), "instance_id")
    found = en.faithfulness(joined)
    return found.select(
        "instance_id", "total_count", F.size("missing").alias("missing_count"), F.size("hallucinated").alias("hallucinated_count"), r6("F").alias("F")
    )


@reg.add(
    "faithfulness_lemmas",
    _METRICS
    + """SELECT 'doc_' || doc_id AS instance_id, total AS total_count, missed AS missing_count,
        round(pow(CASE WHEN total = 0 THEN 1.0 ELSE (total - missed) / total END, 3), 6) AS "F" FROM scored WHERE NOT missing""",
)
def _(spark, sf):
    """The lemma variant: articulated forms, lemmas of the explanation, no penalty for unplanned mentions."""
    parsed = sc.parse_run(tb.latest(outputs(spark, sf), ["run_id", "instance_id"], ["row_pos"]))
    parsed = materialize(parsed.select("instance_id", "explanation", "refs"))
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("explanation"), F.lit("[a-z]+"), F.lit(0)))).alias("word")
    lookup = parsed.select(words).where("word LIKE '%ing'").distinct().withColumn("lemma", F.left("word", F.char_length("word") - 3))
    prepared = tb.prepare_instances(instances(spark, sf), articulated=True).select("instance_id", "entities")
    joined = parsed.join(prepared, "instance_id").join(en.lemma_map(parsed, ["instance_id"], "explanation", lookup), "instance_id")
    found = en.faithfulness(joined, lemmas="lemmas")
    return found.select("instance_id", "total_count", F.size("missing").alias("missing_count"), r6("F").alias("F"))


@reg.add(
    "run_findings",
    _METRICS
    + f""",
        unmet(w, v, check_fn, satisfied) AS (VALUES {_CHECK_ROWS}),
        notes AS (
            SELECT unnest([CASE WHEN n_bad > 0 THEN 'missing diacritics' END, CASE WHEN n_english > 0 THEN 'English words' END,
                CASE WHEN total_issues > 0 THEN 'punctuation' END, CASE WHEN rate > 0.15 THEN 'mostly English' END,
                CASE WHEN n_words < 100 THEN 'too short' END]) AS subject
            FROM report WHERE g < {rp.QUALITY_NOTE_BELOW} AND NOT ({NO_OUTPUT})
        )
        SELECT 'check' AS kind, check_fn AS subject, count(*) AS n FROM documents
            JOIN unmet ON w = doc_id % 4 AND v = (doc_id // 4) % {VARIANTS} WHERE NOT satisfied AND NOT ({NO_OUTPUT}) GROUP BY 1, 2
        UNION ALL SELECT 'missing entity', 'A2', count(*) FILTER (WHERE missed > 0 AND NOT missing) FROM scored
        UNION ALL SELECT 'quality', subject, count(*) FROM notes WHERE subject IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    keys = ["run_id", "instance_id"]
    parsed = materialize(sc.parse_run(tb.latest(outputs(spark, sf), keys, ["row_pos"])).drop("output", "row_pos"))
    prepared = materialize(tb.prepare_instances(instances(spark, sf)))
    metrics = sc.evaluate(parsed, prepared, keys)
    found = rp.findings(metrics, sc.check_results(parsed, prepared, keys), keys)
    return found.groupBy("kind", "subject").agg(F.count(F.lit(1)).alias("n"))


_ENTITIES = "CASE WHEN doc_id % 4 = 2 THEN '' ELSE regexp_extract(ro_text, '\\p{L}+') || '; " + NEVER + "' END"
_CONSTRAINTS = ", ".join(quote("; ".join(c["description_ro"] for c in INSTANCES[w]["constraints"])) for w in WORLDS)


@reg.add(
    "instance_overview",
    f"""SELECT 'doc_' || doc_id AS instance_id, ['TRAVEL', 'SCHEDULE', 'FACT', 'RECIPE'][1 + doc_id % 4] AS world_type,
               'N/A' AS difficulty, {_ENTITIES} AS entities, [{_CONSTRAINTS}][1 + doc_id % 4] AS constraints FROM {DOCS}""",
)
def _(spark, sf):
    return rp.overview(instances(spark, sf)).drop("prompt_ro")
