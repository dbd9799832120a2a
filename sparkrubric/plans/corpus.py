"""Corpora of feasible instances, and plausible baseline outputs for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrubric.operators import ordered as od
from sparkrubric.plans import worlds as wd
from sparkrubric.sources.lineage import materialize

# --- fixed values ------------------------------------------------------------------------------------------
SPEC_VERSION = "0.1"
RETRY_STEP = 10000
BASE_RETRIES, HARD_RETRIES = 100, 10
BASE_COUNTS = {"travel": 150, "schedule": 150, "fact": 100, "recipe": 100}
HARD_COUNTS = {"travel": 100, "schedule": 75, "fact": 50, "recipe": 75}
# --- end of fixed values -----------------------------------------------------------------------------------


def attempt_seed(seed: Column, attempt: Column, hard: bool = False) -> Column:
    """Seed of the n-th try, the given one first: then ``seed + 10000, seed + 10001, ...``, in hard corpora ``seed + 1,
    seed + 2, ...``."""
    later = seed + attempt if hard else seed + RETRY_STEP + attempt - 1
    return F.when(attempt == 0, seed).otherwise(later)


def generate_feasible(requests: DataFrame, world_type: str, hard: bool = False, max_retries: int | None = None) -> DataFrame:
    """Worlds for ``(instance_id, seed, difficulty)``, regenerated from the next seed while no plan is possible.

    First tries run for everyone, then the ids without a plan get one further try, then two, four and so on, up to
    ``max_retries`` tries in all; the first feasible try is kept.  ``attempts`` tells how many tries failed before it.  An
    id without a feasible try keeps its last one, flagged by ``feasible`` = false.
    """
    build = wd.WORLDS[world_type]
    limit = max_retries or (HARD_RETRIES if hard else BASE_RETRIES)
    # the worlds are long expressions: written once, they are neither built twice nor pulled into later filters
    made = materialize(build(requests, hard), "worlds").withColumn("attempts", F.lit(0))
    if world_type == "fact":
        return made
    done, tried, width = made.where("feasible"), 1, 1
    last = made.where("NOT feasible")
    while tried < limit and not last.isEmpty():
        numbers = F.sequence(F.lit(tried), F.lit(min(tried + width, limit) - 1))
        open_ids = last.select("instance_id", "difficulty").join(requests.select("instance_id", "seed"), "instance_id")
        tries = open_ids.withColumn("attempts", F.explode(numbers)).select(
            F.concat_ws("|", "instance_id", F.col("attempts").cast("string")).alias("instance_id"),
            attempt_seed(F.col("seed"), F.col("attempts"), hard).alias("seed"),
            "difficulty",
        )
        parts = F.split("instance_id", r"\|")
        named = build(tries, hard).withColumn("attempts", F.element_at(parts, -1).cast("int"))
        named = named.withColumn("instance_id", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "|"))
        named = materialize(named, "worlds")
        # the first feasible try, else the last one
        order = F.when(F.col("feasible"), F.col("attempts")).otherwise(2 * limit - F.col("attempts"))
        best = materialize(od.best_row(named, ["instance_id"], [order]).select("instance_id", "best.*"), "worlds")
        done, last = done.unionByName(best.where("feasible")), best.where("NOT feasible")
        tried, width = tried + width, 2 * width
    return done.unionByName(last)


def requests(spark: SparkSession, world_type: str, count: int, seed_start: int, difficulty: str, hard: bool) -> DataFrame:
    """Seeds, ids and difficulties of one world type; mixed difficulty goes by position."""
    position = F.col("id")
    level = od.difficulty_by_position(position, F.lit(count)) if difficulty == "mixed" else F.lit(difficulty)
    prefix = f"{world_type}_hard_" if hard else f"{world_type}_"
    seed = position + seed_start
    return spark.range(count).select(
        F.concat(F.lit(prefix), F.lpad(seed.cast("string"), 6, "0")).alias("instance_id"), seed.alias("seed"),
        level.alias("difficulty"),
    )


def build_corpus(
    spark: SparkSession,
    counts: dict[str, int] | None = None,
    seed_start: int = 0,
    difficulty: str = "mixed",
    hard: bool = False,
) -> DataFrame:
    """Union of the four worlds; a hard corpus comes in seeded random order."""
    counts = counts or (HARD_COUNTS if hard else BASE_COUNTS)
    out, start = None, seed_start
    for world_type, count in counts.items():
        rows = requests(spark, world_type, count, start, difficulty, hard)
        made = generate_feasible(rows, world_type, hard)
        out = made if out is None else out.unionByName(made)
        start += count
    return od.seeded_shuffle(out, "instance_id", seed_start).drop("shuffle_key") if hard else out


def as_instances(corpus: DataFrame) -> DataFrame:
    """Corpus rows in the instance schema, ready to write as JSON lines."""

    def parsed(array: str, fields: list[str]) -> Column:
        return F.transform(
            array, lambda c: F.struct(*[c[f].alias(f) for f in fields], F.parse_json(c["params"]).alias("params"))
        )

    entities = F.map_from_entries(
        F.transform(
            "entities",
            lambda e: F.struct(
                e["id"].alias("key"),
                F.struct(
                    e["id"].alias("id"), e["name"].alias("name"), e["aliases"].alias("aliases"),
                    F.parse_json(e["attributes"]).alias("attributes"),
                ).alias("value"),
            ),
        )
    )
    world = F.struct(
        F.col("instance_id").alias("world_id"),
        "world_type",
        F.lit(SPEC_VERSION).alias("spec_version"),
        F.col("seed").cast("bigint").alias("seed"),
        F.parse_json("payload").alias("payload"),
        parsed("constraints", ["id", "type", "description_ro", "description_en", "check_fn"]).alias("constraints"),
        parsed("goals", ["id", "type", "description", "check_fn"]).alias("goals"),
        entities.alias("canonical_entities"),
        F.parse_json("meta").alias("meta"),
    )
    return corpus.select(
        "instance_id", world.alias("world"), "prompt_ro", "prompt_en", F.parse_json("meta").alias("meta")
    )


# --- baseline outputs ------------------------------------------------------------------------------------------
def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("world.payload", path, kind)


def _pairs_json(keys: Column, values: Column) -> Column:
    """Indented JSON object of ready-made JSON values."""
    pairs = F.zip_with(keys, values, lambda k, v: F.concat(F.lit('  "'), k, F.lit('": '), v))
    return F.concat(F.lit("{\n"), F.array_join(pairs, ",\n"), F.lit("\n}"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _travel_output() -> Column:
    days = _get("$.num_days", "int")
    items = _get("$.attractions", "array<struct<name string, family_friendly boolean>>")
    family = F.exists(F.col("world.constraints"), lambda c: c["id"] == "C_FAMILY_FRIENDLY")
    usable = F.slice(F.filter(items, lambda a: ~family | a["family_friendly"]), 1, days)
    numbers = F.sequence(F.lit(1), days)
    item = lambda n: F.get(usable, n - 1)["name"]
    told = F.array_join(
        F.transform(
            numbers,
            lambda n: F.concat(
                F.when(
                    item(n).isNotNull(),
                    F.concat(F.lit("În ziua "), n.cast("string"), F.lit(", vom vizita "), item(n), F.lit(". ")),
                ).otherwise(""),
                F.lit("\n"),
            ),
        ),
        "",
    )
    cells = F.transform(
        numbers,
        lambda n: F.when(item(n).isNotNull(), F.concat(F.lit("[\n    "), _quoted(item(n)), F.lit("\n  ]"))).otherwise("[]"),
    )
    return F.concat(
        F.lit("Pentru călătoria de "), days.cast("string"), F.lit(" zile în "), _get("$.city", "string"),
        F.lit(", propun următorul plan:\n\n"), told,
        F.lit("\nAcest plan respectă toate cerințele și oferă o experiență variată.\n\n"),
        _pairs_json(F.transform(numbers, lambda n: F.concat(F.lit("day"), n.cast("string"))), cells),
    )


def _schedule_output() -> Column:
    days, slots = _get("$.days_ro", "array<string>"), _get("$.slots_ro", "array<string>")
    names = F.transform(_get("$.appointments", "array<struct<name_ro string>>"), lambda a: a["name_ro"])
    at = lambda i, j: F.get(names, i * F.size(slots) + j)
    told = F.transform(
        days,
        lambda d, i: F.concat(
            d,
            F.lit(":\n"),
            F.array_join(
                F.transform(
                    slots,
                    lambda s, j: F.when(
                        at(i, j).isNotNull(), F.concat(F.lit("  - "), s, F.lit(": "), at(i, j), F.lit("\n"))
                    ).otherwise(""),
                ),
                "",
            ),
            F.lit("\n"),
        ),
    )
    keys = F.flatten(F.transform(days, lambda d: F.transform(slots, lambda s: F.concat_ws("_", d, s))))
    values = F.transform(keys, lambda _, n: F.coalesce(_quoted(F.get(names, n)), F.lit("null")))
    return F.concat(
        F.lit("Am organizat programările astfel:\n\n"), F.array_join(told, ""),
        F.lit("Acest plan respectă prioritățile și evită suprapunerile.\n\n"), _pairs_json(keys, values),
    )


def _fact_output() -> Column:
    expected = _get("$.question.expected_answer", "string")
    first = F.get(F.map_values(_get("$.facts", "map<string,string>")), F.lit(0))
    fallback = F.coalesce(first, F.lit("Necunoscut"))
    known = F.coalesce(expected, F.lit("")) != ""
    answer = F.when(known, expected).otherwise(fallback)
    told = F.when(
        known,
        F.concat(
            F.lit("Pe baza informațiilor din contextul dat, răspunsul este: "), expected,
            F.lit("\n\nAceasta este informația din baza de date furnizată.\n\n"),
        ),
    ).otherwise(F.concat(F.lit("Răspunsul este: "), fallback, F.lit("\n\n")))
    return F.concat(told, _pairs_json(F.array(F.lit("answer")), F.array(_quoted(answer))))


def _recipe_output() -> Column:
    days = _get("$.num_days", "int")
    dishes = _get(
        "$.dishes",
        "array<struct<name string, type string, vegetarian boolean, contains_gluten boolean, contains_lactose boolean>>",
    )
    rules = F.col("world.constraints")
    vegetarian = F.exists(
        rules, lambda c: (c["id"] == "C_DIET_0") & F.lower(c["description_ro"]).contains("vegetarian")
    )
    gluten = F.exists(rules, lambda c: c["check_fn"].contains("gluten"))
    lactose = F.exists(rules, lambda c: c["check_fn"].contains("lactose"))
    usable = F.filter(
        dishes,
        lambda x: (~vegetarian | x["vegetarian"])
        & (~gluten | ~x["contains_gluten"])
        & (~lactose | ~x["contains_lactose"]),
    )
    labels = {"mic_dejun": "mic dejun", "pranz": "prânz", "cina": "cină"}
    numbers = F.sequence(F.lit(1), days)
    fallback = F.coalesce(F.get(dishes, F.lit(0))["name"], F.lit("Necunoscut"))

    def pick(meal: str, n: Column) -> Column:
        options = F.filter(usable, lambda x: x["type"] == meal)
        return F.when(F.size(options) > 0, F.get(options, (n - 1) % F.size(options))["name"]).otherwise(fallback)

    told = F.transform(
        numbers,
        lambda n: F.concat(
            F.lit("Ziua "), n.cast("string"), F.lit(":\n"),
            *[F.concat(F.lit(f"  - {label}: "), pick(m, n), F.lit("\n")) for m, label in labels.items()], F.lit("\n"),
        ),
    )
    keys = F.flatten(
        F.transform(numbers, lambda n: F.array(*[F.concat(F.lit("day"), n.cast("string"), F.lit(f"_{m}")) for m in labels]))
    )
    values = F.flatten(F.transform(numbers, lambda n: F.array(*[_quoted(pick(m, n)) for m in labels])))
    return F.concat(
        F.lit("Am planificat meniurile pentru "), days.cast("string"), F.lit(" zile.\n\n"), F.array_join(told, ""),
        F.lit("Meniurile respectă restricțiile alimentare indicate.\n\n"), _pairs_json(keys, values),
    )


def baseline_outputs(instances: DataFrame) -> DataFrame:
    """``instance_id, output``: a plausible plan with explanation for every instance."""
    kind = F.col("world.world_type")
    output = (
        F.when(kind == "travel", _travel_output())
        .when(kind == "schedule", _schedule_output())
        .when(kind == "fact", _fact_output())
        .when(kind == "recipe", _recipe_output())
        .otherwise("Nu pot rezolva această sarcină.")
    )
    return instances.select("instance_id", output.alias("output"))
