"""Reading and writing instances, outputs and metrics as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrubric.functions import morphology as mo
from sparkrubric.functions import text as tx
from sparkrubric.operators import checks as ck

CHECK = "id string, type string, description_ro string, description_en string, check_fn string, params variant"
GOAL = "id string, type string, description string, check_fn string, params variant"
ENTITY = "id string, name string, aliases array<string>, attributes variant"
WORLD = (
    "world_id string, world_type string, spec_version string, seed bigint, payload variant, "
    f"constraints array<struct<{CHECK}>>, goals array<struct<{GOAL}>>, "
    f"canonical_entities map<string, struct<{ENTITY}>>, meta variant"
)
INSTANCE_SCHEMA = f"instance_id string, world struct<{WORLD}>, prompt_ro string, prompt_en string, meta variant"
OUTPUT_SCHEMA = (
    "instance_id string, output string, model string, provider string, language string, latency double"
)


# --- readers -------------------------------------------------------------------------------------------------
def read_instances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSTANCE_SCHEMA).json(path)


def read_outputs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Output rows with ``run_id`` (file name without extension), ``run_path`` (the whole path, which tells files of one name
    in different folders apart) and ``row_pos``, which follows line order in a file."""
    raw = spark.read.schema(OUTPUT_SCHEMA).json(path)
    return raw.select(
        "*",
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("run_id"),
        F.col("_metadata.file_path").alias("run_path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("row_pos"),
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``: a later line for the same id replaces an earlier one.

    An aggregate, not a window, so a key with very many rows is reduced on the map side.
    """
    others = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*")


def first_value(value: Column | str, order: list[str]) -> Column:
    """Value of the first row that has one."""
    c = F.col(value) if isinstance(value, str) else value
    return F.min_by(c, F.when(c.isNotNull(), F.struct(*order)))


def run_identity(outputs: DataFrame, run: str = "run_id", order: list[str] | None = None) -> DataFrame:
    """Per run: ``model`` of the first row that has one, else the run id; ``language`` of the first row, else ro."""
    order = order or ["row_pos"]
    return outputs.groupBy(run).agg(
        F.coalesce(first_value("model", order), F.first(run)).alias("run_model"),
        F.coalesce(F.min_by("language", F.struct(*order)), F.lit("ro")).alias("run_language"),
    )


# --- instance views ------------------------------------------------------------------------------------------
ATTRIBUTES = {
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
}


def entity_structs(entities: Column, articulated: bool = False) -> Column:
    """Array of entity structs with lookup keys, attributes and search forms, in declaration order.

    Built once per instance, before instances meet outputs.
    """

    def of(entry: Column) -> Column:
        e = entry["value"]
        aliases = F.coalesce(e["aliases"], F.array().cast("array<string>"))
        names = F.concat(F.array(e["name"]), aliases)
        forms = mo.search_forms_articulated(names) if articulated else mo.search_forms(names)
        attributes = [F.try_variant_get(e["attributes"], f"$.{n}", t).alias(n) for n, t in ATTRIBUTES.items()]
        return F.struct(
            entry["key"].alias("id"),
            e["name"].alias("name"),
            aliases.alias("aliases"),
            tx.lookup_key(e["name"]).alias("name_key"),
            F.transform(aliases, F.lower).alias("alias_keys"),
            F.transform(names, tx.normalize_match).alias("match_keys"),
            forms.alias("forms"),
            *attributes,
        )

    return F.transform(F.map_entries(entities), of)


def check_structs(world: str = "world") -> Column:
    """The scored checks: constraints of type instruction and goals of type structural, in that order."""
    constraints = F.filter(F.col(f"{world}.constraints"), lambda c: c["type"] == "instruction")
    goals = F.filter(F.col(f"{world}.goals"), lambda g: g["type"] == "structural")

    def spec(kind: str, ro: str, en: str):
        return lambda c, n: F.struct(
            F.concat(F.lit(kind), n.cast("string")).alias("check_id"),
            F.lit(kind).alias("kind"),
            c["id"].alias("id"),
            c[ro].alias("description_ro"),
            c[en].alias("description_en"),
            c["check_fn"].alias("check_fn"),
            *ck.unpacked(c["params"]),
        )

    typed = ",".join(f"{n}:{t}" for n, t in ck.TypedParams.TYPES.items())
    none = F.array().cast(
        "array<struct<check_id:string,kind:string,id:string,description_ro:string,description_en:string,"
        f"check_fn:string,params_json:string,param:struct<{typed}>>>"
    )
    return F.concat(
        F.coalesce(F.transform(constraints, spec("constraint", "description_ro", "description_en")), none),
        F.coalesce(F.transform(goals, spec("goal", "description", "description")), none),
    )


def expected_keys(world: str = "world") -> Column:
    """The plan keys the prompt asks for, by world type."""
    payload = F.col(f"{world}.payload")
    days = F.coalesce(F.try_variant_get(payload, "$.num_days", "int"), F.lit(2))
    numbered = F.transform(F.sequence(F.lit(1), days), lambda d: F.concat(F.lit("day"), d.cast("string")))
    meals = F.coalesce(
        F.try_variant_get(payload, "$.meals_per_day", "array<string>"),
        F.array(F.lit("mic_dejun"), F.lit("pranz"), F.lit("cina")),
    )
    none = F.array().cast("array<string>")
    slots = F.coalesce(F.try_variant_get(payload, "$.slots_ro", "array<string>"), none)
    labels = F.coalesce(F.try_variant_get(payload, "$.days_ro", "array<string>"), none)

    def product(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat_ws("_", a, b))))

    kind = F.col(f"{world}.world_type")
    return (
        F.when(kind == "travel", numbered)
        .when(kind == "recipe", product(numbered, meals))
        .when(kind == "schedule", product(labels, slots))
        .when(kind == "fact", F.array(F.lit("answer")))
        .otherwise(none)
    )


def prepare_instances(instances: DataFrame, articulated: bool = False) -> DataFrame:
    """One narrow row per instance with everything scoring needs."""
    facts = F.try_variant_get("world.payload", "$.facts", "map<string,string>")
    return instances.select(
        "instance_id",
        F.col("world.world_type").alias("world_type"),
        expected_keys().alias("expected_keys"),
        entity_structs(F.col("world.canonical_entities"), articulated).alias("entities"),
        check_structs().alias("checks"),
        F.map_values(facts).alias("facts"),
    )


# --- writers -------------------------------------------------------------------------------------------------
def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, UTF-8 unescaped, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame, *columns: str) -> Column:
    names = columns or tuple(df.columns)
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def failed_ids(instances: DataFrame, outputs: DataFrame, key: str = "instance_id") -> DataFrame:
    """Ids of instances without an output."""
    return instances.select(key).join(outputs.select(key), key, "left_anti")


def write_failed_ids(instances: DataFrame, outputs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    failed_ids(instances, outputs).write.mode(mode).text(path)
