"""U, R, G and F of model outputs, and the batch evaluation of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrubric.functions import outputs as op
from sparkrubric.functions import text as tx
from sparkrubric.operators import checks as ck
from sparkrubric.operators import entities as en
from sparkrubric.operators import quality as ql
from sparkrubric.sources import tables as tb
from sparkrubric.sources.lineage import materialize

# --- fixed values ------------------------------------------------------------------------------------------
CHECK_SHARE, FORMAT_SHARE = 0.85, 0.15
MIN_EXPLANATION = 50
WORLD_TYPES = ("travel", "schedule", "fact", "recipe")
# --- end of fixed values -----------------------------------------------------------------------------------


# --- format --------------------------------------------------------------------------------------------------
def keys_missing(expected: Column, actual: Column) -> Column:
    return F.array_except(expected, actual)


def keys_extra(expected: Column, actual: Column) -> Column:
    return F.array_except(actual, expected)


def value_types_ok(cells: Column, world_type: Column) -> Column:
    """Lists for travel, strings or null for recipe and schedule, a string answer for fact."""
    return (
        F.when(world_type == "travel", F.forall(cells, lambda c: c["kind"] == "list"))
        .when(world_type.isin("recipe", "schedule"), F.forall(cells, lambda c: c["kind"].isin("null", "string")))
        .when(world_type == "fact", F.exists(cells, lambda c: (c["key"] == "answer") & (c["kind"] == "string")))
    )


def format_compliance(df: DataFrame) -> DataFrame:
    """Add the five format checks and their counts; needs ``cells, world_type, expected_keys, format_ok, repaired``.

    An output without a plan counts as an empty object, so "JSON found" always holds.
    """
    actual = F.transform("cells", lambda c: c["key"])
    known = F.col("world_type").isin(*WORLD_TYPES)
    checks = {
        "F_JSON_FOUND": F.lit(True),
        "F_JSON_CLEAN": F.col("format_ok") & ~F.col("repaired"),
        "F_KEYS_PRESENT": F.when(known, F.size(keys_missing(F.col("expected_keys"), actual)) == 0),
        "F_NO_EXTRA_KEYS": F.when(known, F.size(keys_extra(F.col("expected_keys"), actual)) == 0),
        "F_VALUE_TYPES": value_types_ok(F.col("cells"), F.col("world_type")),
    }
    out = df.withColumn("format_checks", F.struct(*[c.alias(n) for n, c in checks.items()]))
    flags = F.array_compact(F.array(*[F.col(f"format_checks.{n}") for n in checks]))
    return out.withColumn("format_satisfied", F.size(F.filter(flags, lambda f: f))).withColumn(
        "format_total", F.size(flags)
    )


# --- U and R -------------------------------------------------------------------------------------------------
def understanding(df: DataFrame) -> DataFrame:
    """Add ``U_constraints, U_format, U, R, format_violation`` from the check and format counts.

    Needs ``constraints_satisfied, constraints_total, format_satisfied, format_total, explanation_chars``.
    """
    share = F.when(F.col("constraints_total") > 0, F.col("constraints_satisfied") / F.col("constraints_total"))
    fmt = F.when(F.col("format_total") > 0, F.col("format_satisfied") / F.col("format_total"))
    base = F.lit(CHECK_SHARE) * F.col("U_constraints") + F.lit(FORMAT_SHARE) * F.col("U_format")
    return (
        df.withColumn("U_constraints_linear", F.coalesce(share, F.lit(1.0)))
        .withColumn("U_format_linear", F.coalesce(fmt, F.lit(1.0)))
        .withColumn("U_constraints", tx.severity(F.col("U_constraints_linear")))
        .withColumn("U_format", tx.severity(F.col("U_format_linear")))
        .withColumn("format_violation", F.col("explanation_chars") < MIN_EXPLANATION)
        .withColumn("U", F.when(F.col("format_violation"), base * F.lit(0.5)).otherwise(base))
        .withColumn("R", F.col("U_format"))
    )


# --- checks of whole outputs -----------------------------------------------------------------------------------
def check_results(parsed: DataFrame, instances: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, check_id, check_fn, satisfied, error``: every check of every output.

    The plan is resolved against its own instance's entities inside the row; items and checks are paired by exploding
    the row, and the two grouped aggregations of ``run_checks`` fold them back.  The explicit repartition puts all rows
    of one output together once, so those aggregations need no further exchange, and it leaves the join before it
    free to split an instance that holds a large share of the outputs.
    """
    joined = parsed.select(*keys, "cells").join(
        instances.select("instance_id", "entities", "checks", "facts"), "instance_id"
    )
    names = F.flatten(
        F.transform(
            F.filter("cells", lambda c: (c["kind"] == "string") & c["truthy"] & ~c["is_null_word"]),
            lambda c: c["refs"],
        )
    )
    attributes = ["name", "aliases", *tb.ATTRIBUTES]

    def entity_part(e: Column, found_id: Column) -> list[Column]:
        return [found_id.alias("entity_id"), *[e[a].alias(a) for a in attributes]]

    def item_rows(cell: Column) -> Column:
        refs = F.when(F.size(cell["refs"]) > 0, cell["refs"]).otherwise(F.array(F.lit(None).cast("string")))
        has_refs = F.size(cell["refs"]) > 0

        def row(ref: Column, pos: Column) -> Column:
            copied = ["key", "day", "slot", "kind", "n_values", "truthy", "is_null_word"]
            return tx.let(
                en.resolve(ref, F.col("entities")),
                lambda e: F.struct(
                    *[cell[n].alias(n) for n in copied],
                    F.when(has_refs, pos).alias("item_pos"),
                    ref.alias("ref"),
                    *entity_part(e, e["id"]),
                    F.lit(False).alias("is_entity"),
                    F.lit(None).cast("boolean").alias("kept"),
                ),
            )

        return F.transform(refs, row)

    def entity_row(e: Column) -> Column:
        nothing = {"key": "string", "day": "string", "slot": "string", "kind": "string", "n_values": "int"}
        return F.struct(
            *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()],
            F.lit(False).alias("truthy"),
            F.lit(False).alias("is_null_word"),
            F.lit(None).cast("int").alias("item_pos"),
            F.lit(None).cast("string").alias("ref"),
            *entity_part(e, F.lit(None).cast("string")),
            F.lit(True).alias("is_entity"),
            F.array_contains(F.col("planned_names"), e["name"]).alias("kept"),
        )

    rows = joined.withColumn("planned_names", names).withColumn(
        "rows", F.concat(F.flatten(F.transform("cells", item_rows)), F.transform("entities", entity_row))
    )
    spec = ["check_id", "check_fn", "params_json", "param"]
    narrow = rows.select(*keys, "checks", "facts", "rows").repartition(*keys)
    paired = (
        narrow.select(*keys, "facts", "rows", F.explode("checks").alias("check"))
        .select(*keys, "facts", "rows", *[f"check.{n}" for n in spec])
        .select(*keys, "facts", *spec, F.explode_outer("rows").alias("item"))
        .select(*keys, "facts", *spec, "item.*")
    )
    return ck.run_checks(paired, keys)


def check_totals(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count_if("satisfied").alias("constraints_satisfied"), F.count(F.lit(1)).alias("constraints_total")
    )


# --- whole rows ----------------------------------------------------------------------------------------------
def parse_run(outputs: DataFrame, output: str = "output") -> DataFrame:
    """Parsed outputs with ``cells`` and ``refs``.  Write this once when several scores are computed from it."""
    parsed = op.parse_outputs(outputs, output)
    return parsed.withColumn("cells", op.plan_cells("plan", "plan_json")).withColumn(
        "refs", op.plan_refs(F.col("cells"))
    )


def evaluate(
    parsed: DataFrame,
    instances: DataFrame,
    keys: list[str] | None = None,
    english: list[str] | None = None,
    grammar: str | None = None,
    weights: ql.Weights = ql.GRAMMAR_WEIGHTS,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """One metrics row per parsed output that has an instance: U, R, G, F, flags and details.

    ``parsed`` and ``instances`` (from ``prepare_instances``) should be stored tables, as ``evaluate_run`` makes them.  A plan with a non-string list element cannot be scored and gets
    zeros with the reason in ``parse_error``.  ``lemmas`` (``keys, lemmas``) switches F to the lemma variant.
    """
    keys = keys or ["run_id", "instance_id"]
    scored = ql.text_quality(parsed, "explanation", english=english, grammar=grammar, weights=weights)
    joined = scored.join(instances.select("instance_id", "world_type", "expected_keys", "entities"), "instance_id")
    if lemmas is not None:
        joined = joined.join(lemmas, keys, "left").withColumn(
            "lemmas", F.coalesce("lemmas", F.array().cast("array<string>"))
        )
    faith = en.faithfulness(joined, lemmas="lemmas" if lemmas is not None else None)
    rows = (
        format_compliance(faith)
        .withColumn("explanation_chars", F.char_length("explanation"))
        .withColumn("broken", F.exists("refs", lambda r: r.isNull()))
        .drop("entities", "cells", "refs", "plan", "plan_json", "expected_keys", "lemmas")
    )
    totals = check_totals(check_results(parsed, instances, keys), keys)
    full = understanding(
        rows.join(totals, keys, "left").na.fill(0, ["constraints_satisfied", "constraints_total"])
    )
    zeroed = ["U", "R", "G", "F", "U_constraints", "U_format"]
    ok = ~F.coalesce("broken", F.lit(False))
    return full.withColumns(
        {n: F.when(ok, F.col(n)).otherwise(0.0) for n in zeroed}
        | {
            "parse_error": F.when(
                ok, F.col("parse_error")
            ).otherwise("Evaluation error: a plan list holds a value that is not a string")
        }
    ).drop("broken")


def evaluate_run(
    outputs: DataFrame, instances: DataFrame, runs: list[str] | None = None, order: str = "row_pos", **options
) -> DataFrame:
    """Batch evaluation of raw outputs (``run_id, instance_id, output`` and a line order) against raw instances.

    The last line per id counts.  Parsed outputs and prepared instances are written once to the checkpoint folder:
    the text is parsed a single time, and the long parsing expressions stay out of the later plans.  With ``runs`` every
    instance of those runs appears, missing outputs scoring 0.
    """
    keys = ["run_id", "instance_id"]
    latest = tb.latest(outputs.select(*keys, "output", order), keys, [order])
    parsed = materialize(parse_run(latest).drop("output", order))
    prepared = materialize(tb.prepare_instances(instances, articulated=options.get("lemmas") is not None))
    metrics = evaluate(parsed, prepared, keys, **options)
    return metrics if runs is None else with_missing(instances, metrics, runs)


def with_missing(instances: DataFrame, metrics: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Every instance (of every listed run) with its metrics; a missing output scores 0 and is flagged."""
    wanted, keys = instances.select("instance_id").distinct(), ["instance_id"]
    if runs is not None:
        wanted = wanted.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs])))
        keys = ["run_id", "instance_id"]
    joined = wanted.join(metrics.withColumn("_there", F.lit(True)), keys, "left")
    zeroed = [c for c in ("U", "R", "G", "F", "U_constraints", "U_format") if c in metrics.columns]
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in zeroed} | {"missing": F.col("_there").isNull()}
    ).drop("_there")


def metrics_record(metrics: DataFrame) -> DataFrame:
    """Metrics in the shape of the written JSON lines: scalars plus one struct per detail block."""
    c = F.col
    u = ["U", "U_constraints", "U_constraints_linear", "U_format", "U_format_linear", "constraints_satisfied",
         "constraints_total", "format_satisfied", "format_total", "format_checks", "format_violation"]
    g = ["G", "G_dia", "G_cs", "G_punct", "G_len", "n_tokens", "n_words", "has_diacritics", "is_likely_english",
         "is_too_short"]
    f = ["F", "F_linear", "missing", "hallucinated", "planned_ids", "mentioned_count", "total_count",
         "hallucinated_count"]
    blocks = {"U_details": u, "R_details": ["R", "format_checks"], "G_details": g, "F_details": f}
    kept = [n for n in ("run_id", "instance_id", "U", "R", "G", "F", "format_ok", "repaired", "parse_error")
            if n in metrics.columns]
    return metrics.select(
        *kept, *[F.struct(*[c(n) for n in names]).alias(block) for block, names in blocks.items()]
    )
