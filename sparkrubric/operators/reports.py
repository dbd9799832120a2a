"""Aggregates, comparisons and listings over metrics rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------------------------
FINAL_WEIGHTS = {"U": 0.50, "G": 0.25, "F": 0.25}
PASS_MARK = 0.7
LARGE_PENALTY, MINOR_PENALTY, LARGE_INSTANCE_DELTA = 0.1, 0.05, 0.2
QUALITY_NOTE_BELOW = 0.95
# --- end of fixed values -----------------------------------------------------------------------------------


def final_score(u: Column, g: Column, f: Column) -> Column:
    return F.lit(FINAL_WEIGHTS["U"]) * u + F.lit(FINAL_WEIGHTS["G"]) * g + F.lit(FINAL_WEIGHTS["F"]) * f


# --- predicates ------------------------------------------------------------------------------------------------
def passed() -> Column:
    """U, R and F all at the pass mark."""
    return (F.col("U") >= PASS_MARK) & (F.col("R") >= PASS_MARK) & (F.col("F") >= PASS_MARK)


def passed_strict() -> Column:
    """U and R above the pass mark."""
    return (F.col("U") > PASS_MARK) & (F.col("R") > PASS_MARK)


def issue_flags() -> dict[str, Column]:
    return {
        "has_constraint_violations": F.col("U") < 1.0,
        "has_reasoning_failures": F.col("R") < 1.0,
        "has_faithfulness_issues": F.col("F") < 1.0,
        "has_quality_notes": F.col("G") < QUALITY_NOTE_BELOW,
    }


# --- aggregates ------------------------------------------------------------------------------------------------
def run_averages(metrics: DataFrame, group: list[str]) -> DataFrame:
    """Averages over all instances (missing scored 0), over answered ones, and both final scores."""
    answered = ~F.col("missing")
    names = [n for n in ("U", "G", "F", "U_constraints", "U_format") if n in metrics.columns]
    out = metrics.groupBy(*group).agg(
        F.count(F.lit(1)).alias("instances"),
        F.count_if("missing").alias("missing_count"),
        *[F.avg(n).alias(f"avg_{n}") for n in names],
        *[F.avg(F.when(answered, F.col(n))).alias(f"answered_{n}") for n in ("U", "G", "F")],
    )
    return out.withColumn(
        "final_score", final_score(F.col("avg_U"), F.col("avg_G"), F.col("avg_F"))
    ).withColumn(
        "answered_score", final_score(F.col("answered_U"), F.col("answered_G"), F.col("answered_F"))
    )


def leaderboard(metrics: DataFrame, model: str) -> DataFrame:
    """Average U, R, G, F per model and their mean."""
    out = metrics.groupBy(model).agg(*[F.avg(m).alias(f"avg_{m}") for m in "URGF"])
    return out.withColumn(
        "avg_all", (F.col("avg_U") + F.col("avg_R") + F.col("avg_G") + F.col("avg_F")) / F.lit(4.0)
    )


def parse_failures(parsed: DataFrame, group: list[str]) -> DataFrame:
    """JSON failure count and rate per run.  Repair covers comments and trailing commas only."""
    return parsed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("plan").isNull()).alias("failures"),
        (F.count_if(F.col("plan").isNull()) / F.count(F.lit(1))).alias("failure_rate"),
    )


def valid_only_averages(metrics: DataFrame, group: list[str], valid: Column) -> DataFrame:
    return metrics.groupBy(*group).agg(
        F.count_if(valid).alias("n"), *[F.avg(F.when(valid, F.col(m))).alias(f"avg_{m}") for m in "URGF"]
    )


def constraint_statistics(per_instance: DataFrame, world_type: str, count: str) -> DataFrame:
    return per_instance.groupBy(world_type).agg(
        F.avg(count).alias("avg_constraints"),
        F.min(count).alias("min_constraints"),
        F.max(count).alias("max_constraints"),
    )


#: Share of a group's rows on either side of a percentile that its sketch leaves open, ten times the sketch's error.
PERCENTILES, SKETCH_ACCURACY, OPEN_SHARE = (50, 95, 99), 10_000, 0.001


def latency_summary(outputs: DataFrame, group: list[str], latency: str = "latency") -> DataFrame:
    """Count, mean, bounds and exact percentiles (linear between neighbours) of a group's latencies, nulls left out.

    A mergeable sketch brackets each percentile; rows below a bracket are counted, and only the different values inside
    it, a few thousandths of a group, are put in order.  A group without a latency has a count of 0 and nulls."""
    shares = [min(max(q / 100 + d, 0.0), 1.0) for q in PERCENTILES for d in (-OPEN_SHARE, OPEN_SHARE)]
    value = F.col(latency).cast("double")
    summary = outputs.groupBy(*group).agg(
        F.count(latency).alias("n"),
        F.avg(latency).alias("avg_latency"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
        F.percentile_approx(value, shares, SKETCH_ACCURACY).alias("_at"),
    )
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"b.{g}"))
    rows = outputs.where(value.isNotNull()).select(*group, value.alias("_x")).groupBy(*group, "_x").agg(F.count("_x").alias("_c"))
    placed = rows.alias("r").join(summary.select(*group, "n", "_at").alias("b"), same).select("r.*", "n", "_at")
    found = []
    for k, q in enumerate(PERCENTILES):
        low, high, x = F.col("_at")[2 * k], F.col("_at")[2 * k + 1], F.col("_x")
        inside = F.when(x.between(low, high), F.struct(x.alias("x"), F.col("_c").alias("c")))
        parts = F.struct(
            F.coalesce(F.sum(F.when(x < low, F.col("_c"))), F.lit(0)).alias("below"),
            F.max(F.when(x < low, x)).alias("before"),
            F.array_sort(F.collect_list(inside)).alias("inside"),
            F.min(F.when(x > high, x)).alias("after"),
        )
        found.append(parts.alias(f"_p{q}"))
    picked = placed.groupBy(*group, "n").agg(*found)
    exact = picked.select(*group, *[_at_rank(F.col(f"_p{q}"), F.col("n"), q / 100).alias(f"p{q}_latency") for q in PERCENTILES])
    columns = [f"b.{c}" for c in (*group, "n", "avg_latency", "min_latency", "max_latency")]
    joined = summary.alias("b").join(exact.alias("r"), same, "left")
    return joined.select(*columns, *[f"r.p{q}_latency" for q in PERCENTILES])


def _at_rank(bracket: Column, n: Column, share: float) -> Column:
    """The value at rank ``share * (n - 1)`` from 0, between its two neighbours where that is no whole number."""
    rank = (n - 1) * F.lit(share)

    def at(place: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            upto = s["upto"] + v["c"]
            here = F.coalesce(s["x"], F.when(place < upto, v["x"]))
            return F.struct(upto.alias("upto"), here.alias("x"))

        none = F.lit(None).cast("double")
        # one rank before the bracket and one behind it are known too
        early = F.when(place == bracket["below"] - 1, bracket["before"])
        start = F.struct(bracket["below"].alias("upto"), early.alias("x"))
        lost = F.raise_error(F.lit("a percentile lies outside of its bracket")).cast("double")

        def finish(s: Column) -> Column:
            behind = F.when(place == s["upto"], bracket["after"])
            return F.coalesce(s["x"], behind, lost)

        known = F.aggregate(bracket["inside"], start, step, finish)
        return F.when(place < bracket["below"] - 1, lost).otherwise(F.coalesce(known, none))

    low, high = F.floor(rank), F.ceil(rank)
    return at(low) + (rank - low) * (at(high) - at(low))


# --- comparisons -------------------------------------------------------------------------------------------------
def model_table(metrics: DataFrame, key: str, model: str, models: list[str], value: Column) -> DataFrame:
    """One row per instance, one column per model."""
    picked = metrics.select(key, model, value.alias("_value"))
    return picked.groupBy(key).pivot(model, models).agg(F.first("_value", ignorenulls=True))


def penalty_class(delta: Column) -> Column:
    return F.when(delta > LARGE_PENALTY, "large").when(delta > MINOR_PENALTY, "minor").otherwise("none")


def paired(instances: DataFrame, ro: DataFrame, en: DataFrame, key: str, columns: str = "URGF") -> DataFrame:
    """Rows with an instance and an output in both languages: ``U_ro, U_en, ...``."""
    left = ro.select(key, *[F.col(c).alias(f"{c}_ro") for c in columns])
    right = en.select(key, *[F.col(c).alias(f"{c}_en") for c in columns])
    return instances.select(key).join(left, key).join(right, key)


def language_delta(pairs: DataFrame) -> DataFrame:
    """One row: averages per language, penalties of U, R, F, their class, and the averages of G."""
    avgs = pairs.agg(
        F.count(F.lit(1)).alias("instances"),
        *[F.avg(f"{c}_{lang}").alias(f"{c}_{lang}") for c in "URGF" for lang in ("ro", "en")],
    )
    deltas = avgs.withColumns({f"delta_{c}": F.col(f"{c}_en") - F.col(f"{c}_ro") for c in "URF"})
    return deltas.withColumns({f"class_{c}": penalty_class(F.col(f"delta_{c}")) for c in "URF"})


def instance_delta(pairs: DataFrame) -> DataFrame:
    """Per-instance penalties and the flag for a large one."""
    out = pairs.withColumns({f"delta_{c}": F.col(f"{c}_en") - F.col(f"{c}_ro") for c in "URF"})
    large = F.greatest(*[F.abs(f"delta_{c}") for c in "URF"]) > LARGE_INSTANCE_DELTA
    return out.withColumn("is_large", large)


# --- listings ------------------------------------------------------------------------------------------------------
def by_language(language: Column, ro: Column, en: Column) -> Column:
    """Prompt or description in the run's language: English for en, else Romanian."""
    return F.when(language == "en", en).otherwise(ro)


def failing_checks(results: DataFrame, described: DataFrame, key: list[str], check_id: str) -> DataFrame:
    """Unsatisfied checks with their description, or a stock one where the instance does not know the check."""
    return (
        results.where(~F.col("satisfied"))
        .join(described, [*key, check_id], "left")
        .withColumn("description", F.coalesce("description", F.lit("Format violation")))
    )


def missing_names(missing: DataFrame, entities: DataFrame, key: list[str], entity_id: str, name: str) -> DataFrame:
    """Names of entities a text left out."""
    return missing.join(entities, [*key, entity_id], "left").withColumn(
        name, F.coalesce(name, F.lit("(unknown entity)"))
    )


def findings(metrics: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Failure analysis: one row per finding of an output (checks, missing entities, quality notes)."""
    checks = results.where(~F.col("satisfied")).select(
        *keys, F.lit("check").alias("kind"), F.col("check_fn").alias("subject")
    )

    def found(kind: str, subjects: Column) -> Column:
        return F.transform(subjects, lambda s: F.struct(F.lit(kind).alias("kind"), s.cast("string").alias("subject")))

    none = F.array().cast("array<string>")
    notes = F.array_compact(
        F.array(
            F.when(F.col("dia_missing") > 0, "missing diacritics"),
            F.when(F.col("english_words") > 0, "English words"),
            F.when(F.col("total_issues") > 0, "punctuation"),
            F.when(F.col("is_likely_english"), "mostly English"),
            F.when(F.col("is_too_short"), "too short"),
        )
    )
    noted = F.when(F.col("G") < QUALITY_NOTE_BELOW, notes).otherwise(none)
    both = F.concat(found("missing entity", F.coalesce("missing", none)), found("quality", noted))
    # one pass over the metrics, and no filter on them or one that explode brings along: Spark would put all expressions of
    # a score into it and work them out again for each place that names one
    rest = metrics.select(*keys, F.explode_outer(both).alias("_found")).where("_found IS NOT NULL").select(*keys, "_found.*")
    return checks.unionByName(rest)


def overview(instances: DataFrame) -> DataFrame:
    """One line per instance: type, difficulty, entities, constraints and the Romanian prompt."""
    entities = F.transform(F.map_entries("world.canonical_entities"), lambda e: e["value"]["name"])
    constraints = F.transform("world.constraints", lambda c: c["description_ro"])
    return instances.select(
        "instance_id",
        F.upper("world.world_type").alias("world_type"),
        F.coalesce(F.try_variant_get("world.meta", "$.difficulty", "string"), F.lit("N/A")).alias("difficulty"),
        F.array_join(entities, "; ").alias("entities"),
        F.array_join(constraints, "; ").alias("constraints"),
        "prompt_ro",
    )
