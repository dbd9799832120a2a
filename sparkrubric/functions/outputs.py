"""Split a model output into explanation and JSON plan, and lay the plan out as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx

# --- fixed values ------------------------------------------------------------------------------------------
FENCED_BLOCK = rf"```(?:json)?{tx.SPACE}*(\{{.*?\}}){tx.SPACE}*```"
NO_BLOCK = "No JSON block found"
# --- end of fixed values -----------------------------------------------------------------------------------

BLOCK_TYPE = "struct<block:string,explanation:string,start:int,stop:int>"


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Make JSON objects with a repeated key parse in this session, the last value winning."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _fenced(text: Column) -> Column:
    before = F.regexp_extract(text, rf"(?s)\A(.*?){FENCED_BLOCK}", 1)
    whole = F.regexp_extract(text, rf"(?s){FENCED_BLOCK}", 0)
    start = F.char_length(before)
    return F.struct(
        F.regexp_extract(text, rf"(?s){FENCED_BLOCK}", 1).alias("block"),
        before.alias("explanation"),
        start.alias("start"),
        (start + F.char_length(whole)).alias("stop"),
    )


def _fold_to_zero(braces: Column, up: str) -> Column:
    """1-based position where the running count, +1 for ``up`` and -1 for the other brace, first returns to 0.

    Only the brace that lowers the count can end the search; 0 when the count never returns.
    """
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("hit"))

    def step(s: Column, brace: Column) -> Column:
        depth = s["depth"] + F.when(brace == up, 1).otherwise(-1)
        found = (s["hit"] == 0) & (brace != up) & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            (s["seen"] + 1).alias("seen"),
            F.when(found, s["seen"] + 1).otherwise(s["hit"]).alias("hit"),
        )

    return F.aggregate(braces, state, step, lambda s: s["hit"])


def _after(brace: str, text: Column, place: Column) -> Column:
    """Place of the next brace after ``place``, 0 if there is none."""
    return F.call_function("locate", F.lit(brace), text, place + 1)


def _naked(text: Column) -> Column:
    """The last balanced ``{...}``.

    A text with one brace of either kind is cut there.  Any other is cut after every brace, so the folds run over braces
    instead of characters and the block and the text before it are joined back from the pieces.
    """

    def locate(pieces: Column) -> Column:
        braces = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.right(p, F.lit(1)))
        return tx.let(braces, lambda b: _cut(pieces, b))

    def _cut(pieces: Column, braces: Column) -> Column:
        from_end = _fold_to_zero(F.reverse(braces), "}")
        first = F.size(braces) - from_end + 1
        return F.when(
            from_end > 0,
            tx.let(
                F.struct(
                    first.alias("first"),
                    _fold_to_zero(F.slice(braces, first, from_end), "{").alias("length"),
                ),
                lambda at: _join(pieces, at["first"], at["length"]),
            ),
        )

    def _join(pieces: Column, first: Column, length: Column) -> Column:
        head = F.array_join(F.slice(pieces, 1, first), "")
        before = F.left(head, F.char_length(head) - 1)
        block = F.concat(F.lit("{"), F.array_join(F.slice(pieces, first + 1, length - 1), ""))
        start = F.char_length(head) - 1
        return F.when(
            length > 0,
            F.struct(
                block.alias("block"),
                before.alias("explanation"),
                start.alias("start"),
                (start + F.char_length(block)).alias("stop"),
            ),
        )

    opens, closes = F.instr(text, "{"), F.instr(text, "}")
    single = (opens > 0) & (opens < closes) & (_after("{", text, opens) == 0) & (_after("}", text, closes) == 0)
    only = F.struct(
        F.substring(text, opens, closes - opens + 1).alias("block"),
        F.left(text, opens - 1).alias("explanation"),
        (opens - 1).alias("start"),
        closes.alias("stop"),
    )
    both = text.contains("{") & text.contains("}")
    return F.when(single, only).when(both, tx.let(F.split(text, r"(?<=[{}])"), locate))


def json_block(text: Column | str) -> Column:
    """Struct ``(block, explanation, start, stop)``: the first fenced object, else the last balanced one, else null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike(rf"(?s){FENCED_BLOCK}"), _fenced(c)).otherwise(_naked(c)).cast(BLOCK_TYPE)


def repair_json(block: Column) -> Column:
    """Drop ``//`` and ``/* */`` comments and trailing commas."""
    out = F.regexp_replace(block, r"(?d)//.*?\n", "\n")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, rf",{tx.SPACE}*\}}", "}")
    return F.regexp_replace(out, rf",{tx.SPACE}*\]", "]")


def parse_outputs(df: DataFrame, output: str = "output") -> DataFrame:
    """Add ``explanation, plan_json, plan, format_ok, repaired, parse_error``.

    ``plan`` is a VARIANT, null when no block parses.  Repair covers comments and trailing commas.  An object that repeats
    a key keeps its last value, for which this sets a session option (``allow_duplicate_keys``).
    """
    allow_duplicate_keys(df.sparkSession)
    found = df.withColumn("_block", json_block(F.coalesce(output, F.lit(""))))
    block = F.col("_block.block")
    parsed = (
        found.withColumn("_strict", F.try_parse_json(block))
        .withColumn("_fixed", F.when(F.col("_strict").isNull(), repair_json(block)))
        .withColumn("plan", F.coalesce("_strict", F.try_parse_json("_fixed")))
        .withColumn("repaired", F.col("_strict").isNull() & F.col("plan").isNotNull())
        .withColumn("plan_json", F.when(F.col("plan").isNotNull(), F.coalesce("_fixed", block)))
    )
    return (
        parsed.withColumn(
            "explanation",
            tx.trim_space(F.coalesce(F.col("_block.explanation"), F.when(block.isNull(), F.col(output)), F.lit(""))),
        )
        .withColumn("format_ok", F.col("plan").isNotNull() & ~F.col("repaired"))
        .withColumn(
            "parse_error",
            F.when(block.isNull(), NO_BLOCK).when(F.col("plan").isNull(), "JSON block does not parse"),
        )
        .drop("_block", "_strict", "_fixed")
    )


def plan_cells(plan: Column | str, plan_json: Column | str) -> Column:
    """Array with one struct per plan key: position, day/slot parts, kind of value, and its refs.

    ``kind`` is list / string / null / other.  ``refs`` holds the list elements (null for a non-string element) or the
    one string; ``n_values`` is the list size or the string length.
    """
    v = F.col(plan) if isinstance(plan, str) else plan
    j = F.col(plan_json) if isinstance(plan_json, str) else plan_json
    order = F.json_object_keys(j)

    def cell(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        shape = F.schema_of_variant(value)
        kind = (
            F.when(shape.startswith("ARRAY<"), "list")
            .when(shape == "STRING", "string")
            .when(value.isNull() | (shape == "VOID"), "null")
            .otherwise("other")
        )
        elements = F.try_variant_get(value, "$", "array<variant>")
        string = F.try_variant_get(value, "$", "string")
        listed = F.transform(
            elements, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
        )
        truthy = (
            F.when(kind == "list", F.size(elements) > 0)
            .when(kind == "string", string != "")
            .when(kind == "null", F.lit(False))
            .otherwise(~F.coalesce(string, F.lit("")).isin("0", "0.0", "false", "{}"))
        )
        parts = tx.split_slot_key(key)
        return F.struct(
            key.alias("key"),
            (F.array_position(order, key).cast("int") - 1).alias("key_pos"),
            parts["day"].alias("day"),
            parts["slot"].alias("slot"),
            kind.alias("kind"),
            F.when(kind == "list", F.size(elements)).when(kind == "string", F.char_length(string)).alias("n_values"),
            truthy.alias("truthy"),
            (F.when(kind == "string", string == "null").otherwise(False)).alias("is_null_word"),
            F.when(kind == "list", listed)
            .when(kind == "string", F.array(string))
            .otherwise(F.array().cast("array<string>"))
            .alias("refs"),
        )

    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.transform(entries, cell), F.array().cast(CELLS_TYPE))


CELLS_TYPE = (
    "array<struct<key:string,key_pos:int,day:string,slot:string,kind:string,n_values:int,truthy:boolean,"
    "is_null_word:boolean,refs:array<string>>>"
)


def plan_refs(cells: Column) -> Column:
    """Every ref of a plan: all list elements, and scalar strings that are neither empty nor the word null."""
    kept = F.filter(
        cells, lambda c: (c["kind"] == "list") | ((c["kind"] == "string") & c["truthy"] & ~c["is_null_word"])
    )
    return F.flatten(F.transform(kept, lambda c: c["refs"]))


def plan_items(df: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """Long form of the cells: one row per ref, one row for an empty value, one row for an empty plan."""
    by_key = df.select(*keys, F.explode_outer(cells).alias("cell"))
    return by_key.select(*keys, "cell.*", F.posexplode_outer("cell.refs").alias("item_pos", "ref")).drop("refs")
