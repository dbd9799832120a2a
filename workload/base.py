"""Shared pieces of the registered queries: table access, planted Romanian letters, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries with their SQL twins, in order of definition."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_PER_CORE = 32 << 20

# The documents hold no Romanian letter, so accented letters are mapped onto them before Romanian text is scored.
PLANT_FROM, PLANT_TO = "éèêçñüöäßàùôíóú", "ăâîșțşţășțâîșțş"


def planted(text: Column | str) -> Column:
    return F.translate(F.col(text) if isinstance(text, str) else text, PLANT_FROM, PLANT_TO)


def planted_sql(text: str = "text") -> str:
    return f"translate({text}, '{PLANT_FROM}', '{PLANT_TO}')"


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table over all cores, as its file may be one split; a large table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_PER_CORE else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the planted text as ``ro_text``."""
    return spread(table(spark, sf_dir, "documents")).withColumn("ro_text", planted("text"))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def strip_sql(x: str) -> str:
    return f"translate({x}, '{tx.ACCENTED}', '{tx.PLAIN}')"


def normalize_sql(x: str) -> str:
    return f"translate({x}, 'şţŞŢ', 'șțȘȚ')"


def words_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {quote(tx.WORD_PATTERN)}), lambda w: lower(w))"


def match_sql(x: str) -> str:
    """SQL twin of ``normalize_match``."""
    spaced = f"translate(translate(lower({x}), 'ăâîșț', 'aaist'), '.,;:!?\"()[]{{}}', '              ')"
    return f"trim(regexp_replace({spaced}, {quote(tx.SPACE + '+')}, ' ', 'g'), ' ')"


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quote(pattern)}))"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, {quote('^' + tx.SPACE + '+|' + tx.SPACE + '+$')}, '', 'g')"
