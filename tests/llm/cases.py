"""Small document tables for the tests of this folder, drawn by a seed."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = [
    "key", "id", "row", "copy", "shuffle_key", "text_key", "line", "n_lines", "n_dropped", "score", "lang_pred", "code",
    "words", "spans", "query", "shard", "kind", "found", "owner", "stratum", "dropped", "of", "chunk", "ids", "bit",
]

WORDS = {
    "en": "the of and with ringer thatch onward stone bleak reading other under thorn wither".split(),
    "fr": "le la des étoile queue ouest mentir rêver eau çà voilà tresse airelle bordé".split(),
}


def words(rng: random.Random, n: int, lang: str = "en") -> list[str]:
    return [rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "st", "x" + str(rng.randrange(30))]) for _ in range(n)]


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages and lines, junk, nulls, empty and repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    texts: list[str] = []
    langs: list[str] = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        kind = i % 10
        if kind in (7, 8):
            of = rng.randrange(len(texts))
            old, lang = texts[of].split(" "), langs[of]
            if kind == 8:
                old[rng.randrange(len(old))] = "changed"
            texts.append(" ".join(old))
        elif kind == 9:
            lang = "en"
            texts.append(" ".join(words(rng, 20) + passage[: rng.randrange(49, 70)] + words(rng, 20)))
        else:
            lines = [" ".join(words(rng, rng.randrange(3, 30), lang)) for _ in range(rng.randrange(1, 6))]
            lines.insert(rng.randrange(len(lines) + 1), f"Job {i} finished in {i * 7} seconds on host h{i}")
            texts.append("\n".join(lines))
        langs.append(lang)
    out = [(i, t, langs[i], f"src{min(3, i % 7)}", len(t)) for i, t in enumerate(texts)]
    long = " ".join(words(rng, 4000))
    out += [
        (n, None, None, None, None),
        (n + 1, "", "en", "src1", 0),
        (n + 2, " \n\t ", "en", None, 4),
        (n + 3, long, "en", "src0", len(long)),
        (n + 4, "!!! 123 ---", None, "src2", 11),
        (None, "the of and with no id at all", "en", "src0", 28),
        (None, None, None, None, None),
        (5, out[5][1], "en", "src0", 1),
        (6, "another text of a repeated id", "en", "src0", 29),
    ]
    return out


def table(spark: SparkSession, data: list[tuple] | None = None, clashes: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    for name in CLASHES if clashes else []:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def same(df: DataFrame) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)
