"""Secret scan with corpus-wide ownership frequency.

Patterns find candidates; the hash of each candidate's value is counted over the whole corpus by distinct owners and
repositories.  A value that several owners hold is a widely copied example; one that a single owner holds, and that isn't
a run of few characters, looks live.  Candidates of the loose ``generic`` pattern become spans only if they look live; the
strict patterns' spans all stay, whatever the counts say.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrubric.llm.storage import written

KEYWORD = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: Kind: its pattern, the prefix that isn't part of the value, and the least characters of the value.  Runs of hex digits
#: and access keys shorter than the least can't hold a longer one, so the length is part of their patterns.
KINDS: list[tuple[str, str, str, int]] = [
    ("assign", KEYWORD + "[A-Za-z0-9+/_.=-]+", "^" + KEYWORD, 8),
    ("access", "AKIA[A-Z0-9]{12,}", "", 16),
    ("hex", "[0-9a-f]{32,}", "", 32),
    ("generic", "[A-Za-z0-9+/_-]{20,}", "", 20),
]
BASE = len(KINDS) - 1
#: Fewer different characters than this don't look like a credential.
LEAST_VARIETY = 8


def _found(kind: int) -> Column:
    """The matches of a kind in ``text`` with the lengths of the gaps before them."""
    name, pattern, prefix, least = KINDS[kind]
    gaps = F.split("text", pattern, -1)

    def match(m: Column, i: Column) -> Column:
        value = F.regexp_replace(m, prefix, "") if prefix else m
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(F.get(gaps, i)).alias("gap"),
            F.length(m).alias("size"),
            F.when(F.length(value) >= least, value).alias("value"),
        )

    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:string>>")
    return F.when(F.col("text").rlike(pattern), F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), match)).otherwise(none)


def _several_kinds(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def candidates(documents: DataFrame) -> DataFrame:
    """``(doc_id, key, owner, repository, kind, start, end, hash, varied)`` of ``documents(doc_id, key, owner, repository, text)``."""
    all_kinds = F.concat(*[_found(n) for n in range(len(KINDS))])
    rows = documents.select("doc_id", "key", "owner", "repository", F.inline(all_kinds)).distinct()
    so_far = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")
    rows = rows.withColumn("end", end).where(F.col("value").isNotNull())
    varied = F.size(F.array_distinct(F.split("value", ""))) >= LEAST_VARIETY
    strict = (F.col("kind") < BASE) | _several_kinds(F.col("value"))
    start = (F.col("end") - F.col("size")).alias("start")
    return rows.where(strict).select(
        "doc_id", "key", "owner", "repository", "kind", start, "end", F.xxhash64("value").alias("hash"), varied.alias("varied")
    )


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, owners, repositories)``: in how many distinct ones a value lies.  A null owner is one of its own."""
    seen = found.select("hash", F.struct("owner").alias("owner"), F.struct("repository").alias("repository")).distinct()
    return seen.groupBy("hash").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories")
    )


def text_ownership(found: DataFrame) -> DataFrame:
    """``(hash, text_owners, texts)``: in how many different texts a value lies, and how many owners those have if copies
    of a text count once, for the smallest of its owners."""
    first = found.groupBy("hash", "key").agg(F.min(F.struct("owner")).alias("owner"))
    return first.groupBy("hash").agg(F.countDistinct("owner").alias("text_owners"), F.count("*").alias("texts"))


def scan(
    documents: DataFrame, owner: str = "source", repository: str = "doc_id", copied_by: int = 2, copied_in: int | None = None
) -> DataFrame:
    """``(doc_id, found)`` of every row of ``documents(doc_id, text)`` and its owner and repository columns.

    ``found`` lists the spans by start and kind: ``kind, start, end`` (code points, end exclusive), ``owners``,
    ``repositories`` and ``live``: held by fewer than ``copied_by`` owners and of some variety.  With ``copied_in``, a value
    must also lie in fewer than so many different texts, and copies of a text count once, for owners too.  A ``generic``
    span is listed only if it looks live and overlaps no other.  A null text has no spans; a null owner or repository counts as one
    of its own; rows with a null or repeated doc_id stay; other columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    key = F.xxhash64("text").alias("key")
    rows = documents.select(
        doc_id, text.alias("text"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository")
    ).withColumn("key", key)
    found = written(candidates(rows), "candidates")
    known = found.join(written(ownership(found), "ownership"), "hash")
    live = F.col("varied") & (F.col("owners") < copied_by)
    if copied_in is not None:
        known = known.join(written(text_ownership(found), "texts"), "hash")
        live = F.col("varied") & (F.col("text_owners") < copied_by) & (F.col("texts") < copied_in)
    by_start = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    base = F.col("kind") < BASE
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    alone = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    known = known.withColumn("live", live).withColumn("alone", alone).where(base | (F.col("live") & F.col("alone")))
    span = F.struct("start", "kind", "end", "owners", "repositories", "live")
    spans = known.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    spans = written(spans.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "spans"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    joined = rows.select("doc_id", "key").join(spans, same, "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    return joined.select("doc_id", F.coalesce("spans", none).alias("found"))


def span_list(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
