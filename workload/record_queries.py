"""Queries over outputs and metrics: sources and sinks, parsing, joins, windows, sets, scores, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrubric.functions import outputs as op
from sparkrubric.functions import text as tx
from sparkrubric.operators import approximate as ap
from sparkrubric.operators import entities as en
from sparkrubric.operators import ordered as od
from sparkrubric.operators import quality as ql
from sparkrubric.operators import reports as rp
from sparkrubric.operators import scoring as sc
from sparkrubric.sources import tables as tb
from sparkrubric.sources.lineage import materialize
from workload.base import Registry, count_sql, documents, match_sql, quote, r6, spread, table, trim_sql, words_sql
from workload.plan_queries import _ALL_SQL, _IT, order_check_results, order_items
from workload.text_queries import report_sql

reg = Registry()

# --- sources and sinks ----------------------------------------------------------------------------------------


@reg.add(
    "source_instances",
    """SELECT 'order_' || o_orderkey AS instance_id, 'travel' AS world_type, o_custkey AS seed, 2::INT AS num_days,
              o_orderpriority AS first_entity, 'check_budget_limit' AS check_fn,
              round(o_totalprice, 2) AS max_budget FROM orders""",
)
def _(spark, sf):
    ident = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    entity = F.struct(
        F.lit("A1").alias("id"),
        F.col("o_orderpriority").alias("name"),
        F.array(F.lower("o_orderpriority")).alias("aliases"),
        F.struct(F.col("o_totalprice").alias("cost_lei")).alias("attributes"),
    )
    check = F.struct(
        F.lit("C_BUDGET").alias("id"),
        F.lit("instruction").alias("type"),
        F.lit("check_budget_limit").alias("check_fn"),
        F.struct(F.col("o_totalprice").alias("max_budget")).alias("params"),
    )
    world = F.struct(
        ident.alias("world_id"),
        F.lit("travel").alias("world_type"),
        F.col("o_custkey").alias("seed"),
        F.struct(F.lit(2).alias("num_days")).alias("payload"),
        F.array(check).alias("constraints"),
        F.create_map(F.lit("A1"), entity).alias("canonical_entities"),
    )
    lines = table(spark, sf, "orders").select(F.to_json(F.struct(ident.alias("instance_id"), world.alias("world"))).alias("line"))
    read = lines.select(F.from_json("line", tb.INSTANCE_SCHEMA).alias("i")).select("i.*")
    first = F.col("world.constraints")[0]
    return read.select(
        "instance_id",
        "world.world_type",
        "world.seed",
        F.try_variant_get("world.payload", "$.num_days", "int").alias("num_days"),
        tb.entity_structs(F.col("world.canonical_entities"))[0]["name"].alias("first_entity"),
        first["check_fn"].alias("check_fn"),
        F.round(F.try_variant_get(first["params"], "$.max_budget", "double"), 2).alias("max_budget"),
    )


@reg.add(
    "source_latest_output",
    """SELECT user_id, event_id, event_type, value FROM
       (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
       WHERE k = 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return tb.latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@reg.add(
    "source_run_identity",
    """SELECT user_id AS run_id, coalesce(arg_min(CASE WHEN event_type <> 'view' THEN event_type END, event_id)
                FILTER (WHERE event_type <> 'view'), user_id::VARCHAR) AS run_model,
              coalesce(arg_min(CASE WHEN value > 20 THEN 'en' ELSE 'ro' END, event_id), 'ro') AS run_language
       FROM events GROUP BY user_id""",
)
def _(spark, sf):
    outputs = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("model"),
        F.when(F.col("value") > 20, "en").otherwise("ro").alias("language"),
        F.col("event_id").alias("row_pos"),
    )
    return tb.run_identity(outputs).withColumn("run_id", F.col("run_id").cast("bigint"))


@reg.add(
    "source_run_language",
    "SELECT source, coalesce(arg_min(lang, doc_id), 'ro') AS run_language FROM documents GROUP BY source",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumnsRenamed({"lang": "language", "doc_id": "row_pos"})
    runs = tb.run_identity(docs.withColumn("model", F.lit(None).cast("string")), "source")
    return runs.select("source", "run_language")


@reg.add(
    "sink_metrics_json",
    f"""SELECT md5(to_json({{'doc_id': doc_id, 'source': source, 'lang': lang,
                             'n_words': {count_sql('text', tx.NON_SPACE + '+')}::BIGINT,
                             'text': text}})) AS digest, doc_id FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", "lang", tx.space_word_count("text").cast("bigint").alias("n_words"), "text",
    )
    return docs.select("doc_id", F.md5(tb.as_json(docs)).alias("digest"))


@reg.add(
    "sink_failed_ids",
    "SELECT o_orderkey AS instance_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(spark, sf):
    instances = table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"))
    outputs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"))
    return tb.failed_ids(instances, outputs)


# --- parsing -----------------------------------------------------------------------------------------------------
# Ten kinds of output, by document: fenced, naked, trailing commas, none, comment, broken, JSON first, two blocks,
# stray closing brace, stray opening brace.  (name, text before, block, text after, strict, repaired)
_KINDS = [
    ("fenced", "\n\n```json\n", '{"day1": ["a", "b"], "day2": []}', "\n```\n", True, False),
    ("naked", "\n\n", '{"day1": ["a"], "n": {"x": {"y": 1}}}', "\n", True, False),
    ("commas", "\n", '{"day1": ["a", "b",], "day2": ["c"], }', "", False, True),
    ("none", "", None, "", False, False),
    ("comment", "\n", '{"day1": ["a"], // first\n /* no */ "day2": null}', " end", False, True),
    ("broken", "\n", '{"day1": [ }', "", False, False),
    ("first", None, '{"answer": "x"}', "\n", True, False),
    ("two", ' {"old": 1} then ', '{"answer": "null", "day1": "b"}', " tail", True, False),
    ("stray_close", ' {"a": 1} } ', None, "", False, False),
    ("stray_open", ' {"a": 1} { ', None, "", False, False),
]


def _piece(n: int, sql: bool):
    """Output text of kind ``n`` around the document text."""
    _, before, block, after, _, _ = _KINDS[n]
    parts = [block or "", after] if before is None else [before, block or "", after]
    if before is None:
        return parts, True
    return parts, False


def outputs(spark, sf):
    """One output per document."""
    kind = (F.col("doc_id") % len(_KINDS)).cast("int")
    text = None
    for n in range(len(_KINDS)):
        parts, leads = _piece(n, False)
        fixed = F.lit("".join(parts))
        whole = F.concat(fixed, F.col("text")) if leads else F.concat(F.col("text"), fixed)
        text = F.when(kind == n, whole) if text is None else text.when(kind == n, whole)
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("instance_id"), F.col("source").alias("run_id"), "lang", text.alias("output")
    )


def _outputs_sql() -> str:
    """Expected parse, written down per kind instead of parsed."""
    whole, block, lead, strict, fixed = [], [], [], [], []
    for n, (_, before, blk, after, ok, rep) in enumerate(_KINDS):
        when = f"WHEN doc_id % {len(_KINDS)} = {n} THEN"
        stop = before if before is not None else ""
        if blk is None:
            lead.append(f"{when} text || {quote(stop + after)}")
            block.append(f"{when} NULL")
        elif before is None:
            lead.append(f"{when} ''")
            block.append(f"{when} {quote(blk)}")
        else:
            cut = "\n\n" if n == 0 else stop
            lead.append(f"{when} text || {quote(cut)}")
            block.append(f"{when} {quote(blk)}")
        strict.append(f"{when} {ok}")
        fixed.append(f"{when} {rep}")
    cols = {"lead": lead, "block": block, "format_ok": strict, "repaired": fixed}
    return "SELECT doc_id, source, " + ", ".join(f"CASE {' '.join(v)} END AS {k}" for k, v in cols.items()) + " FROM documents"


_PARSED = _outputs_sql()


@reg.add(
    "parse_block",
    f"SELECT doc_id AS instance_id, block, CASE WHEN block IS NOT NULL THEN length(lead) END::INT AS start, "
    f"md5({trim_sql('lead')}) AS explanation FROM ({_PARSED})",
)
def _(spark, sf):
    found = outputs(spark, sf).withColumn("b", op.json_block("output"))
    parsed = op.parse_outputs(found)
    return parsed.select(
        "instance_id", "b.block", "b.start", F.md5("explanation").alias("explanation")
    )


@reg.add(
    "parse_plan",
    f"SELECT doc_id AS instance_id, format_ok, repaired, format_ok OR repaired AS has_plan, "
    f"CASE WHEN block IS NULL THEN 'No JSON block found' WHEN NOT (format_ok OR repaired) "
    f"THEN 'JSON block does not parse' END AS parse_error FROM ({_PARSED})",
)
def _(spark, sf):
    parsed = op.parse_outputs(outputs(spark, sf))
    return parsed.select(
        "instance_id", "format_ok", "repaired", F.col("plan").isNotNull().alias("has_plan"), "parse_error"
    )


_ITEM_ROWS = {
    0: [("day1", 0, "list", "a", 0), ("day1", 0, "list", "b", 1), ("day2", 1, "list", None, None)],
    1: [("day1", 0, "list", "a", 0), ("n", 1, "other", None, None)],
    2: [("day1", 0, "list", "a", 0), ("day1", 0, "list", "b", 1), ("day2", 1, "list", "c", 0)],
    4: [("day1", 0, "list", "a", 0), ("day2", 1, "null", None, None)],
    6: [("answer", 0, "string", "x", 0)],
    7: [("answer", 0, "string", "null", 0), ("day1", 1, "string", "b", 0)],
}


def _val(x) -> str:
    return "NULL" if x is None else quote(x) if isinstance(x, str) else str(x)


_ITEMS_SQL = " UNION ALL ".join(
    f"SELECT doc_id AS instance_id, {quote(k)} AS key, {p}::INT AS key_pos, {quote(kind)} AS kind, "
    f"{_val(ref)}::VARCHAR AS ref, {_val(pos)}::INT AS item_pos FROM documents WHERE doc_id % {len(_KINDS)} = {n}"
    for n, rows in _ITEM_ROWS.items()
    for k, p, kind, ref, pos in rows
)


@reg.add("plan_items", _ITEMS_SQL)
def _(spark, sf):
    items = op.plan_items(sc.parse_run(outputs(spark, sf)), ["instance_id"])
    return items.where("key IS NOT NULL").select("instance_id", "key", "key_pos", "kind", "ref", "item_pos")


@reg.add(
    "plan_refs",
    f"""SELECT instance_id, count(*) AS n_refs, string_agg(ref, ',' ORDER BY key_pos, item_pos) AS refs
        FROM ({_ITEMS_SQL}) WHERE ref IS NOT NULL AND (kind = 'list' OR ref NOT IN ('', 'null')) GROUP BY 1""",
)
def _(spark, sf):
    run = sc.parse_run(outputs(spark, sf)).where(F.size("refs") > 0)
    return run.select("instance_id", F.size("refs").cast("bigint").alias("n_refs"), F.array_join("refs", ",").alias("refs"))


@reg.add(
    "plan_keys",
    "SELECT key, kind, count(*) AS n, sum(v)::BIGINT AS total FROM "
    "(SELECT unnest(json_keys(props)) AS key, 'other' AS kind, (props->>'k')::INT AS v FROM events) GROUP BY 1, 2",
)
def _(spark, sf):
    parsed = table(spark, sf, "events").withColumn("plan", F.try_parse_json("props"))
    cells = parsed.select("plan", F.explode(op.plan_cells("plan", "props")).alias("c"))
    return cells.groupBy("c.key", "c.kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("plan", "$.k", "bigint")).alias("total")
    )


@reg.add(
    "parse_failures",
    f"""SELECT source AS run_id, count(*) AS n, count(*) FILTER (WHERE NOT (format_ok OR repaired)) AS failures,
               round(count(*) FILTER (WHERE NOT (format_ok OR repaired)) / count(*), 6) AS failure_rate
        FROM ({_PARSED}) GROUP BY 1""",
)
def _(spark, sf):
    rates = rp.parse_failures(op.parse_outputs(outputs(spark, sf)), ["run_id"])
    return rates.select("run_id", "n", "failures", r6("failure_rate").alias("failure_rate"))


# --- joins ----------------------------------------------------------------------------------------------------------
# A ref is a part id, a part name in odd case and blanks, or a word no part has.
_REF_SQL = """CASE l_partkey % 3 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN '  ' || upper(p_name) || ' '
              ELSE 'no part ' || l_linenumber END"""
_FIRST_PART = "(SELECT lower(p_name) AS k, min(p_partkey)::VARCHAR AS first FROM part GROUP BY 1)"


def line_refs(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pick = F.col("l_partkey") % 3
    ref = (
        F.when(pick == 0, F.col("l_partkey").cast("string"))
        .when(pick == 1, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
        .otherwise(F.concat(F.lit("no part "), F.col("l_linenumber").cast("string")))
    )
    refs = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", ref.alias("ref"))
    return refs, part


@reg.add(
    "resolve_refs",
    f"""SELECT coalesce(id, first) AS entity_id, coalesce(id, first, ref) AS final_id, count(*) AS n,
               count(DISTINCT o)::BIGINT AS orders
        FROM (SELECT l_orderkey AS o, {_REF_SQL} AS ref, CASE WHEN l_partkey % 3 = 0 THEN l_partkey::VARCHAR END AS id
              FROM lineitem JOIN part ON l_partkey = p_partkey)
        LEFT JOIN {_FIRST_PART} ON lower(trim(ref)) = k GROUP BY 1, 2""",
)
def _(spark, sf):
    refs, part = line_refs(spark, sf)
    keys = en.entity_keys(part, [], "p_partkey", "p_partkey", F.array("p_name"))
    resolved = en.resolve_by_join(refs, keys, [])
    return resolved.groupBy("entity_id", "final_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders")
    )


@reg.add(
    "resolve_refs_normalized",
    f"""SELECT coalesce(id, first) AS entity_id, count(*) AS n
        FROM (SELECT {_REF_SQL} AS ref, CASE WHEN l_partkey % 3 = 0 THEN l_partkey::VARCHAR END AS id
              FROM lineitem JOIN part ON l_partkey = p_partkey)
        LEFT JOIN (SELECT {match_sql('p_name')} AS k, min(p_partkey)::VARCHAR AS first FROM part GROUP BY 1)
          ON {match_sql('ref')} = k GROUP BY 1""",
)
def _(spark, sf):
    refs, part = line_refs(spark, sf)
    keys = en.entity_keys(part, [], "p_partkey", "p_partkey", F.array("p_name"), normalized=True)
    resolved = en.resolve_by_join(refs, keys, [], normalized=True, keep_unresolved=False)
    return resolved.groupBy(F.col("final_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))


@reg.add(
    "first_entity_per_name",
    "SELECT lower(p_name) AS lookup, min(p_partkey)::VARCHAR AS entity_id FROM part GROUP BY 1",
)
def _(spark, sf):
    keys = en.entity_keys(table(spark, sf, "part"), [], "p_partkey", "p_partkey", F.array("p_name"))
    return keys.where("rank = 1").select("lookup", "entity_id")


_FOUND_D = f"d AS MATERIALIZED (SELECT doc_id, {match_sql('text')} AS body FROM documents)"
_FOUND = f"""
    b AS MATERIALIZED (SELECT item_id, {match_sql('text')} AS term FROM benchmark),
    {_FOUND_D},
    found AS MATERIALIZED (SELECT doc_id, item_id FROM d JOIN b ON contains(body, term))
"""


def mentioned(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return en.term_mentions(docs, "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")


# short names, "the" among them: first word and first two words of the items, as often as documents hold them
@reg.add(
    "short_mentions",
    f"""WITH {_FOUND_D},
        w AS (SELECT string_split({match_sql('text')}, ' ') AS words FROM benchmark),
        t AS MATERIALIZED (SELECT DISTINCT unnest([words[1], array_to_string(words[1:2], ' '), 'the']) AS term FROM w)
        SELECT term, count(*) AS n_docs FROM d JOIN t ON contains(body, term) WHERE term <> '' GROUP BY term""",
)
def _(spark, sf):
    words = F.split(tx.normalize_match("text"), " ")
    names = F.array(F.get(words, 0), F.array_join(F.slice(words, 1, 2), " "), F.lit("the"))
    terms = table(spark, sf, "benchmark").select(F.explode(names).alias("term")).distinct()
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    found = en.term_mentions(docs, "doc_id", "text", terms.withColumn("name", F.col("term")), "term", "name")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def approximately_mentioned(spark, sf):
    """Names of the benchmark's items, the first four words and the next three, in documents with planted typos and
    negations."""
    words = F.split("text", "[ \n]+")
    names = table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(F.array(F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, 5, 3), " "))).alias("position", "name")
    )
    typos = F.regexp_replace(F.regexp_replace("text", "er ", "r "), "([a-z])the", "$1hte")
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.regexp_replace(typos, " (der|of) ", " nu ").alias("text"))
    return ap.approximate_mentions(docs, "doc_id", "text", names, "item_id", "position", "name")


# every window of every text is beyond SQL's means; the tests hold both queries to a version that scores them all
@reg.add("approximate_mentions")
def _(spark, sf):
    return approximately_mentioned(spark, sf).withColumn("score", r6("score"))


@reg.add("approximate_best_mention")
def _(spark, sf):
    best = ap.best_mentions(approximately_mentioned(spark, sf), "doc_id", "item_id", "position")
    return best.withColumn("score", r6("score"))


@reg.add("mention_join", f"WITH {_FOUND} SELECT doc_id, item_id FROM found")
def _(spark, sf):
    return mentioned(spark, sf)


@reg.add(
    "hallucination_join",
    f"WITH {_FOUND} SELECT doc_id, item_id FROM found WHERE item_id % 4 <> doc_id % 4",
)
def _(spark, sf):
    # a document plans the items of its own residue
    return mentioned(spark, sf).where("item_id % 4 <> doc_id % 4")


def planned_items(spark, sf):
    """Planned item count per document residue; every document plans the benchmark items of its residue."""
    return table(spark, sf, "benchmark").groupBy((F.col("item_id") % 4).alias("r")).agg(
        F.count(F.lit(1)).alias("total_count")
    )


def document_faithfulness(spark, sf):
    hits = mentioned(spark, sf).groupBy("doc_id").agg(
        F.count_if(F.expr("item_id % 4 = doc_id % 4")).alias("mentioned_count"),
        F.count_if(F.expr("item_id % 4 <> doc_id % 4")).alias("hallucinated_count"),
    )
    docs = table(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") % 4).alias("r"))
    counted = (
        docs.join(planned_items(spark, sf), "r", "left")
        .join(hits, "doc_id", "left")
        .na.fill(0, ["total_count", "mentioned_count", "hallucinated_count"])
    )
    return en.faithfulness_score(counted, F.col("total_count") == 0)


@reg.add(
    "faithfulness",
    f"""WITH {_FOUND},
        hit AS (SELECT doc_id, count(*) FILTER (WHERE item_id % 4 = doc_id % 4) AS m,
                       count(*) FILTER (WHERE item_id % 4 <> doc_id % 4) AS h FROM found GROUP BY 1),
        plan AS (SELECT item_id % 4 AS r, count(*) AS t FROM benchmark GROUP BY 1)
        SELECT doc_id, coalesce(m, 0) AS mentioned_count, coalesce(h, 0) AS hallucinated_count, t AS total_count,
               round(coalesce(m, 0) / t * pow(0.9, coalesce(h, 0)), 6) AS "F_linear",
               round(pow(coalesce(m, 0) / t * pow(0.9, coalesce(h, 0)), 3), 6) AS "F"
        FROM documents LEFT JOIN hit USING (doc_id) JOIN plan ON r = doc_id % 4""",
)
def _(spark, sf):
    f = document_faithfulness(spark, sf)
    return f.select(
        "doc_id", "mentioned_count", "hallucinated_count", "total_count", r6("F_linear").alias("F_linear"),
        r6("F").alias("F"),
    )


@reg.add(
    "missing_entity_names",
    f"""WITH {_FOUND},
        plan AS (SELECT d.doc_id, b.item_id, md5(b.text) AS name FROM documents d JOIN benchmark b ON b.item_id % 4 = d.doc_id % 4
                 UNION ALL SELECT doc_id, -1, NULL FROM documents)
        SELECT doc_id, item_id, coalesce(name, '(unknown entity)') AS name FROM plan
        WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = plan.doc_id AND f.item_id = plan.item_id)""",
)
def _(spark, sf):
    # each document plans all items of its residue, and one that does not exist; an item listed twice gets its names by the join
    documents = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).alias("residue"))
    items = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 4).alias("residue")).distinct()
    planned = documents.join(items, "residue").select("doc_id", "item_id")
    planned = planned.unionByName(documents.select("doc_id", F.lit(-1).cast("bigint").alias("item_id")))
    gone = planned.join(mentioned(spark, sf), ["doc_id", "item_id"], "left_anti")
    names = table(spark, sf, "benchmark").select("item_id", F.md5("text").alias("name"))
    return rp.missing_names(gone, names, [], "item_id", "name")


@reg.add(
    "failing_checks",
    f"""SELECT o_orderkey, check_id, coalesce(d, 'Format violation') AS description FROM ({_ALL_SQL})
        LEFT JOIN (VALUES ('budget', 'Stay within 5000'), ('types', 'Three types'), ('family', 'Suit children'))
          AS t(c, d) ON c = check_id WHERE NOT satisfied""",
)
def _(spark, sf):
    texts = {"budget": "Stay within 5000", "types": "Three types", "family": "Suit children"}
    described = spark.createDataFrame(list(texts.items()), "check_id string, description string")
    failing = rp.failing_checks(order_check_results(spark, sf), described, [], "check_id")
    return failing.select("o_orderkey", "check_id", "description")


# --- metrics of orders ---------------------------------------------------------------------------------------------
# U from the checks of the order, F from line amounts, G from its key; the run is the priority.
_METRICS = f"""
    c AS (SELECT o_orderkey, count(*) FILTER (WHERE satisfied) AS sat, count(*) AS total FROM ({_ALL_SQL})
          WHERE check_id <> 'unknown' GROUP BY 1),
    l AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_quantity > 5) AS m,
                 count(*) FILTER (WHERE l_discount > 0.09) AS h, least(count(DISTINCT l_linenumber), 2) AS days
          FROM lineitem GROUP BY 1),
    raw AS (SELECT o_orderkey AS instance_id, o_orderpriority AS run_id, l.lines IS NULL AS missing,
                   pow(sat / total, 3) AS uc, pow((3 + coalesce(days, 0)) / 5, 3) AS uf,
                   o_orderkey % 90 AS chars, (o_orderkey % 50 + 50) / 100 AS g0,
                   CASE WHEN lines > 0 THEN pow(m / lines * pow(0.9, h), 3) ELSE 1.0 END AS f0
            FROM orders JOIN c USING (o_orderkey) LEFT JOIN l ON l_orderkey = o_orderkey),
    metrics AS (SELECT instance_id, run_id, missing,
                       CASE WHEN missing THEN 0.0 ELSE (0.85 * uc + 0.15 * uf) * CASE WHEN chars < 50 THEN 0.5 ELSE 1 END END AS u,
                       CASE WHEN missing THEN 0.0 ELSE uf END AS r, CASE WHEN missing THEN 0.0 ELSE g0 END AS g,
                       CASE WHEN missing THEN 0.0 ELSE f0 END AS f, CASE WHEN missing THEN 0.0 ELSE uc END AS uc,
                       CASE WHEN missing THEN 0.0 ELSE uf END AS uf FROM raw)
"""


def order_metrics(spark, sf, with_missing: bool = True, results=None):
    """Metrics rows of answered orders; with ``with_missing`` the orders without lines follow with zeros."""
    results = (order_check_results(spark, sf) if results is None else results).where("check_id <> 'unknown'")
    totals = sc.check_totals(results, ["o_orderkey"])
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("l_quantity") > 5).alias("mentioned_count"),
        F.count_if(F.col("l_discount") > 0.09).alias("hallucinated_count"),
        F.least(F.count_distinct("l_linenumber"), F.lit(2)).alias("_days"),
    )
    rows = (
        totals.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .withColumn("format_satisfied", F.col("_days") + 3)
        .withColumn("format_total", F.lit(5))
        .withColumn("explanation_chars", F.col("o_orderkey") % 90)
        .withColumn("G", (F.col("o_orderkey") % 50 + 50) / 100)
        .withColumnRenamed("o_orderkey", "instance_id")
    )
    scored = en.faithfulness_score(sc.understanding(rows), F.col("total_count") == 0)
    metrics = scored.select("instance_id", "U", "R", "G", "F", "U_constraints", "U_format")
    instances = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("instance_id"), F.col("o_orderpriority").alias("run_id")
    )
    if not with_missing:
        return instances.join(metrics, "instance_id")
    return sc.with_missing(instances, metrics).join(instances, "instance_id")


def _scores(df, *names):
    return [r6(n).alias(n) for n in names]


_U = 'round(u, 6) AS "U", round(r, 6) AS "R", round(g, 6) AS "G", round(f, 6) AS "F"'


@reg.add(
    "score_understanding",
    f"""WITH {_METRICS} SELECT instance_id, round(u, 6) AS "U", round(r, 6) AS "R", round(uc, 6) AS "U_constraints",
               round(uf, 6) AS "U_format" FROM metrics WHERE NOT missing""",
)
def _(spark, sf):
    m = order_metrics(spark, sf, with_missing=False)
    return m.select("instance_id", *_scores(m, "U", "R", "U_constraints", "U_format"))


@reg.add(
    "check_totals",
    f"""SELECT o_orderkey, count(*) FILTER (WHERE satisfied) AS constraints_satisfied, count(*) AS constraints_total
        FROM ({_ALL_SQL}) GROUP BY 1""",
)
def _(spark, sf):
    return sc.check_totals(order_check_results(spark, sf), ["o_orderkey"])


@reg.add(
    "metrics_with_missing",
    f"WITH {_METRICS} SELECT instance_id, missing, {_U} FROM metrics",
)
def _(spark, sf):
    m = order_metrics(spark, sf)
    return m.select("instance_id", "missing", *_scores(m, "U", "R", "G", "F"))


@reg.add(
    "instances_with_outputs",
    "SELECT o_orderkey, o_orderpriority, lines FROM orders JOIN "
    "(SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


_PASS = "u >= 0.7 AND r >= 0.7 AND f >= 0.7"


@reg.add(
    "filter_passed",
    f"WITH {_METRICS} SELECT instance_id, {_U} FROM metrics WHERE {_PASS}",
)
def _(spark, sf):
    m = order_metrics(spark, sf).where(rp.passed())
    return m.select("instance_id", *_scores(m, "U", "R", "G", "F"))


@reg.add(
    "filter_failed",
    f"WITH {_METRICS} SELECT run_id, count(*) AS n FROM metrics WHERE NOT ({_PASS}) GROUP BY 1",
)
def _(spark, sf):
    return order_metrics(spark, sf).where(~rp.passed()).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@reg.add(
    "status_flags",
    f"WITH {_METRICS} SELECT instance_id, u > 0.7 AND r > 0.7 AS passed_strict, {_PASS} AS passed FROM metrics",
)
def _(spark, sf):
    return order_metrics(spark, sf).select(
        "instance_id", rp.passed_strict().alias("passed_strict"), rp.passed().alias("passed")
    )


@reg.add(
    "issue_flags",
    f"""WITH {_METRICS} SELECT instance_id, u < 1 AS has_constraint_violations, r < 1 AS has_reasoning_failures,
               f < 1 AS has_faithfulness_issues, g < 0.95 AS has_quality_notes FROM metrics""",
)
def _(spark, sf):
    return order_metrics(spark, sf).select("instance_id", *[c.alias(n) for n, c in rp.issue_flags().items()])


@reg.add("filter_one_id", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def _(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 17").select("doc_id", "lang", "source")


@reg.add(
    "run_averages",
    f"""WITH {_METRICS}, a AS (
          SELECT run_id, count(*) AS instances, count(*) FILTER (WHERE missing) AS missing_count, avg(u) AS u, avg(g) AS g,
                 avg(f) AS f, avg(uc) AS uc, avg(uf) AS uf, avg(u) FILTER (WHERE NOT missing) AS au,
                 avg(g) FILTER (WHERE NOT missing) AS ag, avg(f) FILTER (WHERE NOT missing) AS af
          FROM metrics GROUP BY 1)
        SELECT run_id, instances, missing_count, round(u, 6) AS "avg_U", round(g, 6) AS "avg_G", round(f, 6) AS "avg_F",
               round(uc, 6) AS "avg_U_constraints", round(uf, 6) AS "avg_U_format",
               round(0.5 * u + 0.25 * g + 0.25 * f, 6) AS final_score,
               round(0.5 * au + 0.25 * ag + 0.25 * af, 6) AS answered_score FROM a""",
)
def _(spark, sf):
    a = rp.run_averages(order_metrics(spark, sf), ["run_id"])
    names = ["avg_U", "avg_G", "avg_F", "avg_U_constraints", "avg_U_format", "final_score", "answered_score"]
    return a.select("run_id", "instances", "missing_count", *_scores(a, *names))


@reg.add(
    "leaderboard",
    f"""WITH {_METRICS}, a AS (SELECT run_id, avg(u) AS u, avg(r) AS r, avg(g) AS g, avg(f) AS f FROM metrics
                               WHERE NOT missing GROUP BY 1)
        SELECT run_id, round(u, 6) AS "avg_U", round(r, 6) AS "avg_R", round(g, 6) AS "avg_G", round(f, 6) AS "avg_F",
               round((u + r + g + f) / 4, 6) AS avg_all FROM a""",
)
def _(spark, sf):
    board = rp.leaderboard(order_metrics(spark, sf, with_missing=False), "run_id")
    return board.select("run_id", *_scores(board, "avg_U", "avg_R", "avg_G", "avg_F", "avg_all"))


@reg.add(
    "valid_only_averages",
    f"""WITH {_METRICS} SELECT run_id, count(*) FILTER (WHERE NOT missing) AS n,
               round(avg(u) FILTER (WHERE NOT missing), 6) AS "avg_U", round(avg(f) FILTER (WHERE NOT missing), 6) AS "avg_F"
        FROM metrics GROUP BY 1""",
)
def _(spark, sf):
    a = rp.valid_only_averages(order_metrics(spark, sf), ["run_id"], ~F.col("missing"))
    return a.select("run_id", "n", *_scores(a, "avg_U", "avg_F"))


@reg.add(
    "findings",
    f"""WITH {_METRICS}
        SELECT check_fn AS subject, 'check' AS kind, count(*) AS n FROM ({_ALL_SQL}) c
          JOIN metrics ON instance_id = o_orderkey WHERE NOT satisfied AND NOT ({_PASS}) GROUP BY 1, 2""",
)
def _(spark, sf):
    # stored, or the join is pushed into each part of the checks and the metrics are worked out for each of them
    results = materialize(order_check_results(spark, sf), "checks")
    failed = order_metrics(spark, sf, results=results).where(~rp.passed()).select(F.col("instance_id").alias("o_orderkey"))
    violated = results.where("NOT satisfied").join(failed, "o_orderkey", "left_semi")
    return violated.groupBy(F.col("check_fn").alias("subject"), F.lit("check").alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- language pairs: A lines play the Romanian run, R lines the English one ------------------------------------------
_PAIR = """
    q AS (SELECT l_orderkey AS o, l_returnflag AS flag, pow(count(*) FILTER (WHERE l_quantity <= 25) / count(*), 3) AS u,
                 pow(count(*) FILTER (WHERE l_linestatus = 'O') / count(*), 3) AS r, avg(l_tax) AS g,
                 pow(count(*) FILTER (WHERE l_linenumber <= 5) / count(*) * pow(0.9, count(*) FILTER (WHERE l_discount > 0.08)), 3) AS f
          FROM lineitem GROUP BY 1, 2),
    p AS (SELECT a.o AS instance_id, a.u AS u_ro, b.u AS u_en, a.r AS r_ro, b.r AS r_en, a.g AS g_ro, b.g AS g_en,
                 a.f AS f_ro, b.f AS f_en FROM q a JOIN q b ON a.o = b.o JOIN orders ON o_orderkey = a.o
          WHERE a.flag = 'A' AND b.flag = 'R')
"""


def language_pairs(spark, sf):
    n = F.count(F.lit(1))
    lines = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    sums = lines.groupBy("l_orderkey", "l_returnflag").agg(
        n.alias("total_count"),
        F.count_if(F.col("l_linenumber") <= 5).alias("mentioned_count"),
        F.count_if(F.col("l_discount") > 0.08).alias("hallucinated_count"),
        tx.severity(F.count_if(F.col("l_quantity") <= 25) / n).alias("U"),
        tx.severity(F.count_if(F.col("l_linestatus") == "O") / n).alias("R"),
        F.avg("l_tax").alias("G"),
    )
    scored = en.faithfulness_score(sums, F.lit(False)).withColumnRenamed("l_orderkey", "instance_id")
    instances = table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"))
    ro, eng = [scored.where(F.col("l_returnflag") == flag) for flag in ("A", "R")]
    return rp.paired(instances, ro, eng, "instance_id")


@reg.add(
    "language_delta",
    f"""WITH {_PAIR}, a AS (SELECT count(*) AS instances, avg(u_ro) AS ur, avg(u_en) AS ue, avg(r_ro) AS rr, avg(r_en) AS re,
                                   avg(f_ro) AS fr, avg(f_en) AS fe, avg(g_ro) AS gr, avg(g_en) AS ge FROM p)
        SELECT instances, round(ue - ur, 6) AS "delta_U", round(re - rr, 6) AS "delta_R", round(fe - fr, 6) AS "delta_F",
               round(gr, 6) AS "G_ro", round(ge, 6) AS "G_en",
               CASE WHEN ue - ur > 0.1 THEN 'large' WHEN ue - ur > 0.05 THEN 'minor' ELSE 'none' END AS "class_U",
               CASE WHEN re - rr > 0.1 THEN 'large' WHEN re - rr > 0.05 THEN 'minor' ELSE 'none' END AS "class_R",
               CASE WHEN fe - fr > 0.1 THEN 'large' WHEN fe - fr > 0.05 THEN 'minor' ELSE 'none' END AS "class_F" FROM a""",
)
def _(spark, sf):
    d = rp.language_delta(language_pairs(spark, sf))
    return d.select(
        "instances", *_scores(d, "delta_U", "delta_R", "delta_F", "G_ro", "G_en"), "class_U", "class_R", "class_F"
    )


@reg.add(
    "instance_delta",
    f"""WITH {_PAIR} SELECT instance_id, round(u_en - u_ro, 6) AS "delta_U", round(r_en - r_ro, 6) AS "delta_R",
               round(f_en - f_ro, 6) AS "delta_F",
               greatest(abs(u_en - u_ro), abs(r_en - r_ro), abs(f_en - f_ro)) > 0.2 AS is_large FROM p""",
)
def _(spark, sf):
    d = rp.instance_delta(language_pairs(spark, sf))
    return d.select("instance_id", *_scores(d, "delta_U", "delta_R", "delta_F"), "is_large").orderBy("instance_id")


SOURCES = [f"src{n}" for n in range(20)]


def wide_by_source(results):
    """One column per source: those of ``SOURCES``, then any others that occur, ``null`` for rows without a source."""
    named = results.withColumn("source", F.coalesce("source", F.lit("null"))).groupBy("words", "source").agg(F.max("G").alias("G"))
    others = named.where(~F.col("source").isin(SOURCES)).select("source").distinct().orderBy("source").collect()
    columns = SOURCES + [r["source"] for r in others]
    return rp.model_table(named, "words", "source", columns, r6("G")).select("words", *[f"`{c}`" for c in columns])


@reg.add(
    "model_table",
    report_sql()
    + "SELECT n_words AS words, "
    + ", ".join(f"round(max(g) FILTER (WHERE source = '{m}'), 6) AS {m}" for m in SOURCES)
    + " FROM (SELECT n_words::INT AS n_words, source, max(g) AS g FROM report GROUP BY 1, 2) GROUP BY 1",
)
def _(spark, sf):
    # one "instance" per text length, the best score of each source as its model's result
    scored = ql.text_quality(documents(spark, sf), "ro_text", detail=False)
    results = scored.groupBy(F.col("n_words").alias("words"), "source").agg(F.max("G").alias("G"))
    return wide_by_source(results)


# --- aggregates over plans ---------------------------------------------------------------------------------------------
@reg.add(
    "plan_day_sums",
    f"""WITH {_IT} SELECT o AS o_orderkey, 'day' || day AS day, count(*) AS n, sum(cost)::DOUBLE AS cost,
               sum(hours)::DOUBLE AS hours, sum(kcal)::DOUBLE AS kcal, sum(p_size)::DOUBLE AS prep,
               count(*) FILTER (WHERE NOT indoor) AS outdoor FROM it GROUP BY 1, 2""",
)
def _(spark, sf):
    items = order_items(spark, sf).where("key IS NOT NULL")
    return items.groupBy("o_orderkey", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cost_lei").cast("double").alias("cost"),
        F.sum("duration_hours").cast("double").alias("hours"),
        F.sum("calories").alias("kcal"),
        F.sum("prep_time_min").alias("prep"),
        F.count_if(~F.col("indoor")).alias("outdoor"),
    )


@reg.add(
    "plan_distinct_types",
    f"WITH {_IT} SELECT o AS o_orderkey, count(DISTINCT p_type) AS types, count(DISTINCT (day, p_type)) AS day_types "
    "FROM it GROUP BY 1",
)
def _(spark, sf):
    items = order_items(spark, sf).where("key IS NOT NULL")
    return items.groupBy("o_orderkey").agg(
        F.count_distinct("type").alias("types"), F.count_distinct("day", "type").alias("day_types")
    )


@reg.add(
    "constraint_statistics",
    """SELECT o_orderpriority, round(avg(n), 6) AS avg_constraints, min(n) AS min_constraints, max(n) AS max_constraints
       FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem
             ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    counts = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["n"])
    s = rp.constraint_statistics(counts, "o_orderpriority", "n")
    return s.withColumn("avg_constraints", r6("avg_constraints"))


@reg.add("corpus_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@reg.add(
    "latency_summary",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg_latency, min(value) AS min_latency,
              max(value) AS max_latency, round(quantile_cont(value, 0.5), 6) AS p50_latency,
              round(quantile_cont(value, 0.95), 6) AS p95_latency, round(quantile_cont(value, 0.99), 6) AS p99_latency
       FROM events GROUP BY 1""",
)
def _(spark, sf):
    s = rp.latency_summary(table(spark, sf, "events"), ["event_type"], "value")
    return s.withColumns({c: r6(c) for c in ("avg_latency", "p50_latency", "p95_latency", "p99_latency")})


# --- order and position --------------------------------------------------------------------------------------------------
@reg.add(
    "best_mention",
    """SELECT source, lang, doc_id, n_chars AS score FROM
       (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents)
       WHERE k = 1""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", "doc_id", F.col("n_chars").alias("score"))
    best = od.best_row(docs, ["source", "lang"], [-F.col("score"), F.col("doc_id")])
    return best.select("source", "lang", "best.*")


@reg.add(
    "word_trigrams",
    f"""SELECT phrase AS trigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM
        (SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS phrase
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i
               FROM (SELECT doc_id, regexp_extract_all(lower(text), {quote(tx.WORD_CHAR + '+')}) AS words FROM documents)))
        GROUP BY 1""",
)
def _(spark, sf):
    grams = od.trigrams(spread(table(spark, sf, "documents").select("doc_id", "text")), ["doc_id"], "text")
    # dealt by trigram once: counting a trigram's rows in each document needs no exchange of its own then
    dealt = grams.select("trigram", "doc_id").repartition("trigram")
    in_document = dealt.groupBy("trigram", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return in_document.groupBy("trigram").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


_LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]


def order_lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", *_LINE_ORDER)


@reg.add(
    "round_robin_days",
    f"""SELECT l_orderkey, day, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM
        (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) - 1) % 3 + 1 AS day
         FROM lineitem) GROUP BY 1, 2""",
)
def _(spark, sf):
    indexed = od.running_index(
        order_lines(spark, sf), ["l_orderkey"], "l_partkey", _LINE_ORDER
    )
    days = indexed.withColumn("day", od.round_robin(F.col("pos"), 3))
    return days.groupBy("l_orderkey", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@reg.add(
    "difficulty_by_position",
    """SELECT o_orderpriority, difficulty, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM
       (SELECT *, CASE WHEN k < n * 0.4 THEN 'easy' WHEN k < n * 0.8 THEN 'medium' ELSE 'hard' END AS difficulty FROM
        (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k,
                count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)) GROUP BY 1, 2""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    indexed = od.running_index(orders, ["o_orderpriority"], "o_orderkey", ["o_orderkey"])
    marked = indexed.withColumn("difficulty", od.difficulty_by_position(F.col("pos"), F.col("pos_of")))
    return marked.groupBy("o_orderpriority", "difficulty").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@reg.add(
    "disambiguate_names",
    f"""SELECT l_orderkey, unique_name, count(*) AS n FROM
        (SELECT l_orderkey, CASE WHEN of > 1 THEN p_name || ' (' || nth || ')' ELSE p_name END AS unique_name FROM
         (SELECT l_orderkey, p_name, count(*) OVER (PARTITION BY l_orderkey, p_name) AS of,
                 row_number() OVER (PARTITION BY l_orderkey, p_name ORDER BY {', '.join(_LINE_ORDER)}) AS nth
          FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY 1, 2""",
)
def _(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = order_lines(spark, sf).join(names, "l_partkey")
    unique = od.disambiguate(lines, ["l_orderkey"], "p_name", "l_partkey", _LINE_ORDER)
    return unique.groupBy("l_orderkey", "unique_name").agg(F.count(F.lit(1)).alias("n"))


@reg.add(
    "first_feasible",
    "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05 "
    "GROUP BY 1",
)
def _(spark, sf):
    feasible = (F.col("l_quantity") > 25) & (F.col("l_discount") < 0.05)
    return od.first_feasible(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", feasible)


@reg.add(
    "first_instances",
    "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 25",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(25)


@reg.add(
    "seeded_shuffle",
    "SELECT o_orderkey, md5('10000:' || o_orderkey) AS shuffle_key FROM orders ORDER BY 2, 1",
)
def _(spark, sf):
    return od.seeded_shuffle(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10000)


# --- sets ------------------------------------------------------------------------------------------------------------------
WORLDS_BY_PRIORITY = {"1": "urgent", "2": "high", "3": "medium", "4": "unset", "5": "low"}


@reg.add(
    "union_worlds",
    " UNION ALL ".join(
        f"SELECT o_orderkey, '{name}' AS world_type FROM orders WHERE o_orderpriority LIKE '{p}%'"
        for p, name in WORLDS_BY_PRIORITY.items()
    ),
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    worlds = [
        orders.where(F.col("o_orderpriority").startswith(p)).select("o_orderkey", F.lit(name).alias("world_type"))
        for p, name in WORLDS_BY_PRIORITY.items()
    ]
    return reduce(DataFrame.unionByName, worlds)


@reg.add(
    "common_instances",
    "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem "
    "WHERE l_returnflag = 'R'",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    by_flag = [lines.where(F.col("l_returnflag") == f).select("l_orderkey") for f in ("A", "R")]
    return by_flag[0].intersect(by_flag[1])


@reg.add(
    "retry_list",
    "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N'",
)
def _(spark, sf):
    answered = table(spark, sf, "lineitem").where("l_returnflag = 'N'").select("l_orderkey")
    return table(spark, sf, "orders").select("o_orderkey").subtract(answered)


# expected day keys 1..3 of a plan against the days it has
@reg.add(
    "format_compliance",
    f"""WITH {_PARSED.replace('SELECT doc_id', 'x AS (SELECT doc_id', 1)})
        SELECT instance_id, clean, size_ok AS keys_present, extra_ok AS no_extra_keys, types_ok AS value_types,
               (1 + clean::INT + size_ok::INT + extra_ok::INT + types_ok::INT)::INT AS format_satisfied FROM
        (SELECT doc_id AS instance_id, format_ok AS clean, doc_id % 10 IN (0, 2, 4) AS size_ok,
                doc_id % 10 IN (0, 2, 3, 4, 5, 8, 9) AS extra_ok, doc_id % 10 IN (0, 2, 3, 5, 8, 9) AS types_ok FROM x)""",
)
def _(spark, sf):
    run = sc.parse_run(outputs(spark, sf)).select("instance_id", "cells", "format_ok", "repaired")
    expected = run.withColumn("world_type", F.lit("travel")).withColumn(
        "expected_keys", F.array(F.lit("day1"), F.lit("day2"))
    )
    f = sc.format_compliance(expected)
    return f.select(
        "instance_id",
        F.col("format_checks.F_JSON_CLEAN").alias("clean"),
        F.col("format_checks.F_KEYS_PRESENT").alias("keys_present"),
        F.col("format_checks.F_NO_EXTRA_KEYS").alias("no_extra_keys"),
        F.col("format_checks.F_VALUE_TYPES").alias("value_types"),
        "format_satisfied",
    )


@reg.add(
    "late_format_penalty",
    f"""SELECT instance_id, format_violation, round(CASE WHEN format_violation THEN 0.5 ELSE 1 END * 0.85, 6) AS "U" FROM
        (SELECT doc_id AS instance_id, length({trim_sql('lead')}) < 50 AS format_violation FROM ({_PARSED}))""",
)
def _(spark, sf):
    parsed = op.parse_outputs(outputs(spark, sf)).select(
        "instance_id", F.char_length("explanation").alias("explanation_chars")
    )
    counts = {"constraints_satisfied": 1, "constraints_total": 1, "format_satisfied": 0, "format_total": 5}
    scored = sc.understanding(parsed.withColumns({n: F.lit(v) for n, v in counts.items()}))
    return scored.select("instance_id", "format_violation", r6("U").alias("U"))


# --- lemma variant -----------------------------------------------------------------------------------------------------------
_LEMMA = "CASE WHEN w LIKE '%ing' THEN left(w, length(w) - 3) ELSE w END"


@reg.add(
    "text_lemmas",
    f"""SELECT documents.doc_id, coalesce(n_lemmas, 0) AS n_lemmas, coalesce(n_terms, 0) AS n_terms FROM documents LEFT JOIN (
        SELECT doc_id, count(DISTINCT {_LEMMA}) AS n_lemmas, count(DISTINCT {_LEMMA}) FILTER
              (WHERE {_LEMMA} IN ('the', 'and', 'reest')) AS n_terms
        FROM (SELECT doc_id, unnest(regexp_extract_all({match_sql('text')}, '[A-Za-zăâîșțĂÂÎȘȚ]+')) AS w FROM documents)
        GROUP BY 1) USING (doc_id)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    # a lookup table drawn from the corpus: words in -ing and their stems
    letters = F.regexp_extract_all(tx.normalize_match("text"), F.lit("[A-Za-z]+"), F.lit(0))
    lookup = (
        docs.select(F.explode(F.array_distinct(letters)).alias("word"))
        .where("word LIKE '%ing'")
        .distinct()
        .withColumn("lemma", F.left("word", F.char_length("word") - 3))
    )
    lemmas = en.lemma_map(docs, ["doc_id"], "text", lookup)
    terms = F.array(F.lit("the"), F.lit("and"), F.lit("reest"))
    return lemmas.select(
        "doc_id",
        F.size("lemmas").cast("bigint").alias("n_lemmas"),
        F.size(F.array_intersect("lemmas", terms)).cast("bigint").alias("n_terms"),
    )
