"""Queries over text columns: scalar functions, tokens, quality scores, grammar findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrubric.functions import lexicon as lx
from sparkrubric.functions import text as tx
from sparkrubric.operators import grammar as gr
from sparkrubric.operators import quality as ql
from sparkrubric.operators import reports as rp
from workload.base import (
    Registry,
    count_sql,
    documents,
    match_sql,
    normalize_sql,
    planted_sql,
    quote,
    r6,
    spread,
    sql_list,
    strip_sql,
    table,
    trim_sql,
    words_sql,
)

reg = Registry()
RO = planted_sql()
DOCS = f"(SELECT *, {RO} AS ro_text FROM documents)"

# --- scalar functions ----------------------------------------------------------------------------------------
@reg.add(
    "text_normalize_diacritics",
    f"SELECT doc_id, md5({normalize_sql('ro_text')}) AS digest FROM {DOCS}",
)
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.normalize_diacritics("ro_text")).alias("digest"))


@reg.add("text_strip_diacritics", f"SELECT doc_id, md5({strip_sql('ro_text')}) AS digest FROM {DOCS}")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.strip_diacritics("ro_text")).alias("digest"))


@reg.add(
    "text_has_diacritics",
    f"SELECT doc_id, regexp_matches(ro_text, '[ăâîșțĂÂÎȘȚşţŞŢ]') AS has_diacritics FROM {DOCS}",
)
def _(spark, sf):
    return documents(spark, sf).select(
        "doc_id", tx.has_romanian_diacritics("ro_text").alias("has_diacritics")
    )


@reg.add(
    "text_count_diacritics",
    "SELECT doc_id, "
    + ", ".join(
        f"length(t) - length(replace(t, '{ch}', '')) AS n_{n}"
        for n, ch in zip(("a_breve", "a_circ", "i_circ", "s_comma", "t_comma"), tx.DIACRITICS, strict=True)
    )
    + f" FROM (SELECT doc_id, {normalize_sql('lower(ro_text)')} AS t FROM {DOCS})",
)
def _(spark, sf):
    counts = documents(spark, sf).select("doc_id", tx.count_diacritics("ro_text").alias("c"))
    names = ("a_breve", "a_circ", "i_circ", "s_comma", "t_comma")
    return counts.select(
        "doc_id",
        *[F.col(f"c.{ch}").cast("bigint").alias(f"n_{n}") for n, ch in zip(names, tx.DIACRITICS, strict=True)],
    )


_PIECE = f"({tx.SPACE}*)(?:{tx.TOKEN_PATTERN})"
_TOKENS = f"""
    SELECT doc_id, piece, regexp_replace(piece, {quote('^' + tx.SPACE + '+')}, '') AS token,
           sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop
    FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
          FROM (SELECT doc_id, regexp_extract_all(ro_text, {quote(_PIECE)}) AS p FROM {DOCS}))
"""


@reg.add(
    "text_tokenize",
    f"""
    SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE is_word) AS n_words,
           sum(stop - length(token))::BIGINT AS start_sum, sum(stop)::BIGINT AS end_sum, max(length(token)) AS longest
    FROM (SELECT *, regexp_full_match(token, {quote(tx.WORD_PATTERN)}) AS is_word FROM ({_TOKENS}))
    GROUP BY doc_id
    """,
)
def _(spark, sf):
    tokens = tx.tokens(documents(spark, sf), ["doc_id"], "ro_text")
    return tokens.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if("is_word").alias("n_words"),
        F.sum("start").alias("start_sum"),
        F.sum("end").alias("end_sum"),
        F.max(F.char_length("token")).cast("bigint").alias("longest"),
    )


@reg.add(
    "text_words",
    f"SELECT doc_id, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' ')) AS digest "
    f"FROM (SELECT doc_id, {words_sql('ro_text')} AS w FROM {DOCS})",
)
def _(spark, sf):
    words = documents(spark, sf).select("doc_id", tx.tokenize_words("ro_text").alias("w"))
    return words.select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest")
    )


@reg.add("text_match_key", f"SELECT doc_id, md5({match_sql('ro_text')}) AS digest FROM {DOCS}")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.normalize_match("ro_text")).alias("digest"))


@reg.add(
    "text_fuzzy_key",
    f"SELECT doc_id, md5(translate(lower(ro_text), 'ăâîșţț', 'aaistt')) AS digest FROM {DOCS}",
)
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.normalize_fuzzy("ro_text")).alias("digest"))


@reg.add(
    "text_space_words",
    f"SELECT doc_id, {count_sql('text', tx.NON_SPACE + '+')}::BIGINT AS n_words FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.space_word_count("text").cast("bigint").alias("n_words")
    )


@reg.add(
    "text_narrative",
    f"SELECT doc_id, md5({trim_sql('split_part(o, k, 1)')}) AS digest "
    "FROM (SELECT doc_id, text || chr(10) || '{' || chr(10) || '\"day1\": []}' AS o, '{' || chr(10) AS k "
    "FROM documents)",
)
def _(spark, sf):
    out = F.concat("text", F.lit('\n{\n"day1": []}'))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.narrative(out)).alias("digest"))


@reg.add(
    "text_readable_key",
    "SELECT event_type, upper(event_type[1]) || event_type[2:] || ' Type ' || user_id AS label, count(*) AS n "
    "FROM events GROUP BY 1, 2",
)
def _(spark, sf):
    key = F.concat("event_type", F.lit("_type_"), F.col("user_id").cast("string"))
    return (
        table(spark, sf, "events")
        .groupBy("event_type", tx.readable_key(key).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@reg.add(
    "text_slot_parts",
    """
    SELECT l_orderkey, l_linenumber, l_linestatus, split_part(k, '_', 1) AS day,
           substr(k, length(split_part(k, '_', 1)) + 2) AS slot, count(*) AS n,
           CASE WHEN l_linestatus = 'O' THEN 'morning' ELSE 'afternoon' END AS slot_name
    FROM (SELECT *, 'day' || l_linenumber || '_' ||
          CASE WHEN l_linestatus = 'O' THEN 'dimineață_mare' ELSE 'dupa_amiaza' END AS k FROM lineitem)
    GROUP BY ALL
    """,
)
def _(spark, sf):
    slot = F.when(F.col("l_linestatus") == "O", "dimineață_mare").otherwise("dupa_amiaza")
    parts = tx.split_slot_key(F.concat(F.lit("day"), F.col("l_linenumber").cast("string"), F.lit("_"), slot))
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_linestatus", parts.alias("p"))
        .select("l_orderkey", "l_linenumber", "l_linestatus", "p.*", tx.slot_label(F.col("p.slot")).alias("slot_name"))
        .groupBy("l_orderkey", "l_linenumber", "l_linestatus", "day", "slot", "slot_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_DAY_CASE = "CASE dayname(o_orderdate) " + " ".join(
    f"WHEN '{en.title()}' THEN '{ro}'" for en, ro in tx.DAY_NAMES.items()
) + " END"


@reg.add(
    "text_day_names",
    f"SELECT lower(dayname(o_orderdate)) AS day, {_DAY_CASE} AS other_name, count(*) AS n FROM orders GROUP BY 1, 2",
)
def _(spark, sf):
    names = table(spark, sf, "orders").select(F.date_format("o_orderdate", "EEEE").alias("d"))
    both = tx.day_both_languages(F.col("d"))
    return (
        names.select(both[0].alias("day"), F.get(both, F.lit(1)).alias("other_name"))
        .groupBy("day", "other_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- prompt choice -------------------------------------------------------------------------------------------
@reg.add(
    "prompt_by_language",
    "SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'EN: ' || source ELSE 'RO: ' || source END AS prompt "
    "FROM documents",
)
def _(spark, sf):
    ro, en = F.concat(F.lit("RO: "), "source"), F.concat(F.lit("EN: "), "source")
    return table(spark, sf, "documents").select(
        "doc_id", "lang", rp.by_language(F.col("lang"), ro, en).alias("prompt")
    )


# --- quality scores --------------------------------------------------------------------------------------------
_KNOWN, _CORRECT, _ASSUMED = sql_list(lx.known_keys()), sql_list(lx.correct_words()), sql_list(lx.assumed_keys())
_ENGLISH = sql_list(lx.english_words())
_OK = f"(w IN {_CORRECT} OR (w <> {strip_sql('w')} AND {strip_sql('w')} IN {_ASSUMED}))"


def _word_lists(x: str) -> str:
    """Document words with the known, badly spelled and English ones."""
    return f"""
    SELECT *, list_filter(known, lambda w: NOT {_OK}) AS bad,
           list_filter(words, lambda w: w IN {_ENGLISH}) AS english
    FROM (SELECT *, list_filter(words, lambda w: {strip_sql('w')} IN {_KNOWN}) AS known
          FROM (SELECT *, {words_sql('nt')} AS words,
                       regexp_matches(nt, '[ăâîșțĂÂÎȘȚşţŞŢ]') AS has_dia
                FROM (SELECT *, {normalize_sql(x)} AS nt FROM {DOCS})))
    """


_LISTS = _word_lists("ro_text")
_DIA_SCORE = """CASE WHEN len(known) > 0 THEN (len(known) - len(bad)) / len(known)
                     WHEN len(words) > 20 AND NOT has_dia THEN 0.5 ELSE 1.0 END"""


@reg.add(
    "quality_diacritics",
    f"""
    SELECT doc_id, round({_DIA_SCORE}, 6) AS diacritic_score, len(known)::INT AS total_checkable,
           (len(known) - len(bad))::INT AS correct_diacritics, len(bad)::INT AS missing_diacritics,
           has_dia AND len(words) > 0 AS has_diacritics, len(words)::INT AS total_words,
           len(list_distinct(words))::INT AS unique_words,
           CASE WHEN len(words) > 0 THEN round(len(known) / len(words), 6) ELSE 0.0 END AS coverage
    FROM ({_LISTS})
    """,
)
def _(spark, sf):
    return (
        ql.diacritics(documents(spark, sf), "ro_text")
        .select(
            "doc_id", r6("diacritic_score").alias("diacritic_score"), "total_checkable", "correct_diacritics",
            "missing_diacritics", "has_diacritics", "total_words", "unique_words", r6("coverage").alias("coverage"),
        )
    )


_FIRST_FLAGGED = f"""
    SELECT doc_id, n, w FROM (
      SELECT doc_id, w, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (
        SELECT doc_id, w, pos, row_number() OVER (PARTITION BY doc_id, {strip_sql('w')} ORDER BY pos) AS k
        FROM (SELECT doc_id, unnest(bad) AS w, generate_subscripts(bad, 1) AS pos FROM ({_LISTS})))
      WHERE k = 1)
    WHERE n <= 10
"""


@reg.add(
    "quality_flagged_examples",
    f"SELECT doc_id, string_agg(w, ',' ORDER BY n) AS examples FROM ({_FIRST_FLAGGED}) GROUP BY doc_id",
)
def _(spark, sf):
    scored = ql.diacritics(documents(spark, sf), "ro_text", examples=10)
    word = lambda e: F.substring_index(e, " → ", 1)
    return scored.where(F.size("missing_examples") > 0).select(
        "doc_id", F.array_join(F.transform("missing_examples", word), ",").alias("examples")
    )


_CRITICAL = [w for w in lx.CRITICAL_WORDS.split() if w in lx.required_spellings()]
_CRITICAL_OK = [lx.required_spellings()[w] for w in _CRITICAL]


@reg.add(
    "quality_quick_diacritics",
    f"""
    SELECT doc_id, round(CASE WHEN ok + bare > 0 THEN ok / (ok + bare)
                              WHEN n > 30 AND NOT regexp_matches(ro_text, '[ăâîșțĂÂÎȘȚşţŞŢ]') THEN 0.6
                              ELSE 1.0 END, 6) AS quick_score
    FROM (SELECT doc_id, ro_text, len(words) AS n, len(list_filter(words, lambda w: w IN {sql_list(_CRITICAL_OK)})) AS ok,
                 len(list_filter(words, lambda w: w IN {sql_list(_CRITICAL)})) AS bare
          FROM (SELECT *, {words_sql('ro_text')} AS words FROM {DOCS}))
    """,
)
def _(spark, sf):
    return ql.quick_diacritics(documents(spark, sf), "ro_text").select(
        "doc_id", r6("quick_score").alias("quick_score")
    )


_CS = f"""
    SELECT doc_id, lang, len(words)::INT AS total_words, len(english)::INT AS english_words,
           CASE WHEN len(words) > 0 THEN len(english) / len(words) ELSE 0.0 END AS rate,
           array_to_string(english[1:10], ',') AS flagged
    FROM (SELECT *, list_filter(words, lambda w: w IN {_ENGLISH}) AS english
          FROM (SELECT *, {words_sql('text')} AS words FROM documents))
"""


@reg.add(
    "quality_code_switching",
    f"""SELECT doc_id, total_words, english_words, round(rate, 6) AS english_rate,
               round(exp(-20 * rate), 6) AS codeswitch_score, flagged AS flagged_words FROM ({_CS})""",
)
def _(spark, sf):
    return ql.code_switching(spread(table(spark, sf, "documents")), "text").select(
        "doc_id", "total_words", "english_words", r6("english_rate").alias("english_rate"),
        r6("codeswitch_score").alias("codeswitch_score"), F.array_join("flagged_words", ",").alias("flagged_words"),
    )


@reg.add(
    "quality_likely_english",
    f"SELECT lang, count(*) FILTER (WHERE rate > 0.15) AS likely_english, count(*) AS n FROM ({_CS}) GROUP BY lang",
)
def _(spark, sf):
    scored = ql.code_switching(spread(table(spark, sf, "documents")), "text")
    return scored.groupBy("lang").agg(
        F.count_if("is_likely_english").alias("likely_english"), F.count(F.lit(1)).alias("n")
    )


# The same counts through lexicon tables.
@reg.add(
    "lexicon_join_diacritics",
    f"""SELECT doc_id, (len(known) - len(bad))::BIGINT AS correct_diacritics, len(bad)::BIGINT AS missing_diacritics
        FROM ({_LISTS}) WHERE len(known) > 0""",
)
def _(spark, sf):
    words = tx.word_counts(
        documents(spark, sf).withColumn("t", tx.normalize_diacritics("ro_text")), ["doc_id"], "t"
    )
    return ql.diacritic_counts_by_join(words, ["doc_id"], lx.diacritic_table(spark))


@reg.add(
    "lexicon_join_english",
    f"SELECT doc_id, english_words::BIGINT AS english_words FROM ({_CS}) WHERE english_words > 0",
)
def _(spark, sf):
    words = tx.word_counts(table(spark, sf, "documents"), ["doc_id"], "text")
    return ql.english_counts_by_join(words, ["doc_id"], lx.codeswitch_table(spark))


_EDGE = trim_sql("t")
_PUNCT = f"""
    SELECT *, space_before_punct + missing_space_after + double_spaces + other_issues AS total_issues,
           {count_sql('t', tx.NON_SPACE + '+')} AS n_words
    FROM (SELECT doc_id, t, b * {count_sql('t', ql.SPACE_BEFORE)} AS space_before_punct,
                 b * ({count_sql('t', ql.MISSING_AFTER)} - {count_sql('t', ql.MISSING_AFTER_DECIMAL)}) AS missing_space_after,
                 b * {count_sql('t', ql.MULTI_SPACE)} AS double_spaces,
                 b * ({count_sql('t', ql.SPACE_AFTER_OPEN)} + {count_sql('t', ql.SPACE_BEFORE_CLOSE)}) AS other_issues
          FROM (SELECT doc_id, t, CASE WHEN {_EDGE} = '' THEN 0 ELSE 1 END AS b
                FROM (SELECT doc_id, replace(ro_text, ', ', ' ,') AS t FROM {DOCS})))
"""
_PUNCT_SCORE = "CASE WHEN total_issues = 0 THEN 1.0 ELSE greatest(0.3, 1.0 - 5.0 * total_issues / greatest(n_words, 1)) END"


@reg.add(
    "quality_punctuation",
    f"""SELECT doc_id, space_before_punct::INT AS space_before_punct, missing_space_after::INT AS missing_space_after,
               double_spaces::INT AS double_spaces, other_issues::INT AS other_issues,
               total_issues::INT AS total_issues, round({_PUNCT_SCORE}, 6) AS punctuation_score FROM ({_PUNCT})""",
)
def _(spark, sf):
    spaced = documents(spark, sf).withColumn("t", F.replace("ro_text", F.lit(", "), F.lit(" ,")))
    return ql.punctuation(spaced, "t").select(
        "doc_id", "space_before_punct", "missing_space_after", "double_spaces", "other_issues", "total_issues",
        r6("punctuation_score").alias("punctuation_score"),
    )


_TRI = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), {quote(tx.WORD_CHAR + '+')}) AS words FROM documents),
    tri AS (SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS phrase
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 10)),
    rep AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, phrase FROM tri GROUP BY ALL HAVING count(*) >= 3)
            GROUP BY doc_id)
"""


@reg.add(
    "quality_repetition",
    f"""{_TRI}
    SELECT doc_id, nw::INT AS repetition_words, rp::INT AS repeated_phrases, round(ttr, 3) AS type_token_ratio,
           round(CASE WHEN nw < 10 THEN 1.0
                      ELSE greatest(0.3, least(1.0, ttr / 0.5) - least(0.3, rp * 0.05)) END, 6) AS repetition_score
    FROM (SELECT doc_id, len(words) AS nw, coalesce(n, 0) AS rp,
                 CASE WHEN len(words) < 10 THEN 1.0 ELSE len(list_distinct(words)) / len(words) END AS ttr
          FROM w LEFT JOIN rep USING (doc_id))""",
)
def _(spark, sf):
    return ql.repetition(spread(table(spark, sf, "documents")), "text").select(
        "doc_id", "repetition_words", "repeated_phrases", "type_token_ratio",
        r6("repetition_score").alias("repetition_score"),
    )


@reg.add(
    "quality_capitalization",
    f"""
    SELECT doc_id, low::INT AS lowercase_sentence_starts, caps::INT AS all_caps_words,
           round(CASE WHEN low + caps = 0 THEN 1.0 ELSE greatest(0.5, 1.0 - 0.1 * (low + caps)) END, 6)
             AS capitalization_score
    FROM (SELECT doc_id, {count_sql('text', ql.LOWER_START)} AS low,
                 len(list_filter(list_transform(regexp_extract_all(text, {quote(tx.NON_SPACE + '+')}),
                       lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g')),
                     lambda w: regexp_full_match(w, '\\p{{L}}{{4,}}') AND regexp_matches(w, '\\p{{Lu}}')
                               AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]'))) AS caps
          FROM documents)
    """,
)
def _(spark, sf):
    return ql.capitalization(spread(table(spark, sf, "documents")), "text").select(
        "doc_id", "lowercase_sentence_starts", "all_caps_words", r6("capitalization_score").alias("capitalization_score")
    )


def length_sql(n: str) -> str:
    return (
        f"CASE WHEN {n} < 10 THEN 0.2 WHEN {n} < 50 THEN 0.4 + 0.2 * ({n} - 10) / 40 "
        f"WHEN {n} < 100 THEN 0.6 + 0.4 * ({n} - 50) / 50 ELSE 1.0 END"
    )


@reg.add(
    "quality_length",
    f"""SELECT doc_id, len(w)::INT AS n_words, round({length_sql('len(w)')}, 6) AS length_score,
               len(w) < 100 AS is_too_short
        FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)""",
)
def _(spark, sf):
    n = F.size(tx.tokenize_words("text"))
    return (
        table(spark, sf, "documents")
        .select("doc_id", n.alias("n_words"))
        .select(
            "doc_id", "n_words", r6(ql.length_score(F.col("n_words"))).alias("length_score"),
            (F.col("n_words") < ql.FULL_LENGTH_WORDS).alias("is_too_short"),
        )
    )


def report_sql(extra_where: str = "", grammar: str | None = None) -> str:
    """SQL twin of ``text_quality`` over the planted documents."""
    punct = f"""
    SELECT doc_id, {count_sql('nt', ql.SPACE_BEFORE)} + {count_sql('nt', ql.MISSING_AFTER)}
           - {count_sql('nt', ql.MISSING_AFTER_DECIMAL)} + {count_sql('nt', ql.MULTI_SPACE)}
           + {count_sql('nt', ql.SPACE_AFTER_OPEN)} + {count_sql('nt', ql.SPACE_BEFORE_CLOSE)} AS total_issues,
           {count_sql('nt', tx.NON_SPACE + '+')} AS space_words
    FROM (SELECT doc_id, {normalize_sql('ro_text')} AS nt FROM {DOCS})"""
    plain = "0.5 * g_dia + 0.35 * g_cs + 0.15 * g_len"
    base = plain if grammar is None else f"0.35 * g_dia + 0.2 * g_cs + 0.1 * g_len + 0.25 * {grammar}"
    return f"""
    WITH lists AS MATERIALIZED ({_LISTS}), punct AS MATERIALIZED ({punct}),
    parts AS (SELECT l.doc_id, l.source, l.lang, len(words) AS n_words, len(english) AS n_english,
                     {count_sql('nt', tx.TOKEN_PATTERN)} AS n_tokens, len(bad) AS n_bad, len(known) - len(bad) AS n_good,
                     {_DIA_SCORE} AS dia, has_dia, total_issues,
                     CASE WHEN len(words) > 0 THEN len(english) / len(words) ELSE 0.0 END AS rate,
                     {length_sql('len(words)')} AS g_len,
                     CASE WHEN total_issues = 0 THEN 1.0
                          ELSE greatest(0.3, 1.0 - 5.0 * total_issues / greatest(space_words, 1)) END AS g_punct
              FROM lists l JOIN punct p ON l.doc_id = p.doc_id),
    flagged AS (SELECT *, CASE WHEN rate > 0.15 THEN 0.1 ELSE exp(-20 * rate) END AS g_cs,
                       CASE WHEN rate > 0.15 THEN least(dia, 0.3) ELSE dia END AS g_dia FROM parts),
    report AS (SELECT *, ({base}) * (0.5 + 0.5 * g_punct) AS g FROM flagged)
    """


@reg.add(
    "quality_report",
    report_sql()
    + """SELECT doc_id, round(g, 6) AS "G", round(g_dia, 6) AS "G_dia", round(g_cs, 6) AS "G_cs",
                round(g_len, 6) AS "G_len", round(g_punct, 6) AS "G_punct", n_tokens::INT AS n_tokens,
                n_words::INT AS n_words, n_bad::INT AS dia_missing, n_good::INT AS dia_correct,
                n_english::INT AS english_words, total_issues::INT AS total_issues, has_dia AS has_diacritics,
                rate > 0.15 AS is_likely_english, n_words < 100 AS is_too_short FROM report""",
)
def _(spark, sf):
    r = ql.text_quality(documents(spark, sf), "ro_text")
    scores = ["G", "G_dia", "G_cs", "G_len", "G_punct"]
    return r.select(
        "doc_id", *[r6(c).alias(c) for c in scores], "n_tokens", "n_words", "dia_missing", "dia_correct",
        "english_words", "total_issues", "has_diacritics", "is_likely_english", "is_too_short",
    )


@reg.add(
    "quality_overall",
    report_sql()
    + 'SELECT source, count(*) AS n, round(avg(g), 6) AS "avg_G", round(min(g), 6) AS "min_G" FROM report GROUP BY 1',
)
def _(spark, sf):
    r = ql.text_quality(documents(spark, sf), "ro_text", detail=False)
    return r.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("G")).alias("avg_G"), r6(F.min("G")).alias("min_G")
    )


@reg.add(
    "quality_with_grammar",
    report_sql(grammar="exp(-2.5 * (doc_id % 7) / 10)").replace("AS g FROM flagged", "AS g FROM flagged")
    + 'SELECT doc_id, round(g, 6) AS "G" FROM report',
)
def _(spark, sf):
    docs = documents(spark, sf).withColumn("gr", F.exp(F.lit(-2.5) * (F.col("doc_id") % 7) / 10))
    return ql.text_quality(docs, "ro_text", grammar="gr", detail=False).select("doc_id", r6("G").alias("G"))


# --- grammar findings ------------------------------------------------------------------------------------------
# Findings derived from the text itself: every word of eight letters or more is one, its kind set by its length.
_KINDS = ("grammar", "misspelling", "typographical", "style", "other")
_FINDINGS = f"""
    SELECT doc_id, CASE WHEN length(token) % 2 = 0 THEN 'MORFOLOGIK_RULE_RO' ELSE 'RO_AGREEMENT' END AS rule_id,
           ['grammar', 'misspelling', 'typographical', 'style', 'other'][1 + length(token) % 5] AS issue_type,
           stop - length(token) AS start, length(token) AS len, token
    FROM ({_TOKENS}) WHERE length(token) >= 8 AND regexp_full_match(token, {quote(tx.WORD_PATTERN)})
"""
_SKIP = "(rule_id LIKE '%MORFOLOGIK%' AND regexp_matches(token, '^[\\p{Lu}\\p{Lt}]'))"
_WEIGHT = "CASE issue_type WHEN 'grammar' THEN 3 WHEN 'misspelling' THEN 2 ELSE 1 END"


def findings(spark, sf):
    tokens = tx.tokens(documents(spark, sf), ["doc_id"], "ro_text").where("is_word AND char_length(token) >= 8")
    n = F.char_length("token")
    return tokens.select(
        "doc_id",
        F.when(n % 2 == 0, "MORFOLOGIK_RULE_RO").otherwise("RO_AGREEMENT").alias("rule_id"),
        F.get(F.array(*[F.lit(k) for k in _KINDS]), n % 5).alias("issue_type"),
        F.col("start").alias("offset"),
        n.alias("length"),
    )


@reg.add(
    "grammar_proper_nouns",
    f"SELECT rule_id, issue_type, {_SKIP} AS skipped, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1, 2, 3",
)
def _(spark, sf):
    marked = gr.filter_findings(findings(spark, sf), documents(spark, sf), "doc_id", "ro_text")
    return marked.groupBy("rule_id", "issue_type", "skipped").agg(F.count(F.lit(1)).alias("n"))


_GRAMMAR = f"""
    SELECT d.doc_id, {count_sql('ro_text', tx.NON_SPACE + '+')} AS words, coalesce(raw, 0) AS raw,
           coalesce(kept, 0) AS kept, coalesce(skipped, 0) AS skipped, coalesce(weighted, 0) AS weighted
    FROM {DOCS} d LEFT JOIN (
      SELECT doc_id, count(*) AS raw, count(*) FILTER (WHERE NOT {_SKIP}) AS kept,
             count(*) FILTER (WHERE {_SKIP}) AS skipped,
             sum(CASE WHEN {_SKIP} THEN 0 ELSE {_WEIGHT} END) AS weighted
      FROM ({_FINDINGS}) GROUP BY doc_id) f ON d.doc_id = f.doc_id
"""
_DENSITY = "CASE WHEN words > 0 THEN weighted / words ELSE 0.0 END"


@reg.add(
    "grammar_scores",
    f"""SELECT doc_id, raw::BIGINT AS raw_error_count, kept::BIGINT AS error_count,
               skipped::BIGINT AS skipped_proper_nouns, weighted::BIGINT AS weighted_errors,
               round({_DENSITY}, 6) AS error_density, round(exp(-2.5 * {_DENSITY}), 6) AS grammar_score,
               round(greatest(0.0, 100.0 - 100.0 * {_DENSITY}), 6) AS percent_score FROM ({_GRAMMAR})""",
)
def _(spark, sf):
    s = gr.grammar_scores(findings(spark, sf), documents(spark, sf), "doc_id", "ro_text")
    return s.select(
        "doc_id", "raw_error_count", "error_count", "skipped_proper_nouns", "weighted_errors",
        *[r6(c).alias(c) for c in ("error_density", "grammar_score", "percent_score")],
    )


@reg.add(
    "grammar_totals",
    f"SELECT count(*) AS processed, sum(skipped)::BIGINT AS skipped_proper_nouns FROM ({_GRAMMAR})",
)
def _(spark, sf):
    return gr.report_totals(gr.grammar_scores(findings(spark, sf), documents(spark, sf), "doc_id", "ro_text"))


@reg.add(
    "grammar_min_findings",
    f"SELECT doc_id, kept::BIGINT AS error_count FROM ({_GRAMMAR}) WHERE kept >= 50",
)
def _(spark, sf):
    scores = gr.grammar_scores(findings(spark, sf), documents(spark, sf), "doc_id", "ro_text")
    return gr.at_least(scores, 50).select("doc_id", "error_count")


_EVENT_WEIGHT = "CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END"


@reg.add(
    "grammar_severity_sum",
    f"""SELECT user_id, sum({_EVENT_WEIGHT})::BIGINT AS weighted_errors, count(*) AS n,
               round(exp(-2.5 * sum({_EVENT_WEIGHT}) / (10 * count(*))), 6) AS grammar_score
        FROM events GROUP BY user_id""",
)
def _(spark, sf):
    kind = F.when(F.col("event_type") == "error", "grammar").when(F.col("event_type") == "click", "misspelling")
    sums = table(spark, sf, "events").groupBy("user_id").agg(
        F.sum(gr.issue_weight(kind.otherwise(F.col("event_type")))).alias("weighted_errors"),
        F.count(F.lit(1)).alias("n"),
    )
    scored = gr.score_findings(sums.withColumn("total_words", F.col("n") * 10))
    return scored.select("user_id", "weighted_errors", "n", r6("grammar_score").alias("grammar_score"))
