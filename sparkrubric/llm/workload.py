"""Registered queries of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrubric.llm import bags, classifier, credentials, language, lines, mixing, pieces, repeats, rules, search, setsketch, simhash, spelling
from workload.base import Registry, table

reg = Registry()


def remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


@reg.add("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    prototypes = language.train(documents, F.when(remainder(5) != 0, F.col("lang")))
    found = language.predict(documents.select("doc_id", "text"), prototypes)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "cosine")


MIX_SQL = """
WITH counts AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
total AS (SELECT sum(n) AS n, sum(weight) AS weight FROM counts),
rates AS (SELECT c.source, c.weight / t.weight * t.n / c.n AS rate FROM counts c, total t),
cumulative AS (
    SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS below
    FROM rates, generate_series(0, 200) AS g(k)
),
drawn AS (
    SELECT d.*, ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d
),
counted AS (
    SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source,
        any_value(d.n_chars) AS n_chars, count(*) FILTER (WHERE c.below <= d.u) AS n
    FROM drawn d JOIN cumulative c ON c.source IS NOT DISTINCT FROM d.source GROUP BY d.doc_id
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
    ('0x' || substr(md5('17#' || doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, n)) AS copy FROM counted WHERE n > 0)
"""


@reg.add("op4_poisson_mix", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@reg.add("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    code = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return found.select("doc_id", code.alias("fingerprint"), "component_id")


@reg.add("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


LINES_SQL = """
WITH lines AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
        unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS n
    FROM documents WHERE text IS NOT NULL
),
tokens AS (
    SELECT doc_id, text, n, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'),
        lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS t
    FROM lines
),
leaves AS (SELECT *, len(t) AS k, t[1:3] AS lead FROM tokens WHERE len(list_filter(t, lambda w: w <> '<*>')) > 0),
busy AS (
    SELECT k, lead FROM leaves WHERE k > 3 GROUP BY k, lead
    HAVING count(DISTINCT text) * 2 >= 10 AND count(DISTINCT t) > 1
),
placed AS (
    SELECT doc_id, text, n, k, lead, unnest(t[4:]) AS w, unnest(generate_series(4, k)) AS p
    FROM leaves JOIN busy USING (k, lead)
),
sizes AS (SELECT k, lead, p, count(*) AS size FROM placed GROUP BY k, lead, p),
constants AS (
    SELECT k, lead, p, w FROM (SELECT k, lead, p, w, count(*) AS n FROM placed GROUP BY k, lead, p, w)
    JOIN sizes USING (k, lead, p) WHERE 2 * n > size
),
general AS (
    SELECT DISTINCT text, n FROM placed JOIN constants USING (k, lead, p, w)
    GROUP BY doc_id, text, n, k HAVING count(*) / (k - 3) >= 0.6
),
templates AS (
    SELECT l.doc_id, l.text, l.n, CASE WHEN g.n IS NOT NULL THEN 'leaf ' || k || ' ' || array_to_string(lead, ' ')
        ELSE 'line ' || array_to_string(t, ' ') END AS template
    FROM leaves l LEFT JOIN general g ON g.text = l.text AND g.n = l.n
),
recurring AS (
    SELECT template, min((doc_id, n)) AS first FROM templates GROUP BY template HAVING count(DISTINCT text) >= 10
),
later AS (SELECT doc_id, n FROM templates JOIN recurring USING (template) WHERE (doc_id, n) <> first),
kept AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM lines ANTI JOIN later USING (doc_id, n) GROUP BY doc_id
),
counted AS (SELECT doc_id, count(*) AS n FROM later GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::INTEGER AS n_lines, coalesce(c.n, 0)::INTEGER AS n_dropped,
    CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counted c USING (doc_id)
"""


@reg.add("op8_line_templates", LINES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_templates(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


RULES_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
),
line_counts AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
),
words AS (
    SELECT doc_id, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
windows AS (
    SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words)
),
repeated AS (
    SELECT doc_id, unnest(generate_series(i, i + 4)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM repeated GROUP BY doc_id),
counts AS (
    SELECT doc_id, stratum, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM words LEFT JOIN line_counts USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
measured AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
        CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars
    FROM counts
),
long AS (
    SELECT doc_id, stratum, measure, value FROM measured
    UNPIVOT (value FOR measure IN (symbol_ratio, dup_line_ratio, repeat_ratio, upper_ratio, mean_word_chars))
),
cutoffs(measure, place, cutoff) AS (VALUES {cutoffs}),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
tries AS (
    SELECT stratum, measure, place, cutoff, count(*) AS n, count(*) FILTER (WHERE value > cutoff) AS k
    FROM long JOIN good USING (doc_id) JOIN cutoffs USING (measure) GROUP BY ALL
),
tested AS (
    SELECT *, list_sum(list_transform(generate_series(0, k), lambda i: exp(
        lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.004) + (n - i) * ln(0.996)))) AS p,
        (SELECT count(DISTINCT stratum) FROM tries) AS strata
    FROM tries
),
ends AS (
    SELECT stratum, measure, min(CASE WHEN p > 0.05 / (strata * 5) THEN place END) AS failed_at, max(place) AS last
    FROM tested GROUP BY ALL
),
chosen AS (
    SELECT t.stratum, t.measure, t.cutoff FROM tested t JOIN ends e USING (stratum, measure)
    WHERE t.place = coalesce(e.failed_at - 1, e.last)
),
rejected AS (SELECT DISTINCT doc_id FROM long JOIN chosen USING (stratum, measure) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM measured
""".replace(
    "{cutoffs}", ", ".join(f"('{m}', {n}, {c})" for m, cs in rules.CUTOFFS.items() for n, c in enumerate(cs))
)


@reg.add("op2_risk_controlled_rules", RULES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


REPEATS_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words)
),
later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM windows) WHERE first < doc_id
),
removed AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM later),
numbered AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM words),
kept AS (
    SELECT n.doc_id, string_agg(word, ' ' ORDER BY n.p) AS text, count(*) AS n
    FROM numbered n LEFT JOIN removed r ON n.doc_id = r.doc_id AND n.p = r.p WHERE r.p IS NULL GROUP BY n.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(w.w)::BIGINT - coalesce(k.n, 0) AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""


@reg.add("op3_seed_and_extend", REPEATS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SECRETS_SQL = """
WITH kinds(kind, name, pattern, prefix, least) AS (VALUES
    (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+',
        '^(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?', 8),
    (1, 'access', 'AKIA[A-Z0-9]+', '^$', 16),
    (2, 'hex', '[0-9a-f]+', '^$', 32),
    (3, 'generic', '[A-Za-z0-9+/_-]{20,}', '^$', 20)
),
matches AS (
    SELECT doc_id, source, text, kind, name, prefix, least, unnest(m) AS m, unnest(gaps[:len(m)]) AS gap, unnest(generate_series(1, len(m))) AS i
    FROM (
        SELECT d.doc_id, d.source, d.text, k.*, regexp_extract_all(coalesce(d.text, ''), k.pattern) AS m,
            string_split_regex(coalesce(d.text, ''), k.pattern) AS gaps
        FROM documents d, kinds k
    )
),
placed AS (
    SELECT *, regexp_replace(m, prefix, '') AS value,
        sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
    FROM matches
),
candidates AS (
    SELECT doc_id, source, text, kind, name, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop, value,
        len(list_distinct(string_split(value, ''))) >= 8 AS varied
    FROM placed
    WHERE length(value) >= least AND (kind < 3 OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]'))
),
held AS (SELECT value, text, min(coalesce('by ' || source, '')) AS owner FROM candidates GROUP BY value, text),
owned AS (SELECT value, count(DISTINCT owner) AS owners, count(*) AS texts FROM held GROUP BY value),
spans AS (
    SELECT c.*, varied AND owners < 3 AND texts < 10 AS live FROM candidates c JOIN owned USING (value)
    WHERE kind < 3 OR varied AND owners < 3 AND texts < 10 AND NOT EXISTS (
        SELECT 1 FROM candidates b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.start < c.stop AND c.start < b.stop)
),
listed AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
        count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE live) AS n_live,
        string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
        string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN listed USING (doc_id)
"""


#: From so many owners, or different texts, on a value is a widely copied example; copies of a text count once.
OWNERS, TEXTS = 3, 10


@reg.add("op5_secret_ownership", SECRETS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(table(spark, sf_dir, "documents"), copied_by=OWNERS, copied_in=TEXTS)
    base = F.filter("found", lambda s: s["kind"] < credentials.BASE)

    def count(kind: int):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{credentials.KINDS[kind][0]}")

    counts = [count(n) for n in range(credentials.BASE)]
    n_live = F.size(F.filter("found", lambda s: s["live"])).cast("long")
    spans = credentials.span_list
    return found.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"), n_live.alias("n_live"))


@reg.add("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = classifier.train(documents, table(spark, sf_dir, "labels"), remainder(3) != 1)
    found = classifier.score(documents, model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


SEARCH_SQL = """
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z0-9[:^ascii:]]+') AS w FROM documents
),
lengths AS (SELECT doc_id, len(w) AS length, avg(len(w)) OVER () AS mean FROM words),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY doc_id, term),
weights AS (
    SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), (SELECT count(*) AS n FROM documents)
),
scored AS (
    SELECT q.doc_id AS query_id, c.doc_id, sum(idf * c.tf * 2.2 / (c.tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
    FROM counts q JOIN weights USING (term) JOIN counts c USING (term) JOIN lengths l ON l.doc_id = c.doc_id
    WHERE q.doc_id % 100 = 0 GROUP BY ALL
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""


@reg.add("op10_bm25_search", SEARCH_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = search.search(documents, documents.where("doc_id % 100 = 0"))
    return found.withColumn("score", F.round("score", 6))


NEAR_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
classes AS (SELECT w, min(doc_id) AS first FROM words WHERE len(w) > 0 GROUP BY w),
shingles AS (
    SELECT DISTINCT first, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS shingle
    FROM (SELECT first, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM classes)
),
sizes AS (SELECT first, count(*) AS n FROM shingles GROUP BY first),
shared AS (
    SELECT a.first AS a, b.first AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.first <> b.first GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM shared s JOIN sizes x ON x.first = s.a JOIN sizes y ON y.first = s.b
    WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)
),
reached AS (SELECT first AS a, first AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS first, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
    doc_id = coalesce(component_id, doc_id) AS kept
FROM words LEFT JOIN classes USING (w) LEFT JOIN sizes USING (first) LEFT JOIN roots USING (first)
"""


@reg.add("op11_setsketch_near_dedup", NEAR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


BAGS_SQL = """
WITH terms AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark
),
wanted AS (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL),
total AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS length FROM terms),
lengths AS (SELECT doc_id, 25 + (75 * len(w) * n) // length AS m FROM terms, total),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM terms) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total
),
scored AS (
    SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id) GROUP BY ALL
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@reg.add("op12_bag_search", BAGS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SPELLING_SQL = """
WITH RECURSIVE crc AS (
    SELECT list_transform(generate_series(0, 255), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS entries
),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[a-zÀ-ÿ]+')) AS run
        FROM documents
    ) GROUP BY ALL
),
coded AS (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS code FROM runs),
hashed AS (
    SELECT doc_id, run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(generate_series(1, len(code) // 2), lambda i: ('0x' || substr(code, 2 * i - 1, 2))::BIGINT)),
        lambda x, b: xor(x >> 8, entries[(xor(x, b) & 255) + 1]))) AS h
    FROM coded, crc
),
spelled AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_over
    FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words)
),
near AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.left_over = b.left_over AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.left_over
    UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.left_over
),
placed AS (
    SELECT x.word, x.other, w.n, count(*) OVER (PARTITION BY x.word) AS n_near,
        row_number() OVER (PARTITION BY x.word ORDER BY w.n DESC, x.other) AS place
    FROM near x JOIN words w ON w.word = x.other
),
forms AS (
    SELECT w.word, CASE WHEN p.n >= 2 * w.n THEN p.other END AS form, w.n, coalesce(p.n_near, 0) AS n_near,
        CASE WHEN p.n >= 2 * w.n THEN p.n END AS form_n
    FROM words w LEFT JOIN placed p ON p.word = w.word AND p.place = 1
),
followed AS (
    SELECT word, word AS root FROM forms UNION SELECT f.word, g.form FROM followed f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN followed r USING (word) JOIN forms g ON g.word = r.root AND g.form IS NULL
"""


@reg.add("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
