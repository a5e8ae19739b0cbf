"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakwise.llm import bpe, jaccard, licenses, lines, mixing, pii, quality, rules, sharding, spelling, topk, toxicity, whitening
from peakwise.llm.common import WORD, id_crc, stored, table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op1_mix_sources"] = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS n, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM sized GROUP BY source),
prefix AS (
  SELECT *, row_number() OVER (ORDER BY 2 * n / w, source NULLS LAST) AS k, 1.5 * sum(n) OVER () AS budget, 2 * n / w AS ratio,
         sum(2 * n) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS used,
         sum(w) OVER () - sum(w) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS free,
         lead(2 * n / w) OVER (ORDER BY 2 * n / w, source NULLS LAST) AS next_ratio FROM sources),
levels AS (
  SELECT 0 AS k, budget / (SELECT sum(w) FROM sources) AS level, (SELECT min(ratio) FROM prefix) AS next_ratio FROM prefix
  UNION ALL SELECT k, (budget - used) / free, next_ratio FROM prefix WHERE free > 0),
level AS (SELECT arg_min(level, k) AS level FROM levels WHERE level <= next_ratio),
targets AS (SELECT source, n, least(w * level, 2 * n) AS target FROM sources, level),
ordered AS (
  SELECT s.*, t.n, t.target, CASE WHEN t.n > 0 THEN floor(t.target / t.n) ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + s.size / 2.0 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN middle < target - whole * n THEN 1 ELSE 0 END))::BIGINT AS taken FROM ordered
"""


@query
def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The checksum is taken before the rows move, so that no text is shuffled.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"))
    sharded = sharding.shard_documents(docs, shards=16)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.encode_documents(docs, vocabulary, decoded="decoded")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLES["op4_top_k"] = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = stored(rules.measure(docs).drop("text"), "rule-measures")
    judged = rules.judge(measured, rules.thresholds(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_OP6_LIMITS = """
 SELECT {keys}, measure, max(total) AS rows, min(CASE WHEN upto * 4 >= total THEN middle END) AS q1,
        min(CASE WHEN upto * 4 >= total * 3 THEN middle END) AS q3
 FROM (SELECT {keys}, measure, CASE WHEN bucket < 0 THEN 0.0::DOUBLE ELSE exp((bucket + 0.5::DOUBLE) / 50) END AS middle,
              sum(n) OVER (PARTITION BY {keys}, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}, measure) AS total
       FROM (SELECT {keys}, measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL
"""
ORACLES["op6_quality_rules"] = rf"""
WITH worded AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 7] AS g FROM worded, unnest(generate_series(1, len(w) - 7)) AS t(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
steps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM twice WHERE n > 1),
repeats AS (SELECT doc_id, sum(step)::BIGINT AS n_repeat_words FROM steps GROUP BY doc_id),
lined AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{WORD}')] AS l FROM worded),
measured AS (
  SELECT doc_id, coalesce(lang, 'null') AS lang, coalesce(source, 'null') AS source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM worded JOIN lined USING (doc_id) LEFT JOIN repeats USING (doc_id)),
failing AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                   CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
                   CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length,
                   CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS repeated_lines FROM measured),
long AS (SELECT lang, source, 'symbols' AS measure, symbols AS v FROM failing WHERE NOT base_failed
         UNION ALL SELECT lang, source, 'word_length', word_length FROM failing WHERE NOT base_failed
         UNION ALL SELECT lang, source, 'repeated_lines', repeated_lines FROM failing WHERE NOT base_failed),
sketch AS (SELECT lang, source, '' AS everything, measure, CASE WHEN v <= 0 THEN -1 ELSE floor(ln(v::DOUBLE) * 50) END AS bucket, count(*) AS n
           FROM long GROUP BY ALL),
own AS ({_OP6_LIMITS.format(keys='lang, source')}), by_lang AS ({_OP6_LIMITS.format(keys='lang')}),
overall AS ({_OP6_LIMITS.format(keys='everything')}),
chosen AS (
  SELECT own.lang, own.source, own.measure, CASE WHEN own.rows >= 100 THEN own.q1 WHEN by_lang.rows >= 100 THEN by_lang.q1 ELSE overall.q1 END AS q1,
         CASE WHEN own.rows >= 100 THEN own.q3 WHEN by_lang.rows >= 100 THEN by_lang.q3 ELSE overall.q3 END AS q3
  FROM own JOIN by_lang ON own.lang = by_lang.lang AND own.measure = by_lang.measure JOIN overall ON own.measure = overall.measure),
limits AS (SELECT lang, source, measure, round(q1 - 5 * greatest(q3 - q1, least_spread)) AS low, round(q3 + 5 * greatest(q3 - q1, least_spread)) AS high
           FROM chosen JOIN (VALUES ('symbols', 40.0::DOUBLE), ('word_length', 100), ('repeated_lines', 100)) AS s(measure, least_spread) USING (measure))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND symbols BETWEEN a.low AND a.high AND word_length BETWEEN b.low AND b.high AND repeated_lines BETWEEN c.low AND c.high AS kept
FROM failing f LEFT JOIN limits a ON a.lang = f.lang AND a.source = f.source AND a.measure = 'symbols'
LEFT JOIN limits b ON b.lang = f.lang AND b.source = f.source AND b.measure = 'word_length'
LEFT JOIN limits c ON c.lang = f.lang AND c.source = f.source AND c.measure = 'repeated_lines'
"""


@query
def op8_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = licenses.scan_licenses(docs)
    return scanned.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def _op8_sql() -> str:
    word, lowered = licenses.WORD_ANY_CASE, "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split(' ')!r}, {label!r})" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({text!r}, {label!r})" for text, label in licenses.TEMPLATES)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({lowered.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w) x
           JOIN phrases ON w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates AS (SELECT list_distinct(tw) AS t, 2 * len(tw) AS n, ceil({licenses.THRESHOLD} * len(list_distinct(tw)) - 1e-9) AS need, label
              FROM (SELECT regexp_extract_all({lowered.format("t")}, '{word}') AS tw, label FROM (VALUES {templates}) AS x(t, label))),
lines AS (SELECT DISTINCT doc_id, regexp_extract_all({lowered.format("line")}, '{word}') AS b
          FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
runs AS (SELECT doc_id, t, label, need, w[s:s + n - 1] AS b FROM (
         SELECT doc_id, w, t, n, need, label, unnest(generate_series(1, greatest(len(w) - n, 0) + 1)) AS s FROM w JOIN templates ON len(list_intersect(t, w)) >= need)),
found AS (SELECT doc_id, label, len(list_intersect(t, b))::DOUBLE / len(t) AS share FROM lines JOIN templates ON len(list_intersect(t, b)) >= need
          UNION ALL SELECT doc_id, label, len(list_intersect(t, b))::DOUBLE / len(t) FROM runs WHERE len(list_intersect(t, b)) >= need),
more AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLES["op8_scan_licenses"] = _op8_sql()


@query
def op9_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    base = F.filter("spans", lambda s: s["k"] < len(pii.PATTERNS))
    return found.select("doc_id", *[n(k) for k in range(len(pii.PATTERNS))],
                        F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query
def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op11_dedup_lines"] = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op12_group_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = found.select(spelling.drop_letter(F.col("doc_id"), F.col("run")).alias("word"))
    return spelling.group_variants(spelling.count_words(words))


ORACLES["op12_group_spellings"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM generate_series(0::BIGINT, 255::BIGINT) AS s(i))),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM found WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (SELECT run, n, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END
                                  FOR x IN string_split(s, '')]) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) AS h
           FROM bytes, crc),
dropped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM dropped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
longer AS (SELECT DISTINCT w.word AS a, w.n AS na, s.word AS b, s.n AS nb FROM shorter s JOIN words w ON s.d = w.word),
near AS (SELECT x.word, y.word AS near, y.n AS near_n FROM shorter x JOIN shorter y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
         UNION ALL SELECT a, b, nb FROM longer UNION ALL SELECT b, a, na FROM longer),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
                 CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS at FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON f.at = g.word AND g.form IS NOT NULL),
roots AS (SELECT f.word, f.at AS root FROM follow f JOIN forms g ON f.at = g.word AND g.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)
"""


@query
def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
