"""The registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import ann, bpe, classifier, collocations, html_extract, langid, line_dedup, minhash, mixing, pii, quality_rules, runs, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), "doc_id")


def op2_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(_table(spark, sf_dir, "embeddings"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_table(spark, sf_dir, "documents"))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op11_maximal_pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_table(spark, sf_dir, "documents"))


def op12_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op13_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    of = (op1_quality_divergence, op2_one_bit_ann, op3_temperature_mixing, op4_substring_dedup, op5_bpe_trie, op6_byte_cnn, op7_html_tree, op8_minhash_forest, op9_pii, op10_fuzzy_lines, op11_maximal_pair_runs, op12_kneser_ney_language, op13_phrase_streams, pipeline)
    return {f.__name__: f for f in of}


def oracle_sql() -> dict[str, str]:
    return {"op2_one_bit_ann": ORACLE_NEAREST, "op3_temperature_mixing": ORACLE_MIXING, "op4_substring_dedup": ORACLE_WINDOWS, "op8_minhash_forest": ORACLE_COMPONENTS, "op11_maximal_pair_runs": ORACLE_RUNS, "op13_phrase_streams": ORACLE_PHRASES} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


#: Brute force; at these sizes the bounds leave no neighbour out.
ORACLE_NEAREST = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id != q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

ORACLE_MIXING = f"""
WITH RECURSIVE each AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), t AS MATERIALIZED (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM each GROUP BY source),
a AS MATERIALIZED (SELECT list(n ORDER BY source) FILTER (n > 0) AS ns, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 0) AS live FROM t),
h AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN met THEN mid ELSE low END, CASE WHEN met THEN high ELSE mid END FROM (
    SELECT i, low, high, mid, -list_sum(list_transform(r, lambda x: (x / list_sum(r)) * ln(x / list_sum(r)))) >= {mixing.TARGET_ENTROPY} * ln(live) AS met
    FROM (SELECT i, low, high, (low + high) / 2 AS mid, live, list_transform(ns, lambda x: pow(x / total, (low + high) / 2)) AS r FROM h, a WHERE i < {mixing.HALVINGS})
  )
), e AS MATERIALIZED (
  SELECT CASE WHEN live < 2 OR -list_sum(list_transform(ns, lambda x: (x / total) * ln(x / total))) >= {mixing.TARGET_ENTROPY} * ln(live) THEN 1 ELSE low END AS x FROM h, a WHERE i = {mixing.HALVINGS}
), g AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END FROM (
    SELECT i, low, high, mid, list_bool_and(list_transform(list_zip(r, ns), lambda z: z[1] / list_sum(r) * total <= {mixing.MAX_REPEATS} * z[2])) AS fits
    FROM (SELECT i, low, high, (low + high) / 2 AS mid, ns, total, list_transform(ns, lambda x: pow(x / total, (low + high) / 2)) AS r FROM g, a WHERE i < {mixing.HALVINGS})
  )
), chosen AS MATERIALIZED (
  SELECT CASE WHEN list_bool_and(list_transform(list_zip(r, ns), lambda z: z[1] / list_sum(r) * total <= {mixing.MAX_REPEATS} * z[2])) THEN x ELSE greatest(x, high) END AS x, total, ns
  FROM (SELECT x, total, ns, high, list_transform(ns, lambda y: pow(y / total, x)) AS r FROM e, a, g WHERE i = {mixing.HALVINGS})
), b AS MATERIALIZED (
  SELECT source, CASE WHEN n > 0 THEN budget // n ELSE 1 END AS f, CASE WHEN n > 0 THEN budget % n ELSE 0 END AS rest, greatest(1, (n + {mixing.BLOCK_TOKENS} - 1) // {mixing.BLOCK_TOKENS}) AS blocks
  FROM (SELECT source, n, CAST(CAST(floor((CASE WHEN n > 0 THEN pow(n / total, x) / list_sum(list_transform(ns, lambda y: pow(y / total, x))) ELSE 0 END) * 1000000000 + 0.5) AS HUGEINT) * total // 1000000000 AS BIGINT) AS budget FROM t, chosen)
), d AS MATERIALIZED (
  SELECT doc_id, source, n_tokens, f, rest, CAST('0x' || substr(md5('mix:block:' || doc_id), 1, 8) AS BIGINT) % blocks AS block FROM each JOIN b USING (source)
), begun AS (
  SELECT source, block, coalesce(sum(n) OVER (PARTITION BY source ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, block, sum(n_tokens) AS n, CAST('0x' || substr(md5('mix:order:' || source || ':' || block || ':' || (f + 1)), 1, 8) AS BIGINT) AS o FROM d GROUP BY source, block, f)
), last AS (
  SELECT doc_id, source, n_tokens, block, f + 1 AS pass, rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY CAST('0x' || substr(md5('mix:doc:' || doc_id || ':' || (f + 1)), 1, 8) AS BIGINT), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
  FROM d WHERE rest > 0
), taken AS (
  SELECT doc_id, source, n_tokens, block, unnest(range(1, f + 1)) AS pass FROM d
  UNION ALL SELECT doc_id, source, n_tokens, block, pass FROM last JOIN begun USING (source, block) WHERE before + inside < rest
)
SELECT doc_id, source, n_tokens, CAST(pass AS BIGINT) AS pass, block,
  CAST('0x' || substr(md5('mix:order:' || source || ':' || block || ':' || pass), 1, 8) AS BIGINT) AS block_order,
  CAST('0x' || substr(md5('mix:doc:' || doc_id || ':' || pass), 1, 8) AS BIGINT) AS doc_order
FROM taken
"""

#: Every window as text: its smallest document, and the words that a repeated window covers.
ORACLE_WINDOWS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, CASE WHEN count(*) OVER f = {substring.WIDTH} THEN string_agg(w, ' ') OVER f END AS k FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {substring.WIDTH - 1} FOLLOWING)),
m AS (SELECT k, min(doc_id) AS first FROM g WHERE k IS NOT NULL GROUP BY k),
h AS (SELECT doc_id, i, w, max(coalesce(first < doc_id, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {substring.WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM g LEFT JOIN m USING (k)),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

#: Pairs that share one of the rarest shingles that an alike pair must share, confirmed on full sets; then reachability.
ORACLE_COMPONENTS = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS sh FROM d),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s),
f AS MATERIALIZED (SELECT x, count(*) AS c FROM e GROUP BY x),
p AS MATERIALIZED (SELECT doc_id, x FROM (SELECT doc_id, x, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS k FROM e JOIN f USING (x)) WHERE k <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.sh, y.sh)) AS i, len(x.sh) + len(y.sh) AS n FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b) WHERE 100 * i >= 80 * (n - i)),
u AS MATERIALIZED (SELECT a AS v, b AS w FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT v AS root, v AS reached FROM u UNION SELECT r.root, u.w FROM r JOIN u ON u.v = r.reached),
m AS (SELECT root, min(reached) AS component_id FROM r GROUP BY root)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN m ON m.root = s.doc_id
"""

#: Pairs of equal windows of 16 words whose words before differ; how far they reach; the smallest period of a stretch.
ORACLE_RUNS = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM documents),
h AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(bytes, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) AS h FROM d),
m AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) ELSE 1 END AS p FROM h),
t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE ws END AS ws FROM m),
g AS MATERIALIZED (SELECT doc_id, n, unnest(range(0, n - 15)) AS i, unnest(list_transform(range(1, n - 14), lambda i: array_to_string(ws[i:i + 15], ' '))) AS w16, unnest(list_transform(range(1, n - 14), lambda i: CASE WHEN i > 1 THEN ws[i - 1] END)) AS before FROM t WHERE n >= 24),
-- places where equal windows of 16 words begin, a period apart, and the words before differ
c AS MATERIALIZED (SELECT x.doc_id, x.i AS s, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.w16 = y.w16 AND y.i > x.i AND x.before IS DISTINCT FROM y.before AND 3 * (y.i - x.i) <= x.n - x.i),
-- how far the words stay equal
e AS (SELECT doc_id, s, q, coalesce(list_position(list_transform(range(s + 1, n - q + 1), lambda k: ws[k] = ws[k + q]), false) - 1, n - q - s) + q AS len FROM c JOIN t USING (doc_id)),
r AS MATERIALIZED (SELECT doc_id, s, len, min(q) AS q FROM e WHERE len >= greatest(24, 3 * q) GROUP BY doc_id, s, len),
b AS (SELECT doc_id, s, len, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len * 1000000000 // q AS BIGINT) DESC, s, q) = 1),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(ws) AS w FROM t) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Every phrase of one to five words, every cut, and every phrase inside a longer one.
ORACLE_PHRASES = """
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]'), lambda p: regexp_extract_all(p, '[^\\x20\\x09]+')) AS ps FROM documents
), w AS MATERIALIZED (SELECT lang, unnest(ps) AS ws FROM pieces),
words AS MATERIALIZED (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, unnest(range(1, 6)) AS k FROM w WHERE len(ws) > 0),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM g) GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cuts AS (SELECT lang, phrase, k, a, unnest(range(1, k)) AS j, ws FROM c),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.f AS l, y.f AS r, CAST(n AS BIGINT) AS n, j, CAST(1000::HUGEINT * cuts.a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN words ON words.lang = cuts.lang
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[j + 1:cuts.k], ' ')
), worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, k, a AS longer, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM c),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ USING (lang, phrase) WHERE 100 * longer >= 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= 2000
"""
