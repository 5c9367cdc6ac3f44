"""Queries over documents: review, publication, sampling, scripts, scrubbing, search, self-checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import markup, money, state, text
from ledgerloom.operators import postings, reconcile, search
from ledgerloom.sources.ledger import Ledger, with_tables

# The registry that the sources of the given tables stand for.
LICENCES = [("src0", "permitted"), ("src1", "permission_required"), ("src2", "unknown"), ("src3", "permission_required"), ("src4", "permitted"), ("src5", "permission_required"), ("src6", "permission_required")]
GRANTS = [("src1", None), ("src3", "en"), ("src5", None)]
SWITCHED_ON = ["src1", "src3"]
# Words that a neutral text doesn't use.
FORBIDDEN = ("scam", "fraud", "corrupt", "looted", "worthless", "crook", "idiot")
TERM = 'the "of the" -worthless'
INDEX_TERM = 'and "of the" -on'


def _decided(rows, spark):
    licences = state.registry(spark, LICENCES)
    grants = spark.createDataFrame(GRANTS, "source_id string, issuer string")
    return state.publication_decision(rows, "source", licences, grants, SWITCHED_ON, F.col("lang"))


def publishable_sources(spark, sf_dir):
    """Whether each source's material in each language may be shown, and why."""
    rows = Ledger(spark, sf_dir).raw("documents").groupBy("source", "lang").agg(F.count("*").alias("documents"))
    return _decided(rows, spark)


def published_fact(spark, sf_dir):
    """Reviewed, publishable documents with the length of their text, and how many of their source still await review."""
    docs = Ledger(spark, sf_dir).document
    waiting = docs.where("verification_status = 'unverified'").groupBy("source").agg(F.count("*").alias("_awaiting"))
    shown = _decided(docs.where("verification_status IN ('verified', 'corrected')"), spark).where("publishable")
    origin = F.when(F.col("verification_status") == "corrected", "corrected").otherwise("as_extracted")
    return shown.join(waiting, "source", "left").select("id", "source", F.length("text").alias("n_chars"), origin.alias("origin"), "decision", F.coalesce("_awaiting", F.lit(0)).cast("long").alias("awaiting"))


def review_progress(spark, sf_dir):
    docs = Ledger(spark, sf_dir).document
    return docs.groupBy("source").agg(*[F.count_if(F.col("verification_status") == s).alias(s) for s in ("unverified", "verified", "corrected", "rejected")])


def stratified_sample(spark, sf_dir):
    """Twenty documents of each language, the same ones every time: the first by the hash of their ids."""
    docs = Ledger(spark, sf_dir).document.select("id", "lang", F.md5(F.concat_ws(":", F.lit("sample"), F.col("id")).cast("binary")).alias("key"))
    return docs.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("key"))).where("place <= 20").select("lang", "id", "place")


def distinct_on_sentence(spark, sf_dir):
    """Of documents of a source that open with the same line, the one with the lowest id."""
    rows = Ledger(spark, sf_dir).document.select("id", "source", F.substring_index("text", "\n", 1).alias("line"))
    return reconcile.first_of_each(rows, ["source", "line"], F.asc("id")).select("id", "source", F.md5(F.col("line").cast("binary")).alias("line_md5"))


def sentence_counts(spark, sf_dir):
    """Sentences of each document and the longest one."""
    rows = Ledger(spark, sf_dir).document.select("id", text.sentences(F.col("text")).alias("s"))
    return rows.select("id", F.size("s").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).alias("longest"))


def script_and_half(spark, sf_dir):
    t = F.col("text")
    rows = markup.bound(Ledger(spark, sf_dir).document, ["lang"], script=text.script_of(t), half=text.half_of_page(t), declares_unit=text.declares_unit(t), marks=text.substituted_marks(t))
    lost = F.coalesce(F.col("marks") >= text.LOST_MARKS, F.lit(False)).alias("lost_mark")
    return rows.groupBy("lang", "script", "half", "declares_unit", lost).agg(F.count("*").alias("documents"), F.sum("marks").alias("marks"))


def secret_scrub(spark, sf_dir):
    """Documents that hold credentials, scrubbed."""
    rows = Ledger(spark, sf_dir).document.select("id", "text", text.scrub_secrets(F.col("text")).alias("scrubbed"))
    return rows.where("scrubbed != text").select("id", F.md5(F.col("scrubbed").cast("binary")).alias("scrubbed_md5"))


def neutral_scan(spark, sf_dir):
    """Words that a neutral text doesn't use: counts of each in each document that has any."""
    words = F.array(*[F.lit(w) for w in FORBIDDEN])
    rows = Ledger(spark, sf_dir).document.select("id", F.explode(F.filter(search.tokens(F.col("text")), lambda w: F.array_contains(words, w))).alias("term"))
    return rows.groupBy("id", "term").agg(F.count("*").alias("n"))


def search_passages(spark, sf_dir):
    """The twenty best documents for a query with a phrase and a banned word; publishable ones only."""
    shown = _decided(Ledger(spark, sf_dir).document, spark).where("publishable")
    return search.passages(shown, TERM, 20).select("id", "source", "rank", (F.size(F.split("excerpt", " ")) <= search.EXCERPT_WORDS).alias("short"))


def search_index(spark, sf_dir):
    """The twenty best publishable documents for a query over postings, by how near its words stand, with their excerpts' words."""
    docs = Ledger(spark, sf_dir).document.select("id", "source", "lang", "text")
    found = postings.search(postings.build(docs), _decided(docs, spark).where("publishable").select("id", "source", "text"), INDEX_TERM, 20)
    return found.select("id", "source", "rank", F.array_join(search.tokens(F.col("excerpt")), " ").alias("excerpt_words"))


def bag_overlap(spark, sf_dir):
    """Each benchmark passage against the document of the same number: shared tokens as precision and recall."""
    x = Ledger(spark, sf_dir)
    bag = lambda df, key: df.select(F.col(key).alias("k"), F.explode(search.tokens(F.col("text"))).alias("w")).groupBy("k", "w").agg(F.count("*").alias("n"))
    truth = bag(x.raw("benchmark"), "item_id")
    docs = x.raw("documents").join(F.broadcast(x.raw("benchmark").select(F.col("item_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    both = truth.join(bag(docs, "doc_id").withColumnRenamed("n", "m"), ["k", "w"], "full_outer")
    shared = F.coalesce(F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))), F.lit(0))
    return both.groupBy(F.col("k").alias("item_id")).agg(shared.alias("shared"), F.sum("n").alias("truth"), F.sum("m").alias("found")).withColumn("recall", F.round(F.try_divide("shared", "truth"), 6)).withColumn("precision", F.round(F.try_divide("shared", "found"), 6))


def _facts(spark, sf_dir):
    """Evidence sentences from lines: one or two amounts each; every tenth stored value is wrong, every seventh missing."""
    f = Ledger(spark, sf_dir).scheme_finance.select("object_code", "allocated_inr", "released_inr", F.xxhash64("object_code").alias("_"), F.expr("cast(split(object_code, '-')[0] AS bigint) * 10 + cast(split(object_code, '-')[1] AS bigint)").alias("n"))
    second = F.when(F.col("n") % 3 == 0, F.concat(F.lit(" of which ₹ "), F.col("released_inr").cast("string"), F.lit(" lakh was released"))).otherwise("")
    raw = F.concat(F.lit("An amount of ₹ "), F.col("allocated_inr").cast("string"), F.lit(" lakh was allotted"), second)
    value = (F.col("allocated_inr") * 10_000_000).cast("decimal(38,0)")
    return f.select("object_code", raw.alias("raw_text"), F.when(F.col("n") % 7 != 0, value + F.when(F.col("n") % 10 == 0, 1).otherwise(0)).cast("decimal(38,0)").alias("normalised_value"))


def triage(spark, sf_dir):
    """Stored values checked against the amounts in their own evidence."""
    amounts = F.filter(F.transform(text.amounts(F.col("raw_text")), lambda a: a["paise"]), lambda p: p.isNotNull())
    rows = _facts(spark, sf_dir).withColumn("amounts", amounts)
    same = F.size(F.filter("amounts", lambda p: p == F.col("normalised_value")))
    check = F.when(F.col("normalised_value").isNull(), "no_value").when(same == 0, "mismatch").when(F.size("amounts") == 1, "confirmed").when(same == F.size("amounts"), "confirmed_in_context").otherwise("ambiguous")
    return rows.groupBy(check.alias("check")).agg(F.count("*").alias("facts"), F.sum(F.size("amounts")).alias("amounts"))


def money_display(spark, sf_dir):
    """Every customer's balance as shown to a reader and said by a screen reader."""
    paise = (F.col("c_acctbal").cast("decimal(20,2)") * 100 * 1000).cast("decimal(38,0)")
    rows = Ledger(spark, sf_dir).raw("customer").select("c_custkey", paise.alias("paise"))
    return rows.select("c_custkey", money.format_money(F.col("paise")).alias("shown"), money.format_money(F.col("paise"), "full").alias("full"), money.accessible_string(F.col("paise")).alias("said"))


QUERIES = [publishable_sources, published_fact, review_progress, stratified_sample, distinct_on_sentence, sentence_counts, script_and_half, secret_scrub, neutral_scan, search_passages, search_index, bag_overlap, triage, money_display]

_DECISION = """CASE WHEN source IN ('src0', 'src4') THEN 'terms_permit' WHEN source IN ('src1', 'src5') OR source = 'src3' AND lang = 'en' THEN CASE WHEN source IN ('src1', 'src3') THEN 'grant_recorded' ELSE 'not_switched_on' END
  WHEN source IN ('src3', 'src6') THEN 'permission_not_granted' ELSE 'terms_unrecorded' END"""
_SHOWN = f"({_DECISION}) IN ('terms_permit', 'grant_recorded')"
_TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w != '')"


def _indian(digits: str) -> str:
    head = f"reverse(left({digits}, length({digits}) - 3))"
    return f"CASE WHEN length({digits}) <= 3 THEN {digits} ELSE reverse(rtrim(regexp_replace({head}, '(..)', '\\1,', 'g'), ',')) || ',' || right({digits}, 3) END"


_MONEY = f"""SELECT c_custkey, CASE WHEN p < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN r >= 10000000 THEN {_indian("CAST(r // 10000000 AS VARCHAR)")} || '.' || lpad(CAST((r % 10000000) * 100 // 10000000 AS VARCHAR), 2, '0') || ' crore'
  WHEN r >= 100000 THEN {_indian("CAST(r // 100000 AS VARCHAR)")} || '.' || lpad(CAST((r % 100000) * 100 // 100000 AS VARCHAR), 2, '0') || ' lakh' ELSE {_indian("CAST(r AS VARCHAR)")} END AS shown,
  CASE WHEN p < 0 THEN '-' ELSE '' END || '₹' || {_indian("CAST(r AS VARCHAR)")} AS "full"
FROM (SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(20,2)) * 100000 AS BIGINT) AS p, abs(CAST(CAST(c_acctbal AS DECIMAL(20,2)) * 100000 AS BIGINT)) // 100 AS r FROM customer)"""

SQL = {
    "publishable_sources": f"SELECT source, lang, count(*) AS documents, {_DECISION} AS decision, {_SHOWN} AS publishable FROM documents GROUP BY source, lang",
    "published_fact": with_tables(f"""SELECT d.id, d.source, length(d.text) AS n_chars, CASE WHEN verification_status = 'corrected' THEN 'corrected' ELSE 'as_extracted' END AS origin, {_DECISION} AS decision,
  (SELECT count(*) FROM document w WHERE w.source = d.source AND w.verification_status = 'unverified') AS awaiting FROM document d WHERE verification_status IN ('verified', 'corrected') AND {_SHOWN}""", "document"),
    "review_progress": with_tables("SELECT source, count(*) FILTER (WHERE verification_status = 'unverified') AS unverified, count(*) FILTER (WHERE verification_status = 'verified') AS verified, count(*) FILTER (WHERE verification_status = 'corrected') AS corrected, count(*) FILTER (WHERE verification_status = 'rejected') AS rejected FROM document GROUP BY source", "document"),
    "stratified_sample": "SELECT lang, doc_id AS id, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5('sample:' || doc_id)) AS INTEGER) AS place FROM documents QUALIFY place <= 20",
    "distinct_on_sentence": "SELECT DISTINCT ON (source, line) id, source, md5(line) AS line_md5 FROM (SELECT doc_id AS id, source, split_part(text, chr(10), 1) AS line FROM documents) ORDER BY source, line, id",
    "sentence_counts": r"""SELECT doc_id AS id, len(s) AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split(
  regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\b(M/s|No|Rs)\. ', '\1' || chr(1) || ' ', 'g'), '(^|[^A-Z])\. ([A-Z₹(])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: trim(x)), lambda x: x != '') AS s FROM documents)""",
    "script_and_half": r"""SELECT lang, CASE WHEN regexp_matches(text, '\p{Latin}') THEN 'latin' ELSE 'none' END AS script, 'latin' AS half, regexp_matches(text, '(?i)\(\s*(?:₹|Rs\.?|amount|amounts|रक्कम)?[^)\d]{0,18}?(?:crore|lakh|thousand|कोट|िोट|ोट|लाख|हजार)[^)\d]{0,10}\)|(?:₹|\bRs\.?|amount|amounts)\s*(?:are\s+)?in\s+(?:crore|lakh|thousand)') AS declares_unit,
  len(regexp_extract_all(text, '[`´]\s?[0-9][0-9,]*(?:\.[0-9]+)?')) >= 2 AS lost_mark, count(*) AS documents, CAST(sum(len(regexp_extract_all(text, '[`´]\s?[0-9][0-9,]*(?:\.[0-9]+)?'))) AS BIGINT) AS marks FROM documents GROUP BY ALL""",
    "secret_scrub": r"""SELECT doc_id AS id, md5(scrubbed) AS scrubbed_md5 FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '\b([a-z][a-z0-9+.-]*://[^\s:/@]+):[^\s@]+@', '\1:[redacted]@', 'gi'), '\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}', '\1 [redacted]', 'gi'),
  '\b((?:[A-Za-z0-9]+[_-])*(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|authorization|auth))\s*[=:]\s*("[^"]*"|''[^'']*''|[^\s,;)&]+)', '\1=[redacted]', 'gi') AS scrubbed FROM documents) WHERE scrubbed != text""",
    "neutral_scan": f"SELECT id, term, count(*) AS n FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents) WHERE term IN {FORBIDDEN} GROUP BY 1, 2",
    "search_passages": f"""SELECT doc_id AS id, source, rank, true AS short FROM (SELECT doc_id, source, round(len(list_filter(t, lambda w: w IN ('the', 'of'))) / (1 + ln(len(t) + 1.0)), 9) AS rank, ' ' || array_to_string(t, ' ') || ' ' AS line
  FROM (SELECT *, {_TOKENS} AS t FROM documents WHERE {_SHOWN})) WHERE contains(line, ' the ') AND contains(line, ' of the ') AND NOT contains(line, ' worthless ') ORDER BY rank DESC, doc_id LIMIT 20""",
    "search_index": f"""WITH d AS (SELECT doc_id AS id, source, {_TOKENS} AS t FROM documents WHERE {_SHOWN}),
h AS (SELECT * FROM d WHERE list_contains(t, 'and') AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') AND NOT list_contains(t, 'on')),
p AS (SELECT *, list_transform(['and', 'of', 'the'], lambda w: list_filter(range(0, len(t)), lambda i: t[i + 1] = w)) AS ps FROM h),
r AS (SELECT id, source, t, list_sort(flatten(ps)) AS starts, ps, list_aggregate(flatten(list_transform([[1, 2], [1, 3], [2, 3]], lambda ij: flatten(list_transform(ps[ij[1]], lambda a: list_transform(list_filter(ps[ij[2]], lambda b: abs(a - b) <= 100), lambda b: 1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a - b) / 1.5 - 2)))))))), 'product') AS rest FROM p),
b AS (SELECT id, source, t, ps, starts, round(1 - coalesce(rest, 1), 6) AS rank FROM r ORDER BY rank DESC, id LIMIT 20),
s AS (SELECT id, source, rank, t, unnest(starts) AS s, ps FROM b),
e AS (SELECT *, list_sum(list_transform(ps, lambda q: CAST(len(list_filter(q, lambda x: x >= s AND x < s + 28)) > 0 AS INTEGER))) AS n FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, s) = 1)
SELECT id, source, rank, array_to_string(t[s + 1:s + 28], ' ') AS excerpt_words FROM e""",
    "bag_overlap": f"""WITH b AS (SELECT item_id AS k, unnest({_TOKENS}) AS w FROM benchmark), d AS (SELECT doc_id AS k, unnest({_TOKENS}) AS w FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)),
x AS (SELECT coalesce(bc.k, dc.k) AS k, bc.n, dc.n AS m FROM (SELECT k, w, count(*) AS n FROM b GROUP BY 1, 2) bc FULL JOIN (SELECT k, w, count(*) AS n FROM d GROUP BY 1, 2) dc ON bc.k = dc.k AND bc.w = dc.w)
SELECT k AS item_id, CAST(sum(least(coalesce(n, 0), coalesce(m, 0))) AS BIGINT) AS shared, CAST(sum(n) AS BIGINT) AS truth, CAST(sum(m) AS BIGINT) AS found, round(sum(least(coalesce(n, 0), coalesce(m, 0))) / sum(n), 6) AS recall, round(sum(least(coalesce(n, 0), coalesce(m, 0))) / sum(m), 6) AS precision FROM x GROUP BY k""",
    "triage": with_tables(""", f AS (SELECT *, CAST(split_part(object_code, '-', 1) AS BIGINT) * 10 + CAST(split_part(object_code, '-', 2) AS BIGINT) AS n FROM scheme_finance),
g AS (SELECT CASE WHEN n % 7 = 0 THEN 'no_value' WHEN n % 10 = 0 AND NOT (n % 3 = 0 AND CAST(released_inr * 10000000 AS DECIMAL(38,0)) = CAST(allocated_inr * 10000000 AS DECIMAL(38,0)) + 1) THEN 'mismatch' WHEN n % 3 != 0 THEN 'confirmed' WHEN released_inr = allocated_inr THEN 'confirmed_in_context' ELSE 'ambiguous' END AS "check", CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END AS a FROM f)
SELECT "check", count(*) AS facts, CAST(sum(a) AS BIGINT) AS amounts FROM g GROUP BY 1""", "scheme_finance"),
    "money_display": f"""SELECT *, regexp_replace(trim(replace(shown, '₹', '')), '^-', 'minus ') || ' rupees' AS said FROM ({_MONEY})""",
}
