"""The queries ``opN_<name>`` of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, html_extract, language_id, license_scan, line_dedup, minhash_dedup, order_minhash, secret_scan, sentencepiece_sampling, token_store
from nearfield.llm.common import shared_dir, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.classify(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256)
    return found.select(
        "doc_id", *[count(k) for k, *_ in secret_scan.BASE_KINDS], base.alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.components(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_sampling.sample_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").alias("n_samples"), F.transform("ids", F.size).alias("n_ids"),
        F.transform("ids", lambda x: F.xxhash64(x)).alias("ids_xxh64"), "log_prob", "gumbel", "inclusion", "decoded",
    )


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark), tokenizer_path("word_bpe_49k.json"))
    return token_store.token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_html_extract, op3_language_id, op4_secret_scan, op5_order_minhash, op6_minhash_dedup, op7_line_dedup, op8_decontaminate, op9_sentencepiece_sampling, op10_token_store)}


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM item WHERE len(w) > 0),
doc AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win)),
hit AS (
  SELECT doc_id, p.n, i, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM place) p
  JOIN win ON win.n = p.n AND win.g = p.g),
word AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP7_SQL = rf"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (
  SELECT doc_id, i - 1 AS i, l[i] AS line, len(regexp_extract_all(l[i], '\S+')) AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM raw) WHERE regexp_matches(l[i], '\S')),
put AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM line),
span AS (
  SELECT a.doc_id, a.j AS lo, min(b.j) AS hi FROM put a JOIN put b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + {line_dedup.MIN_WORDS}
    AND b.s - a.s + a.w >= {line_dedup.MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.j) AS lo, b.j AS hi FROM put a JOIN put b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + {line_dedup.MIN_WORDS}
    AND b.s - a.s + a.w >= {line_dedup.MIN_WORDS} GROUP BY b.doc_id, b.j),
run AS (
  SELECT span.doc_id, lo, hi, string_agg(line, chr(10) ORDER BY j) AS said, min(i) AS i
  FROM span JOIN put ON put.doc_id = span.doc_id AND j BETWEEN lo AND hi GROUP BY ALL),
later AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT put.doc_id, put.i FROM later JOIN put ON put.doc_id = later.doc_id AND j BETWEEN lo AND hi),
cut AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY 1)
SELECT doc_id, CASE WHEN g IS NULL THEN text
    ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda k: NOT list_contains(g, k - 1)), lambda k: l[k]), chr(10)) END AS text,
  coalesce(len(l), 0) AS n_lines, coalesce(len(g), 0) AS n_removed
FROM raw LEFT JOIN cut USING (doc_id)
"""


def _op1_sql() -> str:
    sets = license_scan.template_words(license_scan.TEMPLATES, license_scan.CONTAINMENT)
    values = ", ".join(f"('{label}', {words!r}::VARCHAR[], {need}, {reach})" for label, words, need, reach in sets)
    phrases = license_scan.PHRASES
    starts = " OR ".join(f"w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p in phrases)
    names = " ".join(f"WHEN w[i] = '{p.split()[0]}' THEN '{name}'" for p, name in phrases.items())
    return rf"""
WITH doc AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
placed AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: {starts}) AS p FROM doc),
template(label, words, need, reach) AS (VALUES {values}),
shared AS (
  SELECT doc_id, w, label, words, need, reach FROM doc, template WHERE len(list_intersect(w, words)) >= need),
pair AS (
  SELECT doc_id, label, list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(words, w[i])),
    lambda i: len(list_intersect(w[i:i + reach - 1], words)))) / len(words) AS c, need / len(words) AS least
  FROM shared),
best AS (SELECT doc_id, list(DISTINCT label) AS more, max(c) AS c FROM pair WHERE c >= least GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda i: CASE {names} END))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda i: CASE {names} END), coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM placed LEFT JOIN best USING (doc_id)
"""


def _op4_sql() -> str:
    kinds = secret_scan.BASE_KINDS + secret_scan.MORE_KINDS
    n_base = len(secret_scan.BASE_KINDS)
    quoted = lambda x: x.replace("'", "''")
    also = {"random": f" AND regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]') AND NOT regexp_matches(v[i], '{secret_scan.HEX}') AND len(list_distinct(string_split(v[i], ''))) >= {secret_scan.RANDOM_CHARS}"}
    spans = " UNION ALL ".join(
        f"SELECT doc_id, owner, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(g[:i], lambda x: length(x))) "
        f"+ coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n, v[i] AS value "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, owner, regexp_extract_all(text, '{quoted(rx)}') AS m, "
        f"regexp_extract_all(text, '{quoted(rx)}', {group}) AS v, regexp_split_to_array(text, '{quoted(rx)}') AS g "
        f"FROM doc WHERE regexp_matches(text, '{quoted(secret_scan._HINTS.get(kind, rx))}'))) WHERE length(v[i]) >= {least}{also.get(kind, '')}"
        for rank, (kind, rx, group, least) in enumerate(kinds)
    )
    return rf"""
WITH doc AS (SELECT doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
span AS (SELECT *, kind || ':' || start::BIGINT::VARCHAR || ':' || (start + n)::BIGINT::VARCHAR AS said FROM ({spans})),
held AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT (coalesce(owner, chr(0)), doc_id)) AS repositories FROM span GROUP BY 1),
judged AS (
  SELECT span.*, owners >= {secret_scan.COPIED_OWNERS} OR repositories >= {secret_scan.COPIED_REPOSITORIES} AS copied,
    len(list_distinct(string_split(value, ''))) >= {secret_scan.DISTINCT_CHARS}
      AND NOT regexp_matches(value, '{secret_scan.PLACEHOLDER}') AS looks_live
  FROM span JOIN held USING (value)),
found AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(said, ',' ORDER BY start, rank) FILTER (rank < {n_base}) AS base,
    string_agg(said, ',' ORDER BY start, rank) FILTER (rank < {n_base} OR NOT copied) AS spans,
    count(*) FILTER (NOT copied AND looks_live) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM judged GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM doc LEFT JOIN found USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op4_secret_scan": _op4_sql(), "op7_line_dedup": OP7_SQL, "op8_decontaminate": OP8_SQL}
