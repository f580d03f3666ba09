"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from inkframe.llm.common import LOWER, UPPER
from inkframe.llm.decontaminate import decontaminate
from inkframe.llm.exact_dedup import exact_dedup
from inkframe.llm.license_scan import PHRASES, TEMPLATES, license_scan, template_table, words_of
from inkframe.llm.mixing import mix_sources
from inkframe.llm.quality import fit_quality
from inkframe.llm.simhash import simhash_dedup
from inkframe.llm.token_count import token_counts
from inkframe.llm.token_store import token_output
from inkframe.llm.toxicity import fit_toxicity, score_documents
from inkframe.llm.url_filter import url_filter

#: The URL rules that op8 applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The base phrases of op1's contract. The bare name is no place of
#: theirs, but names the license in ``labels``.
LICENSE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
LICENSE_NAMES = {"mit license": "mit"}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"), phrases=LICENSE_PHRASES, names=LICENSE_NAMES).drop("matches")


def op2_mixing(spark, sf_dir):
    out = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    p = [F.col("posteriors")[d].alias(f"p_{d}") for d in ("prose", "junk", "toxic")]
    return out.select("doc_id", "n_tokens", *p, "rate", "copies")


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), cut=0.5)


def op4_simhash(spark, sf_dir):
    out = simhash_dedup(table(spark, sf_dir, "documents"), shingle=3, distance=2, segments=2)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_decontaminate(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_token_output(spark, sf_dir):
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op8_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")), cut=0.3)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_output": op7_token_output,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _license_sql() -> str:
    """Phrases by place, and every block against every template."""
    half = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)
    table = template_table(TEMPLATES, 0.8)
    marked = "body"
    for a, b in (p.split("_") for p in sorted({t for _, _, toks, _ in table for t in toks if "_" in t})):
        marked = f"replace(' ' || {marked} || ' ', ' {a} {b} ', ' {a} {a}_{b} {b} ')"
    places, base = [], []
    for phrase, label in PHRASES.items():
        ws = phrase.split()
        same = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(ws))
        places.append(f"list_transform(list_filter(range(1, len(ws) - {len(ws) - 2}), lambda i: {same}), lambda i: i - 1)")
        base.append(f"CASE WHEN len({places[-1]}) > 0 THEN ['{label}'] ELSE [] END")
    held, labels = [], []
    for _, label, toks, need in table:
        overlap = f"list_max(list_transform(blocks, lambda b: len(list_intersect(list_distinct(b), {toks!r}))))"
        held.append(f"CASE WHEN {overlap} >= {need} THEN {overlap} / CAST({len(toks)} AS DOUBLE) ELSE 0 END")
        labels.append(f"CASE WHEN {overlap} >= {need} THEN ['{label}'] ELSE [] END")
    return f"""
WITH t AS (SELECT doc_id, trim(regexp_replace({LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) AS body FROM documents),
w AS (SELECT doc_id, CASE WHEN body = '' THEN [] ELSE string_split(body, ' ') END AS ws, string_split(trim({marked}), ' ') AS ms FROM t),
p AS (SELECT doc_id, len(ws) AS n_words, list_concat({", ".join(places)}) AS places, list_sort(list_distinct(flatten([{", ".join(base)}]))) AS base,
  CASE WHEN len(ms) <= {2 * half} THEN [ms] ELSE list_transform(range(0, CAST(ceil(len(ms) / {half}.0) AS INT) - 1), lambda i: ms[i * {half} + 1 : i * {half} + {2 * half}]) END AS blocks FROM w),
m AS (SELECT *, flatten([{", ".join(labels)}]) AS more, list_max([{", ".join(held)}]) AS best FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0 ELSE best END AS score FROM m
"""


ORACLE_SQL = {
    "op1_license_scan": _license_sql(),
    "op6_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{WORD}') AS bw FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bz AS (SELECT *, least(10, len(bw)) AS size FROM b WHERE len(bw) > 0),
pat AS (SELECT DISTINCT item, size, array_to_string(bw[k : k + size - 1], ' ') AS gram FROM bz, unnest(range(1, len(bw) - size + 2)) AS t(k)),
gram AS (SELECT row_no, k, size, array_to_string(ws[k : k + size - 1], ' ') AS gram FROM d, (SELECT DISTINCT size FROM pat), unnest(range(1, greatest(1, len(ws) - size + 2))) AS t(k)),
hit AS (SELECT row_no, k, size, item FROM gram JOIN pat USING (size, gram)),
n AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(k, k + size)) AS p FROM hit) GROUP BY 1),
found AS (SELECT row_no, list_sort(list_distinct(list(item))) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row_no) LEFT JOIN found USING (row_no)
""",
    "op8_url_filter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), r(rhost, rpath, action) AS (VALUES ('com','/','allow'),('example.com','/en/','block'),('www.example.com','/en/','allow'),('net','/es/','block'),('net','/fr/','block')),
hit AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, action DESC, rhost || rpath) AS n
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM hit WHERE n = 1
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""",
}
