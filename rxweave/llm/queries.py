"""One registered query per operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rxweave.llm import bpe, decontamination, fillmiddle, neardup, negatives, pii, quality, secrets, suffixes, tokenfiles, toxicity, treebpe, warc

QUERIES: dict = {}
CHECKS: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def query(key: str, check: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if check:
            CHECKS[key] = check
        return fn

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_dart_minhash_near_duplicates")
def op1(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_guess_cost_secrets")
def op2(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op3_sentencepiece_bpe")
def op3(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


DECONTAMINATION_CHECK = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, ws[i:i + least(13, len(ws)) - 1] AS win
  FROM item_words, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS r(i) WHERE len(ws) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
doc_windows AS (
  SELECT doc_id, size, i, ws[i:i + size - 1] AS win
  FROM doc_words, (SELECT DISTINCT size FROM item_windows) AS s, unnest(range(1, len(ws) - size + 2)) AS r(i)),
matches AS (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM matches, unnest(range(0, size)) AS r(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_aho_corasick_decontamination", DECONTAMINATION_CHECK)
def op4(spark, sf_dir):
    out = decontamination.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op5_token_files")
def op5(spark, sf_dir):
    return tokenfiles.token_files(spark, table(spark, sf_dir, "documents"), WORDS, END_ID)


REVISIT_CHECK = r"""
WITH tagged AS (SELECT page_id AS p, url, html, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id % 1000) AS day FROM pages),
spelled AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\d*\.', '')
      || regexp_replace(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '') AS place,
    array_to_string(list_filter(list_sort(string_split(regexp_extract(bare, '\?(.*)$', 1), '&')),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|phpsessid|jsessionid|sessionid|sid)(=|$)')), '&') AS query
  FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM tagged)),
full_records AS (SELECT *, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM spelled),
answers AS (
  SELECT *, p + CASE WHEN p % 11 = 0 THEN -1 ELSE 1 + p % 5 END AS at, CASE WHEN p % 7 = 0 THEN '"other"' WHEN p % 3 <> 2 THEN tag END AS named, CASE WHEN p % 2 = 0 THEN day END AS changed
  FROM full_records),
found AS (
  SELECT a.p, a.canonical_url, a.named, a.changed, a.day, max(f.p) AS original FROM answers a LEFT JOIN full_records f ON f.canonical_url = a.canonical_url AND f.p < a.at GROUP BY ALL),
judged AS (
  SELECT found.*, f.tag, f.day AS stored_day, f.html, CASE WHEN original IS NULL THEN 'no_original'
    WHEN named IS NOT NULL AND named <> f.tag OR named IS NULL AND changed IS NOT NULL AND changed <> f.day THEN 'mismatch'
    WHEN named IS NULL AND changed IS NULL THEN 'unvalidated' ELSE 'resolved' END AS verdict
  FROM found LEFT JOIN full_records f ON f.p = original)
SELECT p * 2 + 1 AS record_id, canonical_url, original * 2 AS original_id, verdict,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN sha256('cache-control:max-age=600' || chr(10) || 'content-length:' || octet_length(encode(html)) || chr(10) || 'content-type:text/html' || chr(10)
    || 'date:' || day || chr(10) || 'etag:' || CASE WHEN named IS NULL THEN tag WHEN p % 3 = 0 THEN 'W/' || named ELSE named END || chr(10) || 'last-modified:' || coalesce(changed, stored_day)) END AS headers_sha256,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN sha256(html) END AS payload_digest
FROM judged
"""


@query("op6_not_modified_revisits", REVISIT_CHECK)
def op6(spark, sf_dir):
    out = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return out.select("record_id", "canonical_url", "original_id", "verdict", F.sha2(F.array_join(lines, "\n"), 256).alias("headers_sha256"), "payload_digest")


@query("op7_suffix_radix_repeats")
def op7(spark, sf_dir):
    return suffixes.repeated_strings(table(spark, sf_dir, "documents"))


QUALITY_MEASURES = r"""
words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM {docs}),
windows AS (SELECT doc_id, i, ws[i:i + 4] AS win FROM words, unnest(range(1, len(ws) - 3)) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS r(k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
ruled AS (SELECT *, {flags} FROM measured),
per_host AS (SELECT source AS host, count(*) AS n, {sums} FROM ruled GROUP BY source),
totals AS (SELECT sum(n) AS docs, count(*) AS hosts, {totals} FROM per_host),
means AS (SELECT docs, hosts, {means} FROM totals),
spreads AS (SELECT *, {spreads} FROM means),
strengths AS (SELECT *, {strengths} FROM spreads),
rated AS (SELECT host, n, {rates}, {priors} FROM per_host, strengths),
hosts AS (SELECT host, {bad} FROM rated),
judged AS (
  SELECT ruled.*, NOT base_failed AND NOT ({rejected}) AS kept
  FROM ruled LEFT JOIN hosts ON ruled.source IS NOT DISTINCT FROM hosts.host)
"""


def quality_sql(docs: str = "documents") -> str:
    """Common table expressions up to ``judged``: the measures of ``docs``, its hosts' verdicts and ``kept``."""
    rules = quality.RULES
    return QUALITY_MEASURES.format(
        docs=docs,
        flags=", ".join(f"({c}) AS {r}_failed" for r, c in rules.items()),
        sums=", ".join(f"sum(CAST({r}_failed AS BIGINT)) AS {r}_k" for r in rules),
        totals=", ".join(f"sum({r}_k) / sum(n) AS {r}_m, sum({r}_k * {r}_k / n) / sum(n) AS {r}_kk" for r in rules),
        means=", ".join(f"{r}_m, {r}_kk" for r in rules),
        spreads=", ".join(f"{r}_kk - {r}_m * {r}_m - {r}_m * (1 - {r}_m) * hosts / docs AS {r}_v" for r in rules),
        strengths=", ".join(f"CASE WHEN {r}_v > 0 THEN least(greatest({r}_m * (1 - {r}_m) / {r}_v - 1, {quality.LEAST_STRENGTH}), 1e6) ELSE 1e6 END AS {r}_c" for r in rules),
        rates=", ".join(f"({r}_k + {r}_m * {r}_c) / (n + {r}_c) AS {r}_rate" for r in rules),
        priors=", ".join(f"{r}_m, {r}_c" for r in rules),
        bad=", ".join(f"{r}_rate - {quality.HOST_ERRORS} * sqrt({r}_rate * (1 - {r}_rate) / (n + {r}_c + 1)) > {r}_m AS {r}_bad" for r in rules),
        rejected=" OR ".join(f"(coalesce({r}_bad, false) AND {r}_failed)" for r in rules))


QUALITY_CHECK = f"WITH {quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"


@query("op8_host_quality_rules", QUALITY_CHECK)
def op8(spark, sf_dir):
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_skip_chain_personal_data")
def op10(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op9_nonnegative_pu_toxicity")
def op9(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_tree_concatenation_bpe")
def op11(spark, sf_dir):
    encoded = treebpe.encoded_documents(table(spark, sf_dir, "documents"), BYTES)
    return treebpe.digests(encoded, BYTES)


FILL_CHECK = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
numbered AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS parts,
    length(t) - length(replace(t, chr(10), '')) + CAST(t <> '' AND NOT ends_with(t, chr(10)) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM drawn),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
ends AS (
  SELECT *, CASE a WHEN 0 THEN 0 WHEN n THEN length(t) ELSE length(array_to_string(parts[1:a], chr(10))) + 1 END AS p,
    CASE b WHEN 0 THEN 0 WHEN n THEN length(t) ELSE length(array_to_string(parts[1:b], chr(10))) + 1 END AS q
  FROM cut),
split AS (SELECT *, substring(t, 1, p) AS head, substring(t, p + 1, q - p) AS middle, substring(t, q + 1, length(t) - q) AS tail FROM ends)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM split
"""


@query("op12_roaring_fill_in_middle", FILL_CHECK)
def op12(spark, sf_dir):
    out = fillmiddle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50)
    kept = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    back = fillmiddle.restored_texts(out.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256)), keep=kept)
    return back.select(*kept, F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


NEGATIVE_CHECK = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


@query("op13_threshold_hard_negatives", NEGATIVE_CHECK)
def op13(spark, sf_dir):
    # every label from 0 to 9; each seventh row takes the next one
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), noise=(7, 1, 10))
