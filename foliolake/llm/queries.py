"""The corpus operators bound to their tables: one query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import (
    conversation_repair,
    decontamination,
    dense_ranking,
    license_scan,
    line_dedup,
    lm_scoring,
    minhash_dedup,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    spm_sampling,
    substring_dedup,
    warc,
)
from foliolake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op4_benchmark_decontamination"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
  FROM texts),
short AS (SELECT DISTINCT len(w) AS n FROM words WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
  UNION SELECT kind, id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))
  FROM words JOIN short ON len(w) >= n WHERE kind = 'd'),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n AS item_shingles, count(*) AS shared_shingles, count(*) / n AS containment
FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id, n HAVING 100 * count(*) >= 80 * n
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
SQL["op7_quality_rules"] = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM documents),
windows AS (
  SELECT row, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS five
  FROM parts),
repeated AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, five) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2), (3), (4)) AS o(k) GROUP BY row),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
    len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words
  FROM parts LEFT JOIN covered c USING (row)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.25
    AND n_exclamations / n_words <= 0.5 AND n_capitals / word_chars <= 0.5 AND n_letters / word_chars >= 0.5
    AND (n_words < 40 OR n_stop_words / n_words >= 0.01) AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM judged
"""


@query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


SQL["op10_warc_revisits"] = """
WITH heads AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload) ELSE page_id END AS original
  FROM heads)
SELECT page_id, payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM firsts
"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


SQL["op6_substring_dedup"] = r"""
WITH parts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
    unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS words
  FROM parts),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS least FROM windows)
  WHERE least < doc_id),
gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS places FROM later, range(13) AS o(k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w
    ELSE list_filter(w, lambda x, n: NOT list_contains(places, n)) END, ' ')) AS kept_sha256
FROM parts LEFT JOIN gone USING (doc_id)
"""


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


@query
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash_dedup.components(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_sampling.sampled(table(spark, sf_dir, "documents"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.report(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k
  FROM documents),
told AS (SELECT doc_id, k, line, regexp_matches(line, '[^ \t-\r]') AS full_line FROM lines),
numbered AS (
  SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM told WHERE full_line),
windows AS (
  SELECT doc_id, i, [line, lead(line, 1) OVER w, lead(line, 2) OVER w] AS three,
    lead(i, 2) OVER w AS last FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY three ORDER BY doc_id, i) AS n FROM windows WHERE last IS NOT NULL)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o.k AS i FROM later, (VALUES (0), (1), (2)) AS o(k)),
dropped AS (SELECT doc_id, k FROM gone JOIN numbered USING (doc_id, i)),
marked AS (
  SELECT told.*, d.k IS NOT NULL AS out FROM told LEFT JOIN dropped d USING (doc_id, k))
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (out) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT out), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_ranked_lexical_search"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
terms AS (
  SELECT kind, row, id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM texts),
counted AS (SELECT kind, row, id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM counted WHERE kind = 'd' GROUP BY row),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, totals WHERE kind = 'd' GROUP BY term),
lengthened AS (SELECT row, 100 - 90 + (90 * n * docs) // total AS m FROM lengths, totals),
scored AS (
  SELECT i.row, i.id AS item_id, d.row AS doc_row, d.id AS doc_id,
    sum(w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m)))::BIGINT AS score
  FROM counted i JOIN counted d ON d.term = i.term AND d.kind = 'd' JOIN weights w ON w.term = i.term
  JOIN lengthened l ON l.row = d.row WHERE i.kind = 'i' GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0) WHERE rank <= 10
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repaired_conversations(rows)


@query
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.components(table(spark, sf_dir, "documents"))
