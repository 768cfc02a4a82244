"""The queries of this subpackage, as thin as can be over its operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import bpe_piece, curriculum, exact_cqf, html_lstm, license_join, packing, pii_feistel, quality_forest, simhash_grid, toxicity_subword
from lexarium.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The key of the pseudonyms in the query; a real run names its own.
PII_KEY = b"lexarium demonstration key"


@lru_cache(1)
def _library() -> tiktoken.Encoding:
    path = public_tokenizers.path(VOCABULARY)
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe_piece.ranks(path))}, special_tokens={})


def encoder() -> Callable[[list], Iterator[bytes]]:
    """What turns texts into ids, made in the worker that needs it; packing takes any, and this is the fastest one here."""
    encode = _library().encode_ordinary
    return lambda texts: (np.array(encode(text or ""), "<u4").tobytes() for text in texts)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), encoder)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_cqf.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extracted(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_piece.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=False)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymised(table(spark, sf_dir, "documents"), PII_KEY)


def _told(blocks: str) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.format_string("%s@%d=%.4f", b["label"], b["word"], b["containment"])), ",")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.licenses(table(spark, sf_dir, "documents")).drop("links").withColumn("blocks", _told("blocks"))


def op7_license_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_licenses with every pair of a block and a notice that meet the threshold, and their number."""
    found = license_join.licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("blocks", _told("blocks")).withColumn("n_links", F.size("links").cast("long")).withColumn("links", _told("links"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_grid.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curriculum.mix(table(spark, sf_dir, "documents"))
    first, last = (F.round(F.try_element_at("positions", F.lit(k)), 9) for k in (1, -1))
    return found.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), last.alias("last_position"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_subword.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_quality_rules, op3_exact_duplicates, op4_html_text, op5_byte_bpe, op6_pseudonyms, op7_licenses, op7_license_links, op8_simhash, op9_mix, op10_toxicity]
    return {f.__name__: f for f in found}


OP3_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents
), ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size
  FROM plain WINDOW w AS (PARTITION BY sha ORDER BY n_chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha AS text_sha256 FROM ranked
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS place
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST(rank % 3 + 1 AS INT)] AS weight, [-0.5::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE][CAST(rank % 3 + 1 AS INT)] AS slope,
    source_size * 2.0::DOUBLE AS cap FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), filled AS (
  SELECT source, source_size, slope, least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER (), 'inf'::DOUBLE) * weight) AS target FROM levels
), run AS (
  SELECT s.*, f.source_size, f.target, f.slope,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN filled f ON s.source IS NOT DISTINCT FROM f.source
), counted AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(greatest(ceil((target - start - size / 2.0::DOUBLE) / source_size), 0), 2) AS BIGINT) END AS copies FROM run
), progressed AS (
  SELECT *, least((start + size / 2.0::DOUBLE) / greatest(target, 1e-9), 1.0::DOUBLE) AS p1, least((start + (copies - 1) * source_size + size / 2.0::DOUBLE) / greatest(target, 1e-9), 1.0::DOUBLE) AS p2 FROM counted
)
SELECT doc_id, size, source_size, target, size * copies AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN p1 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * p1) - (1 - slope)) / (2 * slope) END, 9) END AS first_position,
  CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN p2 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * p2) - (1 - slope)) / (2 * slope) END, 9) END AS last_position
FROM progressed
"""


def _op7_sql() -> str:
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in license_join.PHRASES)
    each = [(k, sorted(set(n.split())), label, must.split(), license_join.length(n)) for k, (n, label, must) in enumerate(license_join.NOTICES)]
    notices = ", ".join(f"({k}, {w!r}, '{label}', {must!r}::VARCHAR[], {license_join.need(len(w))}, {len(w)}, {length})" for k, w, label, must, length in each)
    return rf"""
WITH phrases(parts, label) AS (VALUES {phrases}), notices(notice, parts, label, must, need, n, length) AS (VALUES {notices}),
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS place FROM documents),
split AS (SELECT doc_id, place, regexp_extract_all(text, '{license_join.WORDS}') AS words FROM low),
starts AS (
  SELECT place, label, unnest(list_filter(range(0, len(words)), lambda i: words[i + 1 : i + len(parts)] = parts)) AS pos FROM split, phrases
), base AS (
  SELECT place, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS labels FROM starts GROUP BY place
), tok AS (SELECT place, unnest(range(0, len(words))) AS i, unnest(words) AS w FROM split),
part AS (SELECT notice, unnest(parts) AS w FROM notices), hit AS (SELECT t.place, p.notice, t.i, t.w FROM tok t JOIN part p ON p.w = t.w),
block AS (
  SELECT a.place, a.notice, a.i, list(DISTINCT b.w) AS held FROM hit a JOIN notices x ON x.notice = a.notice
  JOIN hit b ON b.place = a.place AND b.notice = a.notice AND b.i >= a.i AND b.i < a.i + x.length GROUP BY a.place, a.notice, a.i
), passed AS (
  SELECT place, label, i, len(held) / n::DOUBLE AS containment, row_number() OVER (PARTITION BY place, b.notice ORDER BY len(held) DESC, i) AS r
  FROM block b JOIN notices x ON x.notice = b.notice WHERE len(held) >= need AND len(list_intersect(held, must)) = len(must)
), found AS (
  SELECT place, list_distinct(list(label)) AS labels, max(containment) AS best, string_agg(label || printf('@%d=%.4f', i, containment), ',' ORDER BY i, label, containment) AS blocks
  FROM passed WHERE r = 1 GROUP BY place
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score, coalesce(blocks, '') AS blocks
FROM split s LEFT JOIN base b ON b.place = s.place LEFT JOIN found f ON f.place = s.place
"""


def _op7_links_sql() -> str:
    """The SQL of op7_licenses with all that passed, not only the best block of each notice."""
    head, _, tail = _op7_sql().rpartition("\n)\nSELECT ")
    each = "string_agg(label || printf('@%d=%.4f', i, containment), ',' ORDER BY i, label, containment)"
    linked = f"\n), linked AS (SELECT place, count(*) AS n_links, {each} AS links FROM passed GROUP BY place\n)\nSELECT "
    whole = tail.replace("AS blocks\nFROM", "AS blocks,\n  coalesce(links, '') AS links, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links\nFROM")
    return f"{head}{linked}{whole.rstrip()} LEFT JOIN linked l ON l.place = s.place\n"


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": _op7_sql(), "op7_license_links": _op7_links_sql(), "op3_exact_duplicates": OP3_SQL, "op9_mix": OP9_SQL}
