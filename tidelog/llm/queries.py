"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, fingerprints, line_dedup, main_text, mixing, near_dedup, personal_data, token_counts, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """Path of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(_table(spark, sf_dir, "documents"), byte_bpe())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = dict([token_counts.byte_bpe_counter(byte_bpe()), token_counts.word_counter()])
    return token_counts.counted(_table(spark, sf_dir, "documents"), versions)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.withColumn("n_offending", F.size("offending").cast("long")).drop("offending")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(_table(spark, sf_dir, "documents"))
    return rows.withColumn("target", F.round("target", 3))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_decontamination, op2_personal_data, op3_token_files, op4_token_counts, op5_line_dedup,
    op6_minhash_near_dedup, op7_main_text, op8_toxicity, op9_fingerprints, op10_mixing,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {}

_SHINGLES = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, k, k + 4) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)"""

ORACLE_SQL["op6_minhash_near_dedup"] = f"""
WITH RECURSIVE {_SHINGLES},
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m ON m.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

ORACLE_SQL["op1_decontamination"] = r"""
WITH texts AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
item_shingles AS (SELECT item_id, len(w) AS l, list_slice(w, k, k + 4) AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM items WHERE len(w) >= 5)),
item_counts AS (SELECT item_id, l, s, count(*) AS c FROM item_shingles GROUP BY ALL),
text_shingles AS (SELECT doc_id, n, i, list_slice(w, i + 1, i + 5) AS s FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS i FROM texts WHERE len(w) >= 5)),
hits AS (SELECT DISTINCT doc_id, n, item_id, l FROM text_shingles t JOIN item_counts c ON t.s = c.s),
windows AS (SELECT doc_id, item_id, l, least(l, n) AS m, unnest(range(0, greatest(n - l, 0) + 1)) AS start FROM hits),
window_counts AS (SELECT w.doc_id, w.item_id, w.start, w.m, t.s, count(*) AS c FROM windows w JOIN text_shingles t ON t.doc_id = w.doc_id AND t.i BETWEEN w.start AND w.start + w.m - 5 GROUP BY ALL),
rated AS (
  SELECT x.doc_id, x.item_id, x.start, sum(least(x.c, y.c)) AS common, any_value(x.m) - 4 + any_value(y.l) - 4 AS both_sizes
  FROM window_counts x JOIN item_counts y ON x.item_id = y.item_id AND x.s = y.s GROUP BY ALL
),
best AS (SELECT doc_id, item_id, common / (both_sizes - common) AS similarity, start FROM rated WHERE common / (both_sizes - common) >= 0.8)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, arg_max(start, (similarity, -start))::BIGINT AS start FROM best GROUP BY 1, 2
"""
ORACLE_SQL["op10_mixing"] = r"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(concat_ws('|', '10', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
    / greatest(0.05, 1.0 - length(regexp_replace(coalesce(text, ''), '[\p{L}\x20\x09-\x0D]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS k
  FROM documents
),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY 1),
weighed AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, sum(source_size) OVER () AS all_ FROM totals),
levels AS (
  SELECT *, (all_ - coalesce(sum(source_size * 3) OVER by_ratio, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER by_ratio, 0)) AS level
  FROM weighed WINDOW by_ratio AS (ORDER BY source_size * 3 / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level_ AS (SELECT max(level) AS level FROM levels),
goals AS (SELECT source, source_size, least(source_size * 3.0, coalesce((SELECT level FROM level_) * weight, 0.0))::DOUBLE AS target FROM weighed),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goals),
placed AS (
  SELECT r.*, p.source_size, target, epochs, target - epochs * p.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM rows_ r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
),
counted AS (SELECT *, (epochs + CASE WHEN rest > 0 AND (so_far + size <= rest OR (so_far < rest AND 2 * (rest - so_far) >= size)) THEN 1 ELSE 0 END)::BIGINT AS times FROM placed)
SELECT doc_id, size, source_size, round(target, 3) AS target, times * size AS taken, times FROM counted
"""
