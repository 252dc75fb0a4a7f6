"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, langid, line_dedup, mixing, packing, quality, sharding, simhash, surrogates
from .shared import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2)
    return mix.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 16384 AS bucket,
         (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 9, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS chance
  FROM documents),
buckets AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS mass, count(*) AS n FROM sized GROUP BY source, bucket),
sources AS (
  SELECT source, CAST(sum(mass) AS BIGINT) AS source_size FROM buckets GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rank FROM sources),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((rank - 1) % 3 AS BIGINT) + 1] AS weight, source_size * 2.0::DOUBLE AS cap,
         (SELECT sum(source_size) FROM sources) * 1.5::DOUBLE AS budget FROM ranked),
filled AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS remaining,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighted),
marked AS (SELECT *, cap * open <= remaining * weight AS is_full FROM filled),
planned AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    (budget - coalesce((SELECT sum(cap) FROM marked WHERE is_full), 0.0::DOUBLE)) * weight / (SELECT sum(weight) FROM marked WHERE NOT is_full) END AS target
  FROM marked),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM planned),
needed AS (SELECT *, target - whole * source_size AS need FROM whole),
running AS (
  SELECT *, CAST(sum(mass) OVER (PARTITION BY source ORDER BY bucket) AS BIGINT) AS upto FROM buckets),
edges AS (
  SELECT n.source, min(r.bucket) AS edge FROM needed n JOIN running r ON r.source IS NOT DISTINCT FROM n.source AND r.upto > n.need GROUP BY n.source),
plan AS (
  SELECT n.*, coalesce(e.edge, 16384) AS edge, (n.need - (r.upto - r.mass)) / r.mass AS part, r.n = 1 AS alone
  FROM needed n LEFT JOIN edges e ON e.source IS NOT DISTINCT FROM n.source
  LEFT JOIN running r ON r.source IS NOT DISTINCT FROM n.source AND r.bucket = e.edge)
SELECT s.doc_id, s.size, p.source_size, p.target,
       s.size * (p.whole + CASE WHEN s.bucket < p.edge OR (s.bucket = p.edge AND CASE WHEN p.alone THEN 0.5 ELSE s.chance END <= p.part) THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    parser = langid.learned(docs.where(fold != 0), "text", "lang", F.col("doc_id"))
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, parser, keep=["doc_id", "held_out"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(_table(spark, sf_dir, "documents"), exact_words=1)
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0")).alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in three parts, is compacted after the second and third, and each document tells its shard in the newest version."""
    store = sharding.ShardStore(spark, scratch_path(spark, "shards"))
    docs = _table(spark, sf_dir, "documents")
    for part in range(3):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == part))
        if part:
            version = store.compact()
    store.vacuum()
    live = store.manifest(version).select(F.col("shard").alias("path"), "rows", "bytes", "tier")
    docs = store.read(version).select("doc_id", F.col("_metadata.file_path").alias("path"))
    named = docs.join(F.broadcast(live) if live.count() <= 100_000 else live, "path")
    return named.select("doc_id", F.element_at(F.split("path", "/"), -1).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier", F.lit(version).cast("long").alias("version"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), largest=True)


OP7_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON g.body = t.body
"""


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(_table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.repetition_stats(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return quality.judged(stats).drop("longest_repeat")


# A position lies in a maximal repeat of ten words and more if it lies in a repeated window of ten words, and the longest
# repeat has more than a fifth of the words if a window of so many words and one more is repeated.
OP9_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT r, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM texts),
windows AS (
  SELECT r, n, i, CASE WHEN i + 2 <= n THEN count(*) OVER (PARTITION BY r, ws[i:i + 2], i + 2 <= n) > 1 ELSE false END AS w3,
         CASE WHEN i + 9 <= n THEN count(*) OVER (PARTITION BY r, ws[i:i + 9], i + 9 <= n) > 1 ELSE false END AS w10 FROM places),
covers AS (
  SELECT r, max(w3::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
         max(w10::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM windows),
covered AS (SELECT r, CAST(sum(c3) AS BIGINT) AS n_repeat_words, CAST(sum(c10) AS BIGINT) AS covered_words FROM covers GROUP BY r),
long_windows AS (
  SELECT p.r, md5(array_to_string(p.ws[p.i:p.i + p.n // 5], ' ')) AS h FROM places p JOIN covered c ON c.r = p.r AND c.covered_words > 0 WHERE p.i + p.n // 5 <= p.n),
too_long AS (SELECT DISTINCT r FROM (SELECT r, h FROM long_windows GROUP BY r, h HAVING count(*) > 1)),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts),
dup_lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
stats AS (
  SELECT x.doc_id, CAST(len(x.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(x.ws, '')) AS BIGINT) AS word_chars,
         CAST(length(x.t) - length(regexp_replace(x.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(d.n_dup_lines, 0) AS n_dup_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(c.covered_words, 0) AS covered_words, l.r IS NOT NULL AS is_long
  FROM texts x LEFT JOIN covered c ON c.r = x.r LEFT JOIN dup_lines d ON d.r = x.r LEFT JOIN too_long l ON l.r = x.r)
SELECT * EXCLUDE (is_long), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered_words <= 30 * n_words AND NOT is_long AS kept
FROM stats
"""


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, key="a key for tests; take yours from a vault")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_quotes": op8_chat_quotes,
    "op9_quality_rules": op9_quality_rules,
    "op10_surrogates": op10_surrogates,
}

ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op7_exact_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL}
