"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import shared_path, table
from tideline.llm.fingerprints import compare_with_edits
from tideline.llm.html_text import extract_text, learn_model, training_pages
from tideline.llm.jaccard_join import jaccard_components
from tideline.llm.langid import held_out, learn_profiles, predict_languages
from tideline.llm.mixing import Mix
from tideline.llm.packing import pack_documents
from tideline.llm.quality import judge_quality
from tideline.llm.sharding import shard_documents
from tideline.llm.token_store import read_store, write_store
from tideline.llm.url_rules import filter_urls


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), learn_model(training_pages(spark)))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, word_tokenizer())
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).decisions()


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), with_text=False).drop("clean_text")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"))
    law = F.lit("bytes").alias("law")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", F.col("position").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, learn_profiles(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("row")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def url_fixed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: url parts and fixed rules, with the verdict of those pages that have one."""
    rows = op3_url_rules(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


RULE_SQL = r"""SELECT page_id, host, path, CASE WHEN www AND en THEN 'www.example.com/en/' WHEN example AND en THEN 'example.com/en/' WHEN net AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN net AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN com AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN www AND en THEN 'allow' WHEN (example AND en) OR (net AND (starts_with(path, '/es/') OR starts_with(path, '/fr/'))) THEN 'block' WHEN com AND starts_with(path, '/') THEN 'allow' END AS verdict
FROM (SELECT *, starts_with(path, '/en/') AS en, '.' || host LIKE '%.www.example.com' AS www, '.' || host LIKE '%.example.com' AS example, '.' || host LIKE '%.com' AS com, '.' || host LIKE '%.net' AS net FROM (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)))"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: sizes and targets."""
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


TARGET_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
-- the level of a share per weight at which all sizes are dealt out, among those at which some sources are full
l AS (SELECT arg_min(level, ratio) AS level FROM (
  SELECT a.source, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * b.source_size) FILTER (3 * b.source_size / b.w < 3 * a.source_size / a.w), 0)) / sum(b.w) FILTER (3 * b.source_size / b.w >= 3 * a.source_size / a.w) AS level,
    any_value(3 * a.source_size / a.w) AS ratio FROM s a, s b GROUP BY a.source) WHERE level <= ratio)
SELECT doc_id, size, source_size, CASE WHEN w * (SELECT level FROM l) < 3 * source_size THEN w * (SELECT level FROM l) ELSE CAST(3 * source_size AS DOUBLE) END AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: base measures and the base verdict."""
    return op6_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id)"""


def shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: sizes and virtual slots."""
    return op7_sharding(spark, sf_dir).select("doc_id", "size", "virtual_slot")


SLOT_SQL = """SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 1 AS size, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 4096 AS INTEGER) AS virtual_slot FROM documents"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text, op2_token_store, op3_url_rules, op4_mixing, op5_fingerprints, op6_quality, op7_sharding, op8_langid, op9_jaccard_join, op10_packing,
        url_fixed_rules, mix_targets, quality_base, shard_slots,
    )
}
#: Whole texts, all pairs that share a shingle; fine at the sizes that SQL is compared at.
JACCARD_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id, count(sh.s) AS n_shingles FROM w LEFT JOIN sh ON w.doc_id = sh.doc_id GROUP BY w.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(other), n.doc_id)) AS component_id FROM n LEFT JOIN reach ON n.doc_id = reach.doc_id GROUP BY n.doc_id, n.n_shingles"""

ORACLE_SQL: dict[str, str] = {"op9_jaccard_join": JACCARD_SQL, "url_fixed_rules": RULE_SQL, "mix_targets": TARGET_SQL, "quality_base": BASE_SQL, "shard_slots": SLOT_SQL}
