"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm import bpe, chat, exact_dedup, langid, mixing, quality, simhash, substring, tokenfile, toxicity
from arbiter.llm.common import documents


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(documents(spark, sf_dir)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum_order(mixing.mix_plan(documents(spark, sf_dir)))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.coalesce(F.floor(F.get("positions", F.lit(0))).cast("long"), F.lit(-1)).alias("first_position"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(documents(spark, sf_dir))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_token_files": op2_token_files,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
}

_WS = r"[\x20\x09-\x0D]+"

#: Names ending in _ are views of the text that several statements share.
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '')"

OP3_SQL = f"""
WITH k AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM k WINDOW g AS (PARTITION BY text_sha256)
"""

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT rid, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
f AS (
  SELECT d.rid, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
j AS (SELECT *, base_failed OR n_symbols > 0.3 * n_words OR n_dup_lines > 0.3 * n_lines
         OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 12 AS failed FROM b),
h AS (SELECT source, count(*) AS n_docs, sum(failed::int) AS n_failed FROM j GROUP BY source),
p AS (SELECT avg(n_failed / n_docs) AS m, coalesce(var_samp(n_failed / n_docs), 0) AS v, avg(1 / n_docs) AS noise FROM h),
s AS (SELECT m, CASE WHEN v - m * (1 - m) * noise > 0
        THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * noise) - 1, 1e-6), {quality.MAX_STRENGTH}) ELSE {quality.MAX_STRENGTH} END AS s FROM p),
r AS (SELECT source, (n_failed + m * s) / (n_docs + s) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= {quality.MAX_RATE} AS kept, round(rate, 6) AS host_rate
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""

#: Each source's place from 0, its weight, target and tape, down to copies and the first position (-1 if the mix doesn't take the document).
OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(doc_id::varchar, 'null')) AS key, text AS tie FROM documents),
s0 AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS k FROM s0),
s2 AS (SELECT *, [5, 2, 1][k + 1] AS w, [-0.5::double, 0::double, 0.5::double][k + 1] AS ramp FROM s1),
s3 AS (SELECT *, 3 * source_size / w AS ratio FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER ()
          - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
          / sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
lv AS (SELECT min_by(level, ratio) AS lvl FROM s4 WHERE level <= ratio),
t AS (SELECT source, source_size, least((3 * source_size)::double, lvl * w) AS target, ramp FROM s4, lv),
tt AS (SELECT sum(target) AS total, sum(target * ramp) AS tilt FROM t),
m AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint + size / 2 AS middle FROM d),
c AS (SELECT doc_id, size, source_size, target, ramp, middle,
        least((middle <= target)::int + (middle + source_size <= target)::int + (middle + 2 * source_size <= target)::int, CASE WHEN size = 0 THEN 1 ELSE 3 END) AS copies
      FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN target > 0 THEN middle / target ELSE 0 END AS y FROM c),
x AS (SELECT *, CASE WHEN ramp = 0 THEN y ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * y) - (1 - ramp)) / (2 * ramp) END AS u FROM y)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies::bigint AS copies,
       CASE WHEN copies > 0 THEN floor((total - tilt) * u + tilt * u * u)::bigint ELSE -1 END AS first_position
FROM x, tt
"""

ORACLES = {"op3_exact_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op5_mixing": OP5_SQL}
