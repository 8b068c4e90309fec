"""The registered queries of this subpackage, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from inkblot.llm import ann, langid, mixing, phrases, pieces, ppm, pq, quality, resample, setjoin, sharding, suffixes, urls
from inkblot.llm.common import crc_mod

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ppm(spark: SparkSession, sf: str) -> DataFrame:
    return ppm.score(table(spark, sf, "documents"), crc_mod(F.col("doc_id"), 5) != 1)


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_set_join(spark: SparkSession, sf: str) -> DataFrame:
    return setjoin.join(table(spark, sf, "documents"))


def op4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


def op7_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.report(table(spark, sf, "documents"))


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"))


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that ``labels`` calls bad under their number (quality 0, or toxic) are the labelled ones."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.judge(table(spark, sf, "pages"), labels)


def op10_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"), ann.every_20th())


def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    scored = resample.scores(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op13_embedding_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_ppm": op1_ppm, "op2_quality_rules": op2_quality_rules, "op3_set_join": op3_set_join, "op4_pieces": op4_pieces, "op5_language": op5_language,
        "op6_mixing": op6_mixing, "op7_suffixes": op7_suffixes, "op8_sharding": op8_sharding, "op9_url_filter": op9_url_filter, "op10_neighbours": op10_neighbours,
        "op11_resampling": op11_resampling, "op12_collocations": op12_collocations, "op13_embedding_duplicates": op13_embedding_duplicates,
        "pipeline": corpus_pipeline.run,
    }


OP6 = """
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source
), ranked AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * source_size AS cap FROM sums
), filled AS (
  SELECT *, cap / w AS ratio, row_number() OVER o AS place,
    sum(cap) OVER (ORDER BY cap / w, rk ROWS UNBOUNDED PRECEDING) - cap AS used,
    sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () AS total
  FROM ranked WINDOW o AS (ORDER BY cap / w, rk)
), levels AS (
  SELECT *, (CAST(total AS DOUBLE) * 1.5::DOUBLE - used) / CAST(rest AS DOUBLE) AS level FROM filled
), water AS (SELECT arg_min(level, place) FILTER (level < ratio) AS level FROM levels
), targets AS (
  SELECT l.source, source_size, least(cap, coalesce(w * water.level, cap)) AS target FROM levels l, water
), rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, CAST(floor(r.rate) AS BIGINT) + CASE WHEN
    CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || md5(coalesce(d.text, ''))) || ':mix-1'), 1, 12) AS BIGINT)
      / 281474976710656.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM drawn
"""


OP11 = """
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t
  FROM (SELECT unnest(range(256)) AS v)
), texts AS (
  SELECT doc_id, 0 AS side, text, row_number() OVER () AS row_no FROM documents UNION ALL SELECT NULL, 1, text, -row_number() OVER () FROM benchmark
), worded AS (
  SELECT doc_id, side, row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts
), runs AS (
  SELECT side, row_no, unnest(list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS run FROM worded
), hashed AS (
  SELECT run, xor(4294967295, list_reduce(
    list_transform(range(0, octet_length(encode(run))), lambda i: CAST('0x' || substr(hex(encode(run)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT run FROM runs), crc_table
), placed AS (SELECT side, row_no, bucket FROM runs JOIN hashed USING (run)
), tallies AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY bucket
), totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM tallies
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM tallies, totals
), weighed AS (
  SELECT row_no, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY row_no
), scored AS (
  SELECT doc_id, row_no, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (row_no) WHERE side = 0
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ordered
"""

OP12 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS ws FROM documents
), occurrences AS (
  SELECT lang, k, ws[i : i + k - 1] AS words FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)
), counts AS (SELECT lang, k, words, count(*) AS f FROM occurrences GROUP BY ALL
), sums AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), often AS MATERIALIZED (SELECT * FROM counts WHERE f >= 30
), cuts AS (
  SELECT o.lang, o.k, o.words, o.f AS a, c, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * o.f // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM often WHERE k > 1) o
  JOIN often l ON l.lang = o.lang AND l.words = o.words[1 : c] JOIN often r ON r.lang = o.lang AND r.words = o.words[c + 1 : o.k]
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, c) = 1
), inner_parts AS (
  SELECT lang, words[i : i + m - 1] AS words, f FROM (SELECT lang, words, f, k, m, unnest(range(1, k - m + 2)) AS i FROM often, (SELECT unnest([2, 3]) AS m) WHERE k > m)
), covers AS (SELECT lang, words, max(f) AS longer FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT w.lang, array_to_string(w.words, ' ') AS phrase, a, l, r, score FROM weakest w LEFT JOIN covers c ON c.lang = w.lang AND c.words = w.words
  WHERE coalesce(100 * longer < 80 * a, true)
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN sums USING (lang) WHERE rank <= 2000
"""

OP13 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS row_no FROM embeddings
), usable AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM vectors
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.row_no AS a, b.row_no AS b, b.vec_id AS id FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.row_no <> b.row_no
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reached AS (
  SELECT row_no AS a, row_no AS b FROM vectors UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), parts AS (SELECT r.a AS row_no, min(v.vec_id) AS component_id FROM reached r JOIN vectors v ON v.row_no = r.b GROUP BY r.a
), counted AS (SELECT a AS row_no, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM vectors JOIN parts USING (row_no) LEFT JOIN counted USING (row_no)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6, "op11_resampling": OP11, "op12_collocations": OP12, "op13_embedding_duplicates": OP13}
