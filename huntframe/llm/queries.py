"""One query for each operator of this subpackage, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm import alignment, bpe, exact_dedup, fingerprints, html_extract, licenses, lm_score, mixing, simhash, toxicity, url_filter, variants, warc


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, chain)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 takes 5 bits a letter: each 5 hexadecimal digits are 4 letters.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, max(page_id) AS winner FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((('0x' || substr(p.h, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT >> s) & 31 AS BIGINT) + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR i IN range(8)], '')
         AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM p JOIN w ON p.h = w.h
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, key, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source, key),
r AS (
  SELECT *, 3 * source_size AS cap,
         row_number() OVER o AS place,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS share
  FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST)),
f AS (SELECT min(place) AS place, arg_min(share, place) AS share FROM r WHERE share * weight <= cap),
t AS (
  SELECT key, source_size, CASE WHEN f.place IS NULL OR r.place < f.place THEN cap::DOUBLE ELSE f.share * weight END AS target,
         least({mixing.MOST_CELLS}, CAST(ceil(n_docs / {mixing.CELL_ROWS}.0) AS BIGINT)) AS n_cells,
         ('0x' || substr(md5('{mixing.SEED}:' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r, f),
k AS (
  SELECT doc_id, size, source_size, target, u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS each,
         row_number() OVER (PARTITION BY d.key ORDER BY
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % n_cells, size, doc_id NULLS LAST) - 1 AS pos
  FROM d JOIN t ON d.key = t.key)
SELECT doc_id, size, source_size, target,
       CAST(floor((pos + 1) * each + u) - floor(pos * each + u) AS BIGINT) * size AS taken
FROM k
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    by = [F.col("by_order")[k].alias(f"n_by_{k}") for k in range(lm_score.ORDER + 1)]
    return scores.select("doc_id", "n_words", "log_score", *by)


OP8_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS c, unnest(range(1, len(words) + 1)) AS i, len(words) AS n FROM t),
g AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS b, lag(c, 2) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM p),
k AS (
  SELECT doc_id, i, n, count(*) OVER () - n AS c0,
         count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS c1,
         CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) ELSE 0 END AS c2,
         CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) ELSE 0 END AS c3
  FROM g),
h AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2,
             CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS k FROM k),
s AS (
  SELECT doc_id, count(*) AS n_words,
         round(avg(ln(CASE k WHEN 3 THEN c3::DOUBLE / p2 WHEN 2 THEN c2::DOUBLE / p1 WHEN 1 THEN c1::DOUBLE / greatest(c0, 1)
                             ELSE 1::DOUBLE / greatest(c0, 1) END) + (least(i, 3) - k) * ln({lm_score.ALPHA}::DOUBLE)), 6) AS log_score,
         count(*) FILTER (k = 0) AS n_by_0, count(*) FILTER (k = 1) AS n_by_1, count(*) FILTER (k = 2) AS n_by_2, count(*) FILTER (k = 3) AS n_by_3
  FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, log_score,
       coalesce(n_by_0, 0) AS n_by_0, coalesce(n_by_1, 0) AS n_by_1, coalesce(n_by_2, 0) AS n_by_2, coalesce(n_by_3, 0) AS n_by_3
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine keeps a public vocabulary, by default the byte-level BPE one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 goes byte by byte through its table of 256 remainders; words are near if one's rest without a letter is the other's, or its rest there too.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256))::BIGINT AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
once AS (SELECT doc_id, run, count(*) AS k, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS bytes FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT doc_id, run, k, xor(4294967295, list_reduce(
      [4294967295::BIGINT] || [('0x' || substr(hex(bytes), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT FOR i IN range(0, octet_length(bytes))],
      lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) + 1 AS BIGINT)]))) AS h
  FROM once, crc),
typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, k
  FROM hashed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, CAST(i AS BIGINT) AS i, substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i + 2 AS BIGINT)) AS rest FROM w, unnest(range(0, length(word))) AS u(i)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min((-m, encode(other))) AS b FROM pairs GROUP BY word),
f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * n THEN decode(b[2]) END AS form, CASE WHEN -b[1] >= 5 * n THEN -b[1] END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
r AS (
  SELECT word, word AS at, form FROM f
  UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.form = f.word)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word AND r.form IS NULL
"""


#: The rules of ``op13_url_filter``: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rule_table(spark, URL_RULES))


OP13_SQL = rf"""
WITH r(rhost, rpath, rverdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (SELECT page_id, row_number() OVER () AS i,
             CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, i, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc": op2_warc,
        "op3_html_text": op3_html_text,
        "op4_fingerprints": op4_fingerprints,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_source_mixing": op6_source_mixing,
        "op7_licenses": op7_licenses,
        "op8_lm_score": op8_lm_score,
        "op9_bpe": op9_bpe,
        "op10_simhash": op10_simhash,
        "op11_alignment": op11_alignment,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2_SQL,
        "op5_exact_dedup": OP5_SQL,
        "op6_source_mixing": OP6_SQL,
        "op8_lm_score": OP8_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_url_filter": OP13_SQL,
    }
