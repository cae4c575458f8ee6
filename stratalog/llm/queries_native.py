"""Queries of the operators that use DataFrame functions only, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import mixing, quality_rules, sharding, url_filter
from stratalog.llm.common import table


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    planned = mixing.plan_mix(docs)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST(source_size AS DOUBLE) AS s,
         CAST(([3, 1, 2])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w FROM s
), c AS (
  SELECT *, 2.0::DOUBLE * s AS cap, 1.5::DOUBLE * sum(s) OVER () AS total FROM w WHERE s > 0
), l AS (
  SELECT *, row_number() OVER o AS k,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)
), f AS (
  SELECT source, least(cap, coalesce((SELECT arg_min(level, k) FROM l WHERE level * w < cap) * w, cap)) AS target FROM l
), t AS (
  SELECT w.source, w.source_size, coalesce(f.target, 0.0::DOUBLE) AS target FROM w LEFT JOIN f ON w.source IS NOT DISTINCT FROM f.source
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"))
    dealt = sharding.assign_shards(rows, "doc_id", shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _ring_sql(shards: int = 8, vnodes: int = 64, seed: int = 7) -> str:
    """The ring of assign_shards, its rounds one after the other: in each, the rows still out ask for a shard, in order of the points."""
    order = sharding.ring(shards, vnodes, seed)
    kinds = sorted({tuple(x) for x in order})
    place = {k: i + 1 for i, k in enumerate(kinds)}

    def hashed(salt: int, *columns: str) -> str:
        texts = " || chr(2) || ".join([f"'{salt}'", *(f"coalesce(CAST({c} AS VARCHAR), chr(1))" for c in columns)])
        return f"CAST(('0x' || substr(md5({texts}), 1, 12)) AS BIGINT)"

    rounds = []
    for r in range(shards):
        before = " UNION ALL ".join(f"SELECT ask, left_n FROM a{q}" for q in range(r)) or "SELECT 0 AS ask, 0 AS left_n WHERE false"
        rounds.append(f"""a{r} AS (
  SELECT point, kind, total, left_n, done, (SELECT kinds[p.kind][{r + 1}] FROM k) AS ask FROM p{r} p
), g{r} AS (
  SELECT a.*, coalesce(sum(left_n) OVER (PARTITION BY ask ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(b.n, 0) AS ahead
  FROM a{r} a LEFT JOIN (SELECT ask AS b_ask, sum(left_n) AS n FROM ({before}) GROUP BY 1) b ON b_ask = ask
), h{r} AS (
  SELECT *, greatest(0, least(left_n, total // {shards} + CASE WHEN ask < total % {shards} THEN 1 ELSE 0 END - ahead)) AS got FROM g{r}
), p{r + 1} AS (
  SELECT point, kind, total, left_n - got AS left_n, done + got AS done FROM h{r}
)""")
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS BIGINT))), lambda c, x: xor(({table}::BIGINT[])[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"
    parts = " UNION ALL ".join(f"SELECT point, ask AS shard, done AS first_n, done + got AS last_n, ahead AS base FROM h{r} WHERE got > 0" for r in range(shards))
    return f"""
WITH k AS (
  SELECT {[list(x) for x in kinds]} AS kinds, {[place[tuple(x)] for x in order]} AS points
), d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, CAST(CASE WHEN text IS NOT NULL THEN {crc} END AS BIGINT) AS text_crc32 FROM documents
), c AS (
  SELECT *, {hashed(seed, "doc_id")} % {sharding.SLOTS} AS point, {hashed(seed + 2, "doc_id", "size", "text_crc32")} % {sharding.SALTS} AS salt, {hashed(seed + 1, "doc_id")} AS h FROM d
), n AS (
  SELECT point, count(*) AS n, sum(count(*)) OVER () AS total FROM c GROUP BY point
), p0 AS (
  SELECT point, (SELECT points[n.point + 1] FROM k) AS kind, total, n AS left_n, 0 AS done FROM n
), {", ".join(rounds)}, parts AS ({parts}), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY point ORDER BY salt, h, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS rank FROM c
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(base + rank - first_n AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM ranked JOIN parts ON ranked.point = parts.point AND rank >= first_n AND rank < last_n
"""


OP4_SQL = _ring_sql()


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), f AS (
  SELECT rid, i FROM u QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1
), r AS (
  SELECT rid, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM f) GROUP BY rid
), l AS (
  SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
), k AS (
  SELECT rid, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS dup, CAST(coalesce(sum(n) FILTER (WHERE NOT (
      (n >= 5 AND NOT regexp_matches(line, {_sql(quality_rules.SENTENCE_END)}))
      OR len(regexp_extract_all(line, {_sql(quality_rules.SEPARATORS)})) * 4 >= greatest(n, 8)
      OR 2 * len(regexp_extract_all(line, '[#*$%&|<>{{}}]')) >= n
      OR len(regexp_extract_all(line, '!!')) * 2 >= n
      OR regexp_matches(line, {_sql(quality_rules.NAVIGATION)})
      OR regexp_matches(line, {_sql(quality_rules.BOILERPLATE)}))), 0) AS BIGINT) AS kept_words
  FROM l WHERE n > 0 GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(k.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
       len(d.w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(d.w) AS base_failed,
       NOT (len(d.w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(d.w)) AND len(d.w) - coalesce(k.kept_words, 0) <= {quality_rules.MAX_LOSS} * len(d.w) AS kept,
       coalesce(k.kept_words, 0) AS kept_words
FROM d LEFT JOIN k USING (rid) LEFT JOIN r USING (rid)
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP8_SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT * FROM (VALUES {", ".join(f"('{kind}', '{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}')" for kind, rule in url_filter.RULES)}) t(kind, rule, rhost, rpath)
), h AS (
  SELECT * FROM (VALUES {", ".join(f"('{h}')" for h in url_filter.HOSTS)}) t(bad)
), b AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS kind FROM u JOIN r
  ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN EXISTS (SELECT 1 FROM h WHERE host = bad OR suffix(host, '.' || bad)) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN b USING (rid)
"""


QUERIES = {"op8_url_filter": op8_url_filter, "op5_quality_rules": op5_quality_rules, "op3_source_mix": op3_source_mix, "op4_ring_shards": op4_ring_shards}
SQL = {"op4_ring_shards": OP4_SQL, "op8_url_filter": OP8_SQL, "op5_quality_rules": OP5_SQL, "op3_source_mix": OP3_SQL}
