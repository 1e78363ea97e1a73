"""The registered queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .language_id import identify_language, learn_profiles
from .license_scan import license_digest, scan_licenses
from .mixing import mix_sources
from .quality import classify_quality, train_quality
from .suffix_dedup import substring_dedup
from .url_filter import rules_frame, url_filter
from .window_index import window_dedup

#: The rules that op7 applies: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(_table(spark, sf_dir, "documents")), "doc_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_language(docs, learn_profiles(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classify_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_jaccard_join, op2_decontaminate, op3_suffix_dedup, op4_license_scan, op5_language_id, op6_mixing, op7_url_filter, op8_exact_dedup, op9_window_dedup, op10_quality)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM i JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)
), m AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER o + 50 OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS new
  FROM w JOIN m USING (s) WHERE doc_id > least WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM c
), r AS (
  SELECT doc_id, island, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL
), k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r
), x AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS s, [3, 1, 2][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 1.5::DOUBLE * sum(s) OVER () AS total,
         coalesce(sum(2.0::DOUBLE * s) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left
  FROM s WINDOW before AS (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (total - capped) / w_left AS level FROM o
), lvl AS (
  SELECT arg_min(level, s / w) FILTER (WHERE w * level <= 2.0::DOUBLE * s) AS level FROM l
), t AS (
  SELECT source, s, CASE WHEN lvl.level IS NULL THEN 2.0::DOUBLE * s ELSE least(w * lvl.level, 2.0::DOUBLE * s) END AS t FROM l, lvl
), p AS (
  SELECT source, s, t, CASE WHEN s > 0 THEN floor(t / s) ELSE 0 END AS whole FROM t
), n AS (
  SELECT source, size, count(*)::BIGINT AS n FROM d WHERE size > 0 GROUP BY ALL
), m AS (
  SELECT n.source, size, t - whole * s AS need,
         coalesce(sum(n * size) OVER larger, 0) AS sure, sum(n * size * size) OVER others AS squares
  FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source
  WINDOW larger AS (PARTITION BY n.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         others AS (PARTITION BY n.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), k AS (
  SELECT source, arg_max(c, size) AS c FROM (SELECT *, (need - sure) / squares AS c FROM m WHERE need > 0) WHERE c * size < 1 GROUP BY source
), q AS (
  SELECT d.*, p.s, p.t, p.whole, CASE WHEN d.size = 0 THEN 0 ELSE least(1::DOUBLE, coalesce(k.c, 0) * d.size) END AS f
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
), r AS (
  SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) * (1 - f) / f END AS v FROM q
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, size, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM r
)
SELECT doc_id, size, s AS source_size, round(t, 6) AS target,
       ((whole + CASE WHEN v IS NOT NULL AND cum - size / 2 <= t - whole * s THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""

OP7_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
a AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM a
), c AS (
  SELECT row_number() OVER () AS n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM b
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule,
       coalesce(arg_max(verdict, length(rhost) + length(rpath)), 'allow') AS verdict
FROM c LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY n, page_id
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d)
), m AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM w JOIN m USING (s) WHERE doc_id > least
), x AS (
  SELECT doc_id, list(i) AS gone, count(*) AS n_removed FROM c GROUP BY doc_id
), k AS (
  SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d JOIN x USING (doc_id))
  ANTI JOIN c USING (doc_id, i)
), y AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(CASE WHEN n_removed IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op7_url_filter": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_window_dedup": OP9_SQL}
