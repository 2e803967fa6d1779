"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchdeck.llm import centroids, decontaminate, embedding_dedup, order_minhash, packing, periodic_runs, quality, secrets, suffix_dedup, token_counts, token_store, url_rules, warc

CAPACITY = 2048


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), CAPACITY, end_id=0)
    return packing.pack(items, CAPACITY)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=CAPACITY)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


SITE_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
PATTERN_RULES = (
    ("feeds", r"/feed(/|$)", ("feed",), "block"),
    ("login", r"/(login|signin)(/|\.html|$)", (), "block"),
    ("printed", r"\.html$", ("html",), "allow"),
)


def url_table(spark: SparkSession) -> DataFrame:
    site = [url_rules.site_rule(*r) for r in SITE_RULES]
    return url_rules.rule_table(spark, site + [url_rules.pattern_rule(*r) for r in PATTERN_RULES])


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_table(spark))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site of a document is its source, the path within it its language: the table has no URL."""
    rows = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carried=["doc_id", "source", "lang"])
    return rows.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "evidence", "host_share", "path_share", "posterior", "kept")


def captures(pages: DataFrame) -> DataFrame:
    """Two crawls of all pages: full responses, and later not-modified revisits of the same URLs; every third page
    is also revisited when it was first fetched, just before its response. Every seventh revisit of the second
    crawl names another ETag, every fifth has a date alone."""
    md5 = F.md5(F.coalesce("html", F.lit("")))
    date = F.concat(F.lit("day "), F.pmod("page_id", F.lit(365)))
    full = pages.select(
        (F.col("page_id") * 4 + 2).alias("record_id"), "url", F.col("page_id").alias("at"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), F.concat(F.lit('"'), md5, F.lit('"')), F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), date).alias("headers"),
    )
    tag = F.when(F.col("page_id") % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit('W/"'), md5, F.lit('"')))
    later = F.when(F.col("page_id") % 5 == 0, F.create_map(F.lit("last-modified"), date)).otherwise(F.create_map(F.lit("etag"), tag, F.lit("date"), F.lit("later")))
    again = pages.select((F.col("page_id") * 4 + 3).alias("record_id"), "url", (F.col("page_id") + 10_000_000_000).alias("at"), F.lit("revisit").alias("kind"), later.alias("headers"))
    before = pages.filter("page_id % 3 = 0").select((F.col("page_id") * 4 + 1).alias("record_id"), "url", F.col("page_id").alias("at"), F.lit("revisit").alias("kind"), F.create_map(F.lit("date"), F.lit("then")).alias("headers"))
    return full.union(again).union(before)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), ";")
    return out.select("record_id", "url_key", "refers_to", "status", shown.alias("headers"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.store_folder(spark)
    manifest = token_store.write(table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_store.read_digest(spark, folder, manifest)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a text of which the words from one place on repeat; for about a tenth of the ids, none for a null id."""
    h = zlib.crc32(str(doc_id).encode())
    g, rest = divmod(h, 10)
    if doc_id is None or rest or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"), rewrite=planted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_decontaminate, op2_suffix_dedup, op3_embedding_dedup, op4_packing, op5_token_counts, op6_order_minhash, op7_url_rules, op8_quality, op9_warc, op10_token_store, op11_centroids, op12_secret_scan, op13_periodic_runs)
    return {f.__name__: f for f in made}


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)
"""

OP7_SQL = r"""
WITH u AS (
  SELECT page_id, url FROM pages),
p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM u),
r(rule, host, path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
  ('org/es/', 'org', '/es/', 'block')),
s AS (
  SELECT page_id, url, max(struct_pack(l := length(r.rule), rule := r.rule, verdict := r.verdict)) AS best
  FROM (SELECT DISTINCT * FROM p) p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id, url),
q AS (
  SELECT p.*, s.best, CASE
    WHEN s.best IS NOT NULL OR coalesce(strpos(p.url, '://'), 0) = 0 THEN NULL
    WHEN regexp_matches(p.host || p.path, '/(login|signin)(/|\.html|$)') THEN 'login'
    WHEN regexp_matches(p.host || p.path, '/feed(/|$)') THEN 'feeds'
    WHEN regexp_matches(p.host || p.path, '\.html$') THEN 'printed' END AS pattern_rule
  FROM p LEFT JOIN s ON p.page_id = s.page_id AND p.url IS NOT DISTINCT FROM s.url)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN pattern_rule IN ('login', 'feeds') THEN 'block' ELSE 'allow' END) AS verdict, pattern_rule
FROM q
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, 'day ' || (page_id % 365) AS day,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)\??([^#]*)', 1, 's') AS h,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)\??([^#]*)', 2, 's') AS pa,
    list_sort(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)\??([^#]*)', 3, 's'), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS q
  FROM pages),
k AS (
  SELECT page_id, tag, day, CASE WHEN h <> '' THEN regexp_replace(lower(h), '^www\.|:(80|443)$', '', 'g') || regexp_replace(pa, '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key FROM p),
rv AS (
  SELECT page_id * 4 + 3 AS record_id, url_key, page_id + 10000000000 AS at, 'again' AS sort,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'other' ELSE tag END AS etag,
    CASE WHEN page_id % 5 = 0 THEN day END AS modified, tag AS own FROM k
  UNION ALL SELECT page_id * 4 + 1, url_key, page_id, 'then', NULL, NULL, NULL FROM k WHERE page_id % 3 = 0),
f AS (
  SELECT rv.*, (SELECT max(k.page_id) FROM k WHERE k.url_key = rv.url_key AND (k.page_id < rv.at OR (k.page_id = rv.at AND k.page_id * 4 + 2 < rv.record_id))) AS ref FROM rv),
g AS (
  SELECT f.*, k.tag AS rtag, k.day AS rday, CASE WHEN f.url_key IS NULL THEN 'no-url' WHEN ref IS NULL THEN 'no-response'
    WHEN f.etag <> k.tag THEN 'etag-differs' WHEN f.etag IS NULL AND f.modified <> k.day THEN 'date-differs' ELSE 'resolved' END AS status
  FROM f LEFT JOIN k ON k.page_id = f.ref)
SELECT record_id, url_key, CASE WHEN status = 'resolved' THEN ref * 4 + 2 END AS refers_to, status,
  CASE WHEN status = 'resolved' THEN 'content-type=text/html;date='
    || CASE WHEN sort = 'then' THEN 'then' WHEN etag IS NOT NULL THEN 'later' ELSE rday END
    || ';etag=' || CASE WHEN etag IS NOT NULL THEN 'W/"' || etag || '"' ELSE '"' || rtag || '"' END
    || ';last-modified=' || coalesce(modified, rday) END AS headers
FROM g
"""


def op11_sql(rounds: int = 3) -> str:
    """Rounds one after the other; all numbers are integers."""
    parts = [
        """
v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, e AS c FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, e, min(struct_pack(d := list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, k := k)) AS best
  FROM v, c{r} GROUP BY vec_id, e)""")
        if r < rounds:
            parts.append(f"""
m{r} AS MATERIALIZED (
  SELECT k, list(q ORDER BY i) AS c FROM (
    SELECT k, i, (s - ((s % n) + n) % n) // n AS q FROM (
      SELECT best.k AS k, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY best.k, i)) GROUP BY k),
c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (k))""")
    return f"""
WITH {",".join(parts)}
SELECT vec_id, best.k::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia,
  sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON k = best.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op7_url_rules": OP7_SQL, "op9_warc": OP9_SQL, "op11_centroids": op11_sql()}
