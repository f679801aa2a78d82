"""Text queries on documents, pages, part and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.functions import text as X
from entrack.sources.tables import table

CATEGORIES = [("licence", r"(?i)licensed|license"), ("table", r" \| "), ("contact", r"@|\d{3}"), ("short", r"^.{0,200}$")]


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.one_line(F.col("text"), 300)).alias("line_md5"), F.length(X.clean_lines(F.col("text"))).alias("chars"))


def markdown_safe(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.markdown_safe(F.col("text"))).alias("safe_md5"))


def text_category(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.first_category(F.col("text"), CATEGORIES, "prose").alias("category"))


def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


def version_compare(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    version = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), F.col("p_size").cast("string"))
    return p.select("p_partkey", X.is_newer(version, F.lit("1.9")).alias("newer"), X.is_newer(F.col("p_name"), F.lit("0")).alias("not_a_version"))


def clocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", X.clock(F.col("value") * 60).alias("clock"))


def first_tags(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.first_tag(F.split(F.lower("p_type"), " "), ["copper", "anodized", "large", "small"], "other").alias("tag"))


def folded_angles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    angle = X.folded_angle(F.round(F.col("value") * 7 - 500, 4))
    return e.select("event_id", F.round(angle, 4).alias("angle"), F.when(F.abs(angle) < 10, "level").when(F.abs(angle) > 80, "upright").otherwise("tilted").alias("tag"), X.half_up(F.round(F.col("value") * 7 - 500, 4)).alias("whole"))



_ONE = r"substr(trim(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]', '', 'g'), '[\x00-\x20\x{7F}-\x{A0}]+', ' ', 'g')), 1, 300)"
_AUTH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_ALL = (clean_text, markdown_safe, text_category, url_canonical, version_compare, clocks, first_tags, folded_angles)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "clean_text": rf"SELECT doc_id, md5({_ONE}) AS line_md5, length(nullif(trim(regexp_replace(text, '\r\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '')) AS chars FROM documents",
    "markdown_safe": r"SELECT doc_id, md5(regexp_replace(text, '([\\`*_{}\[\]()<>#+.!|~-])', '\\\1', 'g')) AS safe_md5 FROM documents",
    "text_category": r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licensed|license') THEN 'licence' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '@|[0-9]{3}') THEN 'contact' WHEN length(text) <= 200 AND NOT contains(text, chr(10)) THEN 'short' ELSE 'prose' END AS category FROM documents",
    "url_canonical": rf"""SELECT page_id, CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1).lower() IN ('http', 'https') AND {_AUTH} <> '' AND NOT contains({_AUTH}, '@')
  THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower({_AUTH}) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') END AS url FROM pages""",
    "version_compare": "SELECT p_partkey, p_size % 3 > 1 OR (p_size % 3 = 1 AND p_size > 9) AS newer, false AS not_a_version FROM part",
    "clocks": "WITH s AS (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock FROM s",
    "first_tags": "SELECT p_partkey, coalesce(list_filter(['copper', 'anodized', 'large', 'small'], lambda t: list_contains(string_split(lower(p_type), ' '), t))[1], 'other') AS tag FROM part",
    "folded_angles": """WITH a AS (SELECT event_id, round(value * 7 - 500, 4) AS x FROM events), p AS (SELECT event_id, x, x - 180 * floor(x / 180) AS t FROM a), f AS (SELECT event_id, x, CASE WHEN t > 90 THEN t - 180 ELSE t END AS g FROM p)
SELECT event_id, round(g, 4) AS angle, CASE WHEN abs(g) < 10 THEN 'level' WHEN abs(g) > 80 THEN 'upright' ELSE 'tilted' END AS tag, CAST(floor(x + 0.5) AS BIGINT) AS whole FROM f""",
}
