"""Registered queries of this folder's operators, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens
from .chat_format import chat_digest, format_chats
from .collocations import collocations
from .decontaminate import contaminated
from .html_text import extract_text
from .language import held_out, learn_languages, predict_languages
from .licences import scan_licences
from .line_rules import line_quality
from .mixing import mix_sources
from .near_dedup import near_groups
from .quality_model import learn_quality, score_quality
from .sharding import byte_shards
from .url_rules import judge_urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def near(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(_table(spark, folder, "documents"))


def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(_table(spark, folder, "documents"))


def mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality(_table(spark, folder, "documents"))


def chats(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(format_chats(turns.unionByName(own)))


def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(_table(spark, folder, "pages"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    apart = held_out("doc_id", 3, 1)
    scored = score_quality(docs, learn_quality(docs, labels.where(~apart)))
    return scored.select("doc_id", apart.alias("held_out"), "score", "predicted")


def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = learn_languages(docs.where(~held_out()))
    predicted = predict_languages(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = byte_shards(_table(spark, folder, "documents"), 40, carry=["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge_urls(_table(spark, folder, "pages"), rules).drop("alias_class")


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(_table(spark, folder, "documents"))


QUERIES = {
    "op1_near_dedup": near,
    "op2_licence_scan": licence_scan,
    "op3_mixing": mixing,
    "op4_quality_rules": quality_rules,
    "op5_chat_formatting": chats,
    "op6_html_extraction": main_texts,
    "op7_decontamination": decontamination,
    "op8_quality_classifier": quality,
    "op9_sharding": sharding,
    "op10_language_id": language,
    "op11_url_filter": url_verdicts,
    "op12_collocations": phrases,
    "op13_token_alignment": token_alignment,
}
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HAS_WORD = "regexp_matches({}, '[^\\x20\\x09-\\x0D]')"

ORACLE: dict[str, str] = {
    # every pair of documents that share a shingle
    "op1_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("text", _LOWER, 1)} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.o),
c AS (SELECT d, min(o) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents JOIN c ON d = doc_id LEFT JOIN n USING (doc_id)""",
    "op4_quality_rules": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_HAS_WORD.format("x")}) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
t AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
v AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM t, range(0, 5) x(k)) GROUP BY 1),
b AS (SELECT doc_id, source, text, l, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN v USING (doc_id)),
x AS (SELECT DISTINCT source, text, lower(trim(regexp_replace(y, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT source, text, unnest(l) AS y FROM b)),
h AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY 1),
f AS (SELECT source, line FROM (SELECT source, line, count(*) AS n FROM x GROUP BY 1, 2) JOIN h USING (source)
  WHERE n > 20 AND n > docs * 0.002),
k AS (SELECT source, text, sum(len(string_split(x.line, ' '))) AS total,
  sum(CASE WHEN f.line IS NULL THEN len(string_split(x.line, ' ')) ELSE 0 END) AS left_over
  FROM x LEFT JOIN f USING (source, line) GROUP BY 1, 2),
z AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b LEFT JOIN k USING (source, text))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(left_over < 0.3 * total, false) AS kept FROM z""",
    # canonical links and refresh redirects to absolute urls; relative ones need the steps of urls' standard
    "op11_url_filter": f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)[\\s/][^>]*>')) AS tag FROM pages
  WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
links AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)^<link.*\\brel\\s*=\\s*["'']?canonical') THEN
    regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^"''\\s>]*)', 1)
  WHEN regexp_matches(tag, '(?i)http-equiv\\s*=\\s*["'']?refresh') THEN
    regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^"''\\s>]*)', 1) ELSE '' END AS target FROM tags),
names AS (SELECT url FROM pages UNION SELECT url FROM links UNION SELECT target FROM links),
rest AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM names),
parts AS (SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM rest),
keys AS (SELECT url, host, path, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)?$', '') ||
  CASE WHEN path = '' THEN '/' ELSE path END || array_to_string(['?'] || list_filter(string_split(query, '&'),
  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=|$)')), '&') END AS id FROM parts),
best AS (SELECT k.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS says
  FROM keys k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path) GROUP BY 1),
ends AS (SELECT a.id AS u, b.id AS v FROM links l JOIN keys a ON a.url = l.url JOIN keys b ON b.url = l.target WHERE a.id <> b.id),
both_ways AS (SELECT u, v FROM ends UNION SELECT v, u FROM ends),
bad AS (SELECT id FROM keys JOIN best USING (url) WHERE says = 'block' AND id IS NOT NULL
  UNION SELECT e.v FROM bad JOIN both_ways e ON e.u = bad.id)
SELECT p.page_id, coalesce(k.host, '') AS host, coalesce(k.path, '') AS path, best.rule,
  CASE WHEN best.says IS NOT NULL THEN best.says
    WHEN k.id IN (SELECT e.u FROM both_ways e JOIN bad ON bad.id = e.v) THEN 'block' ELSE 'allow' END AS verdict
FROM pages p LEFT JOIN keys k ON k.url = p.url LEFT JOIN best ON best.url = p.url""",
    # every phrase of one to five words, counted on its own
    "op12_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.replace("text", "coalesce(text, '')", 1)},
  '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
q AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
w AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
g AS (SELECT lang, w AS w1, {", ".join(f"lead(w, {i}) OVER o AS w{i + 1}" for i in range(1, 5))} FROM w
  WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS ({" UNION ALL ".join(
    f"SELECT lang, {k} AS size, {' || chr(32) || '.join(f'w{j}' for j in range(1, k + 1))} AS phrase, count(*) AS f FROM g "
    f"WHERE w{k} IS NOT NULL GROUP BY ALL" for k in range(1, 6))}),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
h AS MATERIALIZED (SELECT * FROM f WHERE f >= 100),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM h WHERE size > 1),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS u, array_to_string(w[k + 1:], ' ') AS v
  FROM c, range(1, 5) x(k) WHERE k < size),
s AS (SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, n,
  CAST((1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN h l ON l.lang = cut.lang AND l.phrase = u JOIN h r ON r.lang = cut.lang AND r.phrase = v JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT c.lang, array_to_string(c.w[j:j + m - 1], ' ') AS phrase, c.a
  FROM c, range(1, 5) y(j), range(2, 5) x(m) WHERE m < c.size AND j + m - 1 <= c.size),
kept AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase AND 100 * d.a >= 100 * b.a))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
WHERE rank <= 2000""",
}
