"""The operators over their whole tables, and the same results in DuckDB's SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import table
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_text import html_text
from .license_scan import license_scan, normal_words, standard_templates
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .quality import quality_scores
from .quantiles import click_counts, price_counts, quantile_report
from .secrets import BASE_RULES, MORE_RULES, secret_scan, span_text
from .toxicity import toxicity_scores
from .url_filter import url_filter


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"].isin(kinds))
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in kinds), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The dated list of op9: kind, pattern, action and the day from which it holds.
DATED_LIST = (
    ("domain", "ads-track.example.com", "block", "2023-12-01"),
    ("domain", "ads-track.example.com", "allow", "2024-05-01"),
    ("domain", "ads-track.example.com", "block", "2024-07-15"),
    ("domain", "casino-win.example.com", "block", "2024-01-01"),
    ("domain", "cheap-pills.example.com", "block", "2024-02-15"),
    ("prefix", "www.cheap-pills.example.com/de", "allow", "2024-06-01"),
    ("domain", "free-bets.example.com", "block", "2024-03-01"),
    ("domain", "free-bets.example.com", "none", "2024-09-01"),
    ("domain", "tionsh.example.net", "block", "2024-10-01"),
    ("prefix", "tionsh.example.net/en", "block", "2024-04-01"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch time; page_id modulo 366, as days from 2024-01-01, stands for it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))").alias("fetched"))
    entries = spark.createDataFrame(DATED_LIST, "kind string, pattern string, action string, listed string")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return url_filter(pages, entries).select("page_id", "host", day("fetched"), "blocked", "pattern", day("listed"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op12_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = click_counts(table(spark, sf_dir, "clicks")).unionByName(price_counts(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items")))
    return quantile_report(counts)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe": op4_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_license_scan": op10_license_scan,
    "op11_html_text": op11_html_text,
    "op12_quantiles": op12_quantiles,
    "op13_hard_negatives": op13_hard_negatives,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _secret_sql() -> str:
    """Spans from the pieces between matches: a match begins after all pieces and matches before it."""
    one = """
  SELECT doc_id, {place} AS place, '{kind}' AS kind, s AS start, s + length(m) AS stop FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g,
           unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, string_split_regex(t, '{pattern}') AS ps FROM d))
  WHERE length(g) >= {least}"""
    parts = [one.format(place=i, kind=r.kind, pattern=r.pattern.replace("'", "''"), group=r.group, least=r.least) for i, r in enumerate(BASE_RULES + MORE_RULES)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
a AS (
  SELECT doc_id, count_if(place = 0) AS n0, count_if(place = 1) AS n1, count_if(place = 2) AS n2,
         string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, place) FILTER (place < {len(BASE_RULES)}) AS base,
         string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, place) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


def _list_sql() -> str:
    entries = ", ".join(f"('{k}', '{p}', '{a}', DATE '{d}')" for k, p, a, d in DATED_LIST)
    return rf"""
WITH e AS (SELECT * FROM (VALUES {entries}) AS t(kind, pattern, action, since)),
i AS (SELECT *, lead(since) OVER (PARTITION BY kind, pattern ORDER BY since) AS until FROM e),
c AS (
  SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
k AS (
  SELECT page_id, 'domain' AS kind, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(string_split(host, '.')[n:], '.'))) AS pattern FROM c
  UNION ALL
  SELECT page_id, 'prefix', unnest(list_transform(range(1, len(parts) + 1), lambda n: host || '/' || array_to_string(parts[:n], '/'))) FROM c),
m AS (
  SELECT k.page_id, i.* FROM k JOIN c USING (page_id) JOIN i ON i.kind = k.kind AND i.pattern = k.pattern
  WHERE i.action <> 'none' AND i.since <= c.fetched AND (i.until IS NULL OR c.fetched < i.until)),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, kind DESC, action DESC) = 1)
SELECT c.page_id, host, strftime(c.fetched, '%Y-%m-%d') AS fetched, coalesce(b.action = 'block', false) AS blocked,
       b.pattern, strftime(b.since, '%Y-%m-%d') AS listed
FROM c LEFT JOIN b USING (page_id)"""


def _license_sql(threshold: float = 0.8) -> str:
    """Without any pruning: all bigrams of all documents against all templates."""
    known = standard_templates()
    values = ", ".join(f"({i}, '{n}', '{' '.join(normal_words(t))}')" for i, (n, t) in enumerate((n, t) for n in sorted(known) for t in known[n]))
    return rf"""
WITH t AS (SELECT template, name, string_split(words, ' ') AS w FROM (VALUES {values}) AS v(template, name, words)),
p AS (SELECT template, gram, min(i) - 1 AS place FROM (SELECT template, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT template, w, unnest(range(1, len(w))) AS i FROM t)) GROUP BY ALL),
g AS (SELECT template, list(gram) AS grams FROM p GROUP BY template),
d AS (SELECT row_number() OVER () AS id, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
h AS (SELECT id, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT id, template, i - 1 - place AS start, count(*) AS votes FROM h JOIN p USING (gram) GROUP BY ALL),
b AS (SELECT id, template, start FROM v QUALIFY row_number() OVER (PARTITION BY id, template ORDER BY votes DESC, start) = 1),
n AS (
  SELECT id, name, grams, greatest(start, 0) AS lo, least(start + len(t.w), len(d.w)) AS hi,
         list_distinct(list_transform(range(greatest(start, 0) + 1, least(start + len(t.w), len(d.w))), lambda i: d.w[i] || ' ' || d.w[i + 1])) AS own
  FROM b JOIN t USING (template) JOIN g USING (template) JOIN d USING (id)),
s AS (SELECT *, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dice DESC, name, lo, hi) AS place FROM s WHERE dice >= {threshold}),
r AS (SELECT id, count(*) AS n_matched, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM f GROUP BY id)
SELECT doc_id, coalesce(n_matched, 0)::BIGINT AS n_matched, coalesce(licenses, '') AS licenses, f.name AS best_license, f.dice AS best_dice, f.lo::BIGINT AS best_start, f.hi::BIGINT AS best_end
FROM d LEFT JOIN r USING (id) LEFT JOIN f ON f.id = d.id AND f.place = 1"""


ORACLES = {
    "op1_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key
  FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, coalesce(r.first <> k.doc_id, false) AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op2_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT item, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win
  FROM b),
q AS (SELECT DISTINCT item, least(n, 10) AS n, win FROM bw),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
h AS (
  SELECT p.doc_id, p.pos, q.n, q.item
  FROM (SELECT DISTINCT n FROM q) s JOIN p ON p.pos + s.n - 1 <= len(p.w)
  JOIN q ON q.n = s.n AND q.win = array_to_string(p.w[p.pos:p.pos + s.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT hit_pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS hit_pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op5_secret_scan": _secret_sql(),
    "op9_url_filter": _list_sql(),
    "op10_license_scan": _license_sql(),
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same, list_sum(list_transform(range(1, len(v.x) + 1), lambda k: a.x[k] * v.x[k]))::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS positive, p.score AS positive_score, s.b AS negative, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, positive AS positive_id, rank, negative AS negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
