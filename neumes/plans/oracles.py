"""The queries of ``queries`` in DuckDB's SQL."""

from . import sql

_EVENTS = """
s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY user_id),
u AS (SELECT a.user_id, a.types AS pred, b.types AS truth FROM s a JOIN s b ON b.user_id = a.user_id + 1)"""

_LETTERS = "array_to_string(list_transform({}, lambda x: x[1]), '')"
_DIST = f"levenshtein({_LETTERS.format('pred')}, {_LETTERS.format('truth')})"

_SPANS = """
c AS (
  SELECT user_id, event_type, round(value * 100) AS d,
         sum((event_type <> 'view')::INT) OVER w AS span_no, coalesce(sum(round(value * 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
sp AS (
  SELECT user_id, span_no, max(event_type) FILTER (event_type <> 'view') AS label, min(start) AS start_beat, sum(d) AS duration
  FROM c WHERE span_no > 0 GROUP BY user_id, span_no),
sq AS (SELECT user_id - 1 AS user_id, span_no, label, start_beat, duration FROM sp)"""

_OVERLAP = "least(a.start_beat + a.duration, b.start_beat + b.duration) - greatest(a.start_beat, b.start_beat)"
_MEET = "a.user_id = b.user_id AND a.start_beat < b.start_beat + b.duration AND b.start_beat < a.start_beat + a.duration"

_NEAR = """
o AS (
  SELECT *, event_type = 'error' AS b, coalesce(sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
  FROM events),
n AS (
  SELECT *, coalesce(least(n - last_value(CASE WHEN b THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                           first_value(CASE WHEN b THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - n - 1), 1000000000) AS distance
  FROM o)"""

_POOL = """
pool AS (
  SELECT a.s_suppkey, count(*) AS pool FROM supplier a JOIN supplier b
  ON abs(b.s_acctbal - a.s_acctbal) <= 0.15 * greatest(a.s_acctbal, 1.0) GROUP BY a.s_suppkey)"""

_PAGES = """
r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
pg AS (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS page_max FROM r)"""

_HALVES = """
h AS (
  SELECT o_orderpriority, o_custkey, max(o_totalprice) FILTER (o_orderkey % 2 = 0) AS base, max(o_totalprice) FILTER (o_orderkey % 2 = 1) AS other
  FROM orders GROUP BY ALL),
d AS (SELECT *, base - other AS d FROM h WHERE base IS NOT NULL AND other IS NOT NULL)"""

_RANKS = """
k AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY abs(d)) + (count(*) OVER (PARTITION BY o_orderpriority, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)"""

_WORDS = "string_split_regex(text, '[ \\n]+')"

_STATE = """
e AS (SELECT user_id::VARCHAR AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, round(value, 2) AS v FROM events),
m AS (
  SELECT run_id, 0::BIGINT AS epoch, NULL::DOUBLE AS v, {first}::BIGINT AS stage, 0::BIGINT AS below, 1e308::DOUBLE AS best, {final} AS at_final, 0::BIGINT AS no_improve, false AS stop FROM e WHERE epoch = 1
  UNION ALL
  SELECT e.run_id, e.epoch, e.v,
    CASE WHEN m.stop OR m.at_final OR e.v >= {threshold} OR e.v < m.best OR m.below + 1 < {patience} THEN m.stage ELSE least(m.stage + 1, {stages}) END,
    CASE WHEN m.stop OR m.at_final THEN m.below WHEN e.v >= {threshold} OR e.v < m.best OR m.below + 1 >= {patience} THEN 0 ELSE m.below + 1 END,
    CASE WHEN m.stop THEN m.best WHEN m.at_final THEN least(e.v, m.best) WHEN e.v >= {threshold} THEN m.best WHEN e.v < m.best THEN e.v WHEN m.below + 1 < {patience} THEN m.best WHEN m.stage + 1 >= {stages} THEN e.v ELSE 1e308 END,
    m.at_final OR (NOT m.stop AND e.v < {threshold} AND e.v >= m.best AND m.below + 1 >= {patience} AND m.stage + 1 >= {stages}),
    CASE WHEN m.stop OR NOT m.at_final THEN m.no_improve WHEN e.v < m.best THEN 0 ELSE m.no_improve + 1 END,
    m.stop OR (m.at_final AND e.v >= m.best AND m.no_improve + 1 >= {patience2})
  FROM m JOIN e ON e.run_id = m.run_id AND e.epoch = m.epoch + 1)"""

def _significance() -> str:
    """One-sided p-values: by all sign patterns up to 50 pairs without ties, else by the normal limit."""
    z = "(w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)"
    return f"""
WITH {_HALVES}, {_RANKS},
k2 AS (SELECT o_orderpriority, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus FROM k GROUP BY 1),
te AS (SELECT o_orderpriority, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT o_orderpriority, abs(d) AS a, count(*) AS c FROM d WHERE d <> 0 GROUP BY ALL) GROUP BY 1),
st AS (SELECT o_orderpriority AS metric, count(*) AS n, count_if(d > 0)::BIGINT AS wins, count_if(d = 0)::BIGINT AS ties, count_if(d < 0)::BIGINT AS losses FROM d GROUP BY 1),
pv AS (SELECT o_orderpriority AS metric, CASE WHEN n <= 50 AND ties = 0 THEN {sql.signed_rank_tail('n', 'w_plus')} ELSE {sql.normal_tail(z)} END AS p_raw FROM k2 JOIN te USING (o_orderpriority)),
i AS (SELECT *, row_number() OVER (ORDER BY p_raw, metric) AS i, count(*) OVER () AS m FROM st JOIN pv USING (metric)),
a AS (SELECT *, least(1.0, max(p_raw * (m - i + 1)) OVER (ORDER BY p_raw, metric ROWS UNBOUNDED PRECEDING)) AS p_adj FROM i)
SELECT metric, 'other' AS model, n, wins, ties, losses, round(p_raw, 6)::DOUBLE AS p_raw, round(p_adj, 6)::DOUBLE AS p_adj, CASE WHEN p_adj < .001 THEN '***' WHEN p_adj < .01 THEN '**' WHEN p_adj < .05 THEN '*' ELSE '' END AS sig FROM a"""


ORACLES = {
    "scan_project_filter": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'",
    "char_error_rate": f"""
SELECT doc_id, (len({sql.characters("coalesce(text, '')")}) - len({sql.characters("replace(coalesce(text, ''), 'th', 't')")}))::BIGINT AS errors,
       len({sql.characters("coalesce(text, '')")})::BIGINT AS symbols FROM documents""",
    "line_error_rate": f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, ls, string_split(coalesce(array_to_string(list_filter(ls, lambda x: NOT starts_with(x, 'The')), chr(10)), ''), chr(10)) AS ks FROM l),
c AS (SELECT *, {sql.common('ks', 'ls')} AS cs FROM k)
SELECT doc_id, {sql.distance('ks', 'ls', 'cs')}::BIGINT AS errors, len(ls)::BIGINT AS lines FROM c""",
    "symbol_error_rate": f"""
WITH w AS (SELECT item_id, {sql.symbols('text')} AS w FROM benchmark),
k AS (SELECT *, list_filter(w, lambda x, i: i % 7 <> 0) AS p FROM w),
c AS (SELECT *, {sql.common('p', 'w')} AS cs FROM k)
SELECT item_id, {sql.distance('p', 'w', 'cs')}::BIGINT AS errors, len(w)::BIGINT AS symbols FROM c""",
    "sequence_edit_distance": f"WITH {_EVENTS} SELECT user_id, {_DIST}::BIGINT AS distance, len(truth)::BIGINT AS length FROM u",
    "sequence_error_rate": f"""
WITH {_EVENTS}, d AS (SELECT user_id % 5 AS bucket, {_DIST} AS d, len(truth) AS n FROM u)
SELECT bucket, round(100.0 * sum(d) / sum(n), 6)::DOUBLE AS ser, round(100.0 * count_if(d > 0) / count(*), 6)::DOUBLE AS seq_er FROM d GROUP BY bucket""",
    "micro_macro_rates": f"""
WITH {_EVENTS}, d AS (SELECT user_id % 5 AS bucket, {_DIST} AS d, len(truth) AS n FROM u)
SELECT bucket, count(*) AS units, round(100.0 * sum(d) / sum(n), 6)::DOUBLE AS ser_micro, round(avg(100.0::DOUBLE * d / n), 6) AS ser_macro FROM d GROUP BY bucket""",
    "spine_extract": "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderpriority AS token FROM orders",
    "line_classify_filter": """
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '**') THEN 'header' WHEN starts_with(line, '*') THEN 'interpretation' WHEN starts_with(line, '=') THEN 'bar' WHEN starts_with(line, '!') THEN 'comment' ELSE 'data' END AS kind,
       count(*) AS lines, sum(length(line))::BIGINT AS characters FROM l GROUP BY kind""",
    "block_split": """
WITH b AS (SELECT conv_id, turn, sum((coalesce(role, '') = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS block_no FROM conversations)
SELECT conv_id, block_no, count(*) AS turns, min(turn) AS first_turn FROM b GROUP BY conv_id, block_no""",
    "vocab_build": f"WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS token FROM benchmark) SELECT token, row_number() OVER (ORDER BY token) AS id FROM w UNION ALL SELECT '<pad>', 0",
    "vocab_encode_decode": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT unnest(w) AS token FROM b WHERE item_id % 2 = 0)),
x AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM b)
SELECT item_id, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(coalesce(v.token, '<pad>'), ' ' ORDER BY pos) AS decoded
FROM x LEFT JOIN v USING (token) GROUP BY item_id""",
    "tokenise_runs": "SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '([a-gA-G]+|[^a-gA-G])'), '|') AS tokens FROM part",
    "span_islands": f"WITH {_SPANS} SELECT user_id, span_no::BIGINT AS span_no, label, round(start_beat, 6)::DOUBLE AS start_beat, round(duration, 6)::DOUBLE AS duration FROM sp",
    "interval_overlap_match": f"""
WITH {_SPANS},
t AS (SELECT user_id, coalesce(sum(duration) FILTER (label <> 'error'), 0) AS total, count_if(label = 'error') AS excluded FROM sp GROUP BY user_id),
e AS (SELECT a.user_id, sum(CASE WHEN a.label = b.label THEN {_OVERLAP} ELSE 0 END) AS compared FROM sp a JOIN sq b ON {_MEET} WHERE a.label <> 'error' GROUP BY a.user_id)
SELECT user_id, round(coalesce(compared, 0), 6)::DOUBLE AS compared, round(total, 6)::DOUBLE AS total, excluded::BIGINT AS excluded,
       round(CASE WHEN total > 0 THEN 100.0 * coalesce(compared, 0) / total ELSE 0 END, 6)::DOUBLE AS csr
FROM t LEFT JOIN e USING (user_id)""",
    "max_overlap_hamming": f"""
WITH {_SPANS},
x AS (SELECT user_id, sum(duration - best) AS over, sum(duration) AS d1 FROM (SELECT a.user_id, a.span_no, max(a.duration) AS duration, max(CASE WHEN b.user_id IS NULL THEN 0 ELSE {_OVERLAP} END) AS best FROM sp a LEFT JOIN sq b ON {_MEET} GROUP BY ALL) GROUP BY user_id),
y AS (SELECT user_id, sum(duration - best) AS under, sum(duration) AS d2 FROM (SELECT a.user_id, a.span_no, max(a.duration) AS duration, max(CASE WHEN b.user_id IS NULL THEN 0 ELSE {_OVERLAP} END) AS best FROM sq a LEFT JOIN sp b ON {_MEET} GROUP BY ALL) GROUP BY user_id),
z AS (SELECT user_id, coalesce(over, 0) AS over, coalesce(under, 0) AS under, CASE WHEN coalesce(d1, 0) > 0 THEN d1 ELSE coalesce(d2, 0) END AS total FROM x FULL JOIN y USING (user_id))
SELECT user_id, round(over, 6)::DOUBLE AS over, round(under, 6)::DOUBLE AS under, round(CASE WHEN total > 0 THEN greatest(0, 1 - greatest(over, under) / total) * 100 ELSE 1 END, 6)::DOUBLE AS quality FROM z""",
    "bag_match": f"""
WITH {_EVENTS},
a AS (SELECT user_id, x, count(*) AS n FROM (SELECT user_id, unnest(pred) AS x FROM u) GROUP BY ALL),
b AS (SELECT user_id, x, count(*) AS n FROM (SELECT user_id, unnest(truth) AS x FROM u) GROUP BY ALL),
c AS (SELECT user_id, sum(least(a.n, b.n)) AS matches FROM a JOIN b USING (user_id, x) GROUP BY user_id)
SELECT user_id, coalesce(matches, 0)::BIGINT AS matches FROM u LEFT JOIN c USING (user_id)""",
    "position_match_prf": f"""
WITH {_EVENTS},
m AS (SELECT user_id, len(list_filter(range(1, least(len(pred), len(truth)) + 1), lambda i: pred[i] = truth[i])) AS m, len(pred) AS p, len(truth) AS t FROM u)
SELECT user_id, m::BIGINT AS matches, round(m::DOUBLE / p, 6) AS precision, round(m::DOUBLE / t, 6) AS recall, round(CASE WHEN m > 0 THEN 2.0::DOUBLE * m / (p + t) ELSE 0 END, 6) AS f1 FROM m""",
    "align_trace_counts": f"""
WITH {_EVENTS}, x AS (SELECT user_id, truth, {sql.alignment('pred', 'truth')} AS a FROM u)
SELECT user_id, {", ".join(f"{sql.counters('a', 'truth')[k]}::BIGINT AS {n}" for k, n in (("edit_distance", "edit_distance"), ("matches", "n_match"), ("substitutions", "n_substitute"), ("insertions", "n_insert"), ("deletions", "n_delete")))}, true AS sound FROM x""",
    "lcs_match": f"WITH {_EVENTS} SELECT user_id, {sql.common_subsequence('pred', 'truth')}::BIGINT AS matches FROM u",
    "windowed_match": f"WITH {_EVENTS} SELECT user_id, {sql.windowed('pred', 'truth')}::BIGINT AS matches FROM u",
    "significance_report": _significance(),
    "confusion_labels": f"""
WITH {_EVENTS}, st AS ({sql.steps('u', 'user_id')}),
c AS (SELECT 'types' AS level, truth[ti + 1] AS gt, CASE WHEN op = 'd' THEN '<DEL>' ELSE pred[pi + 1] END AS pred, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model FROM st WHERE op IN ('s', 'd')),
n AS (SELECT level, gt, pred, model, count(*) AS count FROM c GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY level, gt, pred) > 1 AS also_in_other_model FROM n""",
    "width_pairs": "SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON abs(b.s_acctbal - a.s_acctbal) <= 0.15 * greatest(a.s_acctbal, 1.0)",
    "boundary_distance": f"WITH {_NEAR} SELECT event_id, distance::BIGINT AS distance, n::BIGINT AS position FROM n WHERE NOT b",
    "distance_gradient": f"""
WITH {_NEAR} SELECT least(distance, 7)::BIGINT AS bucket, count(*) AS n, count_if(event_type = 'purchase')::BIGINT AS errors, round(100.0 * count_if(event_type = 'purchase') / count(*), 6)::DOUBLE AS error_rate FROM n WHERE NOT b GROUP BY 1""",
    "width_band_pool": f"WITH {_POOL} SELECT * FROM pool",
    "pool_stats": f"WITH {_POOL} SELECT min(pool)::BIGINT AS smallest, round(median(pool), 6)::DOUBLE AS median, round(avg(pool), 6)::DOUBLE AS mean, max(pool)::BIGINT AS largest, round(100.0 * count_if(pool < 5) / count(*), 6)::DOUBLE AS below FROM pool",
    "iou_dedup_pairs": """
WITH e AS (SELECT user_id, event_id, floor(epoch(ts)) / 60.0 AS low, floor(epoch(ts)) / 60.0 + 600 + value AS high FROM events),
j AS (SELECT a.user_id, a.event_id, b.event_id AS other, greatest(0, least(a.high, b.high) - greatest(a.low, b.low)) / (greatest(a.high, b.high) - least(a.low, b.low)) AS iou
      FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.low < b.high AND b.low < a.high)
SELECT user_id, event_id, other, round(iou, 6)::DOUBLE AS iou FROM j WHERE iou >= 0.3""",
    "gap_boundaries": """
WITH d AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS t FROM orders),
g AS (SELECT *, lag(t) OVER w + 1 AS b, t - (lag(t) OVER w + 1) AS up, lead(t) OVER w - (t + 1) AS down FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY t, o_orderkey)),
a AS (SELECT *, coalesce(avg(up) OVER (PARTITION BY o_custkey), 0.4) AS mean FROM g)
SELECT o_orderkey, CASE WHEN b IS NULL THEN greatest(0, t - trunc(0.75 * mean)) ELSE b + trunc(0.25 * up) END::BIGINT AS crop_top,
       CASE WHEN down IS NULL THEN least(1000000, t + 1 + trunc(0.25 * mean)) ELSE t + 1 + trunc(0.25 * down) END::BIGINT AS crop_bottom FROM a""",
    "prefix_fanout": """
WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem),
n AS (SELECT *, unnest(CASE WHEN l_orderkey % 10 = 0 THEN [total] ELSE range(place, least(total, 5) + 1) END) AS n FROM r)
SELECT l_orderkey, n::BIGINT AS n, count(*) AS lines, round(sum(l_quantity), 6)::DOUBLE AS quantity FROM n GROUP BY l_orderkey, n""",
    "ordered_concat": """
SELECT conv_id, md5(string_agg(concat_ws(': ', role, text), chr(10) || '!!linebreak:original' || chr(10) ORDER BY turn, concat_ws(': ', role, text))) AS text_md5, count(*) AS parts FROM conversations GROUP BY conv_id""",
    "stage_eligibility": f"""
WITH {_PAGES} SELECT stage::BIGINT AS stage, o_orderkey, n::BIGINT AS n FROM pg, (SELECT unnest([1, 2, 3, 9]) AS stage)
WHERE n = CASE WHEN stage >= 9 THEN page_max ELSE least(stage, page_max) END""",
    "replay_sample": """
WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_linenumber ORDER BY md5(l_orderkey || '-' || l_linenumber || ':42'), l_orderkey || '-' || l_linenumber) AS r, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber FROM r WHERE r <= greatest(1, round_even(n * 0.25, 0))""",
    "curriculum_epoch": f"""
WITH {_PAGES}, e AS (SELECT stage, o_orderkey FROM pg, (SELECT unnest([1, 2, 3]) AS stage) WHERE n = least(stage, page_max)),
again AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY md5(o_orderkey || ':7'), o_orderkey) AS r, count(*) OVER (PARTITION BY stage) AS n FROM e WHERE stage < 3)
SELECT stage::BIGINT AS stage, o_orderkey, 'current' AS origin FROM e WHERE stage = 3
UNION ALL SELECT stage, o_orderkey, 'replay' FROM again WHERE r <= greatest(1, round_even(n * 0.1, 0))""",
    "union_intersect_except": """
WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders)
SELECT 'union' AS op, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'intersect', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
    "left_anti_missing": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "left_join_metrics": "SELECT d.doc_id, n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "pivot_wide": """
WITH m AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY ALL),
w AS (SELECT user_id, """ + ", ".join(f"max(v) FILTER (event_type = '{x}') AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + """ FROM m GROUP BY user_id)
SELECT * FROM w WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL AND "view" IS NOT NULL""",
    "paired_stats": f"""
WITH {_HALVES} SELECT o_orderpriority, count(*) AS n, round(median(base), 2) AS base_median, round(median(other), 2) AS other_median, round(median(d), 2) AS median_diff, round(avg(d), 2) AS mean_diff,
  count_if(d > 0)::BIGINT AS wins, count_if(d = 0)::BIGINT AS ties, count_if(d < 0)::BIGINT AS losses FROM d GROUP BY o_orderpriority""",
    "holm_adjust": """
WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
p AS (SELECT c_nationkey, n / sum(n) OVER () / 10 AS p FROM n),
i AS (SELECT *, row_number() OVER (ORDER BY p, c_nationkey) AS i, count(*) OVER () AS m FROM p),
a AS (SELECT c_nationkey, p, least(1.0, max(p * (m - i + 1)) OVER (ORDER BY p, c_nationkey ROWS UNBOUNDED PRECEDING)) AS p_adj FROM i)
SELECT c_nationkey, round(p, 6)::DOUBLE AS p, round(p_adj, 6)::DOUBLE AS p_adj, CASE WHEN p_adj < .001 THEN '***' WHEN p_adj < .01 THEN '**' WHEN p_adj < .05 THEN '*' ELSE '' END AS sig FROM a""",
    "wilcoxon_rank_sum": f"""
WITH {_HALVES}, {_RANKS} SELECT o_orderpriority, count(*) AS n, round(coalesce(sum(r) FILTER (d > 0), 0), 6)::DOUBLE AS w_plus, round(coalesce(sum(r) FILTER (d < 0), 0), 6)::DOUBLE AS w_minus FROM k GROUP BY o_orderpriority""",
    "confusion_topk": """
WITH c AS (SELECT year(o_orderdate) AS year, o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY year ORDER BY count DESC, o_orderstatus, o_orderpriority) AS place FROM c QUALIFY place <= 3""",
    "outcome_categories": """
SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'both_correct' WHEN quality <> 1 AND toxic <> 1 THEN 'both_wrong' WHEN toxic = 1 THEN 'only_baseline_wrong' ELSE 'only_replay_wrong' END AS outcome, count(*) AS n FROM labels GROUP BY 1""",
    "bucket_mean_cap": """
WITH n AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1)
SELECT least(n, 6)::BIGINT AS bucket, count(*) AS units, round(avg(price), 2) AS mean_price FROM n GROUP BY 1""",
    "dataset_diff": """
WITH a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 11 <> 0),
b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 17 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 13 <> 0),
j AS (SELECT p_partkey, a.p_size AS s, b.p_size AS r FROM a FULL JOIN b USING (p_partkey))
SELECT p_partkey, CASE WHEN s IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' ELSE 'different' END AS status, CASE WHEN s <> r THEN 'p_size' ELSE '' END AS differing
FROM j WHERE s IS DISTINCT FROM r""",
    "best_worst_pages": """
WITH d AS (SELECT n::BIGINT AS nation, round(c - s, 4) AS delta FROM (SELECT c_nationkey AS n, avg(c_acctbal) AS c FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS n, avg(s_acctbal) AS s FROM supplier GROUP BY 1) USING (n))
SELECT * FROM (SELECT nation, delta, 'best' AS side FROM d ORDER BY delta DESC, nation LIMIT 5) UNION ALL SELECT * FROM (SELECT nation, delta, 'worst' FROM d ORDER BY delta, nation LIMIT 5)""",
    "stage_machine": f"""
WITH RECURSIVE {_STATE.format(first=1, final='false', threshold=60.0, patience=2, stages=4, patience2=3)}
SELECT run_id, epoch, stage, below, no_improve, round(CASE WHEN best < 1e300 THEN best END, 6) AS best, at_final, stop FROM m WHERE epoch > 0""",
    "early_stop": f"""
WITH RECURSIVE {_STATE.format(first=1, final='true', threshold=0.0, patience=3, stages=1, patience2=4)}
SELECT run_id, min(epoch) AS stopped_at, round(min(best), 6) AS best FROM m WHERE stop GROUP BY run_id""",
    "clipped_rates": "SELECT user_id, round(least(sum(value), 100.0), 6) AS rate FROM events GROUP BY user_id",
}
