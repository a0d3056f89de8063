"""DuckDB SQL for the queries of `roundtrips`."""

from __future__ import annotations

from arbiter.plans.oracles import _DOMAIN, _FIXED, ORACLES

_P = "'p' || p_partkey"
_MS = "epoch_ms(ts)"

ROUNDTRIP_ORACLES: dict[str, str] = {
    "read_documents": f"SELECT {_P} AS document_id, p_name AS title, p_type AS abstract, p_type || '|' || p_brand AS topics, p_brand AS keywords, CASE WHEN p_size % 4 <> 0 THEN p_size % 4 END::int AS required_experts, p_size::varchar AS size FROM part",
    "read_experts": """SELECT 's' || s_suppkey AS expert_id, s_name AS name, '' AS summary, s_name AS topics, 'a' || s_suppkey AS paper, '' AS abstract, (1990 + s_suppkey % 30)::int AS year, (s_suppkey % 4)::int AS capacity,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'n' || s_nationkey END AS institution, (s_suppkey % 5) / 4.0::double AS seniority, (s_suppkey % 3 - 1)::double AS bid FROM supplier""",
    "read_conflicts": "SELECT 'n' || s_nationkey AS document_id, 's' || s_suppkey AS expert_id, CASE WHEN s_suppkey % 2 = 0 THEN 'second' ELSE 'declared conflict' END AS conflict FROM supplier",
    "read_affinities": """SELECT d AS document_id, e AS expert_id, round(n / max(n) OVER (PARTITION BY d), 6) AS score
  FROM (SELECT c_mktsegment AS d, 'n' || c_nationkey AS e, count(*) AS n FROM customer GROUP BY ALL)""",
    "read_judgments": "SELECT DISTINCT coalesce(source, 'none') AS document_id, doc_id::varchar AS expert_id, (quality + 1 - toxic)::int AS relevance FROM labels JOIN documents USING (doc_id)",
    "read_triplets": """WITH d AS (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT a.p AS document_id, a.s AS positive_expert_id, b.s AS negative_expert_id FROM d a JOIN d b ON a.p = b.p AND a.s < b.s""",
    "read_vectors": "SELECT 'v' || vec_id AS paper_id, len(embedding)::bigint AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) AS total FROM embeddings",
    "read_notes": f"SELECT {_P} AS document_id, p_name AS title, p_type AS abstract, p_type || '|' || p_brand AS topics, p_brand AS keywords, p_brand AS forum FROM part",
    "read_snapshot": """WITH n AS (SELECT l_suppkey AS k, 'n' || l_partkey AS id, max(year(l_shipdate)) AS y FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY ALL)
SELECT '~s' || s_suppkey AS expert_id, any_value(s_name) AS name, 'bio of ' || any_value(s_name) AS summary, any_value(s_name) AS topics, count(id) AS n_publications, min(id) AS first_id, arg_min(y, id)::int AS first_year
FROM supplier LEFT JOIN n ON k = s_suppkey GROUP BY s_suppkey""",
    "read_reviewer_ids": "SELECT '~s' || s_suppkey AS expert_id, '~s' || s_suppkey AS name, 3::int AS capacity, 0.5::double AS seniority, 0::bigint AS n_publications FROM supplier",
    "projected_size": """SELECT sum(length('{"k":' || n_nationkey || ',"name":"' || n_name || '"}') + 1)::bigint AS n_bytes FROM nation""",
    "file_fingerprint": "SELECT sum(length(n_name) + 1)::bigint AS bytes, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation",
    "identifiers": "SELECT n_nationkey, f::int AS form, f IN (0, 6) AS ok FROM nation, range(8) r(f)",
    "safe_terms": r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+')) AS t FROM documents)
SELECT regexp_full_match(t, '[\p{L}\p{N}]{2,}') AND lower(t) = t AND NOT contains(t, 'ß') AND strlen(t) <= 128 AS safe, count(*) AS n FROM w WHERE t <> '' GROUP BY 1""",
    "evidence_names": f"""WITH {_DOMAIN}, o AS (SELECT *, row_number() OVER (PARTITION BY expert_id ORDER BY title) AS k FROM pb)
SELECT expert_id, k AS ord, 'publication:' || expert_id || CASE WHEN y % 2 = 0 THEN ':id:' || title ELSE ':position:' || k END AS evidence_id, true AS ok FROM o""",
    "reloaded_scores": ORACLES["bm25_max"],
    "ranked_scores": f"WITH {_FIXED} SELECT document_id, expert_id, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, expert_id) AS rank FROM pl",
    "admissible_pairs": f"WITH {_FIXED} SELECT document_id, expert_id FROM pl WHERE score >= 0.08 AND score < 0.9",
    "expert_places": "SELECT 's' || s_suppkey AS expert_id, row_number() OVER (ORDER BY 's' || s_suppkey) - 1 AS place FROM supplier",
}

_EVENTS = f"""k AS (SELECT DISTINCT event_type AS t FROM events ORDER BY t LIMIT 2),
b AS (SELECT min({_MS}) AS a, max({_MS}) AS z FROM events),
e AS (SELECT *, CASE event_id % 4 WHEN 0 THEN {_MS} WHEN 1 THEN {_MS} + 1 WHEN 2 THEN {_MS} + 2 END AS date, CASE WHEN event_id % 7 <> 0 THEN props ELSE '  ' END AS title FROM events),
r AS (SELECT e.*, CASE WHEN event_type NOT IN (SELECT t FROM k) THEN 'invitation' WHEN date IS NULL OR date < a + (z - a) // 4 OR date > z THEN 'date' WHEN trim(coalesce(title, '')) = '' THEN 'content' ELSE 'retained' END AS reason FROM e, b)"""
ROUNDTRIP_ORACLES["publication_reasons"] = f"WITH {_EVENTS} SELECT reason, count(*) AS n FROM r GROUP BY reason"
ROUNDTRIP_ORACLES["publications_retained"] = f"WITH {_EVENTS} SELECT 'u' || user_id AS expert_id, 'e' || event_id AS id, title, '' AS abstract, year(make_timestamp(date * 1000))::int AS year FROM r WHERE reason = 'retained'"

# Panels: 16 choices for each of 5 documents; an expert's load is a digit of base 8.
_PANEL = """
n AS (SELECT 'r' || n_regionkey AS d, c_mktsegment AS e, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
af AS (SELECT d, e, round(n / max(n) OVER (PARTITION BY d), 4) AS s FROM n),
ds AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT d FROM af)),
ex AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, CASE WHEN length(e) % 3 = 0 THEN 2 ELSE 3 END AS cap,
         CASE WHEN length(e) % 3 > 0 THEN 'i' WHEN e > 'H' THEN 'j' END AS inst, e < 'H' AS senior FROM (SELECT DISTINCT e FROM af)),
one AS (SELECT k, d, e, i, inst, senior, s, round(s * 1000000)::bigint AS f, 1::bigint << (3 * i)::int AS code FROM af JOIN ds USING (d) JOIN ex USING (e)),
ch AS (SELECT k, 0 AS n, 0::bigint AS f, 0::bigint AS code, true AS apart, 0 AS juniors FROM ds
  UNION ALL SELECT k, 1, f, code, true, (NOT senior)::int FROM one
  UNION ALL SELECT a.k, 2, a.f + b.f, a.code + b.code, coalesce(a.inst <> b.inst, true), (NOT a.senior)::int + (NOT b.senior)::int FROM one a JOIN one b ON a.k = b.k AND a.i < b.i)"""
_PLANS = """
pl AS (SELECT (a.n + b.n + c.n + g.n + h.n)::bigint AS assigned, (a.f + b.f + c.f + g.f + h.f)::bigint AS fixed_score, a.code + b.code + c.code + g.code + h.code AS code
  FROM {0} a, {0} b, {0} c, {0} g, {0} h WHERE a.k = 1 AND b.k = 2 AND c.k = 3 AND g.k = 4 AND h.k = 5),
fit AS (SELECT * FROM pl WHERE (code & 7) <= 3 AND ((code >> 3) & 7) <= 3 AND ((code >> 6) & 7) <= 2 AND ((code >> 9) & 7) <= 2 AND ((code >> 12) & 7) <= 2)"""


def _best(rule: str) -> str:
    return f"WITH {_PANEL}, mine AS (SELECT * FROM ch WHERE {rule}), {_PLANS.format('mine')} SELECT assigned, fixed_score FROM fit ORDER BY assigned DESC, fixed_score DESC LIMIT 1"


ROUNDTRIP_ORACLES["objective_diverse"] = _best("apart")
ROUNDTRIP_ORACLES["objective_senior"] = _best("juniors <= 1")
_LOADS = " + ".join(f"((code >> {3 * k}) & 7) * (((code >> {3 * k}) & 7) - 1)" for k in range(5))
ROUNDTRIP_ORACLES["objective_balanced"] = f"""WITH {_PANEL}, {_PLANS.format('ch')}
SELECT assigned, (fixed_score - 100000 * ({_LOADS}) // 2)::bigint AS penalised FROM fit ORDER BY assigned DESC, penalised DESC LIMIT 1"""

# Step t is round t // 5 of document t % 5: the best expert with room that it doesn't have yet, by score less 0.1 for each document it has.
_GREEDY = f"""WITH RECURSIVE {_PANEL},
tab AS (SELECT list({{'k': k, 'd': d, 'e': e, 'i': i, 's': s, 'code': code, 'cap': cap}} ORDER BY e) AS l FROM one JOIN (SELECT e, cap FROM ex) USING (e)),
g AS (SELECT 0 AS t, 0::bigint AS code, [0::bigint, 0, 0, 0, 0] AS had, NULL::varchar AS d, NULL::varchar AS e, NULL::double AS s
  UNION ALL
  SELECT t + 1, code + coalesce(b.code, 0), list_transform(had, lambda x, j: x + CASE WHEN j = t % 5 + 1 THEN coalesce(b.code, 0) ELSE 0 END), b.d, b.e, b.s
  FROM (SELECT g.*, list_sort(list_transform(list_filter(l, lambda x: x.k = t % 5 + 1 AND ((g.code >> (3 * x.i)::int) & 7) < x.cap AND ((had[(t % 5 + 1)::int] >> (3 * x.i)::int) & 7) = 0),
          lambda x: {{'v': -round(x.s - 0.1::double * ((g.code >> (3 * x.i)::int) & 7), 9), 'e': x.e, 'd': x.d, 's': x.s, 'code': x.code}}))[1] AS b FROM g, tab WHERE t < 10))"""
ROUNDTRIP_ORACLES["greedy_plan"] = f"{_GREEDY} SELECT d AS document_id, e AS expert_id, s AS score FROM g WHERE e IS NOT NULL"
ROUNDTRIP_ORACLES["plan_ranks"] = f"{_GREEDY} SELECT ds.d AS document_id, string_agg(e, ',' ORDER BY s DESC, e) AS by_rank, 2 - count(e) AS unmet FROM ds LEFT JOIN g ON g.d = ds.d AND e IS NOT NULL GROUP BY ds.d"

_CAPS = "(code & 7) <= {0} AND ((code >> 3) & 7) <= {1} AND ((code >> 6) & 7) <= 2 AND ((code >> 9) & 7) <= 2 AND ((code >> 12) & 7) <= {2}"
ROUNDTRIP_ORACLES["whatif_panels"] = f"""WITH {_PANEL}, {_PLANS.format('ch')},
ok AS (SELECT * FROM ch WHERE NOT (k <= 2 AND (code & 7) > 0)), {_PLANS.format('ok').replace('pl AS', 'pl2 AS').replace('fit AS', 'fit2 AS').replace('FROM pl WHERE', 'FROM pl2 WHERE')},
b AS (SELECT assigned, fixed_score FROM fit ORDER BY ALL DESC LIMIT 1),
r AS (SELECT 'fewer' AS scenario, x.* FROM (SELECT assigned, fixed_score FROM pl WHERE {_CAPS.format(3, 0, 1)} ORDER BY ALL DESC LIMIT 1) x
  UNION ALL SELECT 'conflict', x.* FROM (SELECT assigned, fixed_score FROM fit2 ORDER BY ALL DESC LIMIT 1) x)
SELECT scenario, r.assigned - b.assigned AS assigned, b.assigned - r.assigned AS unmet, round((r.fixed_score - b.fixed_score) / 1000000.0::double, 4) AS total_score FROM r, b"""
ROUNDTRIP_ORACLES["centroid_holdout"] = f"""WITH {_DOMAIN},
t AS (SELECT DISTINCT p_brand AS b, list_sum(list_transform(string_split(regexp_replace(p_brand, '[^0-9]', '', 'g'), ''), lambda c: c::int))::int AS s FROM part),
v AS (SELECT b, [((s * 2) % 7 - 3) / 3.0::double, ((s * 3) % 7 - 3) / 3.0::double, ((s * 4) % 7 - 3) / 3.0::double] AS v FROM t),
cd AS (SELECT document_id, avg(v[1]) AS x, avg(v[2]) AS y, avg(v[3]) AS z FROM (SELECT document_id, unnest(keywords) AS b FROM d) JOIN v USING (b) GROUP BY document_id),
ce AS (SELECT expert_id, avg(v[1]) AS x, avg(v[2]) AS y, avg(v[3]) AS z FROM (SELECT expert_id, unnest(keywords) AS b FROM e) JOIN v USING (b) GROUP BY expert_id)
SELECT document_id, expert_id, round(1 / (1 + exp(-(cd.x * ce.x + cd.y * ce.y + cd.z * ce.z))), 6) AS score FROM cd, ce"""
ROUNDTRIP_ORACLES["streamed_affinities"] = ORACLES["emitted_affinities"]
