"""DuckDB SQL for the registered queries. Lambdas, unnest and one backslash are DuckDB's; the meaning is the operators'."""

from __future__ import annotations

from arbiter.functions.text import STOPWORDS
from arbiter.plans.queries import DIAGNOSED

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_FOLD = "replace(lower({0}), 'ß', 'ss')"


def _tokens(text: str, fold_first: bool = False) -> str:
    found = f"regexp_extract_all({_FOLD.format(text)}, '[\\p{{L}}\\p{{N}}]+')" if fold_first else f"list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda x: {_FOLD.format('x')})"
    return f"list_filter({found}, lambda x: length(x) > 1 AND x NOT IN ({_STOP}))"


ORACLES: dict[str, str] = {}

ORACLES["token_counts"] = f"""
SELECT doc_id, len({_tokens("coalesce(text, '')", True)})::bigint AS n_fold_first, len({_tokens("coalesce(text, '')")})::bigint AS n_split_first,
       len(list_distinct({_tokens("coalesce(text, '')", True)}))::bigint AS n_terms FROM documents
"""


def _index(aggregation: str) -> str:
    unit = "expert_id" if aggregation == "aggregate" else "evidence_id"
    name = "'aggregate:' || min(expert_id)" if aggregation == "aggregate" else "min(evidence_id)"
    return f"""
ev AS (SELECT * FROM (SELECT coalesce(source, 'none') AS expert_id, 'd' || doc_id AS evidence_id, doc_id AS ord, {_tokens("coalesce(text, '')")} AS tokens FROM documents) WHERE len(tokens) > 0),
rv AS (SELECT DISTINCT coalesce(source, 'none') AS expert_id FROM documents),
q AS (SELECT 'b' || item_id AS document_id, {_tokens("coalesce(text, '')")} AS tokens FROM benchmark),
qt AS (SELECT document_id, term, count(*) AS tf FROM (SELECT document_id, unnest(tokens) AS term FROM q) GROUP BY ALL),
un AS (SELECT {unit} AS u, min(expert_id) AS expert_id, {name} AS evidence_id, min(ord) AS ord, sum(len(tokens)) AS len, count(*) AS items FROM ev GROUP BY {unit}),
po AS (SELECT u, term, count(*) AS tf FROM (SELECT {unit} AS u, unnest(tokens) AS term FROM ev) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM un)"""


def _values(model: str) -> str:
    if model == "bm25":
        return """
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM po, st GROUP BY term),
va AS (SELECT document_id, u, term, idf * (p.tf * 2.2::double) / (p.tf + 1.2::double * (0.25::double + 0.75::double * len / avgdl)) AS value
       FROM qt JOIN po p USING (term) JOIN idf USING (term) JOIN un USING (u), st)"""
    return """
idf AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM po, st GROUP BY term),
qw AS (SELECT document_id, term, (1 + ln(tf)) * idf AS w FROM qt JOIN idf USING (term)),
pw AS (SELECT u, term, (1 + ln(tf)) * idf AS w FROM po JOIN idf USING (term)),
qn AS (SELECT document_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY document_id),
pn AS (SELECT u, sqrt(sum(w * w)) AS n FROM pw GROUP BY u),
va AS (SELECT document_id, u, term, (qw.w / qn.n) * (pw.w / pn.n) AS value FROM qw JOIN qn USING (document_id) JOIN pw USING (term) JOIN pn USING (u))"""


def _expertise(model: str, aggregation: str) -> str:
    score = "raw_score" if model == "tfidf" else "raw_score / (1 + raw_score)"
    if aggregation == "average":
        best = "be AS (SELECT document_id, expert_id, sum(raw) AS total, NULL::varchar AS evidence_id FROM ra JOIN un USING (u) GROUP BY document_id, expert_id)"
        raw, selected = "coalesce(total, 0) / greatest(items, 1)", "NULL::varchar"
    else:
        best = """be AS (SELECT document_id, expert_id, raw AS total, evidence_id FROM (
          SELECT *, row_number() OVER (PARTITION BY document_id, expert_id ORDER BY round(raw, 12) DESC, ord) AS k FROM ra JOIN un USING (u)) WHERE k = 1)"""
        raw, selected = "coalesce(total, 0)", "coalesce(be.evidence_id, first_id)"
    return f"""WITH {_index(aggregation)}, {_values(model)},
ra AS (SELECT document_id, u, sum(value) AS raw FROM va GROUP BY document_id, u), {best},
ct AS (SELECT expert_id, sum(items)::bigint AS items, arg_min(evidence_id, ord) AS first_id FROM un GROUP BY expert_id),
sp AS (SELECT document_id, rv.expert_id, coalesce(items, 0) AS items, first_id FROM q, rv LEFT JOIN ct USING (expert_id)),
r AS (SELECT document_id, expert_id, {raw} AS raw_score, items AS evidence_count, {selected} AS selected_evidence_id FROM sp LEFT JOIN be USING (document_id, expert_id))
SELECT document_id, expert_id, round(least(1, greatest(0, {score})), 6) AS score, round(raw_score, 6) AS raw_score, evidence_count::bigint AS evidence_count, selected_evidence_id FROM r"""


for _m in ("tfidf", "bm25"):
    for _a in ("aggregate", "max", "average"):
        ORACLES[f"{_m}_{_a}"] = _expertise(_m, _a)
ORACLES["idf_table"] = f"WITH {_index('max')}, {_values('bm25')} SELECT term, df, round(idf, 6) AS idf FROM idf"
ORACLES["emitted_affinities"] = f"SELECT document_id, expert_id, score FROM ({_expertise('bm25', 'max')}) WHERE raw_score / (1 + raw_score) >= 0.5"
ORACLES["term_contributions"] = f"""WITH {_index("average")}, {_values("tfidf")},
ct AS (SELECT expert_id, sum(items) AS items FROM un GROUP BY expert_id)
SELECT document_id, expert_id, term, round(sum(value) / any_value(ct.items), 6) AS value FROM va JOIN un USING (u) JOIN ct USING (expert_id) GROUP BY document_id, expert_id, term"""

# The trade domain -------------------------------------------------------------


def _above(key: str, label: str) -> str:
    return f"""(WITH s AS (SELECT {key}, {label} AS l, sum(l_quantity) AS q FROM lines GROUP BY ALL), m AS (SELECT {key}, sum(q) / count(*) AS mean FROM s GROUP BY {key})
      SELECT {key}, list(l ORDER BY l) AS v FROM s JOIN m USING ({key}) WHERE q > mean GROUP BY {key})"""


_LINES = """
lines AS (SELECT 's' || l_suppkey AS expert_id, 'n' || c_nationkey AS document_id, p_type, p_brand, l_quantity, l_returnflag, year(l_shipdate) AS y
          FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
cf AS (SELECT 'n' || s_nationkey AS document_id, 's' || s_suppkey AS expert_id FROM supplier)"""

_DOMAIN = f"""{_LINES},
d AS (SELECT 'n' || n_nationkey AS document_id, n_name AS title, r_name AS abstract, coalesce(t.v, []) AS topics, coalesce(b.v, []) AS keywords, 1 + n_nationkey % 2 AS demand
      FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN {_above("document_id", "p_type")} t ON t.document_id = 'n' || n_nationkey
      LEFT JOIN {_above("document_id", "p_brand")} b ON b.document_id = 'n' || n_nationkey),
pb AS (SELECT expert_id, p_brand AS title, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS abstract, max(y) AS y FROM lines GROUP BY ALL),
pp AS (SELECT expert_id, string_agg(title || ' ' || abstract, ' ' ORDER BY title) AS text, avg(pow(0.5, greatest(0, 2002 - y) / 6.0)) AS recency FROM pb GROUP BY expert_id),
e AS (SELECT 's' || s_suppkey AS expert_id, s_name || ' ' || n_name AS summary, s_suppkey % 4 AS capacity, CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS institution,
        coalesce((s_acctbal - min(s_acctbal) OVER ()) / nullif(max(s_acctbal) OVER () - min(s_acctbal) OVER (), 0), 0.5) AS seniority,
        coalesce(t.v, []) AS topics, coalesce(b.v, []) AS keywords, coalesce(pp.text, '') AS papers, coalesce(recency, 0) AS recency
      FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN {_above("expert_id", "p_type")} t ON t.expert_id = 's' || s_suppkey
      LEFT JOIN {_above("expert_id", "p_brand")} b ON b.expert_id = 's' || s_suppkey LEFT JOIN pp ON pp.expert_id = 's' || s_suppkey),
bd AS (SELECT expert_id, document_id, 1 - 2 * avg((l_returnflag = 'R')::int::double) AS raw FROM lines GROUP BY ALL)"""

_PAIRS = f"""{_DOMAIN},
tx AS (SELECT 'd' AS side, document_id AS id, concat_ws(' ', title, abstract, array_to_string(topics, ' '), array_to_string(keywords, ' ')) AS t FROM d
       UNION ALL SELECT 'e', expert_id, concat_ws(' ', summary, array_to_string(topics, ' '), array_to_string(keywords, ' '), papers) FROM e),
tf AS (SELECT side, id, term, count(*) AS tf FROM (SELECT side, id, unnest({_tokens("t", True)}) AS term FROM tx) GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM tx),
idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, nn GROUP BY term),
w AS (SELECT side, id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
nm AS (SELECT side, id, sqrt(sum(w * w)) AS n FROM w GROUP BY side, id),
u AS (SELECT w.side, w.id, term, w / n AS w FROM w JOIN nm USING (side, id)),
ct AS (SELECT a.id AS document_id, b.id AS expert_id, least(1, greatest(0, sum(a.w * b.w))) AS content FROM u a JOIN u b ON a.term = b.term AND a.side = 'd' AND b.side = 'e' GROUP BY ALL),
lb AS (SELECT *, list_distinct(list_transform(list_concat(topics, keywords), lambda x: lower(x))) AS labels, list_transform(topics, lambda x: lower(x)) AS lt FROM d),
le AS (SELECT *, list_distinct(list_transform(list_concat(topics, keywords), lambda x: lower(x))) AS labels, list_transform(topics, lambda x: lower(x)) AS lt FROM e),
pr AS (SELECT lb.document_id, le.expert_id, coalesce(content, 0) AS content, recency, seniority, coalesce(raw, 0) AS raw, (coalesce(raw, 0) + 1) / 2 AS bid,
         coalesce(len(list_intersect(lb.labels, le.labels)) / nullif(len(list_distinct(list_concat(lb.labels, le.labels))), 0), 0) AS topics,
         list_sort(list_intersect(lb.lt, le.lt))[1:4] AS shared,
         CASE WHEN cf.expert_id IS NOT NULL THEN 'excluded: same nation' WHEN capacity = 0 THEN 'excluded: zero capacity' END AS excluded
       FROM lb CROSS JOIN le LEFT JOIN ct USING (document_id, expert_id) LEFT JOIN bd USING (document_id, expert_id) LEFT JOIN cf USING (document_id, expert_id)),
sc AS (SELECT document_id, expert_id, CASE WHEN excluded IS NULL THEN content * 0.5::double + topics * 0.2::double + bid * 0.15::double + recency * 0.1::double + seniority * 0.05::double ELSE 0 END AS total, * EXCLUDE (document_id, expert_id) FROM pr)"""


def _kept(c: str) -> str:
    return f"round(CASE WHEN excluded IS NULL THEN {c} ELSE 0 END, 6) AS {c}"


ORACLES["pair_scores"] = f"""WITH {_PAIRS}
SELECT document_id, expert_id, round(total, 6) AS total, {", ".join(map(_kept, ("content", "topics", "bid", "recency")))}, round(seniority, 6) AS seniority, excluded IS NULL AS eligible,
  CASE WHEN excluded IS NOT NULL THEN excluded ELSE coalesce(nullif(concat_ws('; ', CASE WHEN len(shared) > 0 THEN 'shared topics: ' || array_to_string(shared, ', ') END,
    CASE WHEN raw > 0 THEN 'positive preference (' || printf('%.2f', raw) || ')' WHEN raw < 0 THEN 'negative preference (' || printf('%.2f', raw) || ')' END,
    CASE WHEN content >= 0.5 THEN 'strong text similarity (' || printf('%.2f', content) || ')' END), ''), 'eligible with limited direct evidence') END AS reasons FROM sc"""
ORACLES["candidate_pair_scores"] = f"""WITH {_PAIRS}
SELECT document_id, expert_id, round(total, 6) AS total, excluded IS NULL AS eligible FROM sc SEMI JOIN (
  SELECT document_id, expert_id FROM ct UNION SELECT document_id, expert_id FROM bd UNION SELECT document_id, expert_id FROM cf
  UNION SELECT document_id, expert_id FROM lb, le WHERE len(list_intersect(lb.labels, le.labels)) > 0) c USING (document_id, expert_id)"""
ORACLES["expert_recency"] = f"WITH {_DOMAIN} SELECT expert_id, round(recency, 6) AS recency FROM e"
ORACLES["evidence_filters"] = f"""WITH {_DOMAIN}, p AS (SELECT y, 1 AS copy FROM pb UNION ALL SELECT y, 2 FROM pb)
SELECT CASE WHEN copy = 2 THEN 'duplicate_publications' WHEN y < 1999 OR y > 2001 THEN 'date_or_content_filtered_publications' ELSE 'retained' END AS reason, count(*) AS n FROM p GROUP BY reason"""
ORACLES["clean_label_lists"] = "SELECT p_partkey, p_type || '|' || p_brand AS labels FROM part"

# Objectives by enumeration ------------------------------------------------------

_ENUMERATED = """
o AS (SELECT o_orderpriority AS d, o_orderstatus AS e, count(*) AS n FROM orders GROUP BY ALL),
af AS (SELECT d, e, n / sum(n) OVER (PARTITION BY d) AS score FROM o),
ds AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT d FROM af)),
ch AS (SELECT k, e, score FROM af JOIN ds USING (d) UNION ALL SELECT k, NULL, 0 FROM ds),
al AS (SELECT [a.e, b.e, c.e, f.e, g.e] AS es, [a.score, b.score, c.score, f.score, g.score] AS ss FROM ch a, ch b, ch c, ch f, ch g WHERE a.k = 1 AND b.k = 2 AND c.k = 3 AND f.k = 4 AND g.k = 5),
ld AS (SELECT *, len(list_filter(es, lambda x: x IS NOT NULL)) AS assigned, coalesce(list_max(list_transform(list_distinct(es), lambda x: len(list_filter(es, lambda y: y = x)))), 0) AS highest_load FROM al),
ok AS (SELECT assigned::bigint AS assigned, highest_load::bigint AS highest_load, round(list_min(ss), 6) AS weakest_document,
         round(list_min(list_filter(ss, lambda x: x > 0)), 6) AS lowest_score, list_sum(list_transform(ss, lambda x: round(x * 1000000)))::bigint AS fixed_score FROM ld WHERE highest_load <= 2)"""

_ORDERS = {
    "optimal": ("assigned, fixed_score", "assigned DESC, fixed_score DESC"),
    "minmax": ("assigned, highest_load, fixed_score", "assigned DESC, highest_load, fixed_score DESC"),
    "maximin": ("assigned, weakest_document", "assigned DESC, weakest_document DESC"),
    "maximin_flow": ("assigned, lowest_score, fixed_score", "assigned DESC, lowest_score DESC, fixed_score DESC"),
}
for _s, (_columns, _order) in _ORDERS.items():
    ORACLES[f"objective_{_s}"] = f"WITH {_ENUMERATED} SELECT {_columns} FROM ok ORDER BY {_order} LIMIT 1"

# Audit and diagnostics on the fixed plan ------------------------------------------

_FIXED = f"""{_DOMAIN},
tr AS (SELECT expert_id, document_id, sum(l_quantity) AS q FROM lines GROUP BY ALL),
tt AS (SELECT expert_id, sum(q) AS t FROM tr GROUP BY expert_id),
pl AS (SELECT expert_id, document_id, q / t AS score FROM (SELECT *, row_number() OVER (PARTITION BY expert_id ORDER BY q DESC, document_id DESC) AS k FROM tr) JOIN tt USING (expert_id) WHERE k = 1),
wl AS (SELECT e.expert_id, capacity, count(pl.document_id) AS load FROM e LEFT JOIN pl USING (expert_id) GROUP BY ALL),
cv AS (SELECT d.document_id, demand, count(pl.expert_id) AS got FROM d LEFT JOIN pl USING (document_id) GROUP BY ALL),
vi AS (SELECT 'conflict_violations' AS kind, document_id, expert_id, NULL::varchar AS institution FROM pl SEMI JOIN cf USING (document_id, expert_id)
       UNION ALL SELECT 'capacity_violations', NULL, expert_id, NULL FROM wl WHERE load > capacity
       UNION ALL SELECT 'demand_violations', document_id, NULL, NULL FROM cv WHERE got > demand
       UNION ALL SELECT 'institution_duplicates', document_id, NULL, institution FROM pl JOIN e USING (expert_id) WHERE institution IS NOT NULL GROUP BY document_id, institution HAVING count(*) > 1)"""

ORACLES["workload"] = f"WITH {_FIXED} SELECT expert_id, capacity::int AS capacity, load FROM wl"
ORACLES["audit_violations"] = f"WITH {_FIXED} SELECT * FROM vi"
_KINDS = ("unknown_documents", "unknown_experts", "duplicate_assignments", "conflict_violations", "capacity_violations", "demand_violations", "institution_duplicates")
ORACLES["audit_summary"] = f"""WITH {_FIXED},
g AS (SELECT load, row_number() OVER (ORDER BY load) AS i, count(*) OVER () AS n FROM wl)
SELECT (SELECT round(avg((got > 0)::int), 6) FROM cv) AS document_coverage, (SELECT round(sum(least(got, demand)) / sum(demand), 6) FROM cv) AS demand_coverage,
  (SELECT round(avg(score), 6) FROM pl) AS average_score, (SELECT round(min(score), 6) FROM pl) AS minimum_score,
  (SELECT round(coalesce((2 * sum(i * load) - (any_value(n) + 1) * sum(load)) / nullif(any_value(n) * sum(load), 0), 0), 6) FROM g) AS workload_gini,
  {", ".join(f"(SELECT count(*) FROM vi WHERE kind = '{k}') AS {k}" for k in _KINDS)},
  (SELECT count(*) FROM vi WHERE kind <> 'institution_duplicates') = 0 AS safe"""
ORACLES["publish_edges"] = f"WITH {_FIXED} SELECT i AS invitation, document_id AS head, expert_id AS tail, 'batch-1' AS label, round(score, 6) AS weight FROM pl, (VALUES ('venue/assignment'), ('venue/score')) v(i)"

_MINIMUM = DIAGNOSED.minimum_score
ORACLES["shortage_diagnostics"] = f"""WITH {_FIXED},
ch AS (SELECT document_id, expert_id, score FROM (SELECT pl.*, demand, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, expert_id) AS rank FROM pl JOIN d USING (document_id)) WHERE rank < demand),
en AS (SELECT *, coalesce('i:' || institution, 'e:' || expert_id) AS grp, seniority >= 0.75 AS senior FROM e),
lo AS (SELECT expert_id, count(*) AS load FROM ch GROUP BY expert_id),
s AS (SELECT tr.document_id, tr.expert_id, q / t AS total, cf.expert_id IS NULL AS eligible, cf.expert_id IS NOT NULL AS conflict, capacity, grp, senior, coalesce(load, 0) AS load, ch.expert_id IS NOT NULL AS chosen
      FROM tr JOIN tt USING (expert_id) JOIN en USING (expert_id) LEFT JOIN cf USING (document_id, expert_id) LEFT JOIN lo USING (expert_id) LEFT JOIN ch USING (document_id, expert_id)),
hg AS (SELECT document_id, list(grp) AS held, count(*) AS assigned, sum(senior::int) AS senior_assigned FROM ch JOIN en USING (expert_id) GROUP BY document_id),
a AS (SELECT s.*, eligible AND capacity > 0 AS fits, eligible AND capacity > 0 AND total >= {_MINIMUM} AS ok, coalesce(list_contains(held, grp), false) AS same FROM s LEFT JOIN hg USING (document_id)),
c AS (SELECT document_id, count(*) AS scored_pairs, count(*) FILTER (NOT conflict AND NOT eligible AND capacity > 0) AS other_ineligible_pairs, count(*) FILTER (capacity = 0) AS zero_capacity_pairs,
        count(*) FILTER (fits) AS eligible_pairs, count(*) FILTER (fits AND total < {_MINIMUM}) AS below_minimum_score_pairs, count(*) FILTER (ok) AS admissible_pairs, count(*) FILTER (ok AND senior) AS senior_admissible_pairs,
        count(DISTINCT CASE WHEN ok THEN grp END) AS institution_groups, count(*) FILTER (ok AND NOT chosen AND load < capacity AND same) AS institution_blocked_pairs,
        count(*) FILTER (ok AND NOT chosen AND load >= capacity) AS saturated_admissible_experts, coalesce(string_agg(CASE WHEN ok AND NOT chosen AND load >= capacity THEN expert_id END, ',' ORDER BY expert_id), '') AS saturated_experts
      FROM a GROUP BY document_id),
hc AS (SELECT document_id, count(*) AS hard FROM cf GROUP BY document_id),
x AS (SELECT d.document_id, demand AS requested, coalesce(assigned, 0) AS assigned, demand - coalesce(assigned, 0) AS unmet, (SELECT count(*) FROM e) AS total_experts, coalesce(hard, 0) AS hard_conflict_pairs,
        coalesce(senior_assigned, 0) AS senior_assigned, c.* EXCLUDE (document_id) FROM d LEFT JOIN hg USING (document_id) LEFT JOIN hc USING (document_id) LEFT JOIN c USING (document_id))
SELECT document_id, requested::bigint AS requested, assigned::bigint AS assigned, unmet::bigint AS unmet, total_experts, coalesce(scored_pairs, 0) AS scored_pairs, total_experts - coalesce(scored_pairs, 0) AS unscored_experts,
  hard_conflict_pairs, coalesce(other_ineligible_pairs, 0) AS other_ineligible_pairs, coalesce(zero_capacity_pairs, 0) AS zero_capacity_pairs, coalesce(eligible_pairs, 0) AS eligible_pairs,
  coalesce(below_minimum_score_pairs, 0) AS below_minimum_score_pairs, coalesce(admissible_pairs, 0) AS admissible_pairs, coalesce(senior_admissible_pairs, 0) AS senior_admissible_pairs, senior_assigned::bigint AS senior_assigned,
  coalesce(institution_groups, 0) AS institution_groups, coalesce(institution_blocked_pairs, 0) AS institution_blocked_pairs, coalesce(saturated_admissible_experts, 0) AS saturated_admissible_experts,
  coalesce(saturated_experts, '') AS saturated_experts,
  CASE WHEN unmet > 0 THEN concat_ws(',', CASE WHEN hard_conflict_pairs > 0 THEN 'hard_conflict' END, CASE WHEN other_ineligible_pairs > 0 THEN 'other_ineligible' END, CASE WHEN zero_capacity_pairs > 0 THEN 'zero_capacity' END,
    CASE WHEN below_minimum_score_pairs > 0 THEN 'minimum_score' END, CASE WHEN total_experts > coalesce(scored_pairs, 0) THEN 'sparse_score_matrix' END, CASE WHEN coalesce(admissible_pairs, 0) < requested THEN 'candidate_scarcity' END,
    CASE WHEN saturated_admissible_experts > 0 THEN 'expert_capacity' END, CASE WHEN coalesce(institution_groups, 0) < requested OR institution_blocked_pairs > 0 THEN 'institution_diversity' END,
    CASE WHEN admissible_pairs >= requested AND institution_groups >= requested THEN 'global_capacity_coupling' END) ELSE '' END AS reason_codes
FROM x"""

# Evaluation ---------------------------------------------------------------------


def _gold(k_threshold: int) -> str:
    return f"""
j AS (SELECT coalesce(source, 'none') AS document_id, doc_id::varchar AS expert_id, quality + (1 - toxic) AS relevance FROM labels JOIN documents USING (doc_id)),
sc AS (SELECT coalesce(source, 'none') AS document_id, doc_id::varchar AS expert_id, n_chars / max(n_chars) OVER () AS score FROM documents),
r AS (SELECT j.*, score, (relevance >= {k_threshold})::int AS pos, row_number() OVER w AS rank, sum((relevance >= {k_threshold})::int) OVER (w ROWS UNBOUNDED PRECEDING) AS hits
      FROM j LEFT JOIN sc USING (document_id, expert_id) WINDOW w AS (PARTITION BY document_id ORDER BY score IS NULL, score DESC, expert_id)),
p AS (SELECT *, sum(pos) OVER (PARTITION BY document_id) AS positives FROM r),
m AS (SELECT document_id, k, count(*) AS judged_pairs, max(positives)::bigint AS judged_positives, count(*) FILTER (score IS NULL) AS missing_scores, coalesce(sum(pos) FILTER (rank <= k), 0) / k AS precision,
        coalesce(sum(pos) FILTER (rank <= k), 0) / max(positives) AS recall, (coalesce(sum(pos) FILTER (rank <= k), 0) > 0)::int::double AS hits,
        coalesce(sum(hits / rank) FILTER (rank <= k AND pos = 1), 0) / max(positives) AS average_precision
      FROM p, (VALUES (1), (3), (5), (10)) v(k) WHERE positives > 0 GROUP BY document_id, k)"""


_METRICS = ("precision", "recall", "hits", "average_precision")
ORACLES["gold_metrics"] = f"WITH {_gold(2)} SELECT document_id, k, judged_pairs, judged_positives, missing_scores, {', '.join(f'round({x}, 6) AS {x}' for x in _METRICS)} FROM m"
ORACLES["gold_macro"] = f"WITH {_gold(2)} SELECT k, {', '.join(f'round(avg({x}), 6) AS {x}' for x in _METRICS)} FROM m GROUP BY k"
ORACLES["gold_skipped"] = f"WITH {_gold(3)} SELECT document_id, 'no_judged_positive' AS reason FROM p GROUP BY document_id HAVING max(positives) = 0"
ORACLES["gold_counts"] = f"""WITH {_gold(2)}, b AS (SELECT document_id, max(relevance) AS best FROM j GROUP BY document_id)
SELECT (SELECT count(*) FROM b) AS judged_documents, (SELECT count(*) FROM b WHERE best >= 2) AS evaluated_documents, (SELECT count(*) FROM b WHERE best < 2) AS skipped_documents, (SELECT count(*) FROM j) AS judged_pairs,
  (SELECT count(*) FROM sc) AS scored_pairs, (SELECT count(*) FROM sc ANTI JOIN j USING (document_id, expert_id)) AS ignored_unjudged_scores, (SELECT count(*) FROM j ANTI JOIN sc USING (document_id, expert_id)) AS missing_judged_scores"""
ORACLES["gold_wide"] = "SELECT 'd' || doc_id AS document_id, 'p' || doc_id // 10 AS expert_id, max(quality)::int AS relevance FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id"

# Vectors and keyphrases -----------------------------------------------------------

_VECTORS = """
v AS (SELECT 'v' || vec_id AS id, vec_id AS ord, 'l' || label AS expert_id, embedding::double[] AS x, vec_id % 10 = 0 AS asked, sqrt(list_sum(list_transform(embedding::double[], lambda a: a * a))) AS n FROM embeddings),
s AS (SELECT id AS document_id, list_transform(x, lambda a: a / (n + 1e-12)) AS x, list_transform(x, lambda a: a / n) AS u FROM v WHERE asked),
p AS (SELECT id, ord, expert_id, list_transform(x, lambda a: a / (n + 1e-12)) AS x, list_transform(x, lambda a: a / n) AS u FROM v WHERE NOT asked),
rv AS (SELECT DISTINCT expert_id FROM v),
c AS (SELECT document_id, expert_id, p.id, ord, list_inner_product(s.x, p.x) AS c FROM s, p),
b AS (SELECT min(c) AS lo, max(c) AS hi FROM c),
k AS (SELECT document_id, expert_id, id, ord, round((c - lo) / (hi - lo), 12) AS c FROM c, b),
ct AS (SELECT expert_id, count(*) AS evidence_count FROM p GROUP BY expert_id)"""
ORACLES["embed_max"] = f"""WITH {_VECTORS}
SELECT document_id, expert_id, coalesce(round(c, 4), 0) AS score, coalesce(evidence_count, 0) AS evidence_count, id AS selected_publication_id FROM (SELECT document_id, expert_id FROM s, rv) LEFT JOIN ct USING (expert_id)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id, expert_id ORDER BY c DESC, ord) AS r FROM k) q USING (document_id, expert_id) WHERE r = 1 OR r IS NULL"""
ORACLES["embed_average"] = f"""WITH {_VECTORS}
SELECT document_id, expert_id, coalesce(round(a, 4), 0) AS score, coalesce(evidence_count, 0) AS evidence_count, NULL::varchar AS selected_publication_id FROM (SELECT document_id, expert_id FROM s, rv)
LEFT JOIN ct USING (expert_id) LEFT JOIN (SELECT document_id, expert_id, avg(c) AS a FROM k GROUP BY ALL) q USING (document_id, expert_id)"""
ORACLES["embed_centroid"] = f"""WITH {_VECTORS},
z AS (SELECT expert_id, i, sum(y) AS y FROM (SELECT expert_id, unnest(u) AS y, generate_subscripts(u, 1) AS i FROM p) GROUP BY ALL),
g AS (SELECT expert_id, list(y ORDER BY i) AS y FROM z GROUP BY expert_id),
h AS (SELECT expert_id, list_transform(y, lambda a: a / sqrt(list_sum(list_transform(y, lambda t: t * t)))) AS y FROM g)
SELECT document_id, expert_id, coalesce(round(round(least(1, greatest(0, list_inner_product(s.u, h.y))), 12), 4), 0) AS score, coalesce(evidence_count, 0) AS evidence_count, NULL::varchar AS selected_publication_id
FROM s CROSS JOIN rv LEFT JOIN h USING (expert_id) LEFT JOIN ct USING (expert_id)"""


def _sentences(table: str, key: str) -> str:
    """(key, s, t): the kept tokens of each sentence."""
    return f"SELECT {key}, s, {_tokens('x', True)} AS t FROM (SELECT {key}, unnest(r) AS x, generate_subscripts(r, 1) AS s FROM (SELECT {key}, regexp_extract_all({_FOLD.format('coalesce(text, ' + repr('') + ')')}, '[^.!?\\n]+') AS r FROM {table}))"


ORACLES["cooccurrence_counts"] = f"""WITH se AS ({_sentences("documents", "doc_id")}),
w AS (SELECT doc_id, s, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM se),
e AS (SELECT DISTINCT x.doc_id, least(x.a, y.a) AS l, greatest(x.a, y.a) AS r FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i IN (x.i + 1, x.i + 2) AND x.a <> y.a)
SELECT doc_id, count(*) AS n_edges, min(l) AS first_left, max(r) AS last_right FROM e GROUP BY doc_id"""

_STEP = """r{0} AS MATERIALIZED (SELECT t.k, t.a, (0.15::double + 0.85::double * coalesce(dm, 0)) / n + 0.85::double * coalesce(g, 0) AS r FROM t JOIN nt USING (k)
  LEFT JOIN (SELECT k, sum(r) AS dm FROM r{1} ANTI JOIN dg USING (k, a) GROUP BY k) d USING (k)
  LEFT JOIN (SELECT e2.k, e2.b AS a, sum(r / dg) AS g FROM e2 JOIN r{1} USING (k, a) JOIN dg USING (k, a) GROUP BY ALL) x USING (k, a))"""
ORACLES["keyphrase_topk"] = f"""WITH se AS ({_sentences("benchmark", "item_id")}),
w AS (SELECT item_id AS k, s, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM se),
t AS (SELECT DISTINCT k, a FROM w), nt AS (SELECT k, count(*) AS n FROM t GROUP BY k),
e2 AS (SELECT DISTINCT x.k, x.a, y.a AS b FROM w x JOIN w y ON x.k = y.k AND x.s = y.s AND abs(y.i - x.i) = 1 AND x.a <> y.a),
dg AS (SELECT k, a, count(*) AS dg FROM e2 GROUP BY ALL),
r0 AS (SELECT t.k, t.a, 1 / n AS r FROM t JOIN nt USING (k)), {", ".join(_STEP.format(i, i - 1) for i in (1, 2, 3))}
SELECT k::varchar AS owner_id, rank, a AS term, round(r, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(r, 12) DESC, a) AS rank FROM r3) WHERE rank <= 5"""

ORACLES["strict_json"] = "SELECT event_id, (props::json ->> '$.k')::bigint AS k, replace(props, ' ', '') AS canonical FROM events"
