from __future__ import annotations

import math
import random
from collections import Counter

import pandas as pd
import pytest
from domain_tables import conflicts, documents, experts, scores

from arbiter.config import MatchConfig
from arbiter.errors import DataValidationError
from arbiter.operators import assignment, audit
from arbiter.operators.assignment import assign, diagnostics, run_status, unmet
from arbiter.operators.components import components
from arbiter.plans.matching import run_matching


def pairs(df):
    return {(r.document_id, r.expert_id) for r in df.collect()}


def test_plan_rows_are_ranked_and_shortages_listed(spark):
    d = documents(spark, {"document_id": "d1", "required_experts": 3}, {"document_id": "d2", "required_experts": 1}, {"document_id": "d3"})
    e = experts(spark, *[{"expert_id": f"e{i}", "capacity": 2} for i in (1, 2)])
    s = scores(spark, {("d1", "e1"): 0.3, ("d1", "e2"): 0.3, ("d2", "e1"): 0.9, ("d2", "e2"): 0.1}, ineligible=(("d2", "e2"),))
    c = MatchConfig(reviewers_per_document=1)
    got = assign(s, d, e, c)
    assert {(r.document_id, r.expert_id, r["rank"]) for r in got.collect()} == {("d1", "e1", 1), ("d1", "e2", 2), ("d2", "e1", 1)}
    assert {(r.document_id, r.unmet) for r in unmet(got, d, c).collect()} == {("d1", 1), ("d3", 1)}


@pytest.mark.parametrize("strategy", ["optimal", "greedy"])
def test_independent_parts_give_the_same_plan(spark, strategy):
    r = random.Random(3)
    table = {(f"d{g}{i}", f"e{g}{j}"): r.randint(0, 1000) / 1000 for g in range(4) for i in range(3) for j in range(3)}
    d = documents(spark, *[{"document_id": x} for x in sorted({a for a, _ in table})])
    e = experts(spark, *[{"expert_id": x, "capacity": 1} for x in sorted({b for _, b in table})])
    c = MatchConfig(strategy=strategy, reviewers_per_document=1)
    s = scores(spark, table)
    assert pairs(assign(s, d, e, c, split_pairs=0)) == pairs(assign(s, d, e, c))


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "z"), ("q", "q")] + [("hub", f"leaf{i}") for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(61)) and got["z"] == got["x"] == "x" and all(got[f"leaf{i}"] == "hub" for i in range(50)) and "q" not in got


def test_repeated_pairs_and_ceilings_are_refused(spark):
    d = documents(spark, *[{"document_id": f"d{i}"} for i in range(7)])
    e = experts(spark, {"expert_id": "e"})
    s = scores(spark, {("d0", "e"): 0.5})
    with pytest.raises(DataValidationError, match="admissible pairs"):
        assign(s.union(s), d, e)
    with pytest.raises(DataValidationError, match="6 documents"):
        assign(s, d, e, MatchConfig(strategy="maximin"))
    assert pairs(assign(s, d, e, MatchConfig(strategy="maximin-flow", enforce_ceilings=False))) == {("d0", "e")}


def test_diagnostics_tell_every_reason(spark):
    d = documents(spark, {"document_id": "a", "required_experts": 4}, {"document_id": "b", "required_experts": 1})
    e = experts(
        spark,
        {"expert_id": "con", "institution": "I"}, {"expert_id": "zero", "capacity": 0}, {"expert_id": "low"}, {"expert_id": "full", "capacity": 1}, {"expert_id": "got", "institution": "I", "seniority": 0.1},
        {"expert_id": "same", "institution": "I"}, {"expert_id": "bad"}, {"expert_id": "unscored"},
    )
    table = {("a", x): 0.5 for x in ("con", "zero", "full", "got", "same", "bad")} | {("a", "low"): 0.01, ("b", "full"): 0.9}
    s = scores(spark, table, ineligible=(("a", "con"), ("a", "zero"), ("a", "bad")))
    plan = spark.createDataFrame([("a", "got", 0.5), ("b", "full", 0.9)], "document_id string, expert_id string, score double")
    c = MatchConfig(minimum_score=0.1, require_distinct_institutions=True)
    got = {r.document_id: r for r in diagnostics(plan, s, d, e, conflicts(spark, ("a", "con"), ("b", "unscored")), c).collect()}
    a = got["a"]
    assert a.reason_codes == ["hard_conflict", "other_ineligible", "zero_capacity", "minimum_score", "sparse_score_matrix", "candidate_scarcity", "expert_capacity", "institution_diversity"]
    counters = {k: a[k] for k in ("total_experts", "scored_pairs", "unscored_experts", "hard_conflict_pairs", "other_ineligible_pairs", "zero_capacity_pairs", "eligible_pairs", "below_minimum_score_pairs", "admissible_pairs", "institution_groups", "institution_blocked_pairs", "saturated_admissible_experts")}
    assert counters == {"total_experts": 8, "scored_pairs": 7, "unscored_experts": 1, "hard_conflict_pairs": 1, "other_ineligible_pairs": 1, "zero_capacity_pairs": 1, "eligible_pairs": 4, "below_minimum_score_pairs": 1, "admissible_pairs": 3, "institution_groups": 2, "institution_blocked_pairs": 1, "saturated_admissible_experts": 1}
    assert a.saturated_experts == ["full"] and a.unmet == 3 and got["b"].reason_codes == [] and got["b"].hard_conflict_pairs == 1
    assert tuple(run_status(diagnostics(plan, s, d, e), True).first()) == ("infeasible", True, 5, 2, 3)
    assert run_status(diagnostics(plan, s, d, e), False).first().status == "not_certified"
    senior = {r.document_id: r for r in diagnostics(plan, s, d, e, None, MatchConfig(minimum_senior_reviewers=1, strategy="greedy")).collect()}["a"]
    assert "seniority_floor" in senior.reason_codes and senior.reason_codes[-1] == "greedy_not_certified"


def test_audit_counts_every_violation(spark):
    d = documents(spark, {"document_id": "a", "required_experts": 1}, {"document_id": "b"}, {"document_id": "c"})
    e = experts(spark, {"expert_id": "x", "capacity": 1, "institution": ""}, {"expert_id": "y", "institution": ""}, {"expert_id": "z"})
    rows = [("a", "x", 0.4), ("a", "y", 0.6), ("b", "x", 0.8), ("b", "x", 0.2), ("?", "x", 1.0), ("a", "!", 1.0)]
    plan = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "document_id string, expert_id string, score double, position long")
    found = audit.tables(plan, d, e, conflicts(spark, ("a", "y"), ("c", "z")), default_demand=2)
    s = audit.summary(found).first()
    listed = {(r.kind, r.document_id, r.expert_id, r.institution) for r in audit.violations(found).collect()}
    assert listed == {
        ("unknown_documents", "?", None, None), ("unknown_experts", None, "!", None), ("duplicate_assignments", "b", "x", None), ("conflict_violations", "a", "y", None), ("capacity_violations", None, "x", None),
        ("demand_violations", "a", None, None), ("institution_duplicates", "a", None, ""),
    }
    assert not s.safe and math.isclose(s.document_coverage, 2 / 3) and math.isclose(s.demand_coverage, 2 / 5) and math.isclose(s.average_score, 0.6) and s.minimum_score == 0.4


def test_gini(spark):
    load = lambda *xs: spark.createDataFrame([(x,) for x in xs], "load long")
    for xs, want in (((0, 0, 3), 2 / 3), ((1, 1, 1), 0.0), ((0, 0), 0.0), ((), 0.0), ((1, 2, 2, 5), (2 * (1 + 4 + 6 + 20) - 5 * 10) / 40)):
        assert math.isclose(audit.gini(load(*xs)).first().gini, want)


def test_an_empty_plan_is_safe(spark):
    d, e = documents(spark, {"document_id": "a"}), experts(spark, {"expert_id": "x"})
    plan = spark.createDataFrame([], "document_id string, expert_id string, score double")
    s = audit.summary(audit.tables(plan, d, e)).first()
    assert s.safe and s.minimum_score is None and s.average_score == 0 and s.demand_coverage == 0


def test_a_whole_run_does_not_depend_on_row_order_or_partitions(spark):
    r = random.Random(5)
    words = ["graph", "query", "join", "window", "stream", "index"]
    docs = [{"document_id": f"d{i}", "title": " ".join(r.sample(words, 3)), "topics": [r.choice(words)]} for i in range(6)]
    exps = [{"expert_id": f"e{i}", "summary": " ".join(r.sample(words, 3)), "topics": [r.choice(words)], "capacity": 2, "institution": f"i{i % 3}"} for i in range(8)]
    c = MatchConfig(require_distinct_institutions=True)
    none = conflicts(spark, ("d0", "e0"))
    first = run_matching(documents(spark, *docs), experts(spark, *exps), none, c)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        second = run_matching(documents(spark, *docs[::-1]).repartition(3), experts(spark, *exps[::-1]), none, c)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    plan = lambda run: [(r.document_id, r.expert_id, r["rank"], round(r.score, 9)) for r in run.assignments.orderBy("document_id", "rank").collect()]
    assert plan(first) == plan(second) and first.audit.first().safe and first.plan_record()["strategy"] == "optimal-diverse"


@pytest.mark.parametrize("options", [{}, {"load_balance_penalty": 0.2}, {"require_distinct_institutions": True}, {"minimum_senior_reviewers": 1}, {"strategy": "greedy", "load_balance_penalty": 0.3}, {"strategy": "greedy", "require_distinct_institutions": True}, {"strategy": "minmax"}])
def test_kernels_get_the_pairs_that_a_plan_can_hold(spark, options):
    """The pairs that a kernel gets don't grow with the experts, and its plan is that of all pairs."""
    rng = random.Random(5)
    d = spark.createDataFrame([(f"d{i}", f"d{i}", 1 + i % 2) for i in range(4)], "document_id string, title string, required_experts int")
    people = [(f"e{i:03}", "n", rng.randrange(3), rng.choice([None, "a", "b", "c"]), rng.choice([0.0, 1.0])) for i in range(120)]
    e = spark.createDataFrame(people, "expert_id string, name string, capacity int, institution string, seniority double")
    # Scores repeat, so many experts are tied, and two documents want the same ones.
    rows = [(f"d{i}", x[0], rng.randrange(6) / 5 if i < 2 else int(x[0][1:]) // 20 / 6, True) for i in range(4) for x in people]
    table = spark.createDataFrame(rows, "document_id string, expert_id string, total double, eligible boolean")
    config = MatchConfig(**options)
    got = assignment.solver_input(table, d, e, config).toPandas()
    groups = (4 if config.require_distinct_institutions else 1) * (2 if config.minimum_senior_reviewers else 1)
    assert len(got) <= 4 * 6 * groups
    whole = [{"document_id": q[0], "expert_id": q[1], "total": q[2], "demand": 1 + int(q[0][1]) % 2, "capacity": x[2], "institution": x[3], "senior": x[4] >= config.senior_threshold, "place": k} for q in rows for k, x in enumerate(people) if x[0] == q[1] and x[2] > 0]
    want = assignment.solve(assignment._problem(pd.DataFrame(whole)), config)
    chosen = {tuple(r) for r in assignment.choose(table, d, e, config).collect()}
    score = {q[:2]: q[2] for q in rows}
    loads = lambda plan: sorted(Counter(x for _, x in plan).values())
    figures = lambda plan: (len(plan), sum(round(score[q] * 1_000_000) for q in plan), sum(int(x[1:]) for _, x in plan), loads(plan))
    assert figures(chosen) == figures(want)
    assert config.strategy != "greedy" or chosen == want
