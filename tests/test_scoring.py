from __future__ import annotations

import math

import pytest
from domain_tables import conflicts, documents, experts, paper

from arbiter.config import MatchConfig, ScoreWeights
from arbiter.errors import DataValidationError
from arbiter.operators.scoring import affinity_scores, candidate_pairs, content_scores, pair_scores
from arbiter.schemas import check_documents, check_experts, check_references


def rows(df):
    return {(r.document_id, r.expert_id): r for r in df.collect()}


def test_all_parts_of_one_pair(spark):
    d = documents(spark, {"document_id": "d", "title": "Graph search", "topics": ["Graphs"], "keywords": ["search"]})
    e = experts(spark, {"expert_id": "e", "summary": "graph theory", "topics": ["graphs "], "publications": [paper("Search", year=2020), paper("Old", year=2014), paper("Undated")], "seniority": 0.75, "bids": {"d": 0.5}})
    got = rows(pair_scores(d, e, None, MatchConfig(current_year=2026)))["d", "e"]
    recency = (0.5 ** (6 / 6) + 0.5 ** (12 / 6)) / 2
    assert got.bid == 0.75 and got.topics == 0.5 and got.seniority == 0.75 and math.isclose(got.recency, recency)
    # document: graph search graphs search; expert: graph theory graphs search old undated
    idf = {t: math.log(3 / (1 + n)) + 1 for t, n in {"graph": 2, "search": 2, "graphs": 2, "theory": 1, "old": 1, "undated": 1}.items()}
    a = {"graph": idf["graph"], "search": (1 + math.log(2)) * idf["search"], "graphs": idf["graphs"]}
    b = {t: idf[t] for t in ("graph", "theory", "graphs", "search", "old", "undated")}
    cosine = sum(a[t] * b[t] for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    assert math.isclose(got.content, cosine)
    assert math.isclose(got.total, 0.5 * cosine + 0.2 * 0.5 + 0.15 * 0.75 + 0.1 * recency + 0.05 * 0.75)
    # Reasons compare folded topics without stripping them.
    assert got.reasons == ["positive preference (0.50)", f"strong text similarity ({cosine:.2f})"]


def test_conflict_beats_zero_capacity_and_both_keep_seniority(spark):
    d = documents(spark, {"document_id": "d"})
    e = experts(spark, {"expert_id": "a", "capacity": 0, "seniority": 0.9}, {"expert_id": "b", "capacity": 0, "seniority": 0.9})
    got = rows(pair_scores(d, e, conflicts(spark, ("d", "a"))))
    assert got["d", "a"].reasons == ["excluded: declared conflict"] and got["d", "b"].reasons == ["excluded: zero capacity"]
    for r in got.values():
        assert not r.eligible and r.seniority == 0.9 and (r.total, r.content, r.topics, r.bid, r.recency) == (0, 0, 0, 0, 0)


def test_the_last_of_repeated_conflicts_gives_the_reason(spark):
    d, e = documents(spark, {"document_id": "d"}), experts(spark, {"expert_id": "e"})
    c = spark.createDataFrame([("d", "e", "z first", 0), ("d", "e", "a last", 1)], "document_id string, expert_id string, reason string, position long")
    assert rows(pair_scores(d, e, c))["d", "e"].reasons == ["excluded: a last"]


def test_more_bid_and_newer_papers_score_higher(spark):
    d = documents(spark, {"document_id": "d"})
    e = experts(spark, *[{"expert_id": f"{b}{y}", "bids": {"d": b}, "publications": [paper("p", year=y)]} for b in (-1.0, 0.0, 1.0) for y in (2000, 2020, 2030)])
    got = {k[1]: r for k, r in rows(pair_scores(d, e, None, MatchConfig(current_year=2026))).items()}
    assert got["1.02020"].total > got["0.02020"].total > got["-1.02020"].total
    assert got["0.02030"].recency == 1.0 > got["0.02020"].recency > got["0.02000"].recency
    assert got["0.02020"].reasons[0] == "eligible with limited direct evidence" and got["-1.02020"].reasons[0] == "negative preference (-1.00)"


def test_candidates_are_the_pairs_with_evidence(spark):
    d = documents(spark, {"document_id": "d1", "title": "alpha", "topics": ["T"]}, {"document_id": "d2", "title": "beta"}, {"document_id": "d3", "title": "gamma"})
    e = experts(spark, {"expert_id": "e1", "summary": "alpha", "bids": {"d2": 0.1, "gone": 1.0}}, {"expert_id": "e2", "topics": ["t"]}, {"expert_id": "e3"})
    found = candidate_pairs(d, e, content_scores(d, e), conflicts(spark, ("d3", "e3")))
    assert set(map(tuple, found.collect())) == {("d1", "e1"), ("d2", "e1"), ("d1", "e2"), ("d3", "e3")}
    full, some = rows(pair_scores(d, e)), rows(pair_scores(d, e, None, None, found))
    assert set(some) == {("d1", "e1"), ("d2", "e1"), ("d1", "e2"), ("d3", "e3")} and all(some[k].total == full[k].total for k in some)


def test_affinities_keep_only_listed_pairs(spark):
    e = experts(spark, {"expert_id": "a"}, {"expert_id": "b"})
    given = spark.createDataFrame([("d", "a", 0.4), ("d", "b", 0.9)], "document_id string, expert_id string, score double")
    got = rows(affinity_scores(given, e, conflicts(spark, ("d", "b"))))
    assert got["d", "a"].total == 0.4 == got["d", "a"].affinity and got["d", "a"].eligible and got["d", "a"].seniority == 0
    assert not got["d", "b"].eligible and got["d", "b"].total == 0.9


def test_weights(spark):
    assert ScoreWeights.from_mapping({"bid": 2}).normalised() == {"content": 0, "topics": 0, "bid": 1, "recency": 0, "seniority": 0}
    for bad in ({}, {"bid": -1}, {"bid": float("nan")}, {"other": 1}, {"bid": True}):
        with pytest.raises(DataValidationError):
            ScoreWeights.from_mapping(bad)


@pytest.mark.parametrize(
    "setting",
    [{"strategy": "other"}, {"reviewers_per_document": 0}, {"reviewers_per_document": True}, {"load_balance_penalty": 1.5}, {"minimum_senior_reviewers": 1, "require_distinct_institutions": True}, {"strategy": "maximin", "load_balance_penalty": 0.1}, {"fair_local_max_steps": 3}, {"current_year": 1700}, {"unknown": 1}, {"publication_half_life": 0}],
)
def test_settings_are_checked(setting):
    with pytest.raises(DataValidationError):
        MatchConfig.from_mapping(setting)


def test_tables_are_checked(spark):
    for bad in ({"document_id": " d"}, {"document_id": "d\n"}, {"document_id": "d", "title": " "}, {"document_id": "d", "required_experts": 0}):
        with pytest.raises(DataValidationError):
            check_documents(documents(spark, bad))
    with pytest.raises(DataValidationError):
        check_documents(documents(spark, {"document_id": "d"}, {"document_id": "d"}))
    for bad in ({"capacity": -1}, {"seniority": 1.5}, {"bids": {"d": 2.0}}, {"publications": [paper("p", year=1)]}, {"publications": [paper(" ")]}):
        with pytest.raises(DataValidationError):
            check_experts(experts(spark, {"expert_id": "e", **bad}))
    with pytest.raises(DataValidationError, match="unknown experts: x"):
        check_references(conflicts(spark, ("d", "x")), documents(spark, {"document_id": "d"}), experts(spark, {"expert_id": "e"}), "conflicts")
