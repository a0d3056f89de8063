"""Vectors, keyphrases and centroids."""

from __future__ import annotations

import math

import numpy as np
import pytest
from domain_tables import documents, experts, paper

from arbiter.config import CentroidConfig, KeyphraseConfig
from arbiter.errors import DataValidationError
from arbiter.operators import centroid, keyphrases, vectors


def table(spark, rows):
    return spark.createDataFrame(list(rows.items()), "paper_id string, embedding array<double>")


def test_keyphrase_ranks_of_the_published_graphs():
    half = KeyphraseConfig(damping=0.5, iterations=100)
    got = dict(keyphrases.rank_lines([["aa", "bb", "cc"]], half))
    assert all(math.isclose(got[t], v, abs_tol=1e-12) for t, v in {"aa": 5 / 18, "bb": 4 / 9, "cc": 5 / 18}.items()) and list(got) == ["bb", "aa", "cc"]
    got = dict(keyphrases.rank_lines([["aa", "bb"], ["zz"]], half))
    assert all(math.isclose(got[t], v, abs_tol=1e-12) for t, v in {"aa": 2 / 5, "bb": 2 / 5, "zz": 1 / 5}.items())
    assert keyphrases.rank_lines([], half) == []


def test_keyphrase_records_and_edges(spark):
    d = documents(spark, {"document_id": "d", "title": "Graph search", "topics": ["Search engines"]})
    e = experts(spark, {"expert_id": "e", "publications": [paper("Only title"), paper("Named", id="n")]})
    got = {(r.kind, r.owner_id, r.evidence_id): r for r in keyphrases.extract(d, e).collect()}
    assert set(got) == {("submission", "d", "d"), ("profile", "e", "e"), ("publication", "e", "position:0"), ("publication", "e", "id:n")}
    assert got["submission", "d", "d"].token_count == 4 and got["submission", "d", "d"].keyphrases[0].term == "search" and got["profile", "e", "e"].keyphrases == []
    texts = spark.createDataFrame([(1, "one two three one. two two four"), (2, None)], "id int, text string")
    edges = {tuple(r) for r in keyphrases.cooccurrence_edges(texts, "id", window_size=3).collect()}
    assert edges == {(1, "one", "two"), (1, "one", "three"), (1, "three", "two"), (1, "four", "two")}
    with pytest.raises(DataValidationError):
        keyphrases.extract(d, experts(spark, {"expert_id": "e", "publications": [paper("a", id="p"), paper("b", id="p")]}))


def by_hand(s, p, owners, mode):
    unit = lambda v, eps: np.array(v, float) / (np.linalg.norm(v) + eps) if len(v) and np.linalg.norm(v) else None
    cos = lambda a, b, eps: 0.0 if unit(a, eps) is None or unit(b, eps) is None else float(unit(a, eps) @ unit(b, eps))
    every = [cos(a, b, 1e-12) for a in s.values() for b in p.values()]
    lo, hi = min(every), max(every)
    out = {}
    for d, a in s.items():
        for r, mine in owners.items():
            if mode == "centroid":
                parts = [unit(p[x], 0) for x in mine if unit(p[x], 0) is not None]
                value = max(0.0, min(1.0, cos(a, sum(parts) / len(parts), 0))) if parts else 0.0
                out[d, r] = (round(value, 4), len(parts), None)
                continue
            mine = [x for x in mine if len(p[x])]
            scaled = [(cos(a, p[x], 1e-12) - lo) / (hi - lo) for x in mine]
            if not mine:
                out[d, r] = (0.0, 0, None)
            elif mode == "max":
                out[d, r] = (round(max(scaled), 4), len(mine), mine[scaled.index(max(scaled))])
            else:
                out[d, r] = (round(sum(scaled) / len(scaled), 4), len(mine), None)
    return out


@pytest.mark.parametrize("mode", ["max", "average", "centroid"])
@pytest.mark.parametrize("block", [2, 2048])
def test_vector_scores_equal_the_definitions(spark, mode, block):
    s = {"d1": [1.0, 0.0, 0.2], "d2": [0.0, -1.0, 0.4], "d3": []}
    p = {"p1": [0.5, 0.5, 0.0], "p2": [1.0, 0.0, 0.2], "p3": [2.0, 0.0, 0.4], "p4": [0.0, 0.0, 0.0], "p5": [], "p6": [-1.0, 0.3, 0.1]}
    owners = {"r1": ["p1", "p3", "p2"], "r2": ["p4", "p5"], "r3": [], "r4": ["p6", "p2"]}
    a = spark.createDataFrame([(r, x, i) for r, xs in owners.items() for i, x in enumerate(xs)], "expert_id string, paper_id string, ord long")
    reviewers = spark.createDataFrame([(r,) for r in owners], "expert_id string")
    got = {(r.document_id, r.expert_id): (r.score, r.evidence_count, r.selected_publication_id) for r in vectors.embedding_expertise(table(spark, s), table(spark, p), a, reviewers, mode, 3, block).collect()}
    assert got == by_hand(s, p, owners, mode)


def test_vector_checks(spark):
    d = documents(spark, {"document_id": "d"})
    e = experts(spark, {"expert_id": "e", "publications": [paper("a"), paper("b", id="b")]}, {"expert_id": "f", "publications": [paper("b", id="b")]})
    s, p, a = vectors.embedding_requests(d, e)
    assert {r.paper_id for r in p.collect()} == {"publication:e:position:0", "b"} and a.count() == 3
    assert vectors.check_vectors(table(spark, {"d": [1.0, 2.0]}), s, 2)
    for bad in ({}, {"d": [1.0]}, {"d": [float("nan"), 1.0]}, {"d": [1e13, 0.0]}, {"d": [1.0, 1.0], "x": []}):
        with pytest.raises(DataValidationError):
            vectors.check_vectors(spark.createDataFrame(list(bad.items()), "paper_id string, embedding array<double>"), s, 2)
    clash = experts(spark, {"expert_id": "e", "publications": [paper("a", id="x")]}, {"expert_id": "f", "publications": [paper("other", id="x")]})
    with pytest.raises(DataValidationError, match="different texts"):
        vectors.embedding_requests(d, clash)


def test_one_gradient_step():
    w = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    loss = centroid.step(w, np.array([0]), np.array([1]), np.array([2]), 0.1, 0.0)
    delta = 0.1 / (1 + math.e)
    assert math.isclose(loss, math.log(1 + 1 / math.e)) and np.allclose(w, [[1 + delta, -delta], [1 + delta, 0], [-delta, 1]])


def test_validation_map():
    w = np.array([[1.0], [0.5], [0.2]])
    docs = {"d1": np.array([0]), "d2": np.array([0])}
    exps = {"hi": np.array([1]), "lo": np.array([2])}
    assert centroid.mean_average_precision(w, [("d1", "hi", "lo"), ("d2", "lo", "hi")], docs, exps) == 0.75


def test_centroid_training_scoring_and_checkpoints(spark):
    d = spark.createDataFrame([("d1", ["a", "x"]), ("d2", ["b"]), ("d3", ["a"])], "document_id string, terms array<string>")
    e = spark.createDataFrame([("e1", ["a"]), ("e2", ["b"])], "expert_id string, terms array<string>")
    row = lambda *r: spark.createDataFrame([r], "document_id string, positive_expert_id string, negative_expert_id string")
    model = centroid.train(row("d1", "e1", "e2"), row("d2", "e2", "e1"), d, e, CentroidConfig(epochs=5))
    got = {(r.document_id, r.expert_id): r.score for r in centroid.score(model, d.filter("document_id = 'd3'"), e).collect()}
    v = dict(zip(model.vocabulary, map(np.array, model.vectors)))
    for x, term in (("e1", "a"), ("e2", "b")):
        assert got["d3", x] == round(1 / (1 + math.exp(-float(v["a"] @ v[term]))), 6)
    data = model.to_bytes()
    assert centroid.CentroidModel.from_bytes(data) == model and centroid.verify(data, row("d1", "e1", "e2"), row("d2", "e2", "e1"), d, e)
    with pytest.raises(DataValidationError):
        centroid.CentroidModel.from_bytes(data.replace(b'"best_epoch":', b'"best_epoch":1'))
    with pytest.raises(DataValidationError, match="both"):
        centroid.train(row("d1", "e1", "e2"), row("d1", "e2", "e1"), d, e)
    with pytest.raises(DataValidationError, match="vocabulary"):
        centroid.score(model, spark.createDataFrame([("q", ["unseen"])], d.schema), e)


def test_edges_of_texts_with_keys_of_their_own_are_not_shuffled(spark):
    rows = [(1, "alpha beta gamma. beta alpha"), (2, "beta alpha delta"), (None, "alpha zeta")]
    table = lambda r: spark.createDataFrame(r, "k int, text string")
    edges = lambda r: keyphrases.cooccurrence_edges(table(r), "k", window_size=3)
    found = edges(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(1, "alpha", "beta"), (1, "alpha", "gamma"), (1, "beta", "gamma"), (2, "alpha", "beta"), (2, "alpha", "delta"), (2, "beta", "delta"), (None, "alpha", "zeta")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    again = edges([*rows, (1, "gamma alpha eta"), (None, "zeta alpha")])
    assert sorted(map(tuple, again.collect()), key=str) == sorted([*want, (1, "alpha", "eta"), (1, "eta", "gamma")], key=str)
