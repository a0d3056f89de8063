from __future__ import annotations

import math

import pytest

from arbiter.config import GoldEvaluationConfig
from arbiter.errors import DataValidationError
from arbiter.operators import evaluation as ev


def tables(spark):
    j = spark.createDataFrame([("d1", "a", 1), ("d1", "b", 0), ("d1", "c", 2), ("d1", "m", 1), ("d2", "a", 0), ("d2", "b", 1), ("d3", "a", 0)], "document_id string, expert_id string, relevance int")
    s = spark.createDataFrame([("d1", "a", 0.5), ("d1", "b", 0.9), ("d1", "c", 0.5), ("d2", "a", 0.2), ("d2", "b", 0.1), ("d3", "a", 0.4), ("d3", "z", 0.3), ("d9", "a", 0.1)], "document_id string, expert_id string, score double")
    return j, s


def test_metrics(spark):
    j, s = tables(spark)
    c = GoldEvaluationConfig(k_values=(10, 1, 2))
    got = {(r.document_id, r.k): r for r in ev.document_metrics(j, s, c).collect()}
    # d1 is ranked b, a, c, then m without a score; 3 are positive. d3 has no positive.
    r = got["d1", 2]
    assert (r.precision, r.recall, r.hits, r.judged_pairs, r.missing_scores) == (0.5, 1 / 3, 1.0, 4, 1) and math.isclose(r.average_precision, 0.5 / 3)
    assert math.isclose(got["d1", 10].average_precision, (1 / 2 + 2 / 3 + 3 / 4) / 3) and got["d1", 10].precision == 0.3 and got["d1", 1].hits == 0.0
    assert {k for k in got} == {(d, k) for d in ("d1", "d2") for k in (1, 2, 10)}
    report = ev.report(j, s, c)
    assert report["counts"] == {"judged_documents": 3, "evaluated_documents": 2, "skipped_documents": 1, "judged_pairs": 7, "scored_pairs": 8, "ignored_unjudged_scores": 2, "missing_judged_scores": 1}
    assert report["skipped"] == [{"document_id": "d3", "reason": "no_judged_positive"}] and report["k_values"] == [1, 2, 10]
    assert math.isclose(report["macro"]["2"]["precision"], 0.5) and [d["document_id"] for d in report["documents"]] == ["d1", "d2"]


def test_nothing_to_evaluate_gives_zeros(spark):
    j, s = tables(spark)
    c = GoldEvaluationConfig(relevance_threshold=9)
    assert [tuple(r)[1:] for r in ev.macro_metrics(ev.document_metrics(j, s, c), c).collect()] == [(0.0,) * 4] * 4


def test_bad_tables_are_refused(spark):
    j, s = tables(spark)
    with pytest.raises(DataValidationError, match="scored judged pair: d2"):
        ev.report(j, s.filter("document_id <> 'd2'"))
    with pytest.raises(DataValidationError, match="strict"):
        ev.report(j, s, GoldEvaluationConfig(strict_coverage=True))
    with pytest.raises(DataValidationError, match="judged pairs"):
        ev.report(j.union(j), s)
    for bad in ({"k_values": ()}, {"k_values": (1, 1)}, {"k_values": (0,)}, {"relevance_threshold": 0}):
        with pytest.raises(DataValidationError):
            GoldEvaluationConfig(**bad)


def test_wide_tables(spark):
    names = ["ParticipantID", *[x for i in range(1, 11) for x in (f"Paper{i}", f"Expertise{i}")]]
    row = ["p", "x", "3", " ", "", "y", "0", *[None] * 14]
    wide = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))
    assert sorted(map(tuple, ev.unpivot_wide(wide).collect())) == [("x", "p", 3), ("y", "p", 0)]
    for bad in (["p", "x", "", *[None] * 18], ["p", "x", "1001", *[None] * 18], ["p", "x", "2.5", *[None] * 18]):
        with pytest.raises(DataValidationError):
            ev.unpivot_wide(spark.createDataFrame([bad], wide.schema)).collect()
    with pytest.raises(DataValidationError, match="participants"):
        ev.unpivot_wide(wide.union(wide))
