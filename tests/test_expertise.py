from __future__ import annotations

import math

import pytest
from domain_tables import documents, experts, paper

from arbiter.config import ExpertiseConfig
from arbiter.errors import DataValidationError
from arbiter.operators import expertise as x
from arbiter.streaming.scoring import score_stream


def corpus(spark, **options):
    d = documents(spark, {"document_id": "s1", "title": "alpha beta beta"}, {"document_id": "s2", "title": "zeta"})
    e = experts(
        spark,
        {"expert_id": "r1", "summary": "alpha", "publications": [paper("alpha beta", year=2020, id="p1"), paper("beta gamma", year=2010)]},
        {"expert_id": "r2", "publications": [paper("beta beta delta", year=2021)]},
        {"expert_id": "r3"},
    )
    return d, e, ExpertiseConfig(**options)


UNITS = {"profile:r1": "alpha", "publication:r1:id:p1": "alpha beta", "publication:r1:position:2": "beta gamma", "publication:r2:position:1": "beta beta delta"}
OWNERS = {"r1": ["profile:r1", "publication:r1:id:p1", "publication:r1:position:2"], "r2": ["publication:r2:position:1"], "r3": []}


def by_hand(model: str, aggregation: str, query: str):
    """Scores of a query from the definitions, in plain Python."""
    units = {r: " ".join(UNITS[u] for u in us).split() for r, us in OWNERS.items() if us} if aggregation == "aggregate" else {u: t.split() for u, t in UNITS.items()}
    n, df = len(units), {}
    for t in units.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    mean = sum(map(len, units.values())) / n
    q = query.split()

    def raw(t):
        if model == "bm25":
            idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
            return sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(q) & set(t))
        w = {k: math.log((1 + n) / (1 + c)) + 1 for k, c in df.items()}
        vec = lambda s: {k: (1 + math.log(s.count(k))) * w[k] for k in set(s) if k in w}
        a, b = vec(q), vec(t)
        length = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return sum(v * b[k] for k, v in a.items() if k in b) / length if length else 0.0

    out = {}
    for r, us in OWNERS.items():
        if not us:
            out[r] = (0.0, None)
        elif aggregation == "aggregate":
            out[r] = (raw(units[r]), f"aggregate:{r}")
        else:
            values = [raw(units[u]) for u in us]
            out[r] = (sum(values) / len(us), None) if aggregation == "average" else (max(values), us[values.index(max(values))])
    return out


@pytest.mark.parametrize("model", ["tfidf", "bm25"])
@pytest.mark.parametrize("aggregation", ["aggregate", "max", "average"])
def test_scores_equal_the_definitions(spark, model, aggregation):
    d, e, config = corpus(spark, model=model, aggregation=aggregation)
    got = {(r.document_id, r.expert_id): r for r in x.expertise(d, e, config, contributions=True).collect()}
    assert len(got) == 6
    for s, text in (("s1", "alpha beta beta"), ("s2", "zeta")):
        for r, (raw, selected) in by_hand(model, aggregation, text).items():
            row = got[s, r]
            assert math.isclose(row.raw_score, raw, abs_tol=1e-12) and row.selected_evidence_id == selected and row.evidence_count == len(OWNERS[r])
            assert math.isclose(row.score, raw if model == "tfidf" else raw / (1 + raw), abs_tol=1e-12)
            parts = row.contributions or []
            assert math.isclose(sum(c.value for c in parts), raw, abs_tol=1e-12) and [(-c.value, c.term) for c in parts] == sorted((-c.value, c.term) for c in parts)


def test_filters_look_for_duplicates_before_dates(spark):
    d = documents(spark, {"document_id": "s"})
    e = experts(spark, {"expert_id": "r", "publications": [paper("Old", year=1990), paper(" OLD ", year=1990), paper("Kept", year=2020), paper("Undated"), paper("the", year=2020)]})
    c = x.build_corpus(d, e, ExpertiseConfig(minimum_publication_year=2000, undated_publications="exclude"))
    assert {r.reason: r.n for r in c.filters.collect()} == {"duplicate_publications": 1, "date_or_content_filtered_publications": 2, "empty_publications": 1, "empty_profiles": 1}
    assert [r.evidence_id for r in c.evidence.collect()] == ["publication:r:position:3"]


def test_reviewers_without_evidence_change_no_statistic(spark):
    d, e, config = corpus(spark, model="bm25", aggregation="max")
    model = x.fit(x.build_corpus(d, e, config).evidence, e.select("expert_id"), config)
    assert tuple(model.stats.first()) == (4, 2.0)


def test_limits_and_ids(spark):
    d, e, _ = corpus(spark)
    with pytest.raises(DataValidationError, match="max_submissions"):
        x.build_corpus(d, e, ExpertiseConfig.from_mapping({"max_submissions": 1}))
    with pytest.raises(DataValidationError, match="max_pairs"):
        x.expertise(d, e, ExpertiseConfig.from_mapping({"max_pairs": 5}))
    twice = experts(spark, {"expert_id": "r", "publications": [paper("a", id="p"), paper("b", id="p")]})
    with pytest.raises(DataValidationError, match="publication ids"):
        x.build_corpus(d, twice)
    with pytest.raises(DataValidationError, match="abstract"):
        x.build_corpus(d, e, ExpertiseConfig(require_submission_abstract=True))


def test_saved_models_score_the_same_and_tampering_is_found(spark, tmp_path):
    d, e, config = corpus(spark, model="bm25", aggregation="max")
    c = x.build_corpus(d, e, config)
    model = x.fit(c.evidence, c.reviewers, config)
    x.save_model(model, f"{tmp_path}/m")
    again = x.load_model(spark, f"{tmp_path}/m", config)
    order = ["document_id", "expert_id"]
    assert x.score_new(again, d).orderBy(order).collect() == x.score(model, c.submissions).orderBy(order).collect()
    model.idf.selectExpr("term", "df", "idf + 1 as idf").write.mode("overwrite").parquet(f"{tmp_path}/m2/idf")
    for t in ("postings", "units", "stats", "reviewers"):
        getattr(model, t).write.parquet(f"{tmp_path}/m2/{t}")
    with pytest.raises(DataValidationError, match="IDF"):
        x.load_model(spark, f"{tmp_path}/m2", config)


def test_a_stream_scores_as_a_batch(spark, tmp_path):
    d, e, config = corpus(spark, model="bm25", aggregation="max")
    c = x.build_corpus(d, e, config)
    model = x.fit(c.evidence, c.reviewers, config)
    for k, row in enumerate(d.collect()):
        spark.createDataFrame([row], d.schema).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    score_stream(stream, model, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("document_id", "expert_id", "score").collect()
    assert sorted(got) == sorted(x.emitted(x.score(model, c.submissions), config).collect()) and got


@pytest.mark.parametrize("model", ["tfidf", "bm25"])
def test_best_items_are_found_inside_the_tasks(spark, monkeypatch, model):
    """Pieces of any size, flushed or not, tell the same best items as a join of all pairs; the earliest of equals wins."""
    words = ["alpha", "beta", "gamma", "delta", "zeta"]
    d = documents(spark, *[{"document_id": f"s{i}", "title": f"{words[i]} {words[(i + 1) % 5]} {'unknown' * (i % 2)}"} for i in range(5)])
    e = experts(spark, *[{"expert_id": f"r{i}", "publications": [paper(f"{words[(i + k // 2) % 5]} {words[k % 5]}", id=f"p{k}") for k in range(12)]} for i in range(7)])
    config = ExpertiseConfig(model=model, aggregation="max")
    corpus = x.build_corpus(d, e, config)
    fitted = x.fit(corpus.evidence, corpus.reviewers, config)
    query, weights = x._weights(fitted, x.term_counts(corpus.submissions, "document_id"))
    found = []
    for held, cells in ((x.HELD, x.CELLS), (x.HELD, 10), (0, x.CELLS)):
        monkeypatch.setattr(x, "HELD", held)
        monkeypatch.setattr(x, "CELLS", cells)
        found.append({(r.document_id, r.expert_id): (r.unit, round(r.total, 9)) for r in x._best_units(query, weights, fitted.units).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    monkeypatch.setattr(x, "COMMON", 2)
    few = {r.unit: r.norm for r in x._norms(fitted).collect()}
    monkeypatch.setattr(x, "COMMON", 1000)
    assert few == pytest.approx({r.unit: r.norm for r in x._norms(fitted).collect()})
