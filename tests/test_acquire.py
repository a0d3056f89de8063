"""Publications of a site, what may be kept of them, captured inputs, and artifacts that are read back."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from arbiter.config import ExpertiseConfig, KeyphraseConfig
from arbiter.errors import DataValidationError
from arbiter.functions.text import safe_term
from arbiter.operators import expertise, keyphrases
from arbiter.operators.assignment import places_of
from arbiter.sources import acquire, artifacts, domain, sinks
from arbiter.sources.rest import Client, Response
from domain_tables import documents, experts, paper

DAY = 86_400_000


def people(spark):
    one = {"expert_id": "a", "summary": "graph search engines", "publications": [paper("Graph indexes", "search over large graphs", 2001, "g1"), paper("Stream joins", "joins of streams", 2003)]}
    return experts(spark, one, {"expert_id": "b", "summary": "protein folding models"})


def papers(spark):
    return documents(spark, {"document_id": "d1", "title": "Graph search", "abstract": "search of graph data"}, {"document_id": "d2", "title": "Folding proteins fast"})


class Site:
    """Two reviewers' notes by rising id."""

    def __init__(self):
        note = lambda i, **k: {"id": f"n{i}", "invitations": ["v/paper"], "content": {"title": {"value": f"t{i}"}, "abstract": "a", "authorids": ["~A1", "~B1"], "secret": "x"}, "signatures": ["~A1"], **k}
        self.notes = {
            "~A1": [note(1, pdate=10 * DAY), note(2, odate=20_000 * DAY, pdate=None), note(3), note(4, cdate=11 * DAY, invitations=["v/other"])],
            "~B1": [note(5, pdate=12 * DAY, content={"title": " ", "authorids": ["~B1"]}), note(6, pdate=13 * DAY)],
        }

    def get(self, url, headers, timeout, max_bytes):
        from urllib.parse import parse_qs, urlsplit

        rows = self.notes[parse_qs(urlsplit(url).query)["content.authorids"][0]]
        return Response(200, {}, json.dumps({"count": len(rows), "notes": rows}).encode())


def test_publications_are_filtered_counted_and_reduced():
    lines, counts = acquire.publications(Client("https://site.example", Site()), ["~A1", "~B1"], ("v/paper",), 0, 100 * DAY)
    found = [json.loads(x) for x in lines]
    assert [(r["reviewer_id"], r["note"]["id"]) for r in found] == [("~A1", "n1"), ("~B1", "n6")]
    assert counts == {"invitation": 1, "date": 2, "content": 1, "retained": 2}
    assert all(set(r["note"]) == {"id", "content"} and set(r["note"]["content"]) == {"title", "abstract", "year"} and r["note"]["content"]["year"] == 1970 for r in found)
    lines, _ = acquire.publications(Client("https://site.example", Site()), ["~A1"], budget=acquire.Budget(20))
    with pytest.raises(DataValidationError, match="bytes"):
        list(lines)


def test_what_may_be_kept():
    kept = acquire.minimal_publication({"id": "n", "invitation": "i", "pdate": 0, "content": {"title": "t", "authorids": ["~A1", "~B1"]}}, "~B1")
    assert kept == {"id": "n", "invitations": ["i"], "pdate": 0, "title": "t", "abstract": "", "authorids": ["~B1"], "year": 1970}
    assert acquire.minimal_profile({"id": "~A1", "content": {"names": [], "bio": "b", "emails": ["x"]}}) == {"id": "~A1", "content": {"names": [], "bio": "b"}}
    with pytest.raises(DataValidationError, match="must not keep"):
        acquire.only({"a": 1, "b": 2}, ("a",), "row")
    for bad in ({"pdate": "x", "content": {}}, {"content": None}):
        with pytest.raises(DataValidationError):
            acquire.minimal_publication(bad, "~A1")


def test_columns_and_bytes_of_tables(spark):
    df = spark.createDataFrame([(1, "é"), (2, None)], "k int, t string")
    assert df.agg(acquire.projected_bytes(df).alias("n")).first().n == len('{"k":1,"t":"é"}\n'.encode()) + len('{"k":2}\n')
    assert acquire.within_budget(df).count() == 2 and acquire.within_budget(df.limit(0), 0).count() == 0
    with pytest.raises(DataValidationError):
        acquire.within_budget(df, 10)
    with pytest.raises(DataValidationError, match="must not be kept"):
        acquire.only_columns(df, "k")


def test_captured_inputs(tmp_path):
    a = tmp_path / "a.json"
    a.write_text("[1]")
    found = sinks.Captured("local", {"a": 10}, a=a)
    found.verify()
    again = sinks.Captured("local", {"a": 10}, a=a).record()
    sinks.Captured.same_contract(found.record(), again)
    with pytest.raises(DataValidationError, match="limits"):
        sinks.Captured.same_contract(found.record(), {**again, "limits": {"a": 11}})
    a.write_text("[2]")
    with pytest.raises(DataValidationError, match="changed"):
        found.verify()
    with pytest.raises(DataValidationError, match="more than 2 bytes"):
        sinks.Captured("local", {"a": 2}, a=a)


def test_delimited_files_are_bounded(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b"d,e,0.5\rd,f,0.25\r\n")
    assert domain.bounded(spark, str(p), 100, 10) == str(p)
    with pytest.raises(DataValidationError, match="more than 10 bytes"):
        domain.bounded(spark, str(p), 10)
    with pytest.raises(DataValidationError, match="a line"):
        domain.bounded(spark, str(p), 100, 5)
    p.write_bytes(b"d,e\x00,0.5\n")
    with pytest.raises(DataValidationError, match="NUL"):
        domain.bounded(spark, str(p))


def test_safe_terms(spark):
    want = {"ab": True, "a": False, "Ab": False, "straße": False, "naïve": True, "a-b": False, "x1": True, "é" * 64: True, "é" * 65: False, "": False, None: False}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.ok for r in df.select("t", safe_term(F.col("t")).alias("ok")).collect()} == want


def test_models_are_held_against_their_experts(spark):
    e, config = people(spark), ExpertiseConfig(model="bm25", aggregation="max")
    corpus = expertise.build_corpus(papers(spark), e, config)
    model = expertise.fit(corpus.evidence, corpus.reviewers, config)
    assert expertise.check_evidence(model, e) is model
    more = replace(model, postings=model.postings.withColumn("tf", F.col("tf") + 1))
    with pytest.raises(DataValidationError, match="postings"):
        expertise.check_evidence(more, e)
    wrong = replace(model, units=model.units.withColumn("evidence_id", F.lit("publication:x:position:0")))
    with pytest.raises(DataValidationError, match="evidence ids"):
        expertise.check_evidence(wrong, e)


def test_keyphrase_records_are_read_back(spark, tmp_path):
    d, e, config = papers(spark), people(spark), KeyphraseConfig()
    records = keyphrases.extract(d, e, config)
    records.write.json(f"{tmp_path}/records")
    again = keyphrases.read_records(spark, f"{tmp_path}/records", d, e, config)
    assert sorted(map(str, again.collect())) == sorted(map(str, records.collect()))
    bad = again.withColumn("keyphrases", F.array(F.struct(F.lit("Up").alias("term"), F.lit(0.5).alias("score"))))
    for rows, what in ((bad, "index"), (again.union(again), "unique"), (again.filter("kind <> 'profile'"), "profile"), (again.withColumn("owner_id", F.lit("?")), "unique|unknown")):
        with pytest.raises(DataValidationError, match=what):
            keyphrases.check_records(rows, d, e, config)


def test_places_follow_the_ids(spark):
    ids = [f"e{k}" for k in range(500)]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "i string").repartition(7)
    assert {r.i: r.place for r in places_of(df, "i").collect()} == {i: k for k, i in enumerate(sorted(ids))}
    assert places_of(df.limit(0), "i").count() == 0


def frozen(spark, folder, s, p, **changes):
    """A folder with vectors of 2 numbers for the requested papers."""
    folder.mkdir()
    files = {}
    for name, rows in (("submissions.jsonl", s), ("publications.jsonl", p)):
        data = "".join(json.dumps({"paper_id": r.paper_id, "embedding": [1.0, 0.5]}) + "\n" for r in rows.collect()).encode()
        (folder / name).write_bytes(data)
        files[name] = {"bytes": len(data), "sha256": __import__("hashlib").sha256(data).hexdigest()}
    m = {
        "schema_version": 1, "adapter": artifacts.VECTOR_ADAPTER, "encoder": {"family": "specter2", "model_id": "m", "revision": "r", "origin": "synthetic-fixture", "weights_sha256": None},
        "requests": {"submissions_sha256": artifacts.request_digest(s), "publications_sha256": artifacts.request_digest(p)}, "files": files,
    }
    m["encoder"] |= changes.pop("encoder", {})
    (folder / "manifest.json").write_text(json.dumps(m | changes))
    return folder


def test_frozen_vectors(spark, tmp_path):
    from arbiter.operators.vectors import embedding_requests

    s, p, _ = embedding_requests(papers(spark), people(spark))
    found = artifacts.FrozenVectors(frozen(spark, tmp_path / "v", s, p))
    sv, pv = found.load(spark, s, p, 2)
    assert sv.count() == 2 and pv.count() == 2 and found.encoder["family"] == "specter2"
    with pytest.raises(DataValidationError, match="other submissions"):
        found.load(spark, s.withColumn("title", F.lit("x")), p, 2)
    found.inputs.verify()
    (tmp_path / "v" / "publications.jsonl").write_text("")
    with pytest.raises(DataValidationError, match="changed"):
        found.inputs.verify()
    with pytest.raises(DataValidationError, match="manifest says"):
        artifacts.FrozenVectors(tmp_path / "v")
    for k, bad in enumerate(({"encoder": {"family": "other"}}, {"encoder": {"weights_sha256": "0" * 64}}, {"encoder": {"origin": "external-encoder"}}, {"schema_version": 2}, {"schema_version": True}, {"adapter": "x"}, {"requests": {}}, {"more": 1})):
        with pytest.raises(DataValidationError):
            artifacts.FrozenVectors(frozen(spark, tmp_path / f"bad{k}", s, p, **bad))


def plan_record(**changes):
    one = {"document_id": "d1", "expert_id": "a", "score": 0.5, "rank": 1, "components": {"content": 0.5}}
    d1 = {"document_id": "d1", "requested": 2, "assigned": 1, "unmet": 1, "reason_codes": ["expert_capacity"], "evidence": {"total_experts": 2}, "saturated_experts": ["b"]}
    run = {"status": "infeasible", "certified": True, "requested": 2, "assigned": 1, "unmet": 1, "documents": [d1]}
    run |= changes.pop("run", {})
    return {"strategy": "optimal", "total_score": 0.5, "unmet": {"d1": 1}, "assignments": [one], "diagnostics": run} | changes


def test_plans_are_read_back():
    found = artifacts.read_plan(plan_record())
    assert found["total_score"] == 0.5 and found["diagnostics"]["documents"][0]["unmet"] == 1
    assert artifacts.read_plan({})["assignments"] == [] and artifacts.read_plan(plan_record(diagnostics=None))["diagnostics"] is None
    bad = [
        {"total_score": 0.6}, {"unmet": {"d1": 2}}, {"unmet": {"d1": -1}}, {"assignments": [{}]}, {"assignments": []}, {"more": 1}, {"strategy": ""}, {"run": {"status": "satisfied"}},
        {"run": {"certified": False}}, {"run": {"requested": 3}}, {"run": {"status": "?"}}, {"run": {"documents": []}}, {"assignments": [{"document_id": "d1", "expert_id": "a", "score": float("nan"), "rank": 1}]},
    ]
    for change in bad:
        with pytest.raises(DataValidationError):
            artifacts.read_plan(plan_record(**change))


def test_a_run_folder_never_replaces_even_an_empty_one(tmp_path, monkeypatch):
    (tmp_path / "there").mkdir()
    new = tmp_path / "new"
    new.mkdir()
    with pytest.raises(DataValidationError, match="exists"):
        sinks.move_new(new, tmp_path / "there")
    monkeypatch.setattr(sinks.ctypes, "CDLL", lambda *a, **k: object())  # a system without that call
    with pytest.raises(DataValidationError, match="exists"):
        sinks.move_new(new, tmp_path / "there")
    sinks.move_new(new, tmp_path / "moved")
    assert (tmp_path / "moved").is_dir() and not new.exists() and not list(tmp_path.glob(".*lock"))


def test_commands_read_artifacts_back(spark, tmp_path):
    """Keyphrases and vectors of earlier runs go into later ones; run folders hold what they were made from."""
    from arbiter.cli import main

    docs = [{"id": "d1", "title": "Graph search", "abstract": "graph"}, {"id": "d2", "title": "Folding proteins", "abstract": "models"}, {"id": "d3", "title": "Graph joins", "abstract": "streams of graph data"}]
    people_ = [{"id": "a", "name": "A", "summary": "graph search engines", "publications": [{"id": "g1", "title": "Graph indexes", "abstract": "search"}]}, {"id": "b", "name": "B", "summary": "protein folding models", "publications": []}]
    for name, rows in (("d", docs), ("e", people_), ("t", [{"document_id": "d1", "positive_expert_id": "a", "negative_expert_id": "b"}]), ("v", [{"document_id": "d2", "positive_expert_id": "b", "negative_expert_id": "a"}])):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    path = lambda n: str(tmp_path / n)
    base = ["--documents", path("d.jsonl"), "--experts", path("e.jsonl")]
    assert main(["expertise", *base, "--output", path("x")], spark) == 0
    assert {"model-units.jsonl", "model-terms.jsonl", "submission-evidence.jsonl", "reviewer-evidence.jsonl", "documents.jsonl"} <= set(sinks.verify_run(path("x"))["files"])
    assert main(["extract-keyphrases", *base, "--output", path("k")], spark) == 0
    train = ["--train", path("t.jsonl"), "--validation", path("v.jsonl")]
    assert main(["expertise-centroid", *base, *train, "--keyphrases", path("k/keyphrases.jsonl"), "--output", path("c")], spark) == 0
    assert main(["expertise-centroid", *base, *train, "--output", path("c2")], spark) == 0
    assert (tmp_path / "c/model.json").read_bytes() == (tmp_path / "c2/model.json").read_bytes()
    assert [json.loads(x)["id"] for x in (tmp_path / "c/documents.jsonl").read_text().splitlines()] == ["d3"]
    from arbiter.operators.vectors import embedding_requests

    s, p, _ = embedding_requests(domain.load_documents(spark, path("d.jsonl")), domain.load_experts(spark, path("e.jsonl")))
    frozen(spark, tmp_path / "f", s, p)
    assert main(["expertise-embedding", *base, "--vectors", path("f"), "--dimensions", "2", "--output", path("m")], spark) == 0
    assert sinks.verify_run(path("m"))["encoder"]["family"] == "specter2"
    assert main(["expertise-embedding", *base, "--output", path("m2")], spark) == 2
