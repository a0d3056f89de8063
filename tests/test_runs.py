"""What-if, publishing, reports and the command line."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from domain_tables import conflicts, documents, experts

from arbiter.cli import main
from arbiter.config import MatchConfig
from arbiter.errors import DataValidationError
from arbiter.operators import publish, report, whatif
from arbiter.plans.matching import run_matching, score_without_exclusions


def tables(spark):
    d = documents(spark, {"document_id": "d1", "title": "graph"}, {"document_id": "d2", "title": "query"})
    e = experts(spark, {"expert_id": "e1", "summary": "graph", "capacity": 1}, {"expert_id": "e2", "summary": "query", "capacity": 1}, {"expert_id": "e3", "capacity": 1})
    return d, e, conflicts(spark, ("d1", "e2"))


CONFIG = MatchConfig(reviewers_per_document=1)


def test_scenarios_are_independent(spark):
    d, e, c = tables(spark)
    found = whatif.compare((whatif.Scenario("out", {"e1": 0}), whatif.Scenario("swap", {}, (("d2", "e2"),), (("d1", "e2"),)), whatif.Scenario("none", {"e1": 0, "e2": 0, "e3": 0})), score_without_exclusions(d, e, CONFIG), d, e, c, CONFIG)
    got = {r.scenario: r for r in found.delta.collect()}
    pair = lambda r: {(x.document_id, x.expert_id) for x in r}
    assert pair(got["out"].removed_assignments) == {("d1", "e1")} and pair(got["out"].added_assignments) == {("d1", "e3")} and got["out"].unmet == 0
    assert pair(got["swap"].removed_assignments) == {("d2", "e2")} and pair(got["swap"].added_assignments) == {("d2", "e3")}
    assert got["none"].assigned == -2 and got["none"].unmet == 2 and got["none"].added_assignments == []
    assert {r.scenario: (r.assigned, r.unmet) for r in found.results.collect()} == {"baseline": (2, 0), "out": (2, 0), "swap": (2, 0), "none": (0, 2)}
    for bad in (whatif.Scenario("x", {"?": 1}), whatif.Scenario("x", {}, (("d1", "e2"),)), whatif.Scenario("x", {}, (), (("d2", "e2"),))):
        with pytest.raises(DataValidationError):
            whatif.compare((bad,), score_without_exclusions(d, e, CONFIG), d, e, c, CONFIG)


@pytest.mark.parametrize("plan", [{}, {"schema_version": 2, "scenarios": []}, {"schema_version": 1, "scenarios": []}, {"schema_version": 1, "scenarios": [{"id": "a b"}]}, {"schema_version": 1, "scenarios": [{"id": "a"}]}, {"schema_version": 1, "scenarios": [{"id": "a", "capacity_overrides": {"e": -1}}]}, {"schema_version": 1, "scenarios": [{"id": "a", "x": 1}]}, {"schema_version": 1, "scenarios": [{"id": "a", "capacity_overrides": {"e": 1}}] * 2}])
def test_bad_scenario_files(plan):
    with pytest.raises(DataValidationError):
        whatif.parse_plan(plan)


class Site:
    """A create-only site; `drop` loses the answers of some posts, `eat` the posts themselves."""

    def __init__(self, drop=0, eat=0, edges=()):
        self.edges, self.drop, self.eat, self.posts = list(edges), drop, eat, 0

    def inspect_context(self, scope):
        return scope

    def read_edges(self, scope):
        return tuple(self.edges)

    def post_edges(self, edges):
        self.posts += 1
        if self.eat:
            self.eat -= 1
            return
        self.edges += edges
        if self.drop:
            self.drop -= 1
            raise TimeoutError


def test_publishing(spark, tmp_path):
    d, e, c = tables(spark)
    run = run_matching(d, e, c, CONFIG)
    scope = publish.Scope("v/assign", "v/score", "v/reviewers", "label", ("d1", "d2"), ("e1", "e2", "e3"))
    plan = publish.prepare(run.assignments, d, e, c, scope, 1)
    assert len(plan.edges) == 4 and publish.publish(plan).status == "dry_run"
    with pytest.raises(DataValidationError):
        publish.publish(plan, Site(), write=True, confirm_sha256="x")
    with pytest.raises(DataValidationError):
        publish.publish(replace(plan, digest="0" * 64))
    send = lambda site, **k: publish.publish(plan, site, write=True, confirm_sha256=plan.digest, **k)
    site = Site()
    assert send(site, batch_size=3).status == "complete" and site.posts == 2 and sorted(site.edges) == list(plan.edges)
    assert send(site).batches == 0
    lost = Site(drop=1)
    assert send(lost, batch_size=3).reason == "unconfirmed_batch" and send(lost, batch_size=3).status == "complete" and len(lost.edges) == 4
    assert send(Site(eat=1)).status == "incomplete"
    with pytest.raises(DataValidationError, match="differ"):
        send(Site(edges=[replace(plan.edges[0], weight=0.123)]))
    with pytest.raises(DataValidationError, match="complete"):
        publish.prepare(run.assignments, d, e, c, scope, 2)
    with pytest.raises(DataValidationError, match="reviewer_ids"):
        publish.prepare(run.assignments, d, e, c, replace(scope, reviewer_ids=("e1",)), 1)
    publish.write_artifact(plan, tmp_path / "plan.json")
    with pytest.raises(FileExistsError):
        publish.write_artifact(plan, tmp_path / "plan.json")


def test_reports_escape_and_warn(spark):
    d = documents(spark, {"document_id": "d<1>", "title": "<script>alert(1)</script>"})
    e = experts(spark, {"expert_id": "e", "name": "A & B", "capacity": 0})
    plan = spark.createDataFrame([("d<1>", "e", 0.5, 1)], "document_id string, expert_id string, score double, rank int")
    html = report.render(plan, d, e, None)
    assert "<script" not in html and "&lt;script&gt;" in html and "A &amp; B" in html and "capacity violations: e" in html and "width:50.0%" in html


def files(tmp_path):
    put = lambda n, x: (tmp_path / n).write_text(x if isinstance(x, str) else json.dumps(x), encoding="utf-8")
    put("d.json", [{"id": "d1", "title": "graph search", "topics": ["graphs"]}, {"id": "d2", "title": "query plans"}, {"id": "d3", "title": "graph query"}])
    put("e.json", [{"id": "e1", "name": "One", "summary": "graph", "publications": [{"title": "graph search", "year": 2020}]}, {"id": "e2", "name": "Two", "summary": "query plans"}])
    put("c.json", [{"document_id": "d1", "expert_id": "e2"}])
    put("config.json", {"reviewers_per_document": 1})
    put("a.csv", "d1,e1,0.9\nd1,e2,0.8\nd2,e2,0.5\nd3,e1,0.2\n")
    put("j.csv", "document_id,expert_id,relevance\nd1,e1,1\nd2,e2,0\n")
    put("w.json", {"schema_version": 1, "scenarios": [{"id": "s", "capacity_overrides": {"e1": 1}}]})
    put("t.jsonl", json.dumps({"document_id": "d1", "positive_expert_id": "e1", "negative_expert_id": "e2"}) + "\n")
    put("v.jsonl", json.dumps({"document_id": "d2", "positive_expert_id": "e2", "negative_expert_id": "e1"}) + "\n")
    put("sv.jsonl", "\n".join(json.dumps({"paper_id": d, "embedding": [1.0, i]}) for i, d in enumerate(("d1", "d2", "d3"))))
    put("pv.jsonl", json.dumps({"paper_id": "publication:e1:position:0", "embedding": [0.5, 0.5]}))
    put("n.jsonl", json.dumps({"id": "n1", "content": {"title": "T"}}))
    put("r.txt", "~A\n~B\n")


def test_every_command(spark, tmp_path, capsys):
    files(tmp_path)
    p = lambda n: str(tmp_path / n)
    both = ["--documents", p("d.json"), "--experts", p("e.json")]
    call = lambda *a: main(list(a), spark)
    read = lambda n: json.loads((tmp_path / n).read_text(encoding="utf-8"))
    assert call("validate", *both, "--conflicts", p("c.json")) == 0 and json.loads(capsys.readouterr().out) == {"documents": 3, "experts": 2, "conflicts": 1}
    assert call("score", *both, "--output", p("scores.json")) == 0 and len(read("scores.json")) == 6
    assert call("match", *both, "--conflicts", p("c.json"), "--config", p("config.json"), "--output", p("plan.json"), "--report", p("r.html")) == 0
    plan = read("plan.json")
    assert plan["audit"]["safe"] and {(a["document_id"], a["expert_id"]) for a in plan["assignments"]} >= {("d1", "e1"), ("d2", "e2")} and plan["diagnostics"]["status"] == "satisfied"
    assert call("audit", *both, "--plan", p("plan.json"), "--config", p("config.json"), "--output", p("audit.json")) == 0 and read("audit.json")["safe"]
    unsafe = {**plan, "assignments": plan["assignments"] * 2}
    (tmp_path / "unsafe.json").write_text(json.dumps(unsafe))
    assert call("audit", *both, "--plan", p("unsafe.json"), "--output", p("audit2.json")) == 2 and not read("audit2.json")["safe"]
    assert call("match-affinity", *both, "--affinities", p("a.csv"), "--config", p("config.json"), "--output", p("plan2.json")) == 0 and read("plan2.json")["total_score"] == pytest.approx(1.6)
    assert call("what-if", *both, "--scenarios", p("w.json"), "--config", p("config.json"), "--output", p("w_out.json")) == 0 and read("w_out.json")["scenarios"][0]["id"] == "s"
    assert call("expertise", *both, "--output", p("run1")) == 0 and (tmp_path / "run1" / "explanations.jsonl").read_text().count("\n") == 6
    assert call("expertise-embedding", *both, "--submission-vectors", p("sv.jsonl"), "--publication-vectors", p("pv.jsonl"), "--dimensions", "2", "--output", p("run2")) == 0
    assert call("extract-keyphrases", *both, "--output", p("run3")) == 0 and (tmp_path / "run3" / "keyphrases.jsonl").read_text().count("\n") == 6
    assert call("expertise-centroid", *both, "--train", p("t.jsonl"), "--validation", p("v.jsonl"), "--output", p("run4")) == 0
    assert [x.split(",")[:2] for x in (tmp_path / "run4" / "affinities.csv").read_text().split()[1:]] == [["d3", "e1"], ["d3", "e2"]]
    assert call("evaluate-gold", "--judgments", p("j.csv"), "--affinities", p("a.csv"), "--output", p("gold.json")) == 0 and read("gold.json")["counts"]["evaluated_documents"] == 1
    assert call("import-notes", "--notes", p("n.jsonl"), "--reviewers", p("r.txt"), "--output", p("run5")) == 0
    assert call("validate", "--documents", p("run5/documents.jsonl"), "--experts", p("run5/experts.jsonl")) == 0
    assert call("match", *both, "--output", p("d.json")) == 2 and "input" in capsys.readouterr().err
    assert call("validate", "--documents", p("c.json"), "--experts", p("e.json")) == 2
    assert call("expertise", *both, "--output", p("run1")) == 2
