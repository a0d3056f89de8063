"""The command line: 13 commands over the readers, plans and writers. Exit code 2 is an error or an unsafe audit."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.config import CentroidConfig, ExpertiseConfig, GoldEvaluationConfig, KeyphraseConfig, MatchConfig
from arbiter.deploy import ship
from arbiter.errors import DataValidationError
from arbiter.operators import audit, centroid, evaluation, expertise, keyphrases, report, vectors, whatif
from arbiter.operators.scoring import pair_scores
from arbiter.plans.matching import Run, audit_record, run_affinity_matching, run_matching, score_without_exclusions
from arbiter.schemas import check_references
from arbiter.sources import acquire, domain, notes, rest, sinks
from arbiter.sources.artifacts import FrozenVectors, plan_shape, read_plan
from arbiter.sources.strict import fingerprints, loads, translate
from arbiter.storage import release


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arbiter", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *inputs: str, output: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for i in inputs:
            c.add_argument(f"--{i}", required=True)
        if output:
            c.add_argument("--output", required=True)
        c.add_argument("--config")
        return c

    command("validate", "check the inputs", "documents", "experts", output=False).add_argument("--conflicts")
    command("score", "score all pairs", "documents", "experts").add_argument("--conflicts")
    for name, more in (("match", ()), ("match-affinity", ("affinities",))):
        c = command(name, "assign experts and audit the plan", "documents", "experts", *more)
        c.add_argument("--conflicts")
        c.add_argument("--report")
    command("what-if", "compare scenarios", "documents", "experts", "scenarios").add_argument("--conflicts")
    c = command("audit", "audit a plan", "documents", "experts", "plan")
    c.add_argument("--conflicts")
    c = command("import-notes", "turn notes and reviewer ids into domain files", "notes", "reviewers")
    c.add_argument("--capacity", type=int, default=3)
    c = command("fetch-notes", "read the notes of a venue", "base-url", "invitation")
    c.add_argument("--group")
    c.add_argument("--publications", action="store_true", help="the members' publications too")
    c.add_argument("--publication-invitation", action="append", default=[])
    c.add_argument("--minimum-date", type=int, help="UTC milliseconds")
    c.add_argument("--maximum-date", type=int, help="UTC milliseconds")
    command("expertise", "score expertise from evidence", "documents", "experts")
    c = command("expertise-embedding", "score expertise from vectors", "documents", "experts")
    c.add_argument("--vectors", help="a folder with a manifest")
    c.add_argument("--submission-vectors")
    c.add_argument("--publication-vectors")
    c.add_argument("--aggregation", choices=("max", "average", "centroid"), default="max")
    c.add_argument("--dimensions", type=int, default=768)
    command("extract-keyphrases", "rank keyphrases of all evidence", "documents", "experts")
    command("expertise-centroid", "train keyphrase centroids and score the rest", "documents", "experts", "train", "validation").add_argument("--keyphrases", help="a keyphrase run's file, read instead of ranking anew")
    sub.choices["expertise-centroid"].add_argument("--conflicts")
    command("evaluate-gold", "evaluate scores against judgments", "judgments", "affinities")
    return p


_PATHS = ("documents", "experts", "conflicts", "affinities", "scenarios", "plan", "notes", "reviewers", "submission_vectors", "publication_vectors", "train", "validation", "judgments", "config")


def refuse_aliases(args: argparse.Namespace) -> None:
    """No output may be an input or another output, by whatever name or link."""
    inputs = [Path(v) for k in _PATHS if (v := getattr(args, k, None))]
    outputs = [Path(v) for k in ("output", "report") if (v := getattr(args, k, None))]
    for i, out in enumerate(outputs):
        for other in [*inputs, *outputs[:i]]:
            same = out.resolve() == other.resolve() or (out.exists() and other.exists() and os.path.samefile(out, other))
            if same:
                raise DataValidationError(f"{out} is also an input or another output")


def _config(args: argparse.Namespace) -> dict[str, Any]:
    if not args.config:
        return {}
    found = loads(Path(args.config).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise DataValidationError("a config file holds an object")
    return found


def _tables(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, e, c = domain.load_documents(spark, args.documents), domain.load_experts(spark, args.experts), domain.load_conflicts(spark, getattr(args, "conflicts", None))
    return d, e, check_references(c, d, e, "conflicts")


def _finish(run: Run, args: argparse.Namespace) -> int:
    found = run.audit_record()
    scores = [r.asDict(recursive=True) for r in run.scores.orderBy("document_id", "expert_id").toLocalIterator()]
    sinks.write_json(args.output, {**run.plan_record(), "audit": found, "scores": scores})
    if args.report:
        html = report.render(run.assignments, run.documents, run.experts, run.conflicts, run.diagnostics, run.config.reviewers_per_document, require_distinct_institutions=run.config.require_distinct_institutions)
        Path(args.report).write_text(html, encoding="utf-8")
    return 0 if found["safe"] else 2


def _fetch(spark: SparkSession, args: argparse.Namespace, client: rest.Client | None = None) -> int:
    client = client or rest.Client(args.base_url, token=os.environ.get("REVIEW_SITE_TOKEN"))
    lines = lambda rows: [(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n").encode() for r in rows]
    reasons: dict[str, int] = {}
    files = {"submissions.jsonl": lines(client.notes(invitation=args.invitation))}
    if args.group:
        members = client.group_members(args.group)
        budget = acquire.Budget()
        files["reviewers.txt"] = [f"{m}\n".encode() for m in members]
        files["profiles.jsonl"] = (budget.line(acquire.minimal_profile(client.profile(m))) for m in members)
        if args.publications:
            files["reviewer-publications.jsonl"], reasons = acquire.publications(client, members, tuple(args.publication_invitation), args.minimum_date, args.maximum_date, budget)
    elif args.publications:
        raise DataValidationError("publications are those of a group's members")
    sinks.write_run(args.output, files, {"schema_version": 1, "invitation": args.invitation, "publications": reasons})
    return 0


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    refuse_aliases(args)
    ship(spark)
    config, name = _config(args), args.command
    if name == "validate":
        d, e, c = _tables(spark, args)
        print(json.dumps({"documents": d.count(), "experts": e.count(), "conflicts": c.count()}))
        return 0
    if name == "score":
        d, e, c = _tables(spark, args)
        rows = pair_scores(d, e, c, MatchConfig.from_mapping(config)).orderBy("document_id", "expert_id").toLocalIterator()
        sinks.write_json(args.output, [r.asDict(recursive=True) for r in rows])
        return 0
    if name == "match":
        d, e, c = _tables(spark, args)
        return _finish(run_matching(d, e, c, MatchConfig.from_mapping(config)), args)
    if name == "match-affinity":
        d, e, c = _tables(spark, args)
        return _finish(run_affinity_matching(d, e, domain.load_affinities(spark, args.affinities), c, MatchConfig.from_mapping(config)), args)
    if name == "what-if":
        d, e, c = _tables(spark, args)
        scenarios = whatif.parse_plan(loads(Path(args.scenarios).read_text(encoding="utf-8")))
        match = MatchConfig.from_mapping(config)
        found = whatif.compare(scenarios, score_without_exclusions(d, e, match), d, e, c, match)
        results = {r.scenario: r.asDict(recursive=True) for r in found.results.collect()}
        delta = {r.scenario: r.asDict(recursive=True) for r in found.delta.collect()}
        sinks.write_json(args.output, {"baseline": results[whatif.BASELINE], "scenarios": [{"id": s.id, "result": results[s.id], "delta": delta[s.id]} for s in sorted(scenarios, key=lambda s: s.id)]})
        return 0
    if name == "audit":
        d, e, c = _tables(spark, args)
        value = loads(Path(args.plan).read_text(encoding="utf-8"))
        plan, broken = plan_shape(value), None
        try:
            read_plan(value)
        except DataValidationError as error:  # reported beside what the audit finds
            broken = str(error)
        rows = [(a["document_id"], a["expert_id"], float(a["score"]), k) for k, a in enumerate(plan["assignments"])]
        table = spark.createDataFrame(rows, "document_id string, expert_id string, score double, position long")
        match = MatchConfig.from_mapping(config)
        found = audit_record(audit.tables(table, d, e, c, match.reviewers_per_document), match.require_distinct_institutions)
        if broken:
            found |= {"safe": False, "plan_error": broken}
        sinks.write_json(args.output, found)
        return 0 if found["safe"] else 2
    if name == "import-notes":
        d, e = notes.load_submissions(spark, args.notes), notes.load_reviewer_ids(spark, args.reviewers, args.capacity)
        rename = lambda df, key: df.withColumnRenamed(key, "id")
        sinks.write_run(args.output, {"documents.jsonl": _domain_lines(rename(d, "document_id")), "experts.jsonl": _domain_lines(rename(e, "expert_id"))}, {"schema_version": 1})
        return 0
    if name == "fetch-notes":
        return _fetch(spark, args)
    if name == "expertise":
        d, e, _ = _tables(spark, args)
        chosen = ExpertiseConfig.from_mapping(config)
        corpus = expertise.build_corpus(d, e, chosen)
        scores = expertise.score(expertise.fit(corpus.evidence, corpus.reviewers, chosen), corpus.submissions, contributions=True)
        filters = {r.reason: r.n for r in corpus.filters.collect()}
        model = expertise.fit(corpus.evidence, corpus.reviewers, chosen)
        files = {
            "documents.jsonl": _domain_lines(d.withColumnRenamed("document_id", "id")), "experts.jsonl": _domain_lines(e.withColumnRenamed("expert_id", "id")),
            "submission-evidence.jsonl": sinks.jsonl(corpus.submissions, "document_id"), "reviewer-evidence.jsonl": sinks.jsonl(corpus.evidence, "expert_id", "ord", "evidence_id"),
            "affinities.csv": sinks.affinity_lines(expertise.emitted(scores, chosen)), "explanations.jsonl": sinks.jsonl(scores, "document_id", "expert_id"),
            "model-units.jsonl": sinks.jsonl(model.units, "unit"), "model-postings.jsonl": sinks.jsonl(model.postings, "unit", "term"), "model-terms.jsonl": sinks.jsonl(model.idf, "term"),
        }
        sinks.write_run(args.output, files, {"schema_version": 1, "model": chosen.model, "aggregation": chosen.aggregation, "filters": filters, "sources": _sources(spark, args)})
        return 0
    if name == "expertise-embedding":
        d, e, _ = _tables(spark, args)
        s, p, a = vectors.embedding_requests(d, e)
        if args.vectors:
            frozen = FrozenVectors(args.vectors)
            sv, pv = frozen.load(spark, s, p, args.dimensions)
        elif args.submission_vectors and args.publication_vectors:
            frozen = None
            sv, pv = domain.load_vectors(spark, args.submission_vectors, s, args.dimensions), domain.load_vectors(spark, args.publication_vectors, p, args.dimensions)
        else:
            raise DataValidationError("a folder of vectors or both vector files are required")
        scores = vectors.embedding_expertise(sv, pv, a, e, args.aggregation, args.dimensions)
        files = {"affinities.csv": sinks.affinity_lines(scores.filter("score > 0")), "scores.jsonl": sinks.jsonl(scores, "document_id", "expert_id")}
        if frozen:
            frozen.inputs.verify()
        sinks.write_run(args.output, files, {"schema_version": 1, "aggregation": args.aggregation, "encoder": frozen.encoder if frozen else None, "sources": _sources(spark, args)})
        return 0
    if name == "extract-keyphrases":
        d, e, _ = _tables(spark, args)
        found = keyphrases.extract(d, e, KeyphraseConfig(**config))
        sinks.write_run(args.output, {"keyphrases.jsonl": sinks.jsonl(found, "kind", "owner_id", "evidence_id")}, {"schema_version": 1, "sources": _sources(spark, args)})
        return 0
    if name == "expertise-centroid":
        d, e, _ = _tables(spark, args)
        train, validation = domain.load_triplets(spark, args.train), domain.load_triplets(spark, args.validation)
        found = keyphrases.read_records(spark, args.keyphrases, d, e) if args.keyphrases else keyphrases.extract(d, e)
        docs, experts = centroid.terms_of(found)
        model = centroid.train(train, validation, docs, experts, CentroidConfig(**config))
        holdout = docs.join(train.unionByName(validation).select("document_id"), "document_id", "left_anti")
        scores = centroid.score(model, holdout, experts)
        asked = d.join(holdout.select("document_id"), "document_id", "left_semi")
        c = domain.load_conflicts(spark, args.conflicts).join(asked.select("document_id"), "document_id", "left_semi").select("document_id", "expert_id", "reason")
        files = {
            "model.json": model.to_bytes(), "affinities.csv": sinks.affinity_lines(scores, 6), "documents.jsonl": _domain_lines(asked.withColumnRenamed("document_id", "id")),
            "experts.jsonl": _domain_lines(e.withColumnRenamed("expert_id", "id")), "conflicts.jsonl": sinks.jsonl(c, "document_id", "expert_id"),
        }
        sinks.write_run(args.output, files, {"schema_version": 1, "best_epoch": model.best_epoch, "sources": _sources(spark, args)})
        return 0
    chosen = GoldEvaluationConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in config.items()})
    record = evaluation.report(domain.load_judgments(spark, args.judgments), domain.load_affinities(spark, args.affinities), chosen)
    sinks.write_json(args.output, record)
    return 0


def _domain_lines(rows: DataFrame):
    """Domain rows as the readers take them: metadata is an object again."""
    for r in rows.orderBy("id").toLocalIterator():
        record = sinks.plain(r)
        record["metadata"] = json.loads(record["metadata"] or "{}")
        yield (json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()


def _sources(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    found = {}
    for k in _PATHS:
        if v := getattr(args, k, None):
            rows = fingerprints(spark, v).orderBy("path").select(F.col("bytes"), F.col("sha256")).collect()
            found[k] = [r.asDict() for r in rows]
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("arbiter").getOrCreate()
    try:
        return run(args, spark)
    except PySparkException as error:
        found = translate(error)
        if found is None:
            raise
        print(f"error: {found}", file=sys.stderr)
        return 2
    except (DataValidationError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    finally:
        if own:
            release(spark)


if __name__ == "__main__":
    sys.exit(main())
