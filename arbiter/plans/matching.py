"""Whole runs: scores, plan, diagnostics and audit as one bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter import schemas
from arbiter.config import MatchConfig
from arbiter.operators import audit
from arbiter.operators.assignment import assign, check_sizes, diagnostics, run_status, unmet
from arbiter.operators.scoring import affinity_scores, pair_scores
from arbiter.storage import materialise


@dataclass(frozen=True)
class Run:
    """One match: the tables that a plan, its explanation and its audit consist of."""

    config: MatchConfig
    documents: DataFrame
    experts: DataFrame
    conflicts: DataFrame
    scores: DataFrame
    assignments: DataFrame
    diagnostics: DataFrame

    @property
    def certified(self) -> bool:
        return self.config.strategy != "greedy"

    @property
    def status(self) -> DataFrame:
        return run_status(self.diagnostics, self.certified)

    @property
    def unmet(self) -> DataFrame:
        return unmet(self.assignments, self.documents, self.config)

    def audit_tables(self) -> dict[str, DataFrame]:
        return audit.tables(self.assignments, self.documents, self.experts, self.conflicts, self.config.reviewers_per_document)

    @property
    def audit(self) -> DataFrame:
        return audit.summary(self.audit_tables(), self.config.require_distinct_institutions)

    def plan_record(self) -> dict:
        """The plan as one JSON-ready record. Plans are small."""
        parts = self.scores.select("document_id", "expert_id", F.create_map(*[x for c in ("content", "topics", "bid", "recency", "seniority") for x in (F.lit(c), F.col(c))]).alias("components"))
        rows = self.assignments.join(parts, ["document_id", "expert_id"]).orderBy("document_id", "rank").collect()
        status = self.status.first()
        documents = []
        for d in self.diagnostics.orderBy("document_id").toLocalIterator():
            counters = {c: d[c] for c in d.asDict() if c not in ("document_id", "requested", "assigned", "unmet", "saturated_experts", "reason_codes")}
            documents.append({**{c: d[c] for c in ("document_id", "requested", "assigned", "unmet", "reason_codes", "saturated_experts")}, "evidence": counters})
        return {
            "strategy": self.config.label,
            "total_score": sum(r.score for r in rows),
            "unmet": {r.document_id: r.unmet for r in self.unmet.collect()},
            "assignments": [{"document_id": r.document_id, "expert_id": r.expert_id, "score": r.score, "rank": r["rank"], "components": r.components} for r in rows],
            "diagnostics": {**status.asDict(), "documents": documents},
        }

    def audit_record(self) -> dict:
        return audit_record(self.audit_tables(), self.config.require_distinct_institutions)


def audit_record(found: dict[str, DataFrame], distinct_institutions: bool) -> dict:
    """An audit as one JSON-ready record: figures, lists of what is broken, loads."""
    one = audit.summary(found, distinct_institutions).first()
    listed: dict[str, list] = {k: [] for k in (*audit.UNSAFE, "institution_duplicates")}
    for r in audit.violations(found).orderBy("kind", "document_id", "expert_id", "institution").toLocalIterator():
        ids = [x for x in (r.document_id, r.expert_id, r.institution) if x is not None]
        listed[r.kind].append(ids[0] if len(ids) == 1 else ids)
    duplicates: dict[str, list] = {}
    for d, i in listed.pop("institution_duplicates"):
        duplicates.setdefault(d, []).append(i)
    figures = {k: one[k] for k in ("document_coverage", "demand_coverage", "average_score", "minimum_score", "workload_gini", "safe")}
    workload = {r.expert_id: r.load for r in found["workload"].orderBy("expert_id").toLocalIterator()}
    return {**figures, **listed, "institution_duplicates": duplicates, "institution_diversity_required": distinct_institutions, "workload": workload}


def _run(scores: DataFrame, documents: DataFrame, experts: DataFrame, conflicts: DataFrame, config: MatchConfig) -> Run:
    check_sizes(documents, experts, config)
    # Scores are used three times: to solve, to explain, to write. They are made once.
    scores = materialise(scores, "scores")
    assignments = materialise(assign(scores, documents, experts, config), "assignments")
    return Run(config, documents, experts, conflicts, scores, assignments, diagnostics(assignments, scores, documents, experts, conflicts, config))


def run_matching(documents: DataFrame, experts: DataFrame, conflicts: DataFrame, config: MatchConfig | None = None, candidates: DataFrame | None = None) -> Run:
    config = config or MatchConfig()
    schemas.check_references(conflicts, documents, experts, "conflicts")
    return _run(pair_scores(documents, experts, conflicts, config, candidates), documents, experts, conflicts, config)


def run_affinity_matching(documents: DataFrame, experts: DataFrame, affinities: DataFrame, conflicts: DataFrame, config: MatchConfig | None = None) -> Run:
    config = config or MatchConfig()
    schemas.check_references(conflicts, documents, experts, "conflicts")
    schemas.check_references(affinities, documents, experts, "affinities")
    schemas.unique(affinities, "affinity pairs", "document_id", "expert_id")
    schemas.check_unit(affinities, "score", "affinities")
    return _run(affinity_scores(affinities, experts, conflicts), documents, experts, conflicts, config)


def score_without_exclusions(documents: DataFrame, experts: DataFrame, config: MatchConfig) -> DataFrame:
    """Pair scores as if nobody had a conflict and everybody had capacity, for what-if runs."""
    return pair_scores(documents, experts.withColumn("capacity", F.greatest("capacity", F.lit(1))), None, config)
