"""Publishing: the edge table of an audited plan, and the create-only reconcile loop.

The edges are a DataFrame; the loop stays on the driver, because its order and
its read-backs are what make it safe. Dry-run is the default.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.errors import DataValidationError
from arbiter.operators import audit

MAX_ASSIGNMENTS, MAX_BATCH = 1000, 100


@dataclass(frozen=True)
class Scope:
    assignment_invitation: str
    score_invitation: str
    reviewer_group: str
    label: str
    paper_ids: tuple[str, ...]
    reviewer_ids: tuple[str, ...]

    def __post_init__(self) -> None:
        for x in (self.assignment_invitation, self.score_invitation, self.reviewer_group, self.label, *self.paper_ids, *self.reviewer_ids):
            if not isinstance(x, str) or not x or any(c.isspace() or not c.isprintable() for c in x) or len(x.encode()) > 512:
                raise DataValidationError(f"not a publishable identifier: {x!r}")
        if self.assignment_invitation == self.score_invitation:
            raise DataValidationError("the two invitations must differ")
        for name in ("paper_ids", "reviewer_ids"):
            ids = getattr(self, name)
            if not ids or len(set(ids)) != len(ids):
                raise DataValidationError(f"{name} must be distinct and not empty")
            object.__setattr__(self, name, tuple(sorted(ids)))


@dataclass(frozen=True, order=True)
class Edge:
    invitation: str
    head: str
    tail: str
    label: str
    weight: float


@dataclass(frozen=True)
class Plan:
    scope: Scope
    edges: tuple[Edge, ...]
    digest: str


@dataclass(frozen=True)
class Receipt:
    digest: str
    status: str
    planned: int
    confirmed: int
    batches: int
    reason: str | None = None


class Transport(Protocol):
    """What a site offers: its context, the edges that are there, and an atomic create-only post."""

    def inspect_context(self, scope: Scope) -> Scope: ...

    def read_edges(self, scope: Scope) -> tuple[Edge, ...]: ...

    def post_edges(self, edges: tuple[Edge, ...]) -> None: ...


def edge_table(assignments: DataFrame, assignment_invitation: str, score_invitation: str, label: str) -> DataFrame:
    """Two edges for each assignment: (invitation, head, tail, label, weight)."""
    both = F.explode(F.array(F.lit(assignment_invitation), F.lit(score_invitation))).alias("invitation")
    return assignments.select(both, F.col("document_id").alias("head"), F.col("expert_id").alias("tail"), F.lit(label).alias("label"), F.col("score").alias("weight"))


def _digest(scope: Scope, edges: tuple[Edge, ...]) -> str:
    body = {"scope": scope.__dict__, "edges": [e.__dict__ for e in edges]}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def prepare(assignments: DataFrame, documents: DataFrame, experts: DataFrame, conflicts: DataFrame | None, scope: Scope, default_demand: int = 2, require_distinct_institutions: bool = False) -> Plan:
    """The plan of a complete assignment that passes its audit and covers the scope exactly."""
    for what, ids, rows, key in (("paper_ids", scope.paper_ids, documents, "document_id"), ("reviewer_ids", scope.reviewer_ids, experts, "expert_id")):
        given = documents.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        if not given.join(rows.select(F.col(key).alias("there")), F.col("id") == F.col("there"), "full").filter("id is null or there is null").isEmpty():
            raise DataValidationError(f"{what} must be those of the audited tables")
    found = audit.tables(assignments, documents, experts, conflicts, default_demand)
    one = audit.summary(found, require_distinct_institutions).first()
    if not one.safe or one.demand_coverage != 1:
        raise DataValidationError("only a complete plan that passes its audit can be published")
    rows = edge_table(assignments, scope.assignment_invitation, scope.score_invitation, scope.label).limit(2 * MAX_ASSIGNMENTS + 1).collect()
    if not rows or len(rows) > 2 * MAX_ASSIGNMENTS:
        raise DataValidationError(f"a publish plan has 1 to {MAX_ASSIGNMENTS} assignments")
    edges = tuple(sorted(Edge(*r) for r in rows))
    if len({(e.invitation, e.head, e.tail) for e in edges}) != len(edges):
        raise DataValidationError("the plan has repeated edges")
    return Plan(scope, edges, _digest(scope, edges))


def _remote(plan: Plan, transport: Transport) -> frozenset[Edge]:
    """The edges that are there; anything the plan doesn't have fails."""
    if transport.inspect_context(plan.scope) != plan.scope:
        raise DataValidationError("the site's invitations, group or papers have changed")
    rows = tuple(transport.read_edges(plan.scope))
    if len(set(rows)) != len(rows) or set(rows) - set(plan.edges):
        raise DataValidationError("the site has edges that differ from the plan")
    return frozenset(rows)


def publish(plan: Plan, transport: Transport | None = None, write: bool = False, confirm_sha256: str | None = None, batch_size: int = 50) -> Receipt:
    """Post what is missing, batch by batch, and read back after each; an unclear batch ends the run as incomplete."""
    if _digest(plan.scope, plan.edges) != plan.digest:
        raise DataValidationError("the plan's digest doesn't match its edges")
    if isinstance(batch_size, bool) or not isinstance(batch_size, int) or not 1 <= batch_size <= MAX_BATCH:
        raise DataValidationError(f"batch_size must be from 1 to {MAX_BATCH}")
    n = len(plan.edges)
    if not write:
        return Receipt(plan.digest, "dry_run", n, 0, 0)
    if transport is None or confirm_sha256 != plan.digest:
        raise DataValidationError("writing needs a transport and the plan's exact digest")
    there, batches = _remote(plan, transport), 0
    while pending := [e for e in plan.edges if e not in there]:
        batch, failed = tuple(pending[:batch_size]), False
        batches += 1
        try:
            transport.post_edges(batch)
        except Exception:  # what arrived is only known after the read-back
            failed = True
        try:
            now = _remote(plan, transport)
        except Exception:
            return Receipt(plan.digest, "incomplete", n, len(there), batches, "readback_unavailable")
        if failed or not there <= now or not set(batch) <= now:
            return Receipt(plan.digest, "incomplete", n, len(now), batches, "unconfirmed_batch")
        there = now
    return Receipt(plan.digest, "complete", n, len(there), batches)


def write_artifact(plan: Plan, path: str | Path) -> None:
    """Write the plan as JSON; a file that exists is never replaced."""
    body = {"scope": plan.scope.__dict__, "edges": [e.__dict__ for e in plan.edges], "sha256": plan.digest}
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
