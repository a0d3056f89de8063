"""Artifacts that are read back and held against their own claims: frozen vectors and plans."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from arbiter.errors import DataValidationError
from arbiter.operators.assignment import COUNTERS, REASONS
from arbiter.sources.domain import load_vectors
from arbiter.sources.sinks import Captured
from arbiter.sources.strict import decode, loads

#: What a manifest of frozen vectors says. Fixed values.
VECTOR_ADAPTER = "openreview-specter-family-jsonl-v1"
VECTOR_FAMILIES = ("specter", "specter2", "scincl")
VECTOR_ORIGINS = ("synthetic-fixture", "external-encoder")
VECTOR_FILES = ("submissions.jsonl", "publications.jsonl")

#: States of a run's diagnostics. Fixed values.
STATES = ("satisfied", "infeasible", "not_certified")

_ANY = object()


def fields(value: Any, what: str, **rules: Callable[[Any], bool] | tuple) -> Mapping[str, Any]:
    """An object with exactly these fields, each of which keeps its rule: a test, or a (test, default) for one that may lack."""
    if not isinstance(value, Mapping):
        raise DataValidationError(f"{what} must be an object")
    if extra := set(value) - set(rules):
        raise DataValidationError(f"{what} has unknown fields: {sorted(extra)}")
    out = {}
    for name, rule in rules.items():
        test, default = rule if isinstance(rule, tuple) else (rule, _ANY)
        if name not in value and default is _ANY:
            raise DataValidationError(f"{what} lacks {name}")
        out[name] = value.get(name, default)
        if name in value and not test(value[name]):
            raise DataValidationError(f"{what}: {name} isn't valid")
    return out


def _text(value: Any) -> bool:
    return isinstance(value, str) and 0 < len(value) <= 256


def _digest(value: Any) -> bool:
    return isinstance(value, str) and re.fullmatch("[0-9a-f]{64}", value) is not None


def _count(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def _real(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def _mapping(value: Any) -> bool:
    return isinstance(value, Mapping)


def _list(value: Any) -> bool:
    return isinstance(value, list)


def _one_of(*values: Any) -> Callable[[Any], bool]:
    return lambda v: type(v) is type(values[0]) and v in values


def request_digest(requests: DataFrame) -> str:
    """SHA-256 of what an encoder was asked for: canonical JSON of (paper_id, title, abstract) in the order of ids."""
    digest = hashlib.sha256(b"[")
    for k, r in enumerate(requests.select("abstract", "paper_id", "title").orderBy("paper_id").toLocalIterator()):
        digest.update((b"," if k else b"") + json.dumps(r.asDict(), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode())
    digest.update(b"]")
    return digest.hexdigest()


class FrozenVectors:
    """A folder of vectors with a manifest that names the encoder, the requests and the files by digest."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.inputs = Captured(VECTOR_ADAPTER, {}, **{n: self.folder / n for n in ("manifest.json", *VECTOR_FILES)})
        m = fields(loads(decode(self.inputs.content["manifest.json"])), "manifest", schema_version=_one_of(1), adapter=_one_of(VECTOR_ADAPTER), encoder=_mapping, requests=_mapping, files=_mapping)
        encoder = fields(m["encoder"], "encoder", family=_one_of(*VECTOR_FAMILIES), model_id=_text, revision=_text, origin=_one_of(*VECTOR_ORIGINS), weights_sha256=lambda v: v is None or _digest(v))
        if (encoder["weights_sha256"] is None) != (encoder["origin"] == VECTOR_ORIGINS[0]):
            raise DataValidationError("weights have a digest if, and only if, an encoder made the vectors")
        self.encoder = dict(encoder)
        self.requests = fields(m["requests"], "requests", submissions_sha256=_digest, publications_sha256=_digest)
        claimed = fields(m["files"], "files", **dict.fromkeys(VECTOR_FILES, _mapping))
        there = self.inputs.record()["inputs"]
        if wrong := [n for n in VECTOR_FILES if dict(claimed[n]) != there[n]]:
            raise DataValidationError(f"files aren't what the manifest says: {', '.join(wrong)}")

    def load(self, spark: SparkSession, submissions: DataFrame, publications: DataFrame, dimensions: int = 768) -> tuple[DataFrame, DataFrame]:
        """(submission vectors, publication vectors) if they were made for exactly these texts."""
        for kind, asked in (("submissions", submissions), ("publications", publications)):
            if request_digest(asked) != self.requests[f"{kind}_sha256"]:
                raise DataValidationError(f"the vectors were made for other {kind}")
        return tuple(load_vectors(spark, str(self.folder / n), asked, dimensions) for n, asked in zip(VECTOR_FILES, (submissions, publications)))


def plan_shape(value: Any) -> dict[str, Any]:
    """A plan record whose fields are those of a plan."""
    plan = fields(value, "plan", assignments=(_list, []), unmet=(_mapping, {}), strategy=(_text, "unknown"), total_score=(_real, None), diagnostics=(lambda v: v is None or _mapping(v), None), audit=(lambda v: True, None), scores=(_list, None))
    rows = [dict(fields(r, "assignment", document_id=_text, expert_id=_text, score=_real, rank=lambda v: _count(v) and v > 0, components=(_mapping, {}))) for r in plan["assignments"]]
    if any(not _real(x) for r in rows for x in r["components"].values()):
        raise DataValidationError("components must be numbers")
    if not all(_count(n) for n in plan["unmet"].values()):
        raise DataValidationError("unmet demands must be counts")
    return {**plan, "assignments": rows}


def read_plan(value: Any) -> dict[str, Any]:
    """A plan record whose parts agree too: scores with the total, pairs with the diagnostics, these with their sums and state."""
    plan = plan_shape(value)
    rows = plan["assignments"]
    total = math.fsum(r["score"] for r in rows)
    if plan["total_score"] is not None and not math.isclose(plan["total_score"], total, rel_tol=1e-12, abs_tol=1e-12):
        raise DataValidationError("the total isn't the sum of the scores")
    found = None if plan["diagnostics"] is None else _diagnostics(plan["diagnostics"])
    if found is not None:
        assigned = Counter(r["document_id"] for r in rows)
        if any(assigned[d["document_id"]] != d["assigned"] for d in found["documents"]) or set(assigned) - {d["document_id"] for d in found["documents"]}:
            raise DataValidationError("the diagnostics don't count the plan's assignments")
        if {d["document_id"]: d["unmet"] for d in found["documents"] if d["unmet"]} != {d: n for d, n in plan["unmet"].items() if n}:
            raise DataValidationError("the diagnostics' unmet demands aren't the plan's")
    return {**plan, "total_score": total if plan["total_score"] is None else plan["total_score"], "diagnostics": found}


def _diagnostics(value: Any) -> dict[str, Any]:
    run = dict(fields(value, "diagnostics", status=_one_of(*STATES), certified=_one_of(True, False), requested=_count, assigned=_count, unmet=_count, documents=_list))
    rows = [fields(d, "document diagnostics", document_id=_text, requested=_count, assigned=_count, unmet=_count, reason_codes=(_list, []), evidence=_mapping, saturated_experts=(_list, [])) for d in run["documents"]]
    for d in rows:
        if not set(d["reason_codes"]) <= set(REASONS) or len(set(d["reason_codes"])) != len(d["reason_codes"]):
            raise DataValidationError("reason codes must be known and different")
        if not set(d["evidence"]) <= set(COUNTERS) or not all(_count(n) for n in d["evidence"].values()):
            raise DataValidationError("evidence must be known counts")
        if not all(_text(e) for e in d["saturated_experts"]):
            raise DataValidationError("saturated experts must be ids")
    if len({d["document_id"] for d in rows}) != len(rows):
        raise DataValidationError("documents must be diagnosed once")
    for one in (run, *rows):
        if one["assigned"] + one["unmet"] != one["requested"]:
            raise DataValidationError("assigned and unmet demand must make up what was requested")
    if any(sum(d[k] for d in rows) != run[k] for k in ("requested", "assigned")):
        raise DataValidationError("the run's counts must be the sums of its documents'")
    if (run["status"] == "satisfied") != (run["unmet"] == 0) or run["certified"] != (run["status"] != "not_certified"):
        raise DataValidationError("the run's state doesn't follow from its counts")
    return {**run, "documents": sorted(rows, key=lambda d: d["document_id"])}
