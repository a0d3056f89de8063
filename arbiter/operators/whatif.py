"""What-if scenarios: independent reruns with other capacities and conflicts, compared with the baseline.

All scenarios are one DataFrame: scenario id x pairs. Each is solved in a task
of its own.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.config import MatchConfig
from arbiter.errors import DataValidationError
from arbiter.operators import audit
from arbiter.operators.assignment import _selected, admissible, contenders, demands, limits, places_of, slots_of
from arbiter.schemas import check_references, refuse
from arbiter.storage import materialise

BASELINE = "baseline"
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


@dataclass(frozen=True)
class Scenario:
    id: str
    capacity_overrides: Mapping[str, int] = field(default_factory=dict)
    add_conflicts: tuple[tuple[str, str], ...] = ()
    remove_conflicts: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if not isinstance(self.id, str) or not _ID.fullmatch(self.id) or self.id == BASELINE:
            raise DataValidationError(f"not a scenario id: {self.id!r}")
        if len(self.capacity_overrides) > 128 or any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in self.capacity_overrides.values()):
            raise DataValidationError("capacity overrides must be at most 128 whole numbers from 0")
        for name in ("add_conflicts", "remove_conflicts"):
            pairs = tuple(map(tuple, getattr(self, name)))
            if any(len(q) != 2 or not all(isinstance(x, str) and x and x.strip() == x for x in q) for q in pairs) or len(set(pairs)) != len(pairs):
                raise DataValidationError(f"{name} must be distinct pairs of ids")
            object.__setattr__(self, name, tuple(sorted(pairs)))
        if set(self.add_conflicts) & set(self.remove_conflicts):
            raise DataValidationError("a conflict can't be both added and removed")
        if not (self.capacity_overrides or self.add_conflicts or self.remove_conflicts):
            raise DataValidationError(f"scenario {self.id} changes nothing")


def parse_plan(values: Mapping[str, Any]) -> tuple[Scenario, ...]:
    """Scenarios of a plan file: schema_version 1 and 1 to 8 scenarios with distinct ids."""
    if set(values) != {"schema_version", "scenarios"} or values["schema_version"] != 1 or not isinstance(values["scenarios"], list):
        raise DataValidationError("a what-if plan has schema_version 1 and scenarios")
    if not 1 <= len(values["scenarios"]) <= 8:
        raise DataValidationError("a what-if plan has 1 to 8 scenarios")
    allowed = {"id", "capacity_overrides", "add_conflicts", "remove_conflicts"}
    for s in values["scenarios"]:
        if not isinstance(s, dict) or "id" not in s or set(s) - allowed:
            raise DataValidationError("a scenario has an id, capacity_overrides, add_conflicts and remove_conflicts")
    found = tuple(Scenario(s["id"], s.get("capacity_overrides", {}), tuple(map(tuple, s.get("add_conflicts", []))), tuple(map(tuple, s.get("remove_conflicts", [])))) for s in values["scenarios"])
    if len({s.id for s in found}) != len(found):
        raise DataValidationError("scenario ids must be unique")
    return found


@dataclass(frozen=True)
class Comparison:
    """Tables by scenario, baseline included: assignments, results, deltas, workload."""

    assignments: DataFrame
    results: DataFrame
    delta: DataFrame
    workload: DataFrame


def compare(scenarios: tuple[Scenario, ...], scores_without_conflicts: DataFrame, documents: DataFrame, experts: DataFrame, conflicts: DataFrame, config: MatchConfig | None = None) -> Comparison:
    """Solve the baseline and every scenario and compare.

    `scores_without_conflicts` are the pair scores as if nobody had a conflict
    and everybody had capacity, since scenarios add and remove both.
    """
    config = config or MatchConfig()
    spark = documents.sparkSession
    pair = ["document_id", "expert_id"]
    ids = spark.createDataFrame([(BASELINE,), *[(s.id,) for s in scenarios]], "scenario string")
    caps = spark.createDataFrame([(s.id, e, n) for s in scenarios for e, n in s.capacity_overrides.items()], "scenario string, expert_id string, override int")
    added = spark.createDataFrame([(s.id, *q) for s in scenarios for q in s.add_conflicts], "scenario string, document_id string, expert_id string")
    removed = spark.createDataFrame([(s.id, *q) for s in scenarios for q in s.remove_conflicts], "scenario string, document_id string, expert_id string")
    refuse(caps.join(experts, "expert_id", "left_anti"), "capacity overrides name unknown experts", "expert_id")
    check_references(added, documents, experts, "added conflicts")
    refuse(removed.join(conflicts, pair, "left_anti"), "removed conflicts aren't there", *pair)
    refuse(added.join(conflicts, pair, "left_semi"), "added conflicts are there already", *pair)
    keys = ["scenario", *pair]
    held = ids.crossJoin(conflicts.select(*pair).distinct()).join(removed, keys, "left_anti").unionByName(added)  # at most 9 ids
    room = ids.crossJoin(limits(experts, config).join(places_of(experts.select("expert_id"), "expert_id"), "expert_id"))
    room = room.join(caps, ["scenario", "expert_id"], "left").withColumn("capacity", F.coalesce("override", "capacity")).drop("override")
    pairs = admissible(scores_without_conflicts, config).select(*pair, "total").join(room.filter("capacity > 0"), "expert_id").join(held, keys, "left_anti")
    pairs = contenders(pairs, slots_of(documents, config), config, "scenario")
    problems = ids.crossJoin(demands(documents, config)).join(pairs, ["scenario", "document_id"], "left")
    chosen = _selected(problems, config, "scenario").join(scores_without_conflicts.select(*pair, F.col("total").alias("score")), pair)
    chosen = chosen.select(*keys, "score", F.row_number().over(Window.partitionBy("scenario", "document_id").orderBy(F.desc("score"), "expert_id")).alias("rank"))
    chosen = materialise(chosen, "scenarios")
    for s in (BASELINE, *[x.id for x in scenarios]):
        mine = chosen.filter(F.col("scenario") == s)
        limited = experts.drop("capacity").join(room.filter(F.col("scenario") == s).select("expert_id", "capacity"), "expert_id")
        found = audit.tables(mine, documents, limited, held.filter(F.col("scenario") == s), config.reviewers_per_document)
        if not audit.summary(found, config.require_distinct_institutions).first().safe:
            raise DataValidationError(f"the plan of scenario {s} fails its audit")
    asked = demands(documents, config).agg(F.sum("demand").alias("requested"))
    results = ids.join(chosen.groupBy("scenario").agg(F.count("*").alias("assigned"), F.sum("score").alias("total_score")), "scenario", "left").crossJoin(asked)
    results = results.select("scenario", F.coalesce("assigned", F.lit(0)).alias("assigned"), (F.col("requested") - F.coalesce("assigned", F.lit(0))).alias("unmet"), F.coalesce("total_score", F.lit(0.0)).alias("total_score"))
    base = results.filter(F.col("scenario") == BASELINE).select(*[F.col(c).alias(f"b_{c}") for c in ("assigned", "unmet", "total_score")])
    before, after = chosen.filter(F.col("scenario") == BASELINE).select(*pair), chosen.filter(F.col("scenario") != BASELINE).select(*keys)
    every = ids.filter(F.col("scenario") != BASELINE)
    new = after.join(before, pair, "left_anti").groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct(*pair))).alias("added_assignments"))
    gone = every.crossJoin(before).join(after, keys, "left_anti").groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct(*pair))).alias("removed_assignments"))
    none = F.array().cast("array<struct<document_id:string,expert_id:string>>")
    delta = results.join(every, "scenario").crossJoin(base).join(new, "scenario", "left").join(gone, "scenario", "left")
    delta = delta.select("scenario", *[(F.col(c) - F.col(f"b_{c}")).alias(c) for c in ("assigned", "unmet", "total_score")], *[F.coalesce(c, none).alias(c) for c in ("added_assignments", "removed_assignments")])
    workload = room.select("scenario", "expert_id").join(chosen.groupBy("scenario", "expert_id").agg(F.count("*").alias("load")), ["scenario", "expert_id"], "left").select("scenario", "expert_id", F.coalesce("load", F.lit(0)).alias("load"))
    return Comparison(chosen, results, delta, workload)
