"""Assignment: relational pruning, a kernel for each independent part, the ranked plan.

Scores are pruned to admissible pairs before anything leaves the JVM, and only
ids, scores and limits do. Of these, `optimal`, `greedy` and `minmax` only get
the pairs that a plan can hold (`contenders`), so what a kernel gets grows with
documents and slots, not with experts. Parts of the pair graph that share no expert and no
document don't influence each other under `optimal` and `greedy`; beyond
`split_pairs` pairs each part is solved in a task of its own. The other
strategies have one bound for the whole run (a load cap, a score floor, a
sorted vector) and are solved as one problem.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.config import MatchConfig
from arbiter.errors import DataValidationError
from arbiter.functions.numbers import FIXED
from arbiter.operators.components import components
from arbiter.operators.solvers import Problem, solve
from arbiter.schemas import unique
from arbiter.storage import materialise

#: (documents, experts, admissible pairs, requested slots, total capacity) up to which a strategy is meant to run. Fixed values.
CEILINGS = {"maximin": (6, 8, 16, None, None), "maximin-flow": (24, 48, 256, 64, 256), "fair-local": (128, 256, 4096, 512, 4096)}


def demands(documents: DataFrame, config: MatchConfig) -> DataFrame:
    return documents.select("document_id", F.coalesce(F.col("required_experts"), F.lit(config.reviewers_per_document)).alias("demand"))


def limits(experts: DataFrame, config: MatchConfig) -> DataFrame:
    """(expert_id, capacity, institution, senior)."""
    return experts.select("expert_id", "capacity", "institution", (F.col("seniority") >= config.senior_threshold).alias("senior"))


def admissible(scores: DataFrame, config: MatchConfig) -> DataFrame:
    return scores.filter(F.col("eligible") & (F.col("total") >= config.minimum_score))


def check_sizes(documents: DataFrame, experts: DataFrame, config: MatchConfig) -> None:
    """Refuse a run whose documents, experts, slots or capacities are above its strategy's ceilings: before anything is scored."""
    if config.strategy not in CEILINGS or not config.enforce_ceilings:
        return
    d = demands(documents, config).agg(F.count("*").alias("n"), F.sum("demand").alias("slots")).first()
    e = experts.agg(F.count("*").alias("n"), F.sum("capacity").alias("room")).first()
    found = {"documents": d.n, "experts": e.n, "requested slots": d.slots or 0, "total capacity": e.room or 0}
    docs, people, _, slots, room = CEILINGS[config.strategy]
    over = [f"{most} {name}" for (name, n), most in zip(found.items(), (docs, people, slots, room)) if most is not None and n > most]
    if over:
        raise DataValidationError(f"{config.strategy} supports at most {', '.join(over)}")


def _check_pairs(pairs: DataFrame, config: MatchConfig) -> None:
    if config.strategy in CEILINGS and config.enforce_ceilings and pairs.limit(CEILINGS[config.strategy][2] + 1).count() > CEILINGS[config.strategy][2]:
        raise DataValidationError(f"{config.strategy} supports at most {CEILINGS[config.strategy][2]} eligible pairs")


def _problem(pdf: pd.DataFrame) -> Problem:
    d = pdf.drop_duplicates("document_id")
    e = pdf[pdf["expert_id"].notna()].drop_duplicates("expert_id")
    pairs = pdf[pdf["expert_id"].notna()]
    text = lambda x: None if pd.isna(x) else str(x)
    return Problem(
        pairs=dict(zip(zip(pairs["document_id"], pairs["expert_id"]), pairs["total"].astype(float))),
        demand=dict(zip(d["document_id"], d["demand"].astype(int))),
        capacity=dict(zip(e["expert_id"], e["capacity"].astype(int))),
        institution=dict(zip(e["expert_id"], map(text, e["institution"]))),
        senior=dict(zip(e["expert_id"], e["senior"].astype(bool))),
        index=dict(zip(e["expert_id"], e["place"].astype(int))),
    )


def places_of(ids: DataFrame, key: str) -> DataFrame:
    """(key, place) with places from 0 in the order of the ids: ranges are sorted on their own and shifted by the rows before them."""
    ranged = materialise(ids.repartitionByRange(key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("part")), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return ranged.withColumn("here", here).join(F.broadcast(before), "part").select(key, (F.col("here") + F.col("before")).alias("place"))


def contenders(pairs: DataFrame, slots: int, config: MatchConfig, *keys: str) -> DataFrame:
    """Of each document the first `slots` pairs in a strategy's own order (of each institution and seniority, where these count).

    No plan loses by it. All other slots together use fewer experts than that,
    so beside a pair further down there is always one of the first whose
    expert has no document: it may be taken instead, by all rules, and comes
    first in what the strategy compares. Other strategies get all pairs.
    """
    if config.strategy not in ("optimal", "greedy", "minmax"):
        return pairs
    groups = [*keys, "document_id"] + ["senior"] * bool(config.minimum_senior_reviewers) + ["institution"] * config.require_distinct_institutions
    best = F.col("total") if config.strategy == "greedy" else F.rint(F.col("total") * FIXED)
    order = Window.partitionBy(*groups).orderBy(best.desc(), "expert_id")
    return pairs.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= slots).drop("at")


def slots_of(documents: DataFrame, config: MatchConfig) -> int:
    return demands(documents, config).agg(F.sum("demand").alias("n")).first().n or 0


def solver_input(scores: DataFrame, documents: DataFrame, experts: DataFrame, config: MatchConfig) -> DataFrame:
    """The pruned pairs with all that a kernel needs; documents without a pair stand there with no expert."""
    places = places_of(experts.select("expert_id"), "expert_id")
    pairs = admissible(scores, config).select("document_id", "expert_id", "total")
    pairs = contenders(pairs.join(limits(experts, config).filter("capacity > 0"), "expert_id"), slots_of(documents, config), config).join(places, "expert_id")
    return demands(documents, config).join(pairs, "document_id", "left")


def _selected(problems: DataFrame, config: MatchConfig, *keys: str) -> DataFrame:
    """The chosen pairs of every problem, one problem for each value of `keys`."""
    kinds = {f.name: f.dataType.simpleString() for f in problems.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = sorted(solve(_problem(pdf), config))
        return pd.DataFrame([(*key, d, e) for d, e in chosen], columns=[*keys, "document_id", "expert_id"])

    return problems.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "document_id", "expert_id")))


def choose(scores: DataFrame, documents: DataFrame, experts: DataFrame, config: MatchConfig, split_pairs: int = 200_000) -> DataFrame:
    """(document_id, expert_id) of the plan."""
    check_sizes(documents, experts, config)
    pairs = admissible(scores, config)
    unique(pairs, "admissible pairs", "document_id", "expert_id")
    _check_pairs(pairs, config)
    rows = materialise(solver_input(scores, documents, experts, config), "problem")
    if config.strategy in ("optimal", "greedy"):
        edges = rows.filter("expert_id is not null")
        if edges.count() > split_pairs:
            found = components(edges.select(F.concat(F.lit("d"), "document_id").alias("u"), F.concat(F.lit("e"), "expert_id").alias("v")))
            part = found.select(F.expr("substring(node, 2)").alias("document_id"), F.col("root").alias("part")).filter("node like 'd%'")
            return _selected(edges.join(part, "document_id"), config, "part").select("document_id", "expert_id")
    return _selected(rows.withColumn("part", F.lit(0)), config, "part").select("document_id", "expert_id")


def assign(scores: DataFrame, documents: DataFrame, experts: DataFrame, config: MatchConfig | None = None, **options) -> DataFrame:
    """(document_id, expert_id, score, rank): each document's chosen experts, best first."""
    config = config or MatchConfig()
    chosen = choose(scores, documents, experts, config, **options)
    rows = chosen.join(scores.select("document_id", "expert_id", F.col("total").alias("score")), ["document_id", "expert_id"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "expert_id")))


def unmet(assignments: DataFrame, documents: DataFrame, config: MatchConfig) -> DataFrame:
    """(document_id, unmet) of the documents that are short."""
    got = assignments.groupBy("document_id").agg(F.count("*").alias("n"))
    short = demands(documents, config).join(got, "document_id", "left").select("document_id", (F.col("demand") - F.coalesce("n", F.lit(0))).alias("unmet"))
    return short.filter("unmet > 0")


def objective(assignments: DataFrame, documents: DataFrame, experts: DataFrame, config: MatchConfig) -> DataFrame:
    """One row: what the strategies compare. Ties beyond it may be resolved either way."""
    per_doc = documents.select("document_id").join(assignments.groupBy("document_id").agg(F.sum("score").alias("s")), "document_id", "left").agg(F.min(F.coalesce("s", F.lit(0.0))).alias("weakest_document"))
    loads = experts.select("expert_id").join(assignments.groupBy("expert_id").agg(F.count("*").alias("n")), "expert_id", "left").agg(F.max(F.coalesce("n", F.lit(0))).alias("highest_load"))
    total = assignments.agg(F.count("*").alias("assigned"), F.sum(F.round(F.col("score") * 1_000_000).cast("long")).alias("fixed_score"), F.min("score").alias("lowest_score"))
    return total.crossJoin(per_doc).crossJoin(loads)  # one row each


# Shortage diagnostics -------------------------------------------------------

#: Reason codes in the order in which they are listed. Fixed values.
REASONS = (
    "hard_conflict", "other_ineligible", "zero_capacity", "minimum_score", "sparse_score_matrix", "candidate_scarcity", "expert_capacity", "seniority_floor",
    "institution_diversity", "global_capacity_coupling", "greedy_not_certified",
)
COUNTERS = (
    "total_experts", "scored_pairs", "unscored_experts", "hard_conflict_pairs", "other_ineligible_pairs", "zero_capacity_pairs", "eligible_pairs", "below_minimum_score_pairs",
    "admissible_pairs", "senior_admissible_pairs", "senior_assigned", "institution_groups", "institution_blocked_pairs", "saturated_admissible_experts",
)


def _group() -> Column:
    """An expert's institution; an unknown one is a group of its own."""
    return F.when(F.col("institution").isNotNull(), F.concat(F.lit("i:"), "institution")).otherwise(F.concat(F.lit("e:"), "expert_id"))


def diagnostics(assignments: DataFrame, scores: DataFrame, documents: DataFrame, experts: DataFrame, conflicts: DataFrame | None = None, config: MatchConfig | None = None, certified: bool | None = None) -> DataFrame:
    """One row a document: requested, assigned, unmet, the counters, saturated_experts and reason_codes.

    The codes are overlapping evidence and no unique cause. One aggregate over
    the scores with conditional counts gives all counters.
    """
    config = config or MatchConfig()
    certified = config.strategy != "greedy" if certified is None else certified
    pair = ["document_id", "expert_id"]
    e = limits(experts, config).withColumn("group", _group())
    load = assignments.groupBy("expert_id").agg(F.count("*").alias("load"))
    mine = assignments.select(*pair).withColumn("chosen", F.lit(True))
    held = assignments.select(*pair).join(e, "expert_id").groupBy("document_id").agg(
        F.collect_set("group").alias("held"), F.sum(F.col("senior").cast("long")).alias("senior_assigned"), F.count("*").alias("assigned"),
    )
    known = (conflicts.select(*pair).distinct() if conflicts is not None else assignments.select(*pair).limit(0)).join(experts.select("expert_id"), "expert_id", "left_semi")
    hard = known.groupBy("document_id").agg(F.count("*").alias("hard_conflict_pairs"))
    rows = scores.select(*pair, "total", "eligible").join(e, "expert_id").join(load, "expert_id", "left").join(mine, pair, "left").join(held.select("document_id", "held"), "document_id", "left")
    rows = rows.join(known.withColumn("conflict", F.lit(True)), pair, "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    room = F.col("capacity") > 0
    fits = F.col("eligible") & room
    ok = fits & (F.col("total") >= config.minimum_score)
    full = F.coalesce("load", F.lit(0)) >= F.col("capacity")
    blocked = ok & ~flag("chosen") & ~full & F.array_contains(F.coalesce("held", F.array().cast("array<string>")), F.col("group"))
    saturated = F.when(ok & ~flag("chosen") & full, F.col("expert_id"))
    found = rows.groupBy("document_id").agg(
        F.count("*").alias("scored_pairs"), F.count_distinct("expert_id").alias("scored_experts"), count(~flag("conflict") & ~F.col("eligible") & room).alias("other_ineligible_pairs"),
        count(~room).alias("zero_capacity_pairs"), count(fits).alias("eligible_pairs"), count(fits & (F.col("total") < config.minimum_score)).alias("below_minimum_score_pairs"),
        count(ok).alias("admissible_pairs"), count(ok & F.col("senior")).alias("senior_admissible_pairs"), F.count_distinct(F.when(ok, F.col("group"))).alias("institution_groups"),
        count(blocked).alias("institution_blocked_pairs"), F.array_sort(F.collect_set(saturated)).alias("saturated_experts"),
    )
    out = demands(documents, config).join(held.drop("held"), "document_id", "left").join(hard, "document_id", "left").join(found, "document_id", "left")
    out = out.crossJoin(experts.agg(F.count("*").alias("total_experts")))  # one row
    counts = ["assigned", "senior_assigned", "hard_conflict_pairs", "scored_experts", *[c for c in found.columns if c.endswith(("pairs", "groups"))]]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in dict.fromkeys(counts)})
    out = out.withColumn("saturated_experts", F.coalesce("saturated_experts", F.array().cast("array<string>")))
    out = out.withColumns({
        "requested": F.col("demand").cast("long"), "unmet": (F.col("demand") - F.col("assigned")).cast("long"),
        "unscored_experts": F.col("total_experts") - F.col("scored_experts"), "saturated_admissible_experts": F.size("saturated_experts").cast("long"),
    })
    reserved = F.least(F.lit(config.minimum_senior_reviewers).cast("long"), F.col("requested"))
    diverse = F.lit(config.require_distinct_institutions)
    enough = (F.col("admissible_pairs") >= F.col("requested")) & (~diverse | (F.col("institution_groups") >= F.col("requested"))) & ((reserved == 0) | (F.col("senior_admissible_pairs") >= reserved))
    said = {
        "hard_conflict": F.col("hard_conflict_pairs") > 0,
        "other_ineligible": F.col("other_ineligible_pairs") > 0,
        "zero_capacity": F.col("zero_capacity_pairs") > 0,
        "minimum_score": F.col("below_minimum_score_pairs") > 0,
        "sparse_score_matrix": F.col("unscored_experts") > 0,
        "candidate_scarcity": F.col("admissible_pairs") < F.col("requested"),
        "expert_capacity": F.col("saturated_admissible_experts") > 0,
        "seniority_floor": reserved > F.col("senior_assigned"),
        "institution_diversity": diverse & ((F.col("institution_groups") < F.col("requested")) | (F.col("institution_blocked_pairs") > 0)),
        "global_capacity_coupling": F.lit(certified) & enough,
        "greedy_not_certified": F.lit(not certified),
    }
    codes = F.array(*[F.when((F.col("unmet") > 0) & said[r], F.lit(r)) for r in REASONS])
    out = out.withColumn("reason_codes", F.filter(codes, lambda x: x.isNotNull()))
    return out.select("document_id", "requested", "assigned", "unmet", *COUNTERS, "saturated_experts", "reason_codes")


def run_status(found: DataFrame, certified: bool) -> DataFrame:
    """One row: status, certified, requested, assigned, unmet of the run."""
    totals = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("requested", "assigned", "unmet")])
    status = F.when(F.col("unmet") == 0, "satisfied").otherwise("infeasible" if certified else "not_certified")
    return totals.select(status.alias("status"), (status != "not_certified").alias("certified"), "requested", "assigned", "unmet")

