"""An audit that trusts nothing of the engine that made the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gini(loads: DataFrame, column: str = "load") -> DataFrame:
    """One row (gini) of a load column; 0 if there is none or all are 0.

    Loads are counted by value first, so the running rank is over the distinct
    loads and no task sorts all experts.
    """
    values = loads.groupBy(F.col(column).cast("long").alias("x")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Ranks of equal loads are consecutive: their sum is n * before + n (n + 1) / 2.
    ranked = values.withColumn("ranks", F.col("n") * before + F.expr("n * (n + 1) div 2"))
    t = ranked.agg(F.sum(F.col("ranks") * F.col("x")).alias("w"), F.sum(F.col("n") * F.col("x")).alias("s"), F.sum("n").alias("n"))
    return t.select(F.coalesce((2 * F.col("w") - (F.col("n") + 1) * F.col("s")) / F.nullif(F.col("n") * F.col("s"), F.lit(0)), F.lit(0.0)).alias("gini"))


def _list(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.agg(F.array_sort(F.collect_set(value)).alias(name))


def tables(assignments: DataFrame, documents: DataFrame, experts: DataFrame, conflicts: DataFrame | None = None, default_demand: int = 2) -> dict[str, DataFrame]:
    """The audit as tables: valid rows, workload, coverage and one table for each kind of violation."""
    pair = ["document_id", "expert_id"]
    d = documents.select("document_id", F.coalesce(F.col("required_experts"), F.lit(default_demand)).alias("demand"))
    e = experts.select("expert_id", "capacity", "institution")
    counted = assignments.groupBy(*pair).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.first("score").alias("score"))
    # Of repeated rows the first counts; which it is can only be told by a position column.
    if "position" in assignments.columns:
        counted = assignments.groupBy(*pair).agg(F.count("*").alias("n"), F.min_by("score", "position").alias("score"))
    valid = counted.join(d, "document_id", "left_semi").join(e, "expert_id", "left_semi")
    workload = e.join(valid.groupBy("expert_id").agg(F.count("*").alias("load")), "expert_id", "left").select("expert_id", "capacity", F.coalesce("load", F.lit(0)).alias("load"))
    coverage = d.join(valid.groupBy("document_id").agg(F.count("*").alias("got")), "document_id", "left").select("document_id", "demand", F.coalesce("got", F.lit(0)).alias("got"))
    shared = valid.join(e.filter("institution is not null"), "expert_id").groupBy("document_id", "institution").agg(F.count("*").alias("n")).filter("n > 1")
    none = valid.select(*pair).limit(0)
    return {
        "valid": valid,
        "workload": workload,
        "coverage": coverage,
        "unknown_documents": assignments.select("document_id").distinct().join(d, "document_id", "left_anti"),
        "unknown_experts": assignments.select("expert_id").distinct().join(e, "expert_id", "left_anti"),
        "duplicate_assignments": counted.filter("n > 1").select(*pair),
        "conflict_violations": valid.select(*pair).intersect(conflicts.select(*pair)) if conflicts is not None else none,
        "capacity_violations": workload.filter("load > capacity").select("expert_id"),
        "demand_violations": coverage.filter("got > demand").select("document_id"),
        "institution_duplicates": shared.select("document_id", "institution"),
    }


UNSAFE = ("unknown_documents", "unknown_experts", "duplicate_assignments", "conflict_violations", "capacity_violations", "demand_violations")


def violations(found: dict[str, DataFrame]) -> DataFrame:
    """(kind, document_id, expert_id, institution), one row for each violation."""
    rows = None
    for kind in (*UNSAFE, "institution_duplicates"):
        t = found[kind]
        columns = [F.col(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in ("document_id", "expert_id", "institution")]
        t = t.select(F.lit(kind).alias("kind"), *columns)
        rows = t if rows is None else rows.unionByName(t)
    return rows


def summary(found: dict[str, DataFrame], require_distinct_institutions: bool = False) -> DataFrame:
    """One row: coverage, scores, Gini, the number of violations of each kind, and safe."""
    c = found["coverage"].agg(
        F.coalesce(F.sum((F.col("got") > 0).cast("long")) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("document_coverage"),
        F.coalesce(F.sum(F.least("got", "demand")) / F.nullif(F.sum("demand"), F.lit(0)), F.lit(1.0)).alias("demand_coverage"),
    )
    s = found["valid"].agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"), F.min("score").alias("minimum_score"))
    counts = violations(found).groupBy().agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in (*UNSAFE, "institution_duplicates")])
    safe = ~((F.col("institution_duplicates") > 0) & F.lit(require_distinct_institutions))
    for k in UNSAFE:
        safe = safe & (F.col(k) == 0)
    return c.crossJoin(s).crossJoin(gini(found["workload"]).withColumnRenamed("gini", "workload_gini")).crossJoin(counts).withColumn("safe", safe)  # one row each
