"""Ranking evaluation on judged pairs: precision, recall, hits and average precision at k, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.config import GoldEvaluationConfig
from arbiter.errors import DataValidationError
from arbiter.schemas import refuse, unique

METRICS = ("precision", "recall", "hits", "average_precision")
_PAIR = ["document_id", "expert_id"]


def check(judgments: DataFrame, scores: DataFrame, config: GoldEvaluationConfig) -> None:
    unique(judgments, "judged pairs", *_PAIR)
    unique(scores, "scored pairs", *_PAIR)
    if judgments.isEmpty():
        raise DataValidationError("one judgment at least is required")
    both = judgments.join(scores.select(*_PAIR, F.lit(1).alias("scored")), _PAIR, "left").groupBy("document_id").agg(F.count("scored").alias("scored"), F.count("*").alias("n"))
    refuse(both.filter("scored = 0"), "every judged document needs a scored judged pair", "document_id")
    if config.strict_coverage:
        refuse(both.filter("scored < n"), "strict coverage refuses judged pairs without a score", "document_id")


def ranked(judgments: DataFrame, scores: DataFrame, config: GoldEvaluationConfig) -> DataFrame:
    """Judged pairs with their rank: scored ones first, by score, then by expert; and positives so far."""
    rows = judgments.join(scores, _PAIR, "left").withColumn("positive", (F.col("relevance") >= config.relevance_threshold).cast("long"))
    order = Window.partitionBy("document_id").orderBy(F.col("score").isNull(), F.desc("score"), "expert_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("hits", F.sum("positive").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("positives", F.sum("positive").over(Window.partitionBy("document_id")))


def document_metrics(judgments: DataFrame, scores: DataFrame, config: GoldEvaluationConfig | None = None) -> DataFrame:
    """(document_id, k, judged_pairs, judged_positives, missing_scores, the metrics). Documents without a positive are skipped.

    Precision divides by k even if there are fewer pairs; average precision by all positives.
    """
    config = config or GoldEvaluationConfig()
    ks = F.explode(F.array(*[F.lit(k) for k in config.k_values])).alias("k")
    rows = ranked(judgments, scores, config).filter("positives > 0").select("*", ks)
    inside = F.col("rank") <= F.col("k")
    out = rows.groupBy("document_id", "k").agg(
        F.count("*").alias("judged_pairs"), F.max("positives").alias("judged_positives"), F.sum(F.col("score").isNull().cast("long")).alias("missing_scores"),
        F.coalesce(F.sum(F.when(inside, F.col("positive"))), F.lit(0)).alias("hit"), F.coalesce(F.sum(F.when(inside & (F.col("positive") == 1), F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("gain"),
    )
    return out.select(
        "document_id", "k", "judged_pairs", "judged_positives", "missing_scores", (F.col("hit") / F.col("k")).alias("precision"), (F.col("hit") / F.col("judged_positives")).alias("recall"),
        (F.col("hit") > 0).cast("double").alias("hits"), (F.col("gain") / F.col("judged_positives")).alias("average_precision"),
    )


def macro_metrics(per_document: DataFrame, config: GoldEvaluationConfig | None = None) -> DataFrame:
    """(k, the metrics): means over evaluated documents; 0 if there are none."""
    config = config or GoldEvaluationConfig()
    ks = per_document.sparkSession.createDataFrame([(k,) for k in config.k_values], "k int")
    means = per_document.groupBy("k").agg(*[F.avg(m).alias(m) for m in METRICS])
    return ks.join(means, "k", "left").select("k", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])


def skipped(judgments: DataFrame, config: GoldEvaluationConfig | None = None) -> DataFrame:
    config = config or GoldEvaluationConfig()
    best = judgments.groupBy("document_id").agg(F.max("relevance").alias("best"))
    return best.filter(F.col("best") < config.relevance_threshold).select("document_id", F.lit("no_judged_positive").alias("reason"))


def counts(judgments: DataFrame, scores: DataFrame, config: GoldEvaluationConfig | None = None) -> DataFrame:
    """One row with the seven counts of a report."""
    config = config or GoldEvaluationConfig()
    both = judgments.withColumn("judged", F.lit(1)).join(scores.withColumn("scored", F.lit(1)), _PAIR, "full")
    per = both.groupBy("document_id").agg(F.count("judged").alias("j"), F.count("scored").alias("s"), F.count(F.when(F.col("judged").isNull(), 1)).alias("i"), F.count(F.when(F.col("scored").isNull(), 1)).alias("m"), F.max("relevance").alias("best"))
    judged = F.col("j") > 0
    n = lambda c: F.count(F.when(c, 1))
    return per.agg(
        n(judged).alias("judged_documents"), n(judged & (F.col("best") >= config.relevance_threshold)).alias("evaluated_documents"), n(judged & (F.col("best") < config.relevance_threshold)).alias("skipped_documents"),
        F.sum("j").alias("judged_pairs"), F.sum("s").alias("scored_pairs"), F.sum("i").alias("ignored_unjudged_scores"), F.sum("m").alias("missing_judged_scores"),
    )


def unpivot_wide(wide: DataFrame, slots: int = 10) -> DataFrame:
    """(document_id, expert_id, relevance) from rows of a participant with numbered papers and grades; empty slots are left out."""
    unique(wide, "participants", "ParticipantID")
    pairs = F.array(*[F.struct(F.col(f"Paper{i}").alias("paper"), F.col(f"Expertise{i}").cast("string").alias("grade")) for i in range(1, slots + 1)])
    rows = wide.select("ParticipantID", F.explode(pairs).alias("s"))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    refuse(rows.filter(empty(F.col("s.paper")) != empty(F.col("s.grade"))), "a slot must have both a paper and a grade", "ParticipantID")
    rows = rows.filter(~empty(F.col("s.paper")))
    refuse(rows.filter(~F.col("s.grade").rlike("^[0-9]{1,4}$") | (F.try_to_number("s.grade", F.lit("9999")) > 1000)), "grades must be integers from 0 to 1000", "ParticipantID")
    return rows.select(F.col("s.paper").alias("document_id"), F.col("ParticipantID").alias("expert_id"), F.col("s.grade").cast("int").alias("relevance"))


def report(judgments: DataFrame, scores: DataFrame, config: GoldEvaluationConfig | None = None) -> dict:
    """The whole evaluation as one JSON-ready record; its size is that of the judged documents."""
    config = config or GoldEvaluationConfig()
    check(judgments, scores, config)
    per = document_metrics(judgments, scores, config)
    documents: dict[str, dict] = {}
    for r in per.orderBy("document_id", "k").toLocalIterator():
        d = documents.setdefault(r.document_id, {"document_id": r.document_id, "judged_pairs": r.judged_pairs, "judged_positives": r.judged_positives, "missing_scores": r.missing_scores, "metrics": {}})
        d["metrics"][str(r.k)] = {m: r[m] for m in METRICS}
    macro = {str(r.k): {m: r[m] for m in METRICS} for r in macro_metrics(per, config).orderBy("k").collect()}
    return {
        "schema_version": 1,
        "evaluation_universe": "judged_pairs_only",
        "rank_semantics": "descending_score_then_expert_id; missing_scores_last_then_expert_id",
        "positive_relevance_threshold": config.relevance_threshold,
        "k_values": list(config.k_values),
        "strict_coverage": config.strict_coverage,
        "counts": counts(judgments, scores, config).first().asDict(),
        "macro": macro,
        "documents": list(documents.values()),
        "skipped": [r.asDict() for r in skipped(judgments, config).orderBy("document_id").collect()],
    }
