"""One registered query for each operator, over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbiter.config import CentroidConfig, ExpertiseConfig, GoldEvaluationConfig, KeyphraseConfig, MatchConfig
from arbiter.functions.text import clean_labels, once, tokens_fold_first, tokens_split_first
from arbiter.operators import assignment, audit, centroid, evaluation, expertise, keyphrases, publish, scoring, vectors, whatif
from arbiter.plans import testdata
from arbiter.plans.matching import run_affinity_matching, run_matching, score_without_exclusions
from arbiter.plans.testdata import CONFIG, table
from arbiter.sources.strict import loads
from arbiter.storage import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Text and retrieval ---------------------------------------------------------


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.texts(spark, sf_dir).select("doc_id", "text", once(tokens_fold_first(F.col("text"))).alias("f"))
    rows = rows.select("doc_id", "f", once(tokens_split_first(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.size("f").cast("long").alias("n_fold_first"), F.size("s").cast("long").alias("n_split_first"), F.size(F.array_distinct("f")).cast("long").alias("n_terms"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.sources_evidence(spark, sf_dir).withColumn("tokens", once(tokens_split_first(F.col("text"))))
    return rows.filter(F.size("tokens") > 0).select("expert_id", "evidence_id", "ord", "year", "tokens")


def _fitted(spark: SparkSession, sf_dir: str, model: str, aggregation: str) -> tuple[expertise.Model, DataFrame]:
    config = ExpertiseConfig(model=model, aggregation=aggregation)
    evidence = materialise(_evidence(spark, sf_dir), "evidence")
    reviewers = testdata.sources_evidence(spark, sf_dir).select("expert_id").distinct()
    return expertise.fit(evidence, reviewers, config), expertise.submission_tokens(testdata.passages(spark, sf_dir), config)


@query
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _fitted(spark, sf_dir, "bm25", "max")
    return _round(model.idf.select("term", "df", "idf"), "idf")


def _expertise(model: str, aggregation: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fitted, submissions = _fitted(spark, sf_dir, model, aggregation)
        return _round(expertise.score(fitted, submissions), "score", "raw_score")

    return run


for _model in ("tfidf", "bm25"):
    for _aggregation in ("aggregate", "max", "average"):
        QUERIES[f"{_model}_{_aggregation}"] = _expertise(_model, _aggregation)


@query
def term_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, submissions = _fitted(spark, sf_dir, "tfidf", "average")
    rows = expertise.score(fitted, submissions, contributions=True).select("document_id", "expert_id", F.explode("contributions").alias("c"))
    return _round(rows.select("document_id", "expert_id", F.col("c.term").alias("term"), F.col("c.value").alias("value")), "value")


@query
def emitted_affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, submissions = _fitted(spark, sf_dir, "bm25", "max")
    return _round(expertise.emitted(expertise.score(fitted, submissions), ExpertiseConfig(minimum_output_score=0.5)), "score")


_FILTERS = ExpertiseConfig(minimum_publication_year=1999, maximum_publication_year=2001)


@query
def evidence_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, experts, _ = testdata.domain(spark, sf_dir)
    doubled = experts.withColumn("publications", F.concat("publications", F.transform("publications", lambda p: F.struct(F.concat(p["id"], F.lit("'")).alias("id"), F.upper(p["title"]).alias("title"), p["abstract"].alias("abstract"), p["year"].alias("year")))))
    rows = expertise.publication_evidence(doubled, _FILTERS)
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


# Pair scores ----------------------------------------------------------------


@query
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, experts, conflicts = testdata.domain(spark, sf_dir)
    rows = scoring.pair_scores(documents, experts, conflicts, CONFIG)
    return _round(rows.withColumn("reasons", F.array_join("reasons", "; ")), "total", "content", "topics", "bid", "recency", "seniority")


@query
def candidate_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs with evidence: no pair table of the two sides is ever made."""
    documents, experts, conflicts = testdata.domain(spark, sf_dir)
    content = materialise(scoring.content_scores(documents, experts), "content")
    found = scoring.candidate_pairs(documents, experts, content, conflicts)
    rows = scoring.pair_scores(documents, experts, conflicts, CONFIG, found, content)
    return _round(rows.select("document_id", "expert_id", "total", "eligible"), "total")


@query
def expert_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, experts, _ = testdata.domain(spark, sf_dir)
    return _round(experts.select("expert_id", scoring.recency(CONFIG).alias("recency")), "recency")


@query
def clean_label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.concat(F.lit("  "), "p_type"), F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("l"))
    return rows.select("p_partkey", F.array_join(clean_labels(F.col("l")), "|").alias("labels"))


# Assignment -----------------------------------------------------------------


def _assigned(config: MatchConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents, experts, conflicts = testdata.domain(spark, sf_dir)
        found = run_matching(documents, experts, conflicts, config)
        return _round(found.assignments.withColumn("strategy", F.lit(config.label)), "score")

    return run


def _of(**options) -> MatchConfig:
    return MatchConfig(current_year=2002, **options)


QUERIES["assign_optimal"] = _assigned(_of())
QUERIES["assign_optimal_diverse"] = _assigned(_of(require_distinct_institutions=True))
QUERIES["assign_optimal_balanced"] = _assigned(_of(load_balance_penalty=0.1))
QUERIES["assign_optimal_senior"] = _assigned(_of(minimum_senior_reviewers=1))
QUERIES["assign_greedy"] = _assigned(_of(strategy="greedy", load_balance_penalty=0.05))
QUERIES["assign_minmax"] = _assigned(_of(strategy="minmax"))


def _segments(config: MatchConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents, experts = testdata.segments(spark, sf_dir)
        none = documents.select("document_id", F.lit("").alias("expert_id"), F.lit("").alias("reason")).limit(0)
        found = run_affinity_matching(documents, experts, testdata.segment_affinities(spark, sf_dir), none, config)
        return _round(found.assignments, "score")

    return run


QUERIES["assign_maximin_flow"] = _segments(_of(strategy="maximin-flow"))
QUERIES["assign_fair_local"] = _segments(_of(strategy="fair-local", require_distinct_institutions=True))


def _objective(strategy: str) -> Query:
    """What a strategy reached on the small instance that SQL can enumerate."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents, experts = testdata.priorities(spark, sf_dir)
        none = documents.select("document_id", F.lit("").alias("expert_id"), F.lit("").alias("reason")).limit(0)
        found = run_affinity_matching(documents, experts, testdata.priority_affinities(spark, sf_dir), none, _of(strategy=strategy))
        return _round(assignment.objective(found.assignments, documents, experts, found.config), "lowest_score", "weakest_document").select(*OBJECTIVES[strategy])

    return run


#: What each strategy decides, in its order.
OBJECTIVES = {
    "optimal": ("assigned", "fixed_score"),
    "minmax": ("assigned", "highest_load", "fixed_score"),
    "maximin": ("assigned", "weakest_document"),
    "maximin-flow": ("assigned", "lowest_score", "fixed_score"),
}
for _strategy in OBJECTIVES:
    QUERIES[f"objective_{_strategy.replace('-', '_')}"] = _objective(_strategy)


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all pairs, assign, audit: one row."""
    documents, experts, conflicts = testdata.domain(spark, sf_dir)
    found = run_matching(documents, experts, conflicts, CONFIG)
    return _round(found.audit.crossJoin(found.status), "average_score", "minimum_score", "workload_gini", "demand_coverage", "document_coverage")  # one row each


# Audit and diagnostics, on a plan that needs no solver ------------------------


def _fixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    documents, experts, conflicts = testdata.domain(spark, sf_dir)
    return materialise(testdata.fixed_plan(spark, sf_dir), "plan"), documents, experts, conflicts


@query
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(audit.summary(audit.tables(*_fixed(spark, sf_dir))), "document_coverage", "demand_coverage", "average_score", "minimum_score", "workload_gini")


@query
def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.violations(audit.tables(*_fixed(spark, sf_dir)))


@query
def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tables(*_fixed(spark, sf_dir))["workload"]


def _trade_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every traded pair with its share of the supplier's quantity; a nation's own suppliers aren't eligible."""
    rows = testdata.by_nation(spark, sf_dir).groupBy("expert_id", "document_id").agg(F.sum("l_quantity").alias("q"))
    total = rows.groupBy("expert_id").agg(F.sum("q").alias("t"))
    own = testdata.conflicts(spark, sf_dir).select("document_id", "expert_id", F.lit(True).alias("own"))
    return rows.join(total, "expert_id").join(own, ["document_id", "expert_id"], "left").select("document_id", "expert_id", (F.col("q") / F.col("t")).alias("total"), F.col("own").isNull().alias("eligible"))


DIAGNOSED = MatchConfig(current_year=2002, minimum_score=0.04, require_distinct_institutions=True)


@query
def shortage_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, documents, experts, conflicts = _fixed(spark, sf_dir)
    # A plan within the demands: of a nation's suppliers those with the largest share stay.
    best = Window.partitionBy("document_id").orderBy(F.desc("score"), "expert_id")
    plan = plan.withColumn("rank", F.row_number().over(best)).join(documents.select("document_id", "required_experts"), "document_id").filter("rank < required_experts").drop("required_experts")
    found = assignment.diagnostics(plan, _trade_scores(spark, sf_dir), documents, experts, conflicts, DIAGNOSED)
    return found.withColumn("reason_codes", F.array_join("reason_codes", ",")).withColumn("saturated_experts", F.array_join("saturated_experts", ","))


@query
def publish_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(publish.edge_table(testdata.fixed_plan(spark, sf_dir), "venue/assignment", "venue/score", "batch-1"), "weight")


@query
def whatif_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, experts, conflicts = testdata.domain(spark, sf_dir)
    first = conflicts.orderBy("document_id", "expert_id").first()
    scenarios = (
        whatif.Scenario("fewer", {"s1": 0, "s2": 1}),
        whatif.Scenario("pardon", {}, (), ((first.document_id, first.expert_id),)),
    )
    scores = materialise(score_without_exclusions(documents, experts, CONFIG), "scores")
    found = whatif.compare(scenarios, scores, documents, experts, conflicts, CONFIG).delta
    pairs = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("/", p["document_id"], p["expert_id"])), ",")
    return _round(found.withColumn("added_assignments", pairs("added_assignments")).withColumn("removed_assignments", pairs("removed_assignments")), "total_score")


# Evaluation -----------------------------------------------------------------


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return testdata.judgments(spark, sf_dir), testdata.length_scores(spark, sf_dir)


_GOLD = GoldEvaluationConfig(k_values=(1, 3, 5, 10), relevance_threshold=2)


@query
def gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.document_metrics(*_gold(spark, sf_dir), _GOLD), *evaluation.METRICS)


@query
def gold_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.macro_metrics(evaluation.document_metrics(*_gold(spark, sf_dir), _GOLD), _GOLD), *evaluation.METRICS)


@query
def gold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.counts(*_gold(spark, sf_dir), _GOLD)


@query
def gold_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.skipped(_gold(spark, sf_dir)[0], GoldEvaluationConfig(relevance_threshold=3))


@query
def gold_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels laid out ten papers to a participant, and read back as triples."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = labels.groupBy(F.concat(F.lit("p"), F.expr("doc_id div 10").cast("string")).alias("ParticipantID"))
    slot = [x for i in range(1, 11) for x in (F.max(F.when(F.col("doc_id") % 10 == i - 1, F.concat(F.lit("d"), F.col("doc_id").cast("string")))).alias(f"Paper{i}"), F.max(F.when(F.col("doc_id") % 10 == i - 1, F.col("quality").cast("string"))).alias(f"Expertise{i}"))]
    return evaluation.unpivot_wide(rows.agg(*slot))


# Vectors, keyphrases, centroid ------------------------------------------------


def _embedded(aggregation: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vectors.embedding_expertise(*testdata.vectors(spark, sf_dir), aggregation, dimensions=64)

    return run


for _aggregation in ("max", "average", "centroid"):
    QUERIES[f"embed_{_aggregation}"] = _embedded(_aggregation)


@query
def cooccurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = testdata.texts(spark, sf_dir).select("doc_id", "text")
    return keyphrases.cooccurrence_edges(d, "doc_id", window_size=3).groupBy("doc_id").agg(F.count("*").alias("n_edges"), F.min("left").alias("first_left"), F.max("right").alias("last_right"))


KEYPHRASES = KeyphraseConfig(window_size=2, iterations=3, top_k=5)


@query
def keyphrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.lit("submission").alias("kind"), F.col("item_id").cast("string").alias("owner_id"), F.col("item_id").cast("string").alias("evidence_id"), "text")
    found = keyphrases.rank_texts(rows, KEYPHRASES).select("owner_id", F.posexplode("keyphrases").alias("at", "k"))
    return _round(found.select("owner_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("k.term").alias("term"), F.col("k.score").alias("score")), "score")


@query
def document_keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-length ranking of every document."""
    d = testdata.texts(spark, sf_dir).select(F.lit("submission").alias("kind"), F.col("doc_id").cast("string").alias("owner_id"), F.col("doc_id").cast("string").alias("evidence_id"), "text")
    return keyphrases.rank_texts(d, KeyphraseConfig()).select("owner_id", "token_count", F.get(F.col("keyphrases.term"), 0).alias("best"))


@query
def centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations learn from the suppliers that they buy most and least from; those without labels are scored."""
    documents, experts, _ = testdata.domain(spark, sf_dir)
    terms = lambda df, key: df.select(key, F.transform(F.concat("topics", "keywords"), F.lower).alias("terms")).filter(F.size("terms") > 0)
    d, e = terms(documents, "document_id"), terms(experts, "expert_id")
    rows = _trade_scores(spark, sf_dir).join(d, "document_id", "left_semi").join(e, "expert_id", "left_semi").groupBy("document_id")
    triplets = rows.agg(F.max(F.struct("total", "expert_id")).alias("p"), F.min(F.struct("total", "expert_id")).alias("n"), F.count("*").alias("c")).filter("c > 1")
    triplets = triplets.select("document_id", F.col("p.expert_id").alias("positive_expert_id"), F.col("n.expert_id").alias("negative_expert_id"), (F.expr("cast(substring(document_id, 2) as int)") % 3).alias("fold"))
    triplets = materialise(triplets, "triplets")
    fold = lambda k: triplets.filter(F.col("fold") == k).drop("fold")
    model = centroid.train(fold(0), fold(1), d, e, CentroidConfig())
    holdout = d.join(fold(0).unionByName(fold(1)), "document_id", "left_anti")
    return centroid.score(model, holdout, e)


# Sources --------------------------------------------------------------------


@query
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties through the strict parser."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [None if p is None else loads(p) for p in f["props"]]
            yield pd.DataFrame({"event_id": f["event_id"], "k": pd.array([None if p is None else p.get("k") for p in parsed], "Int64"), "canonical": [None if p is None else json.dumps(p, sort_keys=True, separators=(",", ":")) for p in parsed]})

    return table(spark, sf_dir, "events").select("event_id", "props").mapInPandas(run, "event_id long, k long, canonical string")
