"""The five-part pair score: text, topics, bid, recency, seniority.

The text part is a TF-IDF cosine whose document frequencies come from all
documents and all experts of the run. It is an equi-join on terms; the full
matrix of pairs is made only where asked for (`candidates=None`), since it
keeps pairs without any evidence. `candidate_pairs` gives the pairs that share
a term, a label or a bid, which is what a large run should score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.config import COMPONENTS, MatchConfig
from arbiter.functions.numbers import decay, two_digits, unit
from arbiter.functions.terms import normalised, sparse_dot, term_counts, tfidf_weights
from arbiter.functions.text import casefold, label_set, once, set_jaccard, tokens_fold_first


def _labels(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def document_text() -> Column:
    return F.concat_ws(" ", "title", "abstract", _labels("topics"), _labels("keywords"))


def expert_text() -> Column:
    papers = F.transform("publications", lambda p: F.concat_ws(" ", p["title"], p["abstract"]))
    return F.concat_ws(" ", "summary", _labels("topics"), _labels("keywords"), F.coalesce(papers, F.array().cast("array<string>")))


def content_scores(documents: DataFrame, experts: DataFrame) -> DataFrame:
    """(document_id, expert_id, content) for pairs that share a term."""
    d = term_counts(documents.select("document_id", once(tokens_fold_first(document_text())).alias("tokens")), "document_id")
    e = term_counts(experts.select("expert_id", once(tokens_fold_first(expert_text())).alias("tokens")), "expert_id")
    units = documents.agg(F.count("*").alias("n")).union(experts.agg(F.count("*"))).agg(F.sum("n").alias("n"))
    both = d.select("term").unionAll(e.select("term"))
    idf = both.groupBy("term").agg(F.count("*").alias("df")).crossJoin(units)  # units is one row
    idf = idf.select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    left = normalised(tfidf_weights(d, idf, "document_id"), "document_id")
    right = normalised(tfidf_weights(e, idf, "expert_id"), "expert_id")
    return sparse_dot(left, right, "document_id", "expert_id").select("document_id", "expert_id", unit(F.col("dot")).alias("content"))


def last_conflicts(conflicts: DataFrame) -> DataFrame:
    """One row a pair: of repeated ones the last reason in the table's order, if it has a `position`, else the greatest."""
    order = F.col("position") if "position" in conflicts.columns else F.col("reason")
    return conflicts.groupBy("document_id", "expert_id").agg(F.max(F.struct(order.alias("o"), F.col("reason").alias("r"))).alias("x")).select("document_id", "expert_id", F.col("x.r").alias("conflict"))


def recency(config: MatchConfig) -> Column:
    """Mean decay of the dated publications; 0 without any."""
    years = F.filter(F.transform("publications", lambda p: p["year"]), lambda y: y.isNotNull())
    total = F.aggregate(F.transform(years, lambda y: decay(F.lit(config.current_year) - y, config.publication_half_life)), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(total / F.nullif(F.size(years), F.lit(0)), F.lit(0.0))


def reasons() -> Column:
    """What speaks for or against an eligible pair, in words; its topics are folded already."""
    shared = F.slice(F.array_sort(F.array_intersect("topics", "e_topics")), 1, 4)
    raw, content = F.col("raw_bid"), F.col("content")
    said = F.array(
        F.when(F.size(shared) > 0, F.concat(F.lit("shared topics: "), F.array_join(shared, ", "))),
        F.when(raw > 0, F.concat(F.lit("positive preference ("), two_digits(raw), F.lit(")"))).when(raw < 0, F.concat(F.lit("negative preference ("), two_digits(raw), F.lit(")"))),
        F.when(content >= 0.5, F.concat(F.lit("strong text similarity ("), two_digits(content), F.lit(")"))),
    )
    said = F.filter(said, lambda x: x.isNotNull())
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("eligible with limited direct evidence")))


def candidate_pairs(documents: DataFrame, experts: DataFrame, content: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """The pairs with any evidence: a shared term or label, a bid, a conflict. All are equi-joins."""
    label = lambda df, key: df.select(key, F.explode(F.array_distinct(F.transform(F.concat(_labels("topics"), _labels("keywords")), casefold))).alias("label"))
    found = [
        content.select("document_id", "expert_id"),
        label(documents, "document_id").join(label(experts, "expert_id"), "label").select("document_id", "expert_id"),
        experts.select("expert_id", F.explode(F.map_keys("bids")).alias("document_id")).join(documents.select("document_id"), "document_id", "left_semi").select("document_id", "expert_id"),
    ]
    if conflicts is not None:
        found.append(conflicts.select("document_id", "expert_id"))
    return reduce(DataFrame.unionByName, found).distinct()


def pair_scores(documents: DataFrame, experts: DataFrame, conflicts: DataFrame | None = None, config: MatchConfig | None = None, candidates: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """(document_id, expert_id, total, the five parts, eligible, reasons): the full matrix, or the rows of `candidates`. `content` may be given if it was made before."""
    config = config or MatchConfig()
    content = content_scores(documents, experts) if content is None else content
    # Labels are folded once for each side, not for each pair.
    topics = once(F.array_distinct(F.transform(_labels("topics"), casefold)))
    labels = once(label_set(F.concat(_labels("topics"), _labels("keywords"))))
    d = documents.select("document_id", "topics", labels.alias("labels")).select("document_id", topics.alias("topics"), "labels")
    e = experts.select("expert_id", "topics", "capacity", F.col("seniority").cast("double").alias("seniority"), "bids", recency(config).alias("recency"), labels.alias("e_labels"))
    e = e.select("expert_id", topics.alias("e_topics"), "capacity", "seniority", "bids", "recency", "e_labels")
    pairs = d.crossJoin(e) if candidates is None else candidates.join(d, "document_id").join(e, "expert_id")
    pairs = pairs.join(content, ["document_id", "expert_id"], "left").withColumn("content", F.coalesce("content", F.lit(0.0)))
    pairs = pairs.join(last_conflicts(conflicts), ["document_id", "expert_id"], "left") if conflicts is not None else pairs.withColumn("conflict", F.lit(None).cast("string"))
    pairs = pairs.withColumn("raw_bid", F.coalesce(F.try_element_at("bids", F.col("document_id")), F.lit(0.0)))
    pairs = pairs.withColumn("bid", (F.col("raw_bid") + 1) / 2)
    pairs = pairs.withColumn("overlap", set_jaccard(F.col("labels"), F.col("e_labels")))
    weights = config.weights.normalised()
    parts = {"content": F.col("content"), "topics": F.col("overlap"), "bid": F.col("bid"), "recency": F.col("recency"), "seniority": F.col("seniority")}
    total = reduce(lambda s, x: s + x, [parts[c] * F.lit(weights[c]) for c in COMPONENTS])
    excluded = F.when(F.col("conflict").isNotNull(), F.concat(F.lit("excluded: "), F.col("conflict"))).when(F.col("capacity") == 0, F.lit("excluded: zero capacity"))
    pairs = pairs.withColumn("excluded", excluded)
    out = F.col("excluded").isNotNull()
    zero = lambda x: F.when(out, F.lit(0.0)).otherwise(x)
    return pairs.select(
        "document_id", "expert_id", zero(total).alias("total"), zero(parts["content"]).alias("content"), zero(parts["topics"]).alias("topics"), zero(parts["bid"]).alias("bid"),
        zero(parts["recency"]).alias("recency"), "seniority", (~out).alias("eligible"), F.when(out, F.array("excluded")).otherwise(reasons()).alias("reasons"),
    )


def affinity_scores(affinities: DataFrame, experts: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Scores from given affinities. Only listed pairs exist; a conflict makes one ineligible, and the parts are 0."""
    none = F.lit(0.0)
    rows = affinities.select("document_id", "expert_id", F.col("score").cast("double").alias("affinity"))
    rows = rows.join(experts.select("expert_id"), "expert_id", "left_semi")
    rows = rows.join(last_conflicts(conflicts), ["document_id", "expert_id"], "left") if conflicts is not None else rows.withColumn("conflict", F.lit(None).cast("string"))
    out = F.col("conflict").isNotNull()
    said = F.when(out, F.lit("declared hard conflict")).otherwise(F.lit("externally supplied affinity score"))
    parts = [none.alias(c) for c in COMPONENTS]
    return rows.select("document_id", "expert_id", F.col("affinity").alias("total"), *parts, (~out).alias("eligible"), F.array(said).alias("reasons"), "affinity")


def ranked(scores: DataFrame) -> DataFrame:
    """Scores with their place for each document: by score, then by expert."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("total"), "expert_id")))
