"""Dense-vector expertise: block products in NumPy, aggregated inside the task.

Submissions and publications are dealt into blocks by a hash of their ids, and
block pairs are multiplied as matrices. The paper matrix itself never leaves a
task: the first pass reports each block's least and greatest cosine, the
second each (submission, reviewer)'s partial best or sum. So what shuffles
grows with submissions x reviewers (the result), not with papers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.errors import DataValidationError
from arbiter.functions.numbers import finite
from arbiter.schemas import refuse
from arbiter.storage import materialise

BLOCK = 2048
EPSILON = 1e-12
LARGEST = 1e12


def embedding_requests(documents: DataFrame, experts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(submissions, publications, associations): what an encoder has to embed and whose it is. Positions count from 0."""
    submissions = documents.select(F.col("document_id").alias("paper_id"), "title", F.coalesce("abstract", F.lit("")).alias("abstract"))
    p = experts.select("expert_id", F.posexplode("publications").alias("pos", "p"))
    paper = F.coalesce(F.nullif(F.col("p.id"), F.lit("")), F.concat(F.lit("publication:"), "expert_id", F.lit(":position:"), F.col("pos").cast("string")))
    p = p.select("expert_id", "pos", paper.alias("paper_id"), "p.title", F.coalesce("p.abstract", F.lit("")).alias("abstract"))
    refuse(p.groupBy("paper_id").agg(F.count_distinct("title", "abstract").alias("n")).filter("n > 1"), "a shared publication id has different texts", "paper_id")
    associations = p.groupBy("expert_id", "paper_id").agg(F.min("pos").cast("long").alias("ord"))
    return submissions, p.select("paper_id", "title", "abstract").dropDuplicates(["paper_id"]), associations


def check_vectors(vectors: DataFrame, requests: DataFrame, dimensions: int) -> DataFrame:
    """Exactly the requested papers; empty or of the dimension; finite and of bounded size."""
    ids = vectors.select("paper_id").join(requests.select(F.col("paper_id").alias("asked")), F.col("paper_id") == F.col("asked"), "full")
    if not ids.filter("paper_id is null or asked is null").isEmpty():
        raise DataValidationError("the vectors' papers are not the requested ones")
    bad = ~F.size("embedding").isin(0, dimensions) | F.exists("embedding", lambda x: ~finite(x) | (F.abs(x) > LARGEST))
    refuse(vectors.filter(bad | F.col("embedding").isNull()), "vectors must be empty or finite and of the dimension", "paper_id")
    return vectors


def _unit(m: np.ndarray, epsilon: float) -> np.ndarray:
    """Rows over their length; zero rows stay zero."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(n > 0, m / np.where(n > 0, n + epsilon, 1.0), 0.0)


def _matrix(lists: list, dimensions: int) -> np.ndarray:
    out = np.zeros((len(lists), dimensions))
    for i, v in enumerate(lists):
        if v is not None and len(v):
            out[i] = v
    return out


def _blocks(rows: DataFrame, key: str, block: int, *others: str) -> DataFrame:
    """(block, struct of arrays): about `block` rows in one row, by a hash of the key."""
    n = max(1, -(-rows.count() // block))
    packed = F.collect_list(F.struct(key, "embedding", *others)).alias("rows")
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("block").agg(packed)


def _pairs(submissions: DataFrame, publications: DataFrame, block: int, *others: str) -> DataFrame:
    left = _blocks(submissions, "paper_id", block).select(F.col("rows").alias("l"))
    right = _blocks(publications, "paper_id", block, *others).select(F.col("rows").alias("r"))
    # Blocks, not papers, are paired; each row is one matrix product.
    return left.crossJoin(right)


def cosine_range(submissions: DataFrame, publications: DataFrame, dimensions: int, block: int = BLOCK) -> DataFrame:
    """One row (low, high) over all submission and publication pairs; empty vectors count as 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for l, r in zip(f["l"], f["r"]):  # noqa: E741
                product = _unit(_matrix([x["embedding"] for x in l], dimensions), EPSILON) @ _unit(_matrix([x["embedding"] for x in r], dimensions), EPSILON).T
                yield pd.DataFrame({"low": [product.min()], "high": [product.max()]})

    found = _pairs(submissions, publications, block).mapInPandas(run, "low double, high double")
    return found.agg(F.coalesce(F.min("low"), F.lit(0.0)).alias("low"), F.coalesce(F.max("high"), F.lit(0.0)).alias("high"))


def scaled_scores(submissions: DataFrame, publications: DataFrame, associations: DataFrame, reviewers: DataFrame, aggregation: str, dimensions: int, block: int = BLOCK) -> DataFrame:
    """Best or mean min-max cosine of each reviewer's publications that have a vector."""
    # Copies of a publication in several reviewers' lists are products of their own; the range is over distinct papers.
    bounds = cosine_range(submissions, publications, dimensions, block).first()
    low, high = float(bounds.low), float(bounds.high)
    held = associations.join(publications, "paper_id").filter(F.size("embedding") > 0).select("paper_id", "embedding", "expert_id", "ord")
    counts = held.groupBy("expert_id").agg(F.count("*").alias("evidence_count"))
    best = aggregation == "max"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for l, r in zip(f["l"], f["r"]):  # noqa: E741
                product = _unit(_matrix([x["embedding"] for x in l], dimensions), EPSILON) @ _unit(_matrix([x["embedding"] for x in r], dimensions), EPSILON).T
                product = np.clip(product, 0, 1) if low == high else (product - low) / (high - low)
                product = np.round(product, 12)
                docs = [x["paper_id"] for x in l]
                owners, owner = np.unique(np.array([x["expert_id"] for x in r], object), return_inverse=True)
                for k, name in enumerate(owners):
                    at = np.flatnonzero(owner == k)
                    mine = product[:, at]
                    if best:
                        at = at[np.argsort([r[i]["ord"] for i in at], kind="stable")]
                        mine = product[:, at]
                        top = mine.argmax(axis=1)
                        yield pd.DataFrame({"document_id": docs, "expert_id": name, "value": mine[np.arange(len(docs)), top], "ord": [int(r[at[t]]["ord"]) for t in top], "paper_id": [r[at[t]]["paper_id"] for t in top]})
                    else:
                        yield pd.DataFrame({"document_id": docs, "expert_id": name, "value": mine.sum(axis=1), "ord": 0, "paper_id": None})

    part = _pairs(submissions, held, block, "expert_id", "ord").mapInPandas(run, "document_id string, expert_id string, value double, ord long, paper_id string")
    pair = ["document_id", "expert_id"]
    if best:
        # Of equal values the earliest publication wins.
        merged = part.groupBy(*pair).agg(F.min(F.struct((-F.col("value")).alias("v"), "ord", "paper_id")).alias("x")).select(*pair, (-F.col("x.v")).alias("value"), F.col("x.paper_id").alias("selected_publication_id"))
    else:
        merged = part.groupBy(*pair).agg(F.sum("value").alias("value")).withColumn("selected_publication_id", F.lit(None).cast("string"))
    spine = submissions.select(F.col("paper_id").alias("document_id")).crossJoin(reviewers.select("expert_id").join(counts, "expert_id", "left"))
    out = spine.join(merged, pair, "left")
    n = F.coalesce("evidence_count", F.lit(0).cast("long"))
    value = F.coalesce("value", F.lit(0.0)) if best else F.coalesce(F.col("value") / F.col("evidence_count"), F.lit(0.0))
    return out.select(*pair, F.bround(value, 4).alias("score"), n.alias("evidence_count"), "selected_publication_id")


def centroid_scores(submissions: DataFrame, publications: DataFrame, associations: DataFrame, reviewers: DataFrame, dimensions: int, block: int = BLOCK) -> DataFrame:
    """Cosine with the mean of a reviewer's normalised vectors that aren't zero; negative ones count as 0."""

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list] = {}
        for f in frames:
            unit = _unit(_matrix(list(f["embedding"]), dimensions), 0.0)
            for name, v in zip(f["expert_id"], unit):
                if v.any():
                    held = sums.setdefault(name, [np.zeros(dimensions), 0])
                    held[0] += v
                    held[1] += 1
        yield pd.DataFrame({"expert_id": list(sums), "v": [x[0] for x in sums.values()], "n": [x[1] for x in sums.values()]})

    held = associations.join(publications, "paper_id").filter(F.size("embedding") > 0).select("expert_id", "embedding")
    parts = held.mapInPandas(bundle, "expert_id string, v array<double>, n long")
    add = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.lit(0.0))
    sums = parts.select("expert_id", "n", F.posexplode("v").alias("i", "x")).groupBy("expert_id", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    centroids = sums.groupBy("expert_id").agg(F.max("n").alias("evidence_count"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    rows = reviewers.select("expert_id").join(centroids, "expert_id", "left")
    rows = rows.select(F.col("expert_id").alias("paper_id"), F.coalesce("v", add).alias("embedding"), F.coalesce("evidence_count", F.lit(0).cast("long")).alias("evidence_count"))
    rows = materialise(rows, "centroids")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for l, r in zip(f["l"], f["r"]):  # noqa: E741
                product = np.clip(_unit(_matrix([x["embedding"] for x in l], dimensions), 0.0) @ _unit(_matrix([x["embedding"] for x in r], dimensions), 0.0).T, 0, 1)
                for i, x in enumerate(l):
                    yield pd.DataFrame({"document_id": x["paper_id"], "expert_id": [y["paper_id"] for y in r], "score": product[i], "evidence_count": [int(y["evidence_count"]) for y in r]})

    out = _pairs(submissions, rows, block, "evidence_count").mapInPandas(run, "document_id string, expert_id string, score double, evidence_count long")
    return out.select("document_id", "expert_id", F.bround(F.round("score", 12), 4).alias("score"), "evidence_count", F.lit(None).cast("string").alias("selected_publication_id"))


def embedding_expertise(submissions: DataFrame, publications: DataFrame, associations: DataFrame, reviewers: DataFrame, aggregation: str = "max", dimensions: int = 768, block: int = BLOCK) -> DataFrame:
    """(document_id, expert_id, score, evidence_count, selected_publication_id) from vectors (paper_id, embedding) and associations (expert_id, paper_id, ord)."""
    if aggregation not in ("max", "average", "centroid"):
        raise DataValidationError("aggregation must be max, average or centroid")
    if aggregation == "centroid":
        return centroid_scores(submissions, publications, associations, reviewers, dimensions, block)
    return scaled_scores(submissions, publications, associations, reviewers, aggregation, dimensions, block)


def top_publications(scores: DataFrame, k: int) -> DataFrame:
    """The k best reviewers of each submission."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "expert_id"))).filter(F.col("rank") <= k)
