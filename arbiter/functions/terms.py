"""Term statistics as tables: counts, document frequencies, weights, sparse dot products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.functions.numbers import smooth_idf, sublinear


def term_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, tf) from rows (keys, tokens)."""
    return tokens.select(*keys, F.explode("tokens").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df) from term counts of one unit kind: each (unit, term) stands there once."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf_weights(counts: DataFrame, idf: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, weight); terms that idf doesn't know drop out."""
    return counts.join(idf, "term").select(*keys, "term", (sublinear(F.col("tf")) * F.col("idf")).alias("weight"))


def normalised(weights: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, weight) with unit length for each key."""
    norms = weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weights.join(norms, list(keys)).select(*keys, "term", (F.col("weight") / F.col("norm")).alias("weight"))


def fit_smooth_idf(counts: DataFrame, n: Column | int) -> DataFrame:
    n = F.lit(n) if isinstance(n, int) else n
    return document_frequencies(counts).select("term", "df", smooth_idf(n, F.col("df")).alias("idf"))


def sparse_dot(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, dot): an equi-join on terms, never a cross join of the two sides."""
    both = left.select(left_key, "term", F.col("weight").alias("lw")).join(right.select(right_key, "term", F.col("weight").alias("rw")), "term")
    return both.groupBy(left_key, right_key).agg(F.sum(F.col("lw") * F.col("rw")).alias("dot"))
