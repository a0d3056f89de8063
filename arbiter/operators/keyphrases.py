"""Keyphrases: co-occurrence graphs and a fixed number of PageRank steps.

A text's graph is its own, so texts are ranked where they are read, without a
shuffle. `cooccurrence_edges` and `term_counts_of` are the relational form.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.config import KeyphraseConfig
from arbiter.functions.text import casefold, once, safe_term, sentences, tokens_of_folded
from arbiter.schemas import refuse, unique
from arbiter.storage import materialise

RECORD = "kind string, owner_id string, evidence_id string, token_count long, keyphrases array<struct<term:string,score:double>>"


def units(documents: DataFrame, experts: DataFrame) -> DataFrame:
    """(kind, owner_id, evidence_id, text): submissions, profiles and publications; fields are on lines of their own and never bridge."""
    none = F.array().cast("array<string>")
    lines = lambda *parts: F.array_join(F.concat(*parts), "\n")
    one = lambda *names: F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names])
    many = lambda n: F.coalesce(F.col(n), none)
    unique(documents, "document ids", "document_id")
    unique(experts, "expert ids", "expert_id")
    s = documents.select(F.lit("submission").alias("kind"), F.col("document_id").alias("owner_id"), F.col("document_id").alias("evidence_id"), lines(one("title", "abstract"), many("topics"), many("keywords")).alias("text"))
    p = experts.select(F.lit("profile").alias("kind"), F.col("expert_id").alias("owner_id"), F.col("expert_id").alias("evidence_id"), lines(one("summary"), many("topics"), many("keywords")).alias("text"))
    pubs = experts.select("expert_id", F.posexplode("publications").alias("pos", "p")).select("expert_id", "pos", "p.*")
    name = F.when(F.col("id").isNotNull(), F.concat(F.lit("id:"), "id")).otherwise(F.concat(F.lit("position:"), F.col("pos").cast("string")))
    pubs = pubs.select(F.lit("publication").alias("kind"), F.col("expert_id").alias("owner_id"), name.alias("evidence_id"), lines(one("title", "abstract")).alias("text"))
    refuse(pubs.groupBy("owner_id", "evidence_id").count().filter("count > 1"), "publication evidence ids must be unique", "owner_id", "evidence_id")
    return s.unionByName(p).unionByName(pubs)


def tokenised(texts: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """(keys, lines): the kept tokens of each sentence that has any."""
    folded = texts.select(*keys, once(casefold(F.coalesce(F.col(text_col), F.lit("")))).alias("folded"))
    parts = F.transform(sentences(F.col("folded")), lambda s: tokens_of_folded(s))
    return folded.select(*keys, once(F.filter(parts, lambda t: F.size(t) > 0)).alias("lines"))


def cooccurrence_edges(texts: DataFrame, *keys: str, window_size: int = 2, text_col: str = "text") -> DataFrame:
    """(keys, left, right), left < right: distinct pairs of terms that stand in one window of a sentence.

    A text's pairs are made distinct where it is read. Only the pairs of keys
    that several texts have are shuffled.
    """

    def pairs(line: Column, k: int) -> Column:
        n = F.greatest(F.size(line) - k, F.lit(0))
        joined = lambda a, b: F.when(a != b, F.concat(F.least(a, b), F.lit(" "), F.greatest(a, b)))
        return F.zip_with(F.slice(line, 1, n), F.slice(line, k + 1, n), joined)

    def edges(rows: DataFrame) -> DataFrame:
        every = F.flatten(F.transform("lines", lambda t: F.concat(F.array().cast("array<string>"), *[pairs(t, k) for k in range(1, window_size)])))
        e = tokenised(rows, *keys, text_col=text_col).select(*keys, F.explode(F.array_distinct(F.filter(every, lambda x: x.isNotNull()))).alias("e"))
        return e.select(*keys, F.substring_index("e", " ", 1).alias("left"), F.substring_index("e", " ", -1).alias("right"))  # no term has a space

    repeated = materialise(texts.groupBy(*keys).count().filter("count > 1").select(*[F.col(k).alias(f"r_{k}") for k in keys]), "repeated")
    if repeated.isEmpty():
        return edges(texts)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys])
    return edges(texts.join(repeated, same, "left_anti")).unionByName(edges(texts.join(repeated, same, "left_semi")).distinct())


def pagerank(n: int, left: np.ndarray, right: np.ndarray, damping: float, iterations: int) -> np.ndarray:
    """Ranks on an undirected simple graph: the mass of nodes without edges goes to all alike."""
    degree = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    rank = np.full(n, 1.0 / n)
    src, dst = np.concatenate((left, right)), np.concatenate((right, left))
    for _ in range(iterations):
        share = np.divide(damping * rank, degree, out=np.zeros(n), where=degree > 0)
        rest = (1.0 - damping + damping * rank[degree == 0].sum()) / n
        rank = rest + np.bincount(dst, weights=share[src], minlength=n)
    return rank


def rank_lines(lines: list[list[str]], config: KeyphraseConfig) -> list[tuple[str, float]]:
    """The best terms of one text, by score and then by term."""
    terms = sorted({t for line in lines for t in line})
    if not terms:
        return []
    at = {t: i for i, t in enumerate(terms)}
    edges = set()
    for line in lines:
        ids = [at[t] for t in line]
        for k in range(1, config.window_size):
            edges.update((min(a, b), max(a, b)) for a, b in zip(ids, ids[k:]) if a != b)
    e = np.array(sorted(edges), np.int64).reshape(-1, 2)
    rank = pagerank(len(terms), e[:, 0], e[:, 1], config.damping, config.iterations)
    # Ranks that only differ by the order of their sums are ties.
    order = sorted(range(len(terms)), key=lambda i: (-round(rank[i], 12), terms[i]))[: config.top_k]
    return [(terms[i], float(rank[i])) for i in order]


def rank_texts(texts: DataFrame, config: KeyphraseConfig | None = None) -> DataFrame:
    """Keyphrase records of rows (kind, owner_id, evidence_id, text)."""
    config = config or KeyphraseConfig()
    keys = ("kind", "owner_id", "evidence_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ranked = [[{"term": t, "score": s} for t, s in rank_lines([list(x) for x in lines], config)] for lines in f["lines"]]
            yield f[list(keys)].assign(token_count=[sum(map(len, lines)) for lines in f["lines"]], keyphrases=ranked)

    return tokenised(texts, *keys).mapInPandas(run, RECORD)


def extract(documents: DataFrame, experts: DataFrame, config: KeyphraseConfig | None = None) -> DataFrame:
    return rank_texts(units(documents, experts), config)


def check_records(records: DataFrame, documents: DataFrame, experts: DataFrame, config: KeyphraseConfig | None = None) -> DataFrame:
    """Keyphrase records that were read back: identities known and unique, terms safe, one profile a reviewer, lists no longer than allowed."""
    config = config or KeyphraseConfig()
    unique(records, "keyphrase records", "kind", "owner_id", "evidence_id")
    refuse(records.filter(~F.col("kind").isin("submission", "profile", "publication")), "unknown kinds of record", "kind")
    refuse(records.filter("kind = 'submission'").join(documents, F.col("owner_id") == F.col("document_id"), "left_anti"), "records of unknown documents", "owner_id")
    refuse(records.filter("kind <> 'submission'").join(experts, F.col("owner_id") == F.col("expert_id"), "left_anti"), "records of unknown experts", "owner_id")
    refuse(experts.join(records.filter("kind = 'profile'"), F.col("owner_id") == F.col("expert_id"), "left_anti"), "experts without a profile record", "expert_id")
    refuse(records.filter(F.exists("keyphrases", lambda k: ~safe_term(k["term"]) | k["score"].isNull() | (k["score"] <= 0))), "records with terms that an index can't hold", "owner_id")
    refuse(records.filter((F.size("keyphrases") > config.top_k) | (F.size(F.array_distinct(F.transform("keyphrases", lambda k: k["term"]))) < F.size("keyphrases"))), "records with too many or repeated terms", "owner_id")
    return records


def read_records(spark: SparkSession, path: str, documents: DataFrame, experts: DataFrame, config: KeyphraseConfig | None = None) -> DataFrame:
    """The records of a keyphrase run's file, checked."""
    return check_records(spark.read.schema(RECORD).option("mode", "FAILFAST").json(path), documents, experts, config)
