"""Expertise retrieval: TF-IDF or BM25 over reviewers' evidence, by reviewer, best item or mean.

Evidence is a table of token arrays; everything else is term counts joined on
terms. The units that document frequencies and lengths are taken over are
reviewers (`aggregate`) or evidence items (`max`, `average`), and never the
submissions. Scoring only looks at postings of terms that are asked for. The
only pair table is the one of the result: best items are found inside the
tasks, and means are taken of a reviewer's items before submissions are met.

Raw scores are rounded at the 12th decimal before they are ranked, so a tie
doesn't depend on the order of a sum; the earlier evidence wins it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.config import ExpertiseConfig
from arbiter.errors import DataValidationError
from arbiter.functions.numbers import robertson_idf, smooth_idf, sublinear, unit
from arbiter.functions.terms import document_frequencies, term_counts
from arbiter.functions.text import blank, casefold, strip, tokens_split_first
from arbiter.schemas import refuse
from arbiter.storage import materialise

DIGITS = 12

#: Terms whose weights go to every task, terms of submissions that do, and cells of a task's score matrix. Fixed values.
COMMON, HELD, CELLS = 200_000, 5_000_000, 2_000_000

_TOLD = pa.schema([("document_id", pa.string()), ("expert_id", pa.string()), ("key", pa.float64()), ("ord", pa.int64()), ("unit", pa.string()), ("raw", pa.float64())])


@dataclass(frozen=True)
class Corpus:
    """Tables: submissions (document_id, tokens), evidence (expert_id, evidence_id, ord, kind, year, tokens), reviewers (expert_id), filters (reason, n)."""

    submissions: DataFrame
    evidence: DataFrame
    reviewers: DataFrame
    filters: DataFrame
    config: ExpertiseConfig


@dataclass(frozen=True)
class Model:
    """Tables: postings (unit, term, tf), units (unit, expert_id, evidence_id, ord, length, items), idf (term, df, idf), stats (n_units, average_length)."""

    postings: DataFrame
    units: DataFrame
    idf: DataFrame
    stats: DataFrame
    reviewers: DataFrame
    config: ExpertiseConfig


def _tokens(values: dict[str, Column], chosen: tuple[str, ...], config: ExpertiseConfig) -> Column:
    """The fields' tokens in the chosen order. Fields never bridge: tokens are runs inside one."""
    parts = [tokens_split_first(strip(F.coalesce(values[name], F.lit(""))), config.minimum_token_length, config.stopwords) for name in chosen]
    return F.concat(*parts)


def _joined(name: str) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(name), F.array().cast("array<string>")))


def submission_tokens(documents: DataFrame, config: ExpertiseConfig) -> DataFrame:
    values = {"title": F.col("title"), "abstract": F.col("abstract"), "topics": _joined("topics"), "keywords": _joined("keywords")}
    return documents.select("document_id", _tokens(values, config.submission_fields, config).alias("tokens"))


def publication_allowed(config: ExpertiseConfig) -> Column:
    ok = F.lit(True)
    if config.require_publication_abstract:
        ok = ok & ~blank(F.col("abstract"))
    dated = F.lit(True)
    if config.minimum_publication_year is not None:
        dated = dated & (F.col("year") >= config.minimum_publication_year)
    if config.maximum_publication_year is not None:
        dated = dated & (F.col("year") <= config.maximum_publication_year)
    return ok & F.when(F.col("year").isNull(), F.lit(config.undated_publications == "include")).otherwise(dated)


def publication_evidence(experts: DataFrame, config: ExpertiseConfig) -> DataFrame:
    """Every publication with its tokens and the reason why it isn't kept: duplicates are found before dates are looked at."""
    p = experts.select("expert_id", F.posexplode("publications").alias("pos", "p")).select("expert_id", F.col("pos"), "p.*")
    named = p.filter("id is not null").groupBy("expert_id", "id").count().filter("count > 1")
    refuse(named, "a reviewer's publication ids must be unique", "expert_id", "id")
    same = Window.partitionBy("expert_id", "k_title", "k_abstract", "year").orderBy("pos")
    p = p.withColumn("k_title", strip(casefold(F.coalesce("title", F.lit(""))))).withColumn("k_abstract", strip(casefold(F.coalesce("abstract", F.lit("")))))
    p = p.withColumn("copy", F.row_number().over(same)).withColumn("tokens", _tokens({"title": F.col("title"), "abstract": F.col("abstract")}, config.publication_fields, config))
    reason = (
        F.when(F.col("copy") > 1, "duplicate_publications")
        .when(~publication_allowed(config), "date_or_content_filtered_publications")
        .when(F.size("tokens") < config.minimum_evidence_tokens, "empty_publications")
        .otherwise("retained")
    )
    name = F.concat(F.lit("publication:"), "expert_id", F.when(F.col("id").isNotNull(), F.concat(F.lit(":id:"), "id")).otherwise(F.concat(F.lit(":position:"), (F.col("pos") + 1).cast("string"))))
    return p.select("expert_id", name.alias("evidence_id"), (F.col("pos") + 1).cast("long").alias("ord"), F.lit("publication").alias("kind"), "year", "tokens", reason.alias("reason"))


def profile_evidence(experts: DataFrame, config: ExpertiseConfig) -> DataFrame:
    values = {"summary": F.col("summary"), "topics": _joined("topics"), "keywords": _joined("keywords")}
    rows = experts.select("expert_id", _tokens(values, config.profile_fields, config).alias("tokens"))
    reason = F.when(F.size("tokens") < config.minimum_evidence_tokens, "empty_profiles").otherwise("retained")
    return rows.select("expert_id", F.concat(F.lit("profile:"), "expert_id").alias("evidence_id"), F.lit(0).cast("long").alias("ord"), F.lit("profile").alias("kind"), F.lit(None).cast("int").alias("year"), "tokens", reason.alias("reason"))


def _guard(config: ExpertiseConfig, name: str, rows: DataFrame) -> None:
    """Counting stops one row beyond the limit."""
    if (most := config.limits.get(name)) is not None and rows.limit(most + 1).count() > most:
        raise DataValidationError(f"{name} {most} is exceeded")


def _guard_value(config: ExpertiseConfig, name: str, rows: DataFrame, value: Column) -> None:
    if (most := config.limits.get(name)) is not None and (rows.agg(value.alias("v")).first().v or 0) > most:
        raise DataValidationError(f"{name} {most} is exceeded")


def build_corpus(documents: DataFrame, experts: DataFrame, config: ExpertiseConfig | None = None) -> Corpus:
    config = config or ExpertiseConfig()
    _guard(config, "max_submissions", documents)
    _guard(config, "max_reviewers", experts)
    _guard_value(config, "max_total_publications", experts, F.sum(F.size("publications")))
    _guard_value(config, "max_publications_per_reviewer", experts, F.max(F.size("publications")))
    text = F.concat_ws(" ", "title", "abstract")
    _guard_value(config, "max_document_characters", documents, F.max(F.length(text)))
    _guard_value(config, "max_document_bytes", documents, F.max(F.octet_length(text)))
    if config.require_submission_abstract:
        refuse(documents.filter(blank(F.col("abstract"))), "every submission must have an abstract", "document_id")
    submissions = submission_tokens(documents, config)
    every = publication_evidence(experts, config)
    if config.include_profile:
        every = every.unionByName(profile_evidence(experts, config))
    filters = every.filter("reason <> 'retained'").groupBy("reason").agg(F.count("*").alias("n"))
    evidence = every.filter("reason = 'retained'").drop("reason")
    for name, value in (("max_tokens_per_document", F.max(F.size("tokens"))), ("max_total_tokens", F.sum(F.size("tokens"))), ("max_token_characters", F.max(F.array_max(F.transform("tokens", F.length))))):
        _guard_value(config, name, submissions.select("tokens").union(evidence.select("tokens")), value)
    return Corpus(submissions, evidence, experts.select("expert_id"), filters, config)


def fit(evidence: DataFrame, reviewers: DataFrame, config: ExpertiseConfig) -> Model:
    """Postings and statistics of the indexed units. Reviewers without evidence change neither."""
    if config.aggregation == "aggregate":
        counts = evidence.select("expert_id", F.explode("tokens").alias("term")).groupBy("expert_id", "term").agg(F.count("*").alias("tf"))
        postings = counts.select(F.col("expert_id").alias("unit"), "term", "tf")
        units = evidence.groupBy("expert_id").agg(F.sum(F.size("tokens")).alias("length"), F.count("*").alias("items"))
        units = units.select(F.col("expert_id").alias("unit"), "expert_id", F.concat(F.lit("aggregate:"), "expert_id").alias("evidence_id"), F.lit(0).cast("long").alias("ord"), "length", "items")
    else:
        # Dealt by item as token lists, which are shorter than their postings; these are counted and thinned where they arrive.
        counts = term_counts(evidence.select("evidence_id", "tokens").repartition("evidence_id"), "evidence_id")
        postings = counts.select(F.col("evidence_id").alias("unit"), "term", "tf")
        units = evidence.select(F.col("evidence_id").alias("unit"), "expert_id", "evidence_id", "ord", F.size("tokens").cast("long").alias("length"), F.lit(1).cast("long").alias("items"))
    stats = units.agg(F.count("*").alias("n_units"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_length"))
    idf = _idf(postings, stats, config)
    _guard(config, "max_vocabulary_terms", idf)
    return Model(postings, units, idf, stats, reviewers, config)


def _idf(postings: DataFrame, stats: DataFrame, config: ExpertiseConfig) -> DataFrame:
    rule = smooth_idf if config.model == "tfidf" else robertson_idf
    rows = document_frequencies(postings).crossJoin(stats.select("n_units"))  # stats is one row
    return rows.select("term", "df", rule(F.col("n_units"), F.col("df")).alias("idf"))


def _norms(model: Model) -> DataFrame:
    """(unit, norm) over all terms of a unit. The commonest terms are weighed where a unit's postings are; only the rest are dealt by term."""
    idf = materialise(model.idf.select("term", "df", "idf"), "idf")
    common = materialise(idf.orderBy(F.desc("df"), "term").limit(COMMON).select("term", F.col("idf").alias("known")), "common-terms")
    rows = model.postings.join(F.broadcast(common), "term", "left")
    square = lambda idf: (sublinear(F.col("tf")) * F.col(idf)) * (sublinear(F.col("tf")) * F.col(idf))
    here = rows.filter("known is not null").select("unit", square("known").alias("s"))
    rest = rows.filter("known is null").select("unit", "term", "tf").join(idf, "term").select("unit", square("idf").alias("s"))
    parts = [x.groupBy("unit").agg(F.sum("s").alias("s")) for x in (here, rest)]
    return parts[0].unionByName(parts[1]).groupBy("unit").agg(F.sqrt(F.sum("s")).alias("norm"))


def _weights(model: Model, query: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((document_id, term, q), (unit, term, e)) of the terms that are asked for: q * e is what a term adds to a pair's raw score."""
    config = model.config
    asked = materialise(query.select("term").distinct(), "asked")  # its size is known, so postings are thinned by it where they are made
    postings = materialise(model.postings.join(asked, "term", "left_semi"), "asked-postings")
    idf = materialise(_idf(postings, model.stats, config), "asked-idf")
    if config.model == "bm25":
        length = model.units.select("unit", "length").crossJoin(model.stats.select("average_length"))  # one row
        saturation = config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("length") / F.col("average_length"))
        weighted = postings.join(idf, "term").join(length, "unit")
        return query.select("document_id", "term", F.lit(1.0).alias("q")), weighted.select("unit", "term", (F.col("idf") * (F.col("tf") * (config.bm25_k1 + 1)) / (F.col("tf") + saturation)).alias("e"))
    weight = (sublinear(F.col("tf")) * F.col("idf")).alias("w")
    left = query.join(idf, "term").select("document_id", "term", weight)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    left = left.join(left.groupBy("document_id").agg(norm), "document_id").select("document_id", "term", (F.col("w") / F.col("norm")).alias("q"))
    right = postings.join(idf, "term").select("unit", "term", weight).join(_norms(model), "unit")
    return left, right.select("unit", "term", (F.col("w") / F.col("norm")).alias("e"))


def _best_units(query: DataFrame, weights: DataFrame, units: DataFrame) -> DataFrame:
    """(document_id, expert_id, unit, total): of each reviewer's units the best for each document, the earliest of equals.

    Every document that is asked for is held against a unit where the unit is,
    and a task only tells its best, so the pairs of documents and units are
    never rows. Queries above `HELD` terms are joined instead.
    """
    rows = weights.join(units.select("unit", "expert_id", "ord"), "unit")
    if query.count() > HELD:
        raw = query.join(rows, "term").groupBy("document_id", "unit", "expert_id", "ord").agg(F.sum(F.col("q") * F.col("e")).alias("raw"))
        part = raw.select("document_id", "expert_id", (-F.round("raw", DIGITS)).alias("key"), "ord", "unit", "raw")
    else:
        asked = query.toPandas()
        names, doc = np.unique(asked["document_id"].to_numpy(object), return_inverse=True)
        terms, term = np.unique(asked["term"].to_numpy(object), return_inverse=True)
        order = np.argsort(term, kind="stable")
        doc, q = doc[order], asked["q"].to_numpy()[order]
        counts = np.bincount(term, minlength=len(terms))
        starts = np.cumsum(counts) - counts
        at = query.sparkSession.createDataFrame(pd.DataFrame({"term": terms, "at": np.arange(len(terms))}), "term string, at long")
        packed = rows.join(F.broadcast(at), "term").groupBy("unit").agg(F.first("expert_id").alias("expert_id"), F.first("ord").alias("ord"), F.collect_list("at").alias("at"), F.collect_list("e").alias("e"))
        most = max(1, CELLS // max(1, len(names)))

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[np.ndarray]] = {}
            for f in frames:
                for k in range(0, f.num_rows, most):
                    part = f.slice(k, most)
                    raw = _products(part.column("at"), part.column("e"), doc, q, counts, starts, len(names))
                    _keep_best(held, raw, part)
                    if len(held) > most:
                        yield from _told(held, names)
                        held = {}
            yield from _told(held, names)

        part = packed.select("unit", "expert_id", "ord", "at", "e").mapInArrow(run, "document_id string, expert_id string, key double, ord long, unit string, raw double")
    best = part.groupBy("document_id", "expert_id").agg(F.min(F.struct("key", "ord", "unit", "raw")).alias("x"))
    return best.select("document_id", "expert_id", F.col("x.unit").alias("unit"), F.col("x.raw").alias("total"))


def _products(at: pa.ListArray, e: pa.ListArray, doc: np.ndarray, q: np.ndarray, counts: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Raw scores of units (rows) and documents (columns): each posting of a unit meets the documents that ask for its term."""
    sizes = np.diff(at.offsets.to_numpy())
    term, weight = at.flatten().to_numpy(), e.flatten().to_numpy()
    meets = counts[term]
    posting = np.repeat(np.arange(len(term)), meets)
    where = np.arange(len(posting)) - np.repeat(np.cumsum(meets) - meets, meets) + starts[term][posting]
    unit = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(unit[posting] * n + doc[where], weights=weight[posting] * q[where], minlength=len(sizes) * n).reshape(len(sizes), n)


def _keep_best(held: dict[str, list[np.ndarray]], raw: np.ndarray, part: pa.RecordBatch) -> None:
    """Put the best unit of each reviewer and document into `held`: lists of key, ord, unit and raw score by document."""
    ords, units = part.column("ord").to_numpy(), np.array(part.column("unit").to_pylist(), object)
    key = np.round(raw, DIGITS)
    owners, owner = np.unique(np.array(part.column("expert_id").to_pylist(), object), return_inverse=True)
    docs = np.arange(raw.shape[1])
    by = np.lexsort((units.astype(str), ords, owner))
    for name, mine in zip(owners, np.split(by, np.cumsum(np.bincount(owner))[:-1])):
        top = mine[key[mine].argmax(axis=0)]
        found = [key[top, docs], ords[top], units[top], raw[top, docs]]
        if name not in held:
            held[name] = found
            continue
        old = held[name]
        better = (found[0] > old[0]) | ((found[0] == old[0]) & (found[1] < old[1]))
        held[name] = [np.where(better, x, y) for x, y in zip(found, old)]


def _told(held: dict[str, list[np.ndarray]], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    for name, (key, ords, units, raw) in held.items():
        at = np.flatnonzero(raw > 0)
        if len(at):
            values = {"document_id": names[at].tolist(), "expert_id": [name] * len(at), "key": -key[at], "ord": ords[at], "unit": units[at].tolist(), "raw": raw[at]}
            yield pa.RecordBatch.from_pydict(values, schema=_TOLD)


def score(model: Model, submissions: DataFrame, contributions: bool = False) -> DataFrame:
    """(document_id, expert_id, score, raw_score, evidence_count, selected_evidence_id[, contributions]) for every submission and reviewer.

    The sums of evidence are joined to the matrix of pairs at the end, which
    keeps pairs that share nothing, as the reference semantics ask.
    """
    config = model.config
    _guard_pairs(config, submissions, model.reviewers)
    query, weights = _weights(model, materialise(term_counts(submissions, "document_id"), "query"))
    pair = ["document_id", "expert_id"]
    if config.aggregation == "average":
        # A mean of sums over terms is a sum over terms of means, so a reviewer's units are added up first.
        mean = weights.join(model.units.select("unit", "expert_id"), "unit").groupBy("expert_id", "term").agg(F.sum("e").alias("e"))
        values = query.join(mean, "term").select(*pair, "term", (F.col("q") * F.col("e")).alias("value"))
        best = values.groupBy(*pair).agg(F.sum("value").alias("total")).withColumn("evidence_id", F.lit(None).cast("string"))
    else:
        query = materialise(query, "query-weights")
        best = _best_units(query, weights, model.units)
        if contributions:
            best = materialise(best, "best-units")
            values = weights.join(best.select(*pair, "unit"), "unit").join(query, ["document_id", "term"]).select(*pair, "term", (F.col("q") * F.col("e")).alias("value"))
        name = F.concat(F.lit("aggregate:"), "expert_id") if config.aggregation == "aggregate" else F.col("unit")
        best = best.select(*pair, "total", name.alias("evidence_id"))
    counts = model.units.groupBy("expert_id").agg(F.sum("items").alias("evidence_count"), F.count("*").alias("n"), F.min_by("evidence_id", "ord").alias("first_id"))
    spine = submissions.select("document_id").crossJoin(model.reviewers.join(counts, "expert_id", "left"))
    out = spine.join(best, pair, "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0).cast("long")))
    total = F.coalesce("total", F.lit(0.0))
    out = out.withColumn("raw_score", total / F.greatest(F.col("evidence_count"), F.lit(1)) if config.aggregation == "average" else total)
    # Without a match every item's score is 0, and the first one is the best.
    selected = F.lit(None).cast("string") if config.aggregation == "average" else F.coalesce("evidence_id", "first_id")
    squashed = F.col("raw_score") if config.model == "tfidf" else F.col("raw_score") / (1 + F.col("raw_score"))
    out = out.select(*pair, unit(squashed).alias("score"), "raw_score", "evidence_count", selected.alias("selected_evidence_id"))
    if not contributions:
        return out
    if config.aggregation == "average":
        values = values.join(counts.select("expert_id", "n"), "expert_id").select(*pair, "term", (F.col("value") / F.col("n")).alias("value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "term"))), lambda x: F.struct(x["term"].alias("term"), (-x["v"]).alias("value")))
    return out.join(values.groupBy(*pair).agg(listed.alias("contributions")), pair, "left")


def _guard_pairs(config: ExpertiseConfig, submissions: DataFrame, reviewers: DataFrame) -> None:
    if (most := config.limits.get("max_pairs")) is not None and submissions.count() * reviewers.count() > most:
        raise DataValidationError(f"max_pairs {most} is exceeded")


def expertise(documents: DataFrame, experts: DataFrame, config: ExpertiseConfig | None = None, contributions: bool = False) -> DataFrame:
    """Corpus, fit and score in one plan."""
    corpus = build_corpus(documents, experts, config)
    model = fit(corpus.evidence, corpus.reviewers, corpus.config)
    return score(model, corpus.submissions, contributions)


def emitted(scores: DataFrame, config: ExpertiseConfig) -> DataFrame:
    """The affinities that a run writes."""
    return scores.filter((F.col("score") > 0) & (F.col("score") >= config.minimum_output_score)).select("document_id", "expert_id", "score")


def evidence_name_ok(evidence: Column, owner: Column) -> Column:
    """Whether an evidence id is one of its owner's: a profile, or a publication by id or by a place from 1."""
    own = lambda kind: F.concat(F.lit(kind), owner)
    rest = F.substring(evidence, F.length(own("publication:")) + 1, F.length(evidence))
    publication = F.startswith(evidence, own("publication:")) & rest.rlike(r"^:(id:.+|position:[1-9][0-9]*)$")
    return F.coalesce((evidence == own("profile:")) | publication, F.lit(False))


def check_evidence(model: Model, experts: DataFrame) -> Model:
    """The model's units and postings, made anew from the experts and its own settings, must be the same."""
    config = model.config
    if config.aggregation != "aggregate":
        refuse(model.units.filter(~evidence_name_ok(F.col("evidence_id"), F.col("expert_id"))), "evidence ids must be their owner's", "evidence_id")
    every = publication_evidence(experts, config)
    if config.include_profile:
        every = every.unionByName(profile_evidence(experts, config))
    again = fit(every.filter("reason = 'retained'").drop("reason"), experts.select("expert_id"), config)
    for name, columns in (("postings", ("unit", "term", "tf")), ("units", ("unit", "expert_id", "evidence_id", "length", "items"))):
        mine, its = (getattr(m, name).select(*columns) for m in (model, again))
        if not mine.exceptAll(its).isEmpty() or not its.exceptAll(mine).isEmpty():
            raise DataValidationError(f"the model's {name} aren't those of the experts")
    return model


def save_model(model: Model, path: str) -> None:
    """The model's tables as Parquet below `path`, which must be new."""
    for name in ("postings", "units", "idf", "stats", "reviewers"):
        getattr(model, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def load_model(spark, path: str, config: ExpertiseConfig) -> Model:
    """Read a saved model; its statistics are recomputed from its postings and must agree to 1e-12."""
    t = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "units", "idf", "stats", "reviewers")}
    stats = t["units"].agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("a"))
    if stats.crossJoin(t["stats"]).filter("n <> n_units or abs(a - average_length) > 1e-12").count():
        raise DataValidationError("the model's unit statistics disagree with its units")
    again = _idf(t["postings"], t["stats"], config).select("term", F.col("idf").alias("again"))
    if not again.join(t["idf"], "term", "full").filter("again is null or idf is null or abs(again - idf) > 1e-12").isEmpty():
        raise DataValidationError("the model's IDF disagrees with its postings")
    return Model(t["postings"], t["units"], t["idf"], t["stats"], t["reviewers"], config)


def score_new(model: Model, documents: DataFrame) -> DataFrame:
    """Score documents that weren't there when the model was fitted; nothing is refitted."""
    return score(model, submission_tokens(documents, model.config))
