"""Queries of the sources and sinks, and of plans that SQL can enumerate or replay.

Tables are written in a source's format, read back by its reader, and compared with SQL on the tables.

Files go to the shared scratch folder through Spark's writers, so they are as
large as the tables and as many as the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.config import CentroidConfig, ExpertiseConfig, MatchConfig
from arbiter.functions.text import identifier_ok, safe_term
from arbiter.operators import assignment, centroid, expertise, scoring, whatif
from arbiter.operators.assignment import admissible, places_of
from arbiter.plans import testdata
from arbiter.plans.matching import run_affinity_matching
from arbiter.plans.testdata import CONFIG, table
from arbiter.sources import acquire, domain, notes
from arbiter.sources.strict import fingerprints
from arbiter.storage import scratch
from arbiter.streaming.scoring import score_stream

ROUNDTRIPS: dict = {}


def query(f):
    ROUNDTRIPS[f.__name__] = f
    return f


def _written(lines: DataFrame, name: str, header: str | None = None) -> str:
    """A folder of text files with one line a row, or with a header a single file."""
    path = scratch(lines.sparkSession, name)
    lines = lines.select(F.col(lines.columns[0]).alias("value"))
    if header is not None:
        first = lines.sparkSession.createDataFrame([(0, header)], "k int, value string")
        lines = first.unionByName(lines.withColumn("k", F.lit(1))).repartitionByRange(1, "k").sortWithinPartitions("k").select("value")
    lines.write.text(path)
    return path


def _json(rows: DataFrame, **fields: Column) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))


def _part_documents(spark: SparkSession, sf_dir: str) -> str:
    p = table(spark, sf_dir, "part")
    labels = F.array(F.concat(F.lit("  "), "p_type"), F.col("p_type"), F.lit(" "), F.col("p_brand"))
    demand = F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4)
    rows = _json(p, id=F.concat(F.lit("p"), F.col("p_partkey").cast("string")), title=F.col("p_name"), abstract=F.col("p_type"), topics=labels, keywords=F.array("p_brand"), required_experts=demand, metadata=F.struct(F.col("p_size").alias("size")))
    return _written(rows, "documents")


@query
def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.load_documents(spark, _part_documents(spark, sf_dir))
    return rows.select("document_id", "title", "abstract", F.array_join("topics", "|").alias("topics"), F.array_join("keywords", "|").alias("keywords"), "required_experts", F.get_json_object("metadata", "$.size").alias("size"))


def _supplier_experts(spark: SparkSession, sf_dir: str) -> str:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    paper = F.array(F.struct(F.concat(F.lit("a"), key).alias("id"), F.col("s_name").alias("title"), (1990 + F.col("s_suppkey") % 30).cast("int").alias("year")))
    rows = _json(
        s, id=F.concat(F.lit("s"), key), name=F.col("s_name"), topics=F.array(F.concat(F.col("s_name"), F.lit(" "))), publications=paper, capacity=(F.col("s_suppkey") % 4).cast("int"),
        institution=F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))), seniority=(F.col("s_suppkey") % 5) / 4.0, bids=F.create_map(F.lit("n1"), (F.col("s_suppkey") % 3) - 1.0),
    )
    return _written(rows, "experts")


@query
def read_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.load_experts(spark, _supplier_experts(spark, sf_dir))
    first = F.get("publications", F.lit(0))
    return rows.select("expert_id", "name", "summary", F.array_join("topics", "|").alias("topics"), first["id"].alias("paper"), first["abstract"].alias("abstract"), first["year"].alias("year"), "capacity", "institution", "seniority", F.try_element_at("bids", F.lit("n1")).alias("bid"))


@query
def read_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that stand twice: the last reason counts, and one without a reason has the usual one."""
    c = testdata.conflicts(spark, sf_dir)
    number = F.expr("cast(substring(expert_id, 2) as int)")
    twice = c.select("document_id", "expert_id", F.explode(F.array(F.lit("first"), F.when(number % 2 == 0, F.lit("second")))).alias("reason"), number.alias("k"))
    rows = _json(twice.coalesce(1), document_id=F.col("document_id"), expert_id=F.col("expert_id"), reason=F.col("reason"))
    return scoring.last_conflicts(domain.load_conflicts(spark, _written(rows, "conflicts")))


@query
def read_affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = testdata.segment_affinities(spark, sf_dir)
    lines = a.select(F.concat_ws(",", F.concat(F.lit('"'), "document_id", F.lit('"')), F.concat(F.lit(" "), "expert_id"), F.format_string("%.6f", "score")).alias("value"))
    return domain.load_affinities(spark, _written(lines, "affinities", "document_id,expert_id,score"))


@query
def read_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = testdata.judgments(spark, sf_dir).dropDuplicates(["document_id", "expert_id"])
    return domain.load_judgments(spark, _written(j.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("document_id", "expert_id", "relevance")])), "judgments", "document_id\texpert_id\trelevance"))


@query
def read_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    pairs = d.alias("a").join(d.alias("b"), F.expr("a.o_orderpriority = b.o_orderpriority and a.o_orderstatus < b.o_orderstatus"))
    rows = _json(pairs, document_id=F.col("a.o_orderpriority"), positive_expert_id=F.col("a.o_orderstatus"), negative_expert_id=F.col("b.o_orderstatus"))
    return domain.load_triplets(spark, _written(rows, "triplets"))


@query
def read_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("paper_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = domain.load_vectors(spark, _written(_json(v, paper_id=F.col("paper_id"), embedding=F.col("embedding")), "vectors"), v.select("paper_id"), 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rows.select("paper_id", F.size("embedding").cast("long").alias("dimensions"), F.round(total, 4).alias("total"))


def _notes(spark: SparkSession, sf_dir: str) -> str:
    """Every second note in the newer shape, where each content field is an object with a value."""
    p = table(spark, sf_dir, "part")
    wrap = lambda c: F.struct(c.alias("value"))
    old = F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.array("p_brand", F.lit(" ")).alias("keywords"), F.array("p_type", "p_brand", "p_type").alias("subject_areas"))
    new = F.struct(wrap(F.col("p_name")).alias("title"), wrap(F.col("p_type")).alias("abstract"), wrap(F.array("p_brand", F.lit(" "))).alias("keywords"), wrap(F.array("p_type", "p_brand", "p_type")).alias("subject_areas"))
    even = p.filter("p_partkey % 2 = 0")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    lines = _json(even, id=name, forum=F.col("p_brand"), content=old).unionByName(_json(p.filter("p_partkey % 2 = 1"), id=name, forum=F.col("p_brand"), content=new))
    return _written(lines, "notes")


@query
def read_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.load_submissions(spark, _notes(spark, sf_dir))
    return rows.select("document_id", "title", "abstract", F.array_join("topics", "|").alias("topics"), F.array_join("keywords", "|").alias("keywords"), F.get_json_object("metadata", "$.openreview_forum").alias("forum"))


@query
def read_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with their publications joined, in the order of ids; reviewers without any stay."""
    s = table(spark, sf_dir, "supplier").withColumn("id", F.concat(F.lit("~s"), F.col("s_suppkey").cast("string")))
    names = F.array(F.struct(F.lit("other").alias("fullname"), F.lit(False).alias("preferred")), F.struct(F.col("s_name").alias("fullname"), F.lit(True).alias("preferred")))
    profiles = _written(_json(s, id=F.col("id"), content=F.struct(names.alias("names"), F.concat(F.lit("bio of "), "s_name").alias("bio"), F.array("s_name").alias("expertise"))), "profiles")
    papers = table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 <> 0").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year")).groupBy("l_suppkey", "l_partkey").agg(F.max("year").alias("year"))
    note = F.struct(F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("id"), F.struct(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"), F.lit("").alias("abstract"), F.col("year").alias("year")).alias("content"))
    publications = _written(_json(papers, reviewer_id=F.concat(F.lit("~s"), F.col("l_suppkey").cast("string")), note=note), "publications")
    _, experts = notes.load_snapshot(spark, _notes(spark, sf_dir), profiles, publications)
    return experts.select("expert_id", "name", "summary", F.array_join("topics", "|").alias("topics"), F.size("publications").cast("long").alias("n_publications"), F.get("publications", F.lit(0))["id"].alias("first_id"), F.get("publications", F.lit(0))["year"].alias("first_year"))


@query
def read_reviewer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" ~s"), F.col("s_suppkey").cast("string"), F.lit(" ")))
    return notes.load_reviewer_ids(spark, _written(ids, "reviewers")).select("expert_id", "name", "capacity", "seniority", F.size("publications").cast("long").alias("n_publications"))


def _event_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    dated = lambda k, c: F.when(F.col("event_id") % 4 == k, c)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("expert_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("note_id"), F.col("event_type").alias("invitation"), dated(0, ms).alias("pdate"), F.when(F.col("event_id") % 4 < 2, ms + 1).alias("odate"),
        F.when(F.col("event_id") % 4 < 3, ms + 2).alias("cdate"), F.when(F.col("event_id") % 7 != 0, F.col("props")).otherwise(F.lit("  ")).alias("title"), F.lit(None).cast("string").alias("abstract"),
    )


def _filtered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _event_notes(spark, sf_dir)
    kinds = tuple(r.invitation for r in rows.groupBy("invitation").count().orderBy("invitation").limit(2).collect())
    bounds = table(spark, sf_dir, "events").agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("b")).first()
    return notes.filter_publications(rows, kinds, bounds.a + (bounds.b - bounds.a) // 4, bounds.b)


@query
def publication_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir)[1]


@query
def publications_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the columns that may be kept, and no others; the bytes of the whole are bounded."""
    rows = acquire.only_columns(_filtered(spark, sf_dir)[0], "expert_id", "id", "title", "abstract", "year")
    return acquire.within_budget(rows, 1 << 40)


@query
def projected_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return rows.agg(acquire.projected_bytes(rows).alias("n_bytes"))


@query
def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").repartitionByRange(1, "n_nationkey").sortWithinPartitions("n_nationkey").select("n_name")
    return fingerprints(spark, _written(rows, "names") + "/*.txt").filter("bytes > 0").select("bytes", "sha256")


@query
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are and in forms that an identifier must not have."""
    forms = F.array(F.col("n_name"), F.concat(F.lit(" "), "n_name"), F.concat("n_name", F.lit("\t")), F.concat(F.lit("a"), F.lit(" "), "n_name"), F.concat("n_name", F.lit(" ")), F.lit(""), F.concat(F.lit("é "), "n_name"), F.concat(F.lit("a\u0007"), "n_name"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(forms).alias("form", "value"))
    return rows.select("n_nationkey", "form", identifier_ok(F.col("value")).alias("ok"))


@query
def safe_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("term")).filter("term <> ''").distinct()
    return words.groupBy(safe_term(F.col("term")).alias("safe")).agg(F.count("*").alias("n"))


@query
def evidence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications with an id are named by it, others by their place from 1."""
    e = testdata.experts(spark, sf_dir)
    named = e.withColumn("publications", F.transform("publications", lambda p: F.struct(F.when(p["year"] % 2 == 0, p["id"]).alias("id"), p["title"].alias("title"), p["abstract"].alias("abstract"), p["year"].alias("year"))))
    rows = expertise.publication_evidence(named, ExpertiseConfig())
    return rows.select("expert_id", "ord", "evidence_id", expertise.evidence_name_ok(F.col("evidence_id"), F.col("expert_id")).alias("ok"))


@query
def reloaded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New submissions scored by a model that was saved and read back."""
    from arbiter.plans.queries import _fitted, _round

    fitted, submissions = _fitted(spark, sf_dir, "bm25", "max")
    path = scratch(spark, "model")
    expertise.save_model(fitted, path)
    model = expertise.load_model(spark, path, fitted.config)
    return _round(expertise.score(model, submissions), "score", "raw_score")


def _plan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.fixed_plan(spark, sf_dir)
    return rows.select("document_id", "expert_id", F.col("score").alias("total"), (F.col("score") < 0.9).alias("eligible"))


@query
def ranked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ranked(_plan_scores(spark, sf_dir)).select("document_id", "expert_id", F.col("rank").cast("long").alias("rank"))


@query
def admissible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    return admissible(_plan_scores(spark, sf_dir), replace(CONFIG, minimum_score=0.08)).select("document_id", "expert_id")


@query
def expert_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("expert_id"))
    return places_of(s, "expert_id")


def _panel_run(spark: SparkSession, sf_dir: str, **options):
    d, e, affinities = testdata.panels(spark, sf_dir)
    none = d.select("document_id", F.lit("").alias("expert_id"), F.lit("").alias("reason")).limit(0)
    return run_affinity_matching(d, e, affinities, none, MatchConfig(current_year=2002, **options)), d, e


def _panel_objective(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found, d, e = _panel_run(spark, sf_dir, **options)
    return assignment.objective(found.assignments, d, e, found.config).select("assigned", "fixed_score")


@query
def objective_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel_objective(spark, sf_dir, require_distinct_institutions=True)


@query
def objective_senior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel_objective(spark, sf_dir, minimum_senior_reviewers=1)


PENALTY = 0.1


@query
def objective_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score less a penalty for each further document of an expert."""
    found, _, _ = _panel_run(spark, sf_dir, load_balance_penalty=PENALTY)
    load = found.assignments.groupBy("expert_id").agg(F.count("*").alias("n"), F.sum(F.bround(F.col("score") * 1_000_000, 0).cast("long")).alias("s"))
    cost = round(PENALTY * 1_000_000)
    return load.agg(F.sum("n").alias("assigned"), F.sum(F.col("s") - F.expr(f"{cost} * n * (n - 1) div 2")).alias("penalised"))


@query
def greedy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs themselves: SQL replays the rounds."""
    return _panel_run(spark, sf_dir, strategy="greedy", load_balance_penalty=PENALTY)[0].assignments.select("document_id", "expert_id", F.round("score", 4).alias("score"))


@query
def plan_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, demands and what is unmet of a greedy plan."""
    found, d, _ = _panel_run(spark, sf_dir, strategy="greedy", load_balance_penalty=PENALTY)
    ranks = found.assignments.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "expert_id"))), lambda x: x["expert_id"]), ",").alias("by_rank"))
    short = found.unmet.select("document_id", F.col("unmet").cast("long").alias("unmet"))
    return d.select("document_id").join(ranks, "document_id", "left").join(short, "document_id", "left").select("document_id", "by_rank", F.coalesce("unmet", F.lit(0)).alias("unmet"))


@query
def whatif_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes if an expert has no room and if a pair conflicts."""
    d, e, affinities = testdata.panels(spark, sf_dir)
    none = d.select("document_id", F.lit("").alias("expert_id"), F.lit("").alias("reason")).limit(0)
    scenarios = (whatif.Scenario("fewer", {"BUILDING": 0, "MACHINERY": 1}), whatif.Scenario("conflict", {}, (("r0", "AUTOMOBILE"), ("r1", "AUTOMOBILE"))))
    found = whatif.compare(scenarios, scoring.affinity_scores(affinities, e), d, e, none, MatchConfig(current_year=2002))
    return found.delta.select("scenario", "assigned", "unmet", F.round("total_score", 4).alias("total_score"))


@query
def centroid_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a given model: a term's vector follows from its length."""
    d, e, _ = testdata.domain(spark, sf_dir)
    terms = lambda df, key: df.select(key, F.transform("keywords", F.lower).alias("terms")).filter(F.size("terms") > 0)
    d, e = terms(d, "document_id"), terms(e, "expert_id")
    known = sorted(r.t for r in table(spark, sf_dir, "part").select(F.lower("p_brand").alias("t")).distinct().collect())  # the model's vocabulary
    number = lambda t: sum(map(int, filter(str.isdigit, t)))
    vectors = tuple(tuple((number(t) * (j + 2) % 7 - 3) / 3 for j in range(3)) for t in known)
    model = centroid.CentroidModel(CentroidConfig(), tuple(known), vectors, 1, 1.0, ())
    return centroid.score(model, d, e)


@query
def streamed_affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions that arrive as a stream, scored by the stored model: the same as a batch."""
    from dataclasses import replace

    from arbiter.plans.queries import _fitted

    fitted, submissions = _fitted(spark, sf_dir, "bm25", "max")
    model = replace(fitted, config=replace(fitted.config, minimum_output_score=0.5))
    arrivals, out, state = (scratch(spark, x) for x in ("arrivals", "streamed", "stream-state"))
    rows = testdata.passages(spark, sf_dir)
    rows.write.parquet(arrivals)
    score_stream(spark.readStream.schema(rows.schema).parquet(arrivals), model, out, state).awaitTermination()
    return spark.read.schema("document_id string, expert_id string, score double").parquet(f"{out}/batch=*").withColumn("score", F.round("score", 6))
