"""The benchmark tables read as a matching domain.

Documents are nations that look for suppliers, experts are suppliers, built by
aggregating the whole tables; retrieval takes the benchmark passages as
submissions and the documents of a source as that reviewer's evidence. The
same derivations stand in `plans/oracles.py` as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.config import MatchConfig
from arbiter.storage import materialise

CONFIG = MatchConfig(current_year=2002)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out if their scan has fewer tasks than there are cores: a small file of one row group is one task."""
    rows = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p_type, p_brand, l_quantity, year, returned, nation of the customer) of every line."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.year("l_shipdate").alias("year"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return line.join(part, "l_partkey").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("expert_id"), "p_type", "p_brand", "l_quantity", "l_returnflag", "year")


def by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`traded` with the buyer's nation as document_id."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("l_orderkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("document_id"))
    return traded(spark, sf_dir).join(buyers, "l_orderkey")


def _above_average(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label array): the labels with more than their even share of the key's quantity, sorted."""
    sums = rows.groupBy(key, label).agg(F.sum("l_quantity").alias("q"))
    mean = sums.groupBy(key).agg((F.sum("q") / F.count("*")).alias("mean"))
    return sums.join(mean, key).filter("q > mean").groupBy(key).agg(F.array_sort(F.collect_list(label)).alias(label))


def documents(spark: SparkSession, sf_dir: str, nation_lines: DataFrame | None = None) -> DataFrame:
    lines = by_nation(spark, sf_dir) if nation_lines is None else nation_lines
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    none = F.array().cast("array<string>")
    rows = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("document_id"), F.col("n_name").alias("title"), F.col("r_name").alias("abstract"), (1 + F.col("n_nationkey") % 2).cast("int").alias("required_experts"))
    rows = rows.join(_above_average(lines, "document_id", "p_type"), "document_id", "left").join(_above_average(lines, "document_id", "p_brand"), "document_id", "left")
    return rows.select("document_id", "title", "abstract", F.coalesce("p_type", none).alias("topics"), F.coalesce("p_brand", none).alias("keywords"), "required_experts", F.lit("{}").alias("metadata"))


def experts(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, nation_lines: DataFrame | None = None) -> DataFrame:
    lines = traded(spark, sf_dir) if lines is None else lines
    nation_lines = by_nation(spark, sf_dir) if nation_lines is None else nation_lines
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    bounds = s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    s = s.crossJoin(bounds).select(  # bounds is one row
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("expert_id"), F.col("s_name").alias("name"), F.concat_ws(" ", "s_name", "n_name").alias("summary"), (F.col("s_suppkey") % 4).cast("int").alias("capacity"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("n_name")).alias("institution"), F.coalesce((F.col("s_acctbal") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.5)).alias("seniority"),
    )
    papers = lines.groupBy("expert_id", "p_brand").agg(F.max("year").alias("year"), F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("abstract"))
    paper = F.struct(F.col("p_brand").alias("id"), F.col("p_brand").alias("title"), "abstract", F.col("year").cast("int").alias("year"))
    papers = papers.groupBy("expert_id").agg(F.array_sort(F.collect_list(paper)).alias("publications"))
    bids = nation_lines.groupBy("expert_id", "document_id").agg((1 - 2 * F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("bid"))
    bids = bids.groupBy("expert_id").agg(F.map_from_entries(F.collect_list(F.struct("document_id", "bid"))).alias("bids"))
    none = F.array().cast("array<string>")
    out = s.join(_above_average(lines, "expert_id", "p_type"), "expert_id", "left").join(_above_average(lines, "expert_id", "p_brand"), "expert_id", "left").join(papers, "expert_id", "left").join(bids, "expert_id", "left")
    return out.select(
        "expert_id", "name", "summary", F.coalesce("p_type", none).alias("topics"), F.coalesce("p_brand", none).alias("keywords"),
        F.coalesce("publications", F.array().cast("array<struct<id:string,title:string,abstract:string,year:int>>")).alias("publications"), "capacity", "institution", none.alias("regions"), "seniority",
        F.coalesce("bids", F.create_map().cast("map<string,double>")).alias("bids"), F.lit("{}").alias("metadata"),
    )


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's own suppliers."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("document_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("expert_id"), F.lit("same nation").alias("reason"))


def domain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, experts and conflicts; the joined lines and both sides are made once and shared."""
    lines = materialise(by_nation(spark, sf_dir), "lines")
    return materialise(documents(spark, sf_dir, lines), "documents"), materialise(experts(spark, sf_dir, lines, lines), "experts"), conflicts(spark, sf_dir)


def fixed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that needs no solver: each supplier goes to the nation that bought most from it, with its share as the score.

    It breaks capacities, demands and conflicts, which is what an audit is for.
    """
    rows = by_nation(spark, sf_dir).groupBy("expert_id", "document_id").agg(F.sum("l_quantity").alias("q"))
    share = rows.groupBy("expert_id").agg(F.sum("q").alias("total"), F.max(F.struct("q", "document_id")).alias("best"))
    return share.select(F.col("best.document_id").alias("document_id"), "expert_id", (F.col("best.q") / F.col("total")).alias("score"))


def segment_affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments and nations of customers: each nation's share of a segment's balance, scaled by the largest."""
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    top = c.groupBy("c_mktsegment").agg(F.max("n").alias("top"))
    return c.join(top, "c_mktsegment").select(F.col("c_mktsegment").alias("document_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("expert_id"), (F.col("n") / F.col("top")).alias("score"))


def segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of `segment_affinities`: every segment asks for two nations, a nation takes 1 to 3."""
    d = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("document_id")).distinct().withColumn("title", F.col("document_id")).withColumn("required_experts", F.lit(2))
    n = table(spark, sf_dir, "nation")
    e = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("expert_id"), F.col("n_name").alias("name"), (1 + F.col("n_nationkey") % 3).cast("int").alias("capacity"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("institution"), ((F.col("n_nationkey") % 4) / 3.0).alias("seniority"))
    return d, e


def priority_affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities and order states: the state's share of the priority's orders, times its mean price over the highest one."""
    o = table(spark, sf_dir, "orders")
    n = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    all_n = n.groupBy("o_orderpriority").agg(F.sum("n").alias("total"))
    return n.join(all_n, "o_orderpriority").select(F.col("o_orderpriority").alias("document_id"), F.col("o_orderstatus").alias("expert_id"), (F.col("n") / F.col("total")).alias("score"))


def priorities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderpriority").alias("document_id")).distinct().withColumn("title", F.col("document_id")).withColumn("required_experts", F.lit(1))
    e = o.select(F.col("o_orderstatus").alias("expert_id")).distinct().withColumns({"name": F.col("expert_id"), "capacity": F.lit(2), "institution": F.lit(None).cast("string"), "seniority": F.lit(0.5)})
    return d, e


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as submissions."""
    b = table(spark, sf_dir, "benchmark")
    none = F.array().cast("array<string>")
    return b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("document_id"), F.coalesce("text", F.lit("")).alias("title"), F.lit("").alias("abstract"), none.alias("topics"), none.alias("keywords"))


def sources_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(expert_id, evidence_id, ord, year, text): every document as evidence of its source."""
    d = texts(spark, sf_dir)
    return d.select(F.coalesce("source", F.lit("none")).alias("expert_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("evidence_id"), F.col("doc_id").alias("ord"), (2010 + F.col("doc_id") % 16).cast("int").alias("year"), F.coalesce("text", F.lit("")).alias("text"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents judged for their source: grade quality + (1 - toxic)."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select(F.coalesce("source", F.lit("none")).alias("document_id"), F.col("doc_id").cast("string").alias("expert_id"), (F.col("quality") + (1 - F.col("toxic"))).cast("int").alias("relevance"))


def length_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document: how near its length is to the longest."""
    d = table(spark, sf_dir, "documents")
    top = d.agg(F.max("n_chars").alias("top"))
    return d.crossJoin(top).select(F.coalesce("source", F.lit("none")).alias("document_id"), F.col("doc_id").cast("string").alias("expert_id"), (F.col("n_chars") / F.col("top")).alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(submissions, publications, associations, reviewers) from the embeddings table.

    Every tenth vector is a submission; the rest are publications of the reviewer that their label names.
    """
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("paper_id"), "embedding", F.concat(F.lit("l"), F.col("label").cast("string")).alias("expert_id"), F.col("vec_id").alias("ord"), (F.col("vec_id") % 10 == 0).alias("asked"))
    subs, pubs = v.filter("asked"), v.filter("not asked")
    return subs.select("paper_id", "embedding"), pubs.select("paper_id", "embedding"), pubs.select("expert_id", "paper_id", "ord"), v.select("expert_id").distinct()


def panels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, experts, affinities): regions that ask for two market segments each, by their share of the region's customers.

    Small enough that SQL can enumerate all plans, with institutions, seniors and capacities of 2 and 3.
    """
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, sf_dir, "nation"), "n_nationkey")
    c = c.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("document_id"), F.col("c_mktsegment").alias("expert_id")).agg(F.count("*").alias("n"))
    most = c.groupBy("document_id").agg(F.max("n").alias("most"))
    affinities = c.join(most, "document_id").select("document_id", "expert_id", F.round(F.col("n") / F.col("most"), 4).alias("score"))
    d = c.select("document_id").distinct().withColumns({"title": F.col("document_id"), "required_experts": F.lit(2)})
    place = F.length("expert_id") % 3  # AUTOMOBILE 1, BUILDING 2, FURNITURE 0, HOUSEHOLD 0, MACHINERY 0
    e = c.select("expert_id").distinct().withColumns({"name": F.col("expert_id"), "capacity": F.when(place == 0, 2).otherwise(3), "institution": F.when(place > 0, F.lit("i")).when(F.col("expert_id") > "H", F.lit("j")), "seniority": F.when(F.col("expert_id") < "H", 1.0).otherwise(0.0)})
    return d, e, affinities
