"""Readers of the domain tables: documents, experts, conflicts, affinities, judgments, triplets, vectors."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter import schemas
from arbiter.errors import DataValidationError
from arbiter.functions.numbers import finite
from arbiter.functions.text import clean_labels
from arbiter.operators.evaluation import unpivot_wide
from arbiter.operators.vectors import check_vectors
from arbiter.schemas import refuse, unique
from arbiter.sources.strict import REQUIRED, checked, read_fields, read_records

_DOCUMENT = {"id": ("string", REQUIRED), "title": ("string", REQUIRED), "abstract": ("string", ""), "topics": ("strings", []), "keywords": ("strings", []), "required_experts": ("int", None), "metadata": ("object", {})}
_PUBLICATION = {"id": ("string", None), "title": ("string", REQUIRED), "abstract": ("string", ""), "year": ("int", None)}
_EXPERT = {
    "id": ("string", REQUIRED), "name": ("string", REQUIRED), "summary": ("string", ""), "topics": ("strings", []), "keywords": ("strings", []), "publications": ("list", []), "capacity": ("int", 3),
    "institution": ("string", None), "regions": ("strings", []), "seniority": ("number", 0.5), "bids": ("object", {}), "metadata": ("object", {}),
}
_CONFLICT = {"document_id": ("string", REQUIRED), "expert_id": ("string", REQUIRED), "reason": ("string", schemas.DEFAULT_REASON)}
_TRIPLET = {"document_id": ("string", REQUIRED), "positive_expert_id": ("string", REQUIRED), "negative_expert_id": ("string", REQUIRED)}
_VECTOR = {"paper_id": ("string", REQUIRED), "embedding": ("list", REQUIRED)}
TRIPLETS = T.StructType([T.StructField(n, T.StringType()) for n in _TRIPLET])
VECTORS = T.StructType([T.StructField("paper_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def document_row(record: dict[str, Any]) -> dict[str, Any]:
    r = read_fields(record, _DOCUMENT, "document")
    return {"document_id": r.pop("id"), **r, "metadata": json.dumps(r["metadata"], sort_keys=True, ensure_ascii=False)}


def expert_row(record: dict[str, Any]) -> dict[str, Any]:
    r = read_fields(record, _EXPERT, "expert")
    r["publications"] = [read_fields(p if isinstance(p, dict) else {}, _PUBLICATION, "publication") for p in r["publications"]]
    if any(isinstance(b, bool) or not isinstance(b, (int, float)) for b in r["bids"].values()):
        raise DataValidationError("bids must be numbers")
    r["bids"] = {k: float(v) for k, v in r["bids"].items()}
    r["seniority"] = float(r["seniority"])
    return {"expert_id": r.pop("id"), **r, "metadata": json.dumps(r["metadata"], sort_keys=True, ensure_ascii=False)}


def conflict_row(record: dict[str, Any]) -> dict[str, Any]:
    return read_fields(record, _CONFLICT, "conflict")


def vector_row(record: dict[str, Any]) -> dict[str, Any]:
    r = read_fields(record, _VECTOR, "vector")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in r["embedding"]):
        raise DataValidationError("an embedding must be numbers")
    return {"paper_id": r["paper_id"], "embedding": [float(x) for x in r["embedding"]]}


def load_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    rows = checked(read_records(spark, path, document_row, schemas.DOCUMENTS, **options)).drop("position")
    return schemas.check_documents(rows.withColumns({c: clean_labels(F.col(c)) for c in ("topics", "keywords")}))


def load_experts(spark: SparkSession, path: str, **options) -> DataFrame:
    rows = checked(read_records(spark, path, expert_row, schemas.EXPERTS, **options)).drop("position")
    return schemas.check_experts(rows.withColumns({c: clean_labels(F.col(c)) for c in ("topics", "keywords", "regions")}))


def load_conflicts(spark: SparkSession, path: str | None, **options) -> DataFrame:
    """No path is no conflicts. Of repeated pairs the last one counts, so `position` stays."""
    if path is None:
        return spark.createDataFrame([], T.StructType([*schemas.CONFLICTS.fields, T.StructField("position", T.LongType())]))
    return checked(read_records(spark, path, conflict_row, schemas.CONFLICTS, **options))


def load_triplets(spark: SparkSession, path: str) -> DataFrame:
    return checked(read_records(spark, path, lambda r: read_fields(r, _TRIPLET, "triplet"), TRIPLETS, blank_lines=False)).drop("position")


def load_vectors(spark: SparkSession, path: str, requests: DataFrame, dimensions: int = 768) -> DataFrame:
    rows = checked(read_records(spark, path, vector_row, VECTORS, blank_lines=False)).drop("position")
    unique(rows, "vector papers", "paper_id")
    return check_vectors(rows, requests, dimensions)


#: Bytes of a delimited file and of one of its lines, at most. Fixed values.
MAX_FILE_BYTES, MAX_LINE_BYTES = 64 << 20, 1 << 20


def bounded(spark: SparkSession, path: str, most: int = MAX_FILE_BYTES, most_line: int = MAX_LINE_BYTES) -> str:
    """The path, if its files have no more bytes than allowed, no line above its bound (LF, CR or both end one) and no NUL."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first().n or 0
    if size > most:
        raise DataValidationError(f"{path} has more than {most} bytes")
    lines = spark.read.text(path)
    bad = lines.agg(F.max(F.octet_length("value")).alias("n"), F.max(F.col("value").contains("\x00").cast("int")).alias("nul")).first()
    if (bad.n or 0) > most_line:
        raise DataValidationError(f"a line has more than {most_line} bytes")
    if bad.nul:
        raise DataValidationError("a line has a NUL")
    return path


def _delimited(spark: SparkSession, path: str, fields: int, header: tuple[str, ...], optional_header: bool, separators: str) -> DataFrame:
    """(position, f): non-blank lines split at the separator of the first line; exactly `fields` fields each, quotes as in CSV."""
    lines = spark.read.text(bounded(spark, path), lineSep="\n").withColumn("value", F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^﻿", "")).filter("trim(value) <> ''")
    first = lines.withColumn("at", F.monotonically_increasing_id()).orderBy("at").limit(1).collect()
    if not first:
        raise DataValidationError("the file is empty")
    sep = "\t" if "\t" in separators and "\t" in first[0].value else ","
    head = [x.strip() for x in first[0].value.split(sep)]
    if head != list(header) and not optional_header:
        raise DataValidationError(f"the header must be {','.join(header)}")
    names = [f"f{i}" for i in range(fields + 1)]  # one more shows lines that are too long
    rows = lines.select(F.monotonically_increasing_id().alias("position"), F.from_csv("value", F.lit(", ".join(f"{n} string" for n in names)), {"sep": sep, "escape": '"'}).alias("f"))
    if head == list(header):
        rows = rows.filter(F.col("position") != first[0].at)
    bad = F.col(f"f.f{fields}").isNotNull()
    for n in names[:fields]:
        bad = bad | F.col(f"f.{n}").isNull() if optional_header else bad
    refuse(rows.filter(bad), f"lines must have exactly {fields} fields; bad line", "position")
    return rows


def _score(text: Column) -> Column:
    return F.trim(text).try_cast("double") if hasattr(text, "try_cast") else F.expr("try_cast(trim(f.f2) as double)")


def load_affinities(spark: SparkSession, path: str) -> DataFrame:
    """document, expert, score by line, with or without a header; scores in [0, 1], pairs once."""
    rows = _delimited(spark, path, 3, ("document_id", "expert_id", "score"), True, ",")
    rows = rows.select(F.trim("f.f0").alias("document_id"), F.trim("f.f1").alias("expert_id"), _score(F.col("f.f2")).alias("score"))
    if rows.isEmpty():
        raise DataValidationError("one affinity at least is required")
    refuse(rows.filter(~(finite(F.col("score")) & F.col("score").between(0, 1)) | F.col("score").isNull()), "scores must be numbers in [0, 1]", "document_id", "expert_id")
    refuse(rows.filter("document_id = '' or expert_id = ''"), "ids must not be empty", "document_id", "expert_id")
    unique(rows, "affinity pairs", "document_id", "expert_id")
    return rows


def load_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments as triples or as the wide table of participants with ten papers each."""
    wide = ("ParticipantID", *[x for i in range(1, 11) for x in (f"Paper{i}", f"Expertise{i}")])
    try:
        rows = _delimited(spark, path, 3, ("document_id", "expert_id", "relevance"), False, ",\t")
    except DataValidationError as error:
        if "header" not in str(error):
            raise
        rows = _delimited(spark, path, len(wide), wide, False, ",\t")
        return unpivot_wide(rows.select(*[F.col(f"f.f{i}").alias(n) for i, n in enumerate(wide)]))
    rows = rows.select(F.trim("f.f0").alias("document_id"), F.trim("f.f1").alias("expert_id"), F.trim("f.f2").alias("grade"))
    refuse(rows.filter(~F.coalesce(F.col("grade").rlike("^[0-9]{1,4}$"), F.lit(False)) | (F.expr("try_cast(grade as int)") > 1000)), "grades must be integers from 0 to 1000", "document_id", "expert_id")
    rows = rows.select("document_id", "expert_id", F.col("grade").cast("int").alias("relevance"))
    unique(rows, "judged pairs", "document_id", "expert_id")
    return rows
