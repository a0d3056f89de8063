"""Notes, profiles and publications of a review site's API (both of its content shapes) as domain tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter import schemas
from arbiter.errors import DataValidationError
from arbiter.functions.text import clean_labels
from arbiter.schemas import refuse, unique
from arbiter.sources.strict import checked, read_records
from arbiter.storage import materialise

#: Where metadata comes from and what it is called. Fixed values.
_METADATA = (("forum", "openreview_forum"), ("invitation", "openreview_invitation"), ("venueid", "openreview_venue"))
_ADAPTER = "openreview-note-v1-v2"

PROFILES = T.StructType([T.StructField(n, T.StringType()) for n in ("expert_id", "name", "summary")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("topics", "keywords")])
PUBLICATIONS = T.StructType([T.StructField("expert_id", T.StringType()), *schemas.PUBLICATION.fields])

#: What a profile and a publication may keep; all else is dropped on arrival. Fixed values.
PROFILE_FIELDS = ("names", "bio", "research_interests", "keywords", "expertise")
PUBLICATION_FIELDS = ("id", "invitations", "pdate", "title", "abstract", "authorids", "year")


def unwrap(value: Any, name: str) -> Any:
    """A bare value, or the value of an object with one."""
    if isinstance(value, dict):
        if "value" not in value:
            raise DataValidationError(f"{name} must have a value")
        return value["value"]
    return value


def _object(value: Any, name: str) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise DataValidationError(f"{name} must be an object")
    return value


def _text(value: Any, name: str, required: bool = False) -> str:
    value = unwrap(value, name)
    if value is None and not required:
        return ""
    if not isinstance(value, str) or (required and not value.strip()):
        raise DataValidationError(f"{name} must be a string" + " that isn't blank" * required)
    return value


def _labels(value: Any, name: str) -> list[str]:
    value = unwrap(value, name)
    value = [] if value is None else [value] if isinstance(value, str) else value
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise DataValidationError(f"{name} must be a string or a list of strings")
    return [x for x in value if x.strip()]


def submission(note: dict[str, Any]) -> dict[str, Any]:
    content = _object(note.get("content"), "content")
    metadata: dict[str, Any] = {"adapter": _ADAPTER}
    for field, name in _METADATA:
        if note.get(field) is not None:
            metadata[name] = _text(note[field], field)
    if note.get("invitations") is not None:
        metadata["openreview_invitations"] = _labels(note["invitations"], "invitations")
    if content.get("venueid") is not None:
        metadata["openreview_venue"] = _text(content["venueid"], "venueid")
    topics = _labels(content.get("subject_areas"), "subject_areas") + _labels(content.get("subject_area"), "subject_area")
    return {
        "document_id": _text(note.get("id"), "id", True), "title": _text(content.get("title"), "title", True), "abstract": _text(content.get("abstract"), "abstract"),
        "topics": list(dict.fromkeys(topics)), "keywords": _labels(content.get("keywords"), "keywords"), "required_experts": None, "metadata": json.dumps(metadata, sort_keys=True, ensure_ascii=False),
    }


def profile(record: dict[str, Any]) -> dict[str, Any]:
    content = _object(record.get("content"), "content")
    names = unwrap(content.get("names"), "names")
    if not isinstance(names, list) or not names:
        raise DataValidationError("a profile must have names")
    found = []
    for n in names:
        preferred = _object(n, "name").get("preferred", False)
        if not isinstance(preferred, bool):
            raise DataValidationError("preferred must be true or false")
        found.append((not preferred, _text(n.get("fullname"), "fullname", True)))
    topics = _labels(content.get("expertise"), "expertise") + _labels(content.get("research_interests"), "research_interests")
    # min keeps the first of equals
    return {"expert_id": _text(record.get("id"), "id", True), "name": min(found, key=lambda x: x[0])[1], "summary": _text(content.get("bio"), "bio"), "topics": list(dict.fromkeys(topics)), "keywords": _labels(content.get("keywords"), "keywords")}


def publication(record: dict[str, Any]) -> dict[str, Any]:
    if set(record) != {"reviewer_id", "note"}:
        raise DataValidationError("a publication row has exactly reviewer_id and note")
    note = _object(record["note"], "note")
    content = _object(note.get("content"), "content")
    year = unwrap(content.get("year"), "year")
    if year is not None and (isinstance(year, bool) or not isinstance(year, int) or not 1800 <= year <= 2200):
        raise DataValidationError("a year must be null or from 1800 to 2200")
    return {"expert_id": _text(record["reviewer_id"], "reviewer_id", True), "id": _text(note.get("id"), "id", True), "title": _text(content.get("title"), "title", True), "abstract": _text(content.get("abstract"), "abstract"), "year": year}


def load_submissions(spark: SparkSession, path: str, **options) -> DataFrame:
    rows = checked(read_records(spark, path, submission, schemas.DOCUMENTS, **options)).drop("position")
    return schemas.check_documents(rows.withColumns({c: clean_labels(F.col(c)) for c in ("topics", "keywords")}))


def _experts(profiles: DataFrame, publications: DataFrame, capacity: int) -> DataFrame:
    """Profiles with their publications, sorted by id, title and year; those without any stay."""
    order = F.struct("id", "title", F.coalesce("year", F.lit(-1)).alias("y"), "abstract", "year")
    papers = publications.groupBy("expert_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda p: F.struct(p["id"].alias("id"), p["title"].alias("title"), p["abstract"].alias("abstract"), p["year"].alias("year"))).alias("publications"))
    none = F.array().cast(T.ArrayType(schemas.PUBLICATION))
    rows = profiles.join(papers, "expert_id", "left").withColumns({
        "publications": F.coalesce("publications", none), "capacity": F.lit(capacity), "institution": F.lit(None).cast("string"), "regions": F.array().cast("array<string>"),
        "seniority": F.lit(0.5), "bids": F.create_map().cast("map<string,double>"), "metadata": F.lit("{}"),
    })
    return rows.select(*schemas.EXPERTS.names)


def load_snapshot(spark: SparkSession, submissions: str, profiles: str, publications: str, capacity: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents, experts) of the three snapshot files. Unknown reviewers and repeated publications are errors."""
    p = checked(read_records(spark, profiles, profile, PROFILES)).drop("position")
    unique(p, "profile ids", "expert_id")
    papers = checked(read_records(spark, publications, publication, PUBLICATIONS)).drop("position")
    refuse(papers.join(p, "expert_id", "left_anti"), "publications of unknown reviewers", "expert_id")
    unique(papers, "a reviewer's publications", "expert_id", "id")
    p = p.withColumns({c: clean_labels(F.col(c)) for c in ("topics", "keywords")})
    return load_submissions(spark, submissions), schemas.check_experts(materialise(_experts(p, papers, capacity), "experts"))


def load_reviewer_ids(spark: SparkSession, path: str, capacity: int = 3) -> DataFrame:
    """Experts known by id only, one on a line; repeated ids are errors."""
    ids = spark.read.text(path).select(F.trim("value").alias("expert_id")).filter("expert_id <> ''")
    unique(ids, "reviewer ids", "expert_id")
    p = ids.select("expert_id", F.col("expert_id").alias("name"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("topics"), F.array().cast("array<string>").alias("keywords"))
    return schemas.check_experts(_experts(p, spark.createDataFrame([], PUBLICATIONS), capacity))


def filter_publications(notes: DataFrame, invitations: tuple[str, ...] = (), minimum_date: int | None = None, maximum_date: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(retained, counts by reason) of rows (expert_id, note_id, invitation, pdate, odate, cdate, title, abstract), dates in UTC milliseconds.

    Of the dates the first that is there counts. Invitation, date and content are looked at in this order.
    """
    date = F.coalesce("pdate", "odate", "cdate")
    wrong = F.lit(False) if not invitations else ~F.coalesce(F.col("invitation").isin(*invitations), F.lit(False))
    late = F.lit(False)
    if minimum_date is not None:
        late = late | (F.col("date") < minimum_date)
    if maximum_date is not None:
        late = late | (F.col("date") > maximum_date)
    reason = F.when(wrong, "invitation").when(F.col("date").isNull() | late, "date").when(F.trim(F.coalesce("title", F.lit(""))) == "", "content").otherwise("retained")
    rows = notes.withColumn("date", date).withColumn("reason", reason)
    year = F.year(F.timestamp_millis(F.col("date")))
    kept = rows.filter("reason = 'retained'").select("expert_id", F.col("note_id").alias("id"), "title", F.coalesce("abstract", F.lit("")).alias("abstract"), year.alias("year"))
    return kept, rows.groupBy("reason").agg(F.count("*").alias("n"))
