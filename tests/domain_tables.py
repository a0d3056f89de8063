"""Small domain tables for tests."""

from __future__ import annotations

from arbiter import schemas


def documents(spark, *rows: dict):
    full = {"abstract": "", "topics": [], "keywords": [], "required_experts": None, "metadata": "{}"}
    return spark.createDataFrame([{"title": f"title {r['document_id']}", **full, **r} for r in rows], schemas.DOCUMENTS)


def experts(spark, *rows: dict):
    full = {"summary": "", "topics": [], "keywords": [], "publications": [], "capacity": 3, "institution": None, "regions": [], "seniority": 0.5, "bids": {}, "metadata": "{}"}
    return spark.createDataFrame([{"name": r["expert_id"], **full, **r} for r in rows], schemas.EXPERTS)


def conflicts(spark, *pairs: tuple):
    return spark.createDataFrame([(d, e, "declared conflict") for d, e in pairs], schemas.CONFLICTS)


def scores(spark, table: dict, ineligible: tuple = ()):
    rows = [(d, e, float(s), (d, e) not in ineligible) for (d, e), s in table.items()]
    return spark.createDataFrame(rows, "document_id string, expert_id string, total double, eligible boolean")


def paper(title: str, abstract: str = "", year: int | None = None, id: str | None = None) -> dict:  # noqa: A002
    return {"id": id, "title": title, "abstract": abstract, "year": year}
