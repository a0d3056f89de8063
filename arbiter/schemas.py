"""Schemas of the domain tables and the checks that they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.errors import DataValidationError
from arbiter.functions.numbers import finite
from arbiter.functions.text import blank, identifier_ok

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


PUBLICATION = _struct(id=_S, title=_S, abstract=_S, year=_I)
DOCUMENTS = _struct(document_id=_S, title=_S, abstract=_S, topics=T.ArrayType(_S), keywords=T.ArrayType(_S), required_experts=_I, metadata=_S)
EXPERTS = _struct(
    expert_id=_S, name=_S, summary=_S, topics=T.ArrayType(_S), keywords=T.ArrayType(_S), publications=T.ArrayType(PUBLICATION), capacity=_I,
    institution=_S, regions=T.ArrayType(_S), seniority=_D, bids=T.MapType(_S, _D), metadata=_S,
)
CONFLICTS = _struct(document_id=_S, expert_id=_S, reason=_S)
AFFINITIES = _struct(document_id=_S, expert_id=_S, score=_D)
ASSIGNMENTS = _struct(document_id=_S, expert_id=_S, score=_D)
DEFAULT_REASON = "declared conflict"


def refuse(rows: DataFrame, message: str, *columns: str) -> None:
    """Raise if `rows` has any; the first few are named."""
    if bad := rows.select(*columns).distinct().orderBy(*columns).limit(6).collect():
        named = ", ".join("/".join(map(str, r)) for r in bad[:5]) + (", ..." if len(bad) > 5 else "")
        raise DataValidationError(f"{message}: {named}")


def unique(rows: DataFrame, what: str, *keys: str) -> None:
    refuse(rows.groupBy(*keys).count().filter("count > 1"), f"{what} must be unique", *keys)


def _rules(rows: DataFrame, what: str, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """All rules of rows in one pass, then the ids' uniqueness; what is broken first in the list is named."""
    found = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.bool_or(bad), F.lit(False)).alias(f"r{k}") for k, (bad, _) in enumerate(rules)]).first()
    for k, (bad, message) in enumerate(rules):
        if k == 1:
            unique(rows, f"{what} ids", key)
        if found[f"r{k}"]:
            refuse(rows.filter(bad), message, key)
    if not found.n:
        raise DataValidationError(f"one {what} at least is required")
    return rows


def check_documents(documents: DataFrame) -> DataFrame:
    """Ids are valid and unique, titles not blank, demands 1 at least, and there is one row."""
    return _rules(documents, "document", "document_id", [
        (~identifier_ok(F.col("document_id")), "document ids must be non-empty, stripped and printable"),
        (blank(F.col("title")), "document titles must not be blank"),
        (F.expr("required_experts < 1"), "required_experts must be positive"),
    ])


def check_experts(experts: DataFrame) -> DataFrame:
    """Ids are valid and unique, capacities not negative, seniority, bids and years in their ranges."""
    return _rules(experts, "expert", "expert_id", [
        (~identifier_ok(F.col("expert_id")), "expert ids must be non-empty, stripped and printable"),
        (F.col("capacity").isNull() | (F.col("capacity") < 0), "capacities must not be negative"),
        (~(finite(F.col("seniority")) & F.col("seniority").between(0, 1)), "seniority must be in [0, 1]"),
        (F.exists(F.map_values("bids"), lambda b: ~(finite(b) & b.between(-1, 1))), "bids must be in [-1, 1]"),
        (F.exists("publications", lambda p: p["year"].isNotNull() & ~p["year"].between(1800, 2200)), "publication years must be from 1800 to 2200"),
        (F.exists("publications", lambda p: blank(p["title"])), "publication titles must not be blank"),
    ])


def check_references(pairs: DataFrame, documents: DataFrame, experts: DataFrame, what: str) -> DataFrame:
    """Every pair names a known document and a known expert."""
    refuse(pairs.join(documents.select("document_id"), "document_id", "left_anti"), f"{what} name unknown documents", "document_id")
    refuse(pairs.join(experts.select("expert_id"), "expert_id", "left_anti"), f"{what} name unknown experts", "expert_id")
    return pairs


def check_unit(pairs: DataFrame, column: str, what: str) -> DataFrame:
    refuse(pairs.filter(~(finite(F.col(column)) & F.col(column).between(0, 1))), f"{what} must be in [0, 1]", "document_id", "expert_id")
    return pairs
