"""A static HTML report without scripts; every text from the data is escaped."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from arbiter.operators import audit

_STYLE = (
    "body{font:15px/1.5 sans-serif;margin:2rem auto;max-width:60rem;color:#222}table{border-collapse:collapse;width:100%}"
    "td,th{border-bottom:1px solid #ddd;padding:.3rem .5rem;text-align:left}.bar{background:#dde6f5;height:.8rem}.bar b{display:block;height:100%;background:#3465a4}.bad{color:#a40000}"
)


def _percent(x: float) -> str:
    return f"{100 * x:.1f}%"


def _table(head: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
    cells = lambda tag, r: "".join(f"<{tag}>{c}</{tag}>" for c in r)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def render(assignments: DataFrame, documents: DataFrame, experts: DataFrame, conflicts: DataFrame | None = None, diagnostics: DataFrame | None = None, default_demand: int = 2, title: str = "Assignment report", require_distinct_institutions: bool = False) -> str:
    """The report of one plan. Plans are small; their rows are read to the driver part by part."""
    found = audit.tables(assignments, documents, experts, conflicts, default_demand)
    s = audit.summary(found, require_distinct_institutions).first()
    figures = [
        ("Safe", "yes" if s.safe else '<span class="bad">no</span>'), ("Documents covered", _percent(s.document_coverage)), ("Demand covered", _percent(s.demand_coverage)),
        ("Mean score", f"{s.average_score:.3f}"), ("Lowest score", "none" if s.minimum_score is None else f"{s.minimum_score:.3f}"), ("Workload Gini", f"{s.workload_gini:.3f}"),
    ]
    warnings = [f"{escape(r.kind.replace('_', ' '))}: {escape('/'.join(x for x in (r.document_id, r.expert_id, r.institution) if x is not None))}" for r in audit.violations(found).orderBy("kind", "document_id", "expert_id", "institution").toLocalIterator()]
    named = assignments.join(documents.select("document_id", "title"), "document_id", "left").join(experts.select("expert_id", "name"), "expert_id", "left")
    rows = []
    for r in named.orderBy("document_id", "rank").toLocalIterator():
        bar = f'<div class="bar"><b style="width:{max(0.0, min(1.0, r.score)) * 100:.1f}%"></b></div>'
        rows.append((escape(r.title or r.document_id), str(r["rank"]), escape(r.name or r.expert_id), f"{r.score:.3f}", bar))
    parts = [f"<h1>{escape(title)}</h1>", _table(("Figure", "Value"), figures)]
    if warnings:
        parts.append('<h2 class="bad">Warnings</h2><ul>' + "".join(f"<li>{w}</li>" for w in warnings) + "</ul>")
    parts.append("<h2>Assignments</h2>" + _table(("Document", "Rank", "Expert", "Score", ""), rows))
    loads = [(escape(r.expert_id), f"{r.load} of {r.capacity}") for r in found["workload"].orderBy("expert_id").toLocalIterator()]
    parts.append("<h2>Workload</h2>" + _table(("Expert", "Load"), loads))
    if diagnostics is not None:
        short = [(escape(r.document_id), str(r.unmet), escape(", ".join(r.reason_codes))) for r in diagnostics.filter("unmet > 0").orderBy("document_id").toLocalIterator()]
        if short:
            parts.append("<h2>Unmet demand</h2>" + _table(("Document", "Unmet", "Evidence"), short))
    policy = "default-src 'none'; style-src 'unsafe-inline'"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>{escape(title)}</title><style>{_STYLE}</style></head><body>{"".join(parts)}</body></html>\n'
