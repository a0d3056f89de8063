"""Connected components of an edge table, without collecting links or components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arbiter.operators.components import components

#: Up to so many edges (16 MB) are finished in one task; above, rounds go on.
FINISH_ROWS = 1_000_000


class UnionFind:
    """Components in memory; the smallest member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while x != root:
            p[x], x = root, p.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.parent.setdefault(a, a)
            self.parent[b] = a

    def stars(self) -> Iterator[tuple[int, int]]:
        return ((self.find(x), x) for x in list(self.parent) if self.find(x) != x)


def _contract(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars: as many rows as nodes at most, with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = UnionFind()
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                links.union(u, v)
        rows = np.array(list(links.stars()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, finish_rows: int = FINISH_ROWS, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (u, v) but the roots: root is the smallest node reachable.

    Rounds of large star and small star; when few edges are left, one task
    finishes them. That is a bound on the edges of that task, and no edge is
    dropped. If `max_rounds` don't suffice, it is an error.
    """
    return components(edges, max_rounds, lambda few: _contract(few.coalesce(1)), finish_rows).filter("node <> root")
