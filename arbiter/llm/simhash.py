"""SimHash near-dedup: fingerprints, BK-trees over shards, components of links.

Fingerprint. A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; each shingle
of four words, repeats included and joined by spaces (the whole sequence if
there are fewer), is hashed by XXH64 with seed 42 over UTF-8. A bit is set if
it is set in over half of the hashes. A text without words has fingerprint 0,
which links like any other.

Search. The 64 bits are cut into b blocks; two fingerprints with at most
`radius` differing bits agree on some b - radius of them. A shard holds the
distinct fingerprints that agree on one choice of blocks, so each stands in
C(b, radius) shards. b is chosen by the number of fingerprints: with more of
them the keys get wider, and a shard's size stays about the same (5 shards each
up to some 10**6 fingerprints, 15 up to 10**9, 35 up to 10**10, then 70). Any b finds the same
links.

A shard of more than `shard_rows` is cut again by the blocks it leaves out:
these hold all differing bits, so of radius + 1 parts of them one agrees. What
is still larger is cut into parts, and each part's tree is sent to the queries
of every other part of the shard, so what one task holds is bounded by
`shard_rows` whatever the size of a group of near copies. (A single tree over
all documents, broadcast, would grow with the corpus.) In a BK-tree a child
hangs from its parent by their Hamming distance e; a query at distance d from
the parent follows only edges with |d - e| <= radius.

A shard's links leave it as a spanning forest, never as all pairs, and the
forests' components are found by `components`. Fingerprints are searched once
however many documents have them.

Defined results
  null text      as the empty text: fingerprint 0
  null doc_id    takes its fingerprint's component; it names none (null if all are null)
  repeated rows  one row each; rows that share a doc_id are one document
  empty table    empty result
  very long text hashed in blocks of 65536 shingles
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import fresh, materialise, partitions
from arbiter.llm.components import UnionFind, connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
SHARD_ROWS = 2048
PER_ROW = 500
BLOCK = 65536


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    if n == 1:
        hashes = np.array([digest(b" ".join(words), seed)], np.uint64)
        counts += _bits(hashes)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        s, e = starts[:n].tolist(), ends[shingle - 1 :].tolist()
        for k in range(0, n, BLOCK):
            hashes = np.array([digest(line[a:b], seed) for a, b in zip(s[k : k + BLOCK], e[k : k + BLOCK])], np.uint64)
            counts += _bits(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            out = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values, built by levels: each node's others, grouped by distance, are its children's subtrees."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.nodes: list[tuple[int, list[tuple[int, int]]]] = []  # (place in values, [(edge, child node)])
        if len(values):
            self._build()

    def _build(self) -> None:
        todo = [(np.arange(len(self.values)), -1, 0)]
        while todo:
            members, parent, edge = todo.pop()
            me, rest = len(self.nodes), members[1:]
            self.nodes.append((int(members[0]), []))
            if parent >= 0:
                self.nodes[parent][1].append((edge, me))
            if len(rest):
                d = np.bitwise_count(self.values[rest] ^ self.values[members[0]])
                order = np.argsort(d, kind="stable")
                cuts = np.flatnonzero(np.diff(d[order])) + 1
                for group in np.split(rest[order], cuts):
                    todo.append((group, me, int(np.bitwise_count(self.values[group[0]] ^ self.values[members[0]]))))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place of a value, places of the queries within radius) for every value with any. All queries go down together."""
        todo = [(0, np.arange(len(queries)))] if self.nodes else []
        while todo:
            node, who = todo.pop()
            at, children = self.nodes[node]
            d = np.bitwise_count(queries[who] ^ self.values[at]).astype(np.int16)
            if (hit := who[d <= radius]).size:
                yield at, hit
            for edge, child in children:
                if (down := who[np.abs(d - edge) <= radius]).size:
                    todo.append((child, down))


def _forest(tree_fp: np.ndarray, tree_id: np.ndarray, query_fp: np.ndarray, query_id: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges (smaller root, member) of the components of links between a tree's values and the queries."""
    links = UnionFind()
    for at, hit in BKTree(tree_fp).search(query_fp, radius):
        me = int(tree_id[at])
        for other in query_id[hit].tolist():
            if other != me:
                links.union(me, other)
    return links.stars()


def block_count(fingerprints: int, radius: int = RADIUS) -> int:
    """Into how many blocks the bits are cut: more if shards would be large. A row in a shard costs about as much as PER_ROW comparisons."""
    cost = lambda b: comb(b, radius) * (1 + fingerprints / 2 ** (64 * (b - radius) / b) / PER_ROW)
    return min(range(radius + 1, radius + 9), key=cost)


def _masks(bits: list[int], parts: int) -> list[int]:
    """The bits dealt to so many masks in turn, in runs of about one length."""
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << x for x in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shard_keys(blocks: int, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """For each choice of blocks to agree on: the mask of their bits, and those of the parts of the other bits."""
    every = _masks(list(range(64)), blocks)
    out = []
    for chosen in combinations(every, blocks - radius):
        mask = sum(chosen)
        out.append((mask, _masks([x for x in range(64) if not mask >> x & 1], radius + 1)))
    return out


def shard_links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) between ids, a spanning forest for each shard, from distinct rows (fp, id)."""
    keys = shard_keys(blocks or block_count(fps.count(), radius), radius)
    masked = lambda mask: F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    choice = [F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), masked(mask)).alias("key")) for i, (mask, _) in enumerate(keys)]
    keyed = fps.select("fp", "id", F.explode(F.array(*choice)).alias("k")).select("fp", "id", "k.choice", "k.key")
    # Written: then the joins' sides are plain exchanges, of which one is broadcast if small and a skewed one is split.
    large = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).select("key"), "large-shards")
    rest = keyed.join(large, "key", "left_anti").select("fp", "id", "key", F.lit(1).alias("parts"))
    parts_of = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for _, masks in keys])
    cut = keyed.join(large, "key", "left_semi").select("fp", "id", "key", F.posexplode(F.get(parts_of, F.col("choice"))).alias("j", "mask"))
    cut = cut.select("fp", "id", F.xxhash64("key", "j", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    sizes = materialise(cut.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
    cut = cut.join(sizes, "key").select("fp", "id", "key", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts"))
    keyed = rest.unionByName(cut).withColumn("part", F.pmod(F.hash("fp"), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("a"), F.greatest("part", j).alias("b")))
    tasks = keyed.select("fp", "id", "key", "part", F.explode(pair).alias("p")).select("key", "p.a", "p.b", "part", "fp", "id")
    n = partitions(fps.sparkSession)
    tasks = tasks.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        out: list[tuple[int, int]] = []

        def solve(g: list[np.ndarray]) -> None:
            a, b, part, fp, ids = g[1][0], g[2][0], g[3], g[4].view(np.uint64), g[5]
            tree = part == a
            queries = part == b
            out.extend(_forest(fp[tree], ids[tree], fp[queries], ids[queries], radius))

        def flush() -> pa.RecordBatch:
            rows = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["u", "v"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            edges = [0, *change.tolist()]
            for lo, hi in zip(edges, edges[1:]):
                if hi - lo > 1:
                    solve([c[lo:hi] for c in cols])
            rest = [c[edges[-1] :] for c in cols]
            if out:
                yield flush()
        if rest is not None and len(rest[0]) > 1:
            solve(rest)
        if out:
            yield flush()

    return tasks.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of `docs`. Ids are integers."""
    rows = fingerprints(docs, id_col, text_col)
    rows = materialise(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    links = materialise(shard_links(distinct.filter("id is not null"), radius, shard_rows), "links")
    roots = connected_components(links)
    found = distinct.join(roots, distinct.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    found = materialise(found, "classes")
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay: of each component the document with the smallest id. Columns as in `docs`.

    Only ids of documents that go are joined back; rows without an id stay.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).filter("doc_id <> component_id").select("doc_id").distinct()
    key = fresh(docs, "__gone")
    gone = materialise(gone.select(F.col("doc_id").alias(key)), "gone")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(key), "left_anti")
