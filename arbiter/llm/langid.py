"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone.
A letter trigram binds the three permuted (rolled) letter vectors by their
product; a text bundles its trigrams by their sum; a language's prototype
bundles the unit vectors of its training texts. A text takes the language whose
prototype has the largest cosine, and that cosine, cut to [0, 1], is the score.

Runs of anything but letters count as one boundary, which has a vector too.
Texts are read whole, in blocks.

Training takes about `per_language` documents of each language, chosen by a
hash of the id (the documented bound of the sample). Every value of the column
is learned. What is broadcast is one prototype a value (4 KB); more than
`MOST_LANGUAGES` values (256 MB) are refused as an error, none is dropped.

Defined results
  null text, no letter  'und', score 0
  nothing to learn from 'und', score 0
  equal cosines         the smaller language tag
  null language         not learned from
  repeated rows         each predicted; each weighs in training
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import materialise

DIMS = 1024
SEED = 7
PER_LANGUAGE = 1000
MOST_LANGUAGES = 65_536
TOGETHER = 1024  # prototypes that a batch is multiplied with at a time
UND = "und"
BLOCK = 1 << 20
ITEMS = 16384  # cached trigram vectors: 64 MB
DOCS = 32  # texts that are multiplied together


class Items:
    """Trigram vectors, made from letter vectors when first met."""

    def __init__(self, dims: int = DIMS, seed: int = SEED):
        self.dims, self.seed = dims, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((ITEMS, dims), np.float32)
        self.alpha = np.zeros(0x110000, np.int8)  # 0 unknown, 1 letter, 2 not

    def letter(self, point: int) -> np.ndarray:
        if (v := self.letters.get(point)) is None:
            bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dims)
            v = self.letters[point] = (bits * 2 - 1).astype(np.float32)
        return v

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of a text and their counts; none if it has no letter."""
        found: list[np.ndarray] = []
        for lo in range(0, len(text), BLOCK):
            points = np.frombuffer(text[max(0, lo - 2) : lo + BLOCK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            kinds = self.alpha[points]
            if not kinds.all():
                for p in np.unique(points[kinds == 0]).tolist():
                    self.alpha[p] = 1 if chr(p).isalpha() else 2
                kinds = self.alpha[points]
            letters = np.where(kinds == 1, points, 0).astype(np.int64)
            keep = np.ones(len(letters), bool)
            keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
            letters = letters[keep]
            if lo == 0:
                letters = np.concatenate(([0], letters)) if len(letters) and letters[0] else letters
            if lo + BLOCK >= len(text):
                letters = np.concatenate((letters, [0])) if len(letters) and letters[-1] else letters
            tri = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
            found.append(tri)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes, counts = np.unique(np.concatenate(found), return_counts=True)
        return (codes, counts) if codes.any() else (codes[:0], counts[:0])

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The rows of the matrix that hold the codes' vectors; all of them fit together."""
        rows = np.fromiter((self.rows.get(c, -1) for c in codes.tolist()), np.int64, len(codes))
        if (new := np.flatnonzero(rows < 0)).size:
            if len(self.rows) + new.size > len(self.matrix):
                self.rows.clear()
                return self.place(codes)
            mask = (1 << 21) - 1
            for k in new.tolist():
                c = int(codes[k])
                at = self.rows[c] = len(self.rows)
                self.matrix[at] = np.roll(self.letter(c >> 42), 2) * np.roll(self.letter(c >> 21 & mask), 1) * self.letter(c & mask)
                rows[k] = at
        return rows

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """The bundle of each text; 0 for one without letters."""
        out = np.zeros((len(texts), self.dims), np.float32)
        for lo in range(0, len(texts), DOCS):
            each = [self.codes(t or "") for t in texts[lo : lo + DOCS]]
            union = np.unique(np.concatenate([c for c, _ in each]))
            for a in range(0, len(union), ITEMS):
                part = union[a : a + ITEMS]
                rows = self.place(part)
                counts = np.zeros((len(each), len(part)), np.float32)
                for i, (codes, n) in enumerate(each):
                    at = np.searchsorted(part, codes)
                    ok = at < len(part)
                    ok[ok] = part[at[ok]] == codes[ok]
                    counts[i, at[ok]] = n[ok]
                out[lo : lo + DOCS] += counts @ self.matrix[rows]
        return out


_ITEMS: dict[tuple[int, int], Items] = {}


def items(dims: int, seed: int) -> Items:
    if (dims, seed) not in _ITEMS:
        _ITEMS[dims, seed] = Items(dims, seed)
    return _ITEMS[dims, seed]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def train(labelled: DataFrame, dims: int = DIMS, seed: int = SEED, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Prototypes from rows (doc_id, text, lang): the tags in order and one unit vector each."""
    known = labelled.filter("lang is not null")
    share = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if share.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = share.select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")).alias("share"))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(share), "lang").filter(chance < F.col("share")).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            v = _unit(items(dims, seed).vectors(b.column(1).to_pylist()))
            for lang, row in zip(b.column(0).to_pylist(), v):
                sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = sample.mapInArrow(bundle, "lang string, v array<double>")
    # One row a language and place; rounded, so the order of the sums doesn't show.
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.round(F.sum("x"), 4).alias("x"))
    rows = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).orderBy("lang")
    found = rows.collect()  # languages x dims numbers
    return [r.lang for r in found], _unit(np.array([r.v for r in found], np.float32).reshape(-1, dims))


def predict(docs: DataFrame, tags: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs`."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast((tags, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, profile = model.value
        for b in batches:
            lang, score = [UND] * b.num_rows, np.zeros(b.num_rows)
            if names:
                v = items(dims, seed).vectors(b.column(1).to_pylist())
                some = v.any(axis=1)
                v, best, most = _unit(v), np.zeros(len(v), np.int64), np.full(len(v), -2.0)
                for lo in range(0, len(names), TOGETHER):
                    cosine = np.round((v @ profile[lo : lo + TOGETHER].T).astype(np.float64), 6)
                    at = cosine.argmax(axis=1)
                    here = cosine[np.arange(len(v)), at]
                    best, most = np.where(here > most, lo + at, best), np.maximum(here, most)
                for i in np.flatnonzero(some).tolist():
                    lang[i] = names[best[i]]
                    score[i] = min(1.0, max(0.0, most[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(mod: int, rest: int, id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves `rest` at division by `mod`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def language_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learned from rows that are not held out."""
    tags, prototypes = train(docs.filter(~held_out(4, 2)).select("doc_id", "text", "lang"), **options)
    return predict(docs, tags, prototypes).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
