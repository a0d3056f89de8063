"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that stands inside no vocabulary token can't be merged across, so
it marks a certain cut of a pre-token. The fragments between cuts are encoded
independently (only the last one carries the end-of-word mark) and their ids
are put together again. Fragments repeat far more than words do, so most come
from a cache.

A text is read as the tokenizer file says: special tokens are taken from the
raw text, the rest is normalised and cut into pre-tokens. For texts of Latin
letters without special tokens that is done here at once. Any other text is
cut at ASCII white space, across which no pre-token reaches, and chunks that
aren't plain are normalised and cut by the library's own normaliser and
pre-tokenizer. The merges are made here.

Defined results
  null or empty text  no ids, decoded to the empty text
  very long pre-token a heap of merges, n log n steps
  special tokens      their strings in a text become their ids
  repeated rows       one result each
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.pretokens import PLAIN, SPACE, BatchEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Entries in a generation of a cache: about 40 MB. Workers keep their caches while later stages run.
CACHE = 200_000
#: Texts encoded together, however many rows a batch has.
STEP = 1024

#: Symbols up to which merging looks through all pairs each time; a rank above all.
SHORT, NEVER = 48, 1 << 60

_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + k)
            k += 1
    return out


class Encoder:
    """The vocabulary of one tokenizer file with its merges, forced cuts and caches."""

    def __init__(self, path: str = VOCABULARY):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path}: a BPE model without post-processor and decoder is asked for")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.tokens = np.array([named.get(i, "") for i in range(max(named) + 1)], object)
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.library = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        inside: set[str] = set()
        for token in self.vocab:
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            inside.update(body[i : i + 2] for i in range(len(body) - 1))
        self.inside = inside
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragments: dict[str, bytes] = {}
        self.chunks = Generations(self.chunk)
        self.words = Generations(self.word)
        self.batches = BatchEncoder(self.words.__getitem__, self.encode, self.cut_special)

    def cuts(self, symbols: str) -> list[str]:
        """A pre-token's fragments between forced boundaries."""
        at = [i + 1 for i in range(len(symbols) - 1) if symbols[i : i + 2] not in self.inside]
        return [symbols[a:b] for a, b in zip([0, *at], [*at, len(symbols)])] if at else [symbols]

    def merge(self, fragment: str, last: bool) -> list[int]:
        """Ids of a fragment: the lowest-ranked pair is merged first, the leftmost of equals."""
        parts: list[str | None] = list(fragment)
        if last:
            parts[-1] += self.suffix
        n, ranks = len(parts), self.ranks
        if n <= SHORT:
            return self._merge_short(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [self.vocab[p] for p in parts if p is not None and p in self.vocab]

    def _merge_short(self, parts: list[str]) -> list[int]:
        """The same by looking for the lowest rank each time, which is faster for a few symbols."""
        rank = self.ranks.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def pre_token(self, symbols: str) -> bytes:
        out, pieces = [], self.cuts(symbols)
        for i, piece in enumerate(pieces):
            last = i == len(pieces) - 1
            key = piece + " " if last else piece
            if (ids := self.fragments.get(key)) is None:
                ids = array("I", self.merge(piece, last)).tobytes()
                if len(pieces) > 1 and len(piece) <= 64:  # a whole word has a place in `words`
                    if len(self.fragments) >= CACHE:
                        self.fragments.clear()
                    self.fragments[key] = ids
            out.append(ids)
        return b"".join(out)

    def segment(self, text: str) -> bytes:
        """Ids of a chunk without special tokens."""
        return b"".join(map(self.words.__getitem__, pre_tokens(self.library, text)))

    def word(self, text: str) -> bytes:
        """Ids of a pre-token."""
        return self.pre_token("".join([self.alphabet[b] for b in text.encode()]))

    def chunk(self, text: str) -> bytes:
        if self.cut_special is None or not self.cut_special.search(text):
            return self.segment(text)
        return b"".join(self.special[t].to_bytes(4, "little") if t in self.special else self.segment(t) for t in self.cut_special.split(text) if t)

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, chunks_of(text or "")))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.batches.encode(texts)

    def decode(self, ids: bytes) -> str:
        """As the library without a decoder: the tokens, special ones too, with a space between them."""
        return " ".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


class Generations(dict):
    """A cache of two generations: when the young one is full it becomes the old one; what is used again moves back."""

    def __init__(self, make: Callable[[str], bytes], most: int = CACHE):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def chunks_of(text: str) -> list[str]:
    """The text cut at white space of ASCII, across which the tokenizer's pattern never matches."""
    if text.isascii() and not re.search("[\x1c-\x1f]", text):
        return text.split()
    return [c for c in SPACE.split(text) if c]


def pre_tokens(library, text: str) -> list[str]:
    """The pre-tokens of a chunk without special tokens, as normalised text."""
    if PLAIN.fullmatch(text):
        return _PATTERN.findall(text.lower())
    text = library.normalizer.normalize_str(text)
    return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a worker process."""
    return Encoder(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, texts: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256; with `texts` also ids (binary) and decoded."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n, ids_sha, decoded_sha, all_ids, all_decoded = [], [], [], [], []
            for ids in chain.from_iterable(e.encode_all(b.column(1).slice(k, STEP).to_pylist()) for k in range(0, b.num_rows, STEP)):
                ids = ids.tobytes()
                decoded = e.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if texts:
                    all_ids.append(ids)
                    all_decoded.append(decoded)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                columns += [pa.array(all_ids, pa.binary()), pa.array(all_decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
