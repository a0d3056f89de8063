"""Pre-tokens of many texts at once, for texts of plain Latin letters.

The texts are laid end to end as code points. Where the kind of character
changes (letter, digit, other sign, white space) a pre-token begins or ends;
each digit is one of its own; an apostrophe that is a sign run of its own takes
the ending after it ('s 't 're 've 'm 'll 'd). Arrow then makes a dictionary of
the pre-tokens, so that what follows is done once for each distinct one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Code points for which lower() and the kinds below do what the library does: ASCII but its controls that Python calls white space, and Latin-1 and Extended-A letters. İ and the rest go to the library.
PLAIN = re.compile("[\x00-\x1b\x20-\x7e¡-¬®-±´-¸»¿-įĲ-ňŊ-ž]*")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

#: Code points worked on together: about 25 MB of arrays.
TOGETHER = 1 << 20

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KINDS = bytes(_SPACE if c in "\t\n\v\f\r " else _LETTER if c.isalpha() else _DIGIT if c.isdecimal() else _SIGN for c in map(chr, range(0x180)))
_SIZES = bytes(0 if k == _SPACE else 1 if c < 0x80 else 2 for c, k in enumerate(_KINDS))  # in UTF-8
#: Endings that an apostrophe takes. Fixed values.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def pieces(text: str, most: int = TOGETHER) -> Iterator[str]:
    """The text, or if it is long its pieces between white space."""
    at = 0
    while len(text) - at > most:
        found = SPACE.search(text, at + most)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def _contractions(points: np.ndarray, kinds: np.ndarray, start: np.ndarray) -> None:
    """Move the starts of pre-tokens where an apostrophe takes an ending."""
    n = len(points)
    at = np.flatnonzero(points[: n - 1] == 0x27)
    at = at[(start[at]) & (kinds[at + 1] == _LETTER)]  # a sign run of just this apostrophe, then letters
    if not len(at):
        return
    first, second = points[at + 1], points[np.minimum(at + 2, n - 1)]
    taken = np.zeros(len(at), np.int64)
    for e in _ENDINGS:
        fits = first == ord(e[0])
        if len(e) == 2:
            fits &= second == ord(e[1])
        taken[fits & (taken == 0)] = len(e)
    at, taken = at[taken > 0], taken[taken > 0]
    start[at + 1] = False
    after = at + 1 + taken
    start[after[kinds[after] == _LETTER]] = True


def _looked_up(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with their kinds and sizes: one byte each if all are of Latin-1."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        points = np.frombuffer(line.encode("utf-16-le"), np.uint16)
        return points, np.frombuffer(_KINDS, np.uint8)[points], np.frombuffer(_SIZES, np.uint8)[points]
    return tuple(np.frombuffer(x, np.uint8) for x in (raw, raw.translate(_KINDS[:256]), raw.translate(_SIZES[:256])))


def split(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each pre-token, distinct pre-tokens, where each text's begin and the last end) of plain texts."""
    line = "\n".join([*texts, ""]).lower()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    if not line:
        return np.empty(0, np.int64), [], np.zeros(len(texts) + 1, np.int64)
    points, kinds, sizes = _looked_up(line)
    start = np.ones(len(points), bool)
    start[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
    _contractions(points, kinds, start)
    solid = kinds != _SPACE
    start &= solid
    at = np.flatnonzero(start)
    # Bytes of UTF-8 without white space: then pre-tokens touch each other.
    size = np.cumsum(sizes, dtype=np.int32)
    offsets = np.append(np.where(at > 0, size[at - 1], 0), size[-1]).astype(np.int32)
    data = "".join(line.split()).encode()
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    bounds = np.searchsorted(at, np.concatenate(([0], np.cumsum(lengths))))
    return words.indices.to_numpy(), words.dictionary.to_pylist(), bounds


def gather(codes: np.ndarray, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pre-tokens, where each pre-token's begin and the last end)."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat, begins = np.frombuffer(b"".join(values), "<u4"), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    each = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(each)))
    return flat[np.repeat(begins[codes] - ends[:-1], each) + np.arange(ends[-1])], ends


class BatchEncoder:
    """Ids of many texts: `word` gives those of a pre-token, `other` those of a text that isn't plain or has special tokens."""

    def __init__(self, word: Callable[[str], bytes], other: Callable[[str], bytes], special: re.Pattern | None):
        self.word, self.other, self.special = word, other, special

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not (self.special is not None and self.special.search(text))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        n = 0

        def flush() -> None:
            nonlocal n
            codes, distinct, bounds = split([t for _, t in held])
            ids, ends = gather(codes, list(map(self.word, distinct)))
            cuts = ends[bounds].tolist()
            for (k, _), lo, hi in zip(held, cuts, cuts[1:]):
                out[k].append(ids[lo:hi])
            held.clear()
            n = 0

        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.plain(text):
                out[k].append(np.frombuffer(self.other(text), "<u4"))
                continue
            for piece in pieces(text):
                held.append((k, piece))
                n += len(piece)
                if n >= TOGETHER:
                    flush()
        if held:
            flush()
        none = np.empty(0, "<u4")
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]
