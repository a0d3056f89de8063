"""Text functions whose results equal Python's on every code point, as Spark columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic. Fixed values.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "using", "with")

#: Runs of letters and numbers of any script.
TOKEN = r"([\p{L}\p{N}]+)"

#: What str.isspace accepts.
SPACE = "\t-\r\x1c-\x20\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What case folding does beyond lower(): characters for one other, and characters for several."""
    points = (chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000)
    table = {c: c.casefold() for c in points if c.lower() == c and c.casefold() != c}
    single = {c: f for c, f in table.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), tuple((c, f) for c, f in table.items() if len(f) > 1)


@lru_cache(maxsize=1)
def _unsettling() -> str:
    """Characters in lower case that are folded to something else than letters and numbers, or are no letter or number themselves."""
    one, other, several = _foldings()
    word = lambda text: all(unicodedata.category(c)[0] in "LN" for c in text)
    return "".join(c for c, f in [*zip(one, other), *several] if not (word(c) and word(f)))


def _has(text: Column, characters: str) -> Column:
    """Whether a text has one of the characters, none of which is of ASCII: told by deleting them, one pass with a table."""
    return (F.octet_length(text) != F.length(text)) & (F.translate(text, characters, "") != text)


def casefold(text: Column) -> Column:
    """str.casefold. Texts without a special character take the short way; the one that is common in texts is replaced at once."""
    one, other, several = _foldings()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    steps = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in several if c != "ß"])
    full = F.aggregate(steps, F.translate(low, one, other), lambda acc, s: F.replace(acc, s["c"], s["f"]))
    return F.when(_has(low, one + "".join(c for c, _ in several if c != "ß")), full).otherwise(low)


def once(value: Column) -> Column:
    """A generator of one row: what is made of `value` later doesn't make it anew for each use."""
    return F.explode(F.array(value))


def strip(text: Column) -> Column:
    """str.strip."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")


def blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def _kept(tokens: Column, minimum: int, stopwords: tuple[str, ...]) -> Column:
    rule = lambda t: F.length(t) >= minimum
    if not stopwords:
        return F.filter(tokens, rule)
    return F.filter(tokens, lambda t: rule(t) & ~t.isin(*stopwords))


def tokens_fold_first(text: Column, minimum: int = 2, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The matching scorer's and the keyphrases' tokens: the text is folded, then split."""
    return tokens_of_folded(casefold(F.coalesce(text, F.lit(""))), minimum, stopwords)


def tokens_of_folded(text: Column, minimum: int = 2, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The same of a text that is folded already (folding it again changes nothing)."""
    return _kept(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), minimum, stopwords)


def tokens_split_first(text: Column, minimum: int = 2, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The expertise index's tokens: the text is split, then each token is folded."""
    text = F.coalesce(text, F.lit(""))
    found = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1))
    # The order only matters for texts with a character that folding takes out of a word, or puts into one, and for the one letter whose lower case has a mark in it.
    late = _has(F.lower(text), _unsettling()) | text.contains(chr(0x130))
    return _kept(F.when(late, F.transform(found(text), casefold)).otherwise(found(casefold(text))), minimum, stopwords)


def sentences(text: Column) -> Column:
    """Runs without a full stop, exclamation mark, question mark or line feed."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^.!?\n]+)"), F.lit(1))


def clean_labels(labels: Column) -> Column:
    """Stripped, non-empty labels; the first of equal ones stays."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), strip), lambda x: x != ""))


def label_set(labels: Column) -> Column:
    """The different labels after folding and stripping, without empty ones."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: strip(casefold(x))), lambda x: x != ""))


def set_jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of arrays without repeated values; 0 if both are empty."""
    both = F.size(F.array_intersect(left, right))
    return F.coalesce(both / F.nullif(F.size(left) + F.size(right) - both, F.lit(0)), F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of label arrays after folding and stripping; 0 if both are empty."""
    return set_jaccard(label_set(left), label_set(right))


def identifier_ok(value: Column) -> Column:
    """A non-empty, stripped, printable string."""
    return value.isNotNull() & (value != "") & (strip(value) == value) & ~value.rlike(r"[\p{C}\p{Zl}\p{Zp}]")


def safe_term(term: Column) -> Column:
    """A term that an index may hold: letters and numbers only, folded, of two characters and 128 bytes at most."""
    return F.coalesce(term.rlike(r"^[\p{L}\p{N}]{2,}$") & (casefold(term) == term) & (F.octet_length(term) <= 128), F.lit(False))
