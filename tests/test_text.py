from __future__ import annotations

import re
import sys

from pyspark.sql import functions as F

from arbiter.functions.numbers import two_digits
from arbiter.functions.text import STOPWORDS, blank, casefold, clean_labels, jaccard, sentences, strip, tokens_fold_first, tokens_split_first

WORDS = re.compile(r"[^\W_]+")


def one(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_casefold_equals_python_on_every_letter_that_folds(spark):
    points = [chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and chr(p).casefold() != chr(p)]
    texts = ["a" + c + "b" for c in points] + ["Straße ΣΊΣΥΦΟΣ İstanbul", "", "plain"]
    assert one(spark, casefold, texts) == [t.casefold() for t in texts]


def test_strip_equals_python_on_every_space(spark):
    spaces = [chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and chr(p).isspace()]
    texts = [s + "a" + s + "b" + s for s in spaces] + ["".join(spaces), "", "​x"]
    assert one(spark, strip, texts) == [t.strip() for t in texts]
    assert one(spark, blank, [None, "  ", "x"]) == [True, True, False]


def test_the_two_tokenisers_differ_where_folding_makes_a_boundary(spark):
    texts = ["The İstanbul using ½ cup_of tea2 x", "Straße é combiné", None, "", "a an and"]
    keep = lambda ts: [t for t in ts if len(t) > 1 and t not in STOPWORDS]
    assert one(spark, tokens_fold_first, texts) == [keep(WORDS.findall((t or "").casefold())) for t in texts]
    assert one(spark, tokens_split_first, texts) == [keep([w.casefold() for w in WORDS.findall(t or "")]) for t in texts]
    assert one(spark, tokens_fold_first, ["İs"]) != one(spark, tokens_split_first, ["İs"])


def test_splitting_first_equals_python_on_every_letter_that_folds(spark):
    """But for the letters of Unicode versions that the JVM doesn't know yet: it takes them for no letters."""
    points = [chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and chr(p).casefold() != chr(p)]
    known = one(spark, lambda x: x.rlike(r"[\p{L}\p{N}]"), points)
    points = [c for c, k in zip(points, known) if k or not WORDS.match(c)]
    assert len(points) > 1400
    texts = ["xa" + c + "bz" for c in points] + ["xa" + a + "b " + c for a, c in zip(points, points[1:])]
    assert one(spark, tokens_split_first, texts) == [[w.casefold() for w in WORDS.findall(t) if len(w.casefold()) > 1] for t in texts]


def test_labels_and_jaccard(spark):
    assert one(spark, clean_labels, [[" a", "a", "", "B", " "], None], "array<string>") == [["a", "B"], []]
    df = spark.createDataFrame([(["A ", "b"], ["a", "c"]), ([], []), (["x"], ["X"])], "l array<string>, r array<string>")
    assert [r[0] for r in df.select(jaccard(F.col("l"), F.col("r"))).collect()] == [1 / 3, 0.0, 1.0]


def test_sentences(spark):
    assert one(spark, sentences, ["One two. Three!\nFour", "...", None]) == [["One two", " Three", "Four"], [], []]


def test_two_digits_equals_python(spark):
    values = [k / 1000 for k in range(-1000, 1001)] + [k / 128 for k in range(-128, 129)] + [0.005, 0.015, 0.285, 0.29, -0.001, 1 / 3]
    assert one(spark, two_digits, values, "double") == [f"{v:.2f}" for v in values]
