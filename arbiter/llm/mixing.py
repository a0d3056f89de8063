"""Mixing sources to target weights along a time-varying curriculum, DataFrame functions only.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share `share` of all words. A target stops at `cap` times its source's size;
what is over goes to the other sources by weight until none is above. The
fixed point of that is min(cap * size, level * weight) with one level for all,
found by ordering sources by cap * size / weight.

Amounts. A source's words form a tape, repeated `cap` times, on which its
documents stand in the order of md5(doc_id). A document is taken once for each
repetition in which its middle lies on the first `target` words of the tape.

Curriculum. Source s is drawn at time t in [0, 1] with the rate
target * (1 + c_s (2t - 1)); c_s is negative for sources that are heavy early
and positive for those that are heavy late. The integral of the rate is the
cumulative demand. Inverting it gives the time at which a place on the tape is
consumed, and the sum of all sources' demands at that time is the training
position. `curriculum_order` range-sorts by it.

Running totals of a source come from sums over buckets of md5 prefixes and
then over the rows of a bucket, so no task holds a whole source.

Defined results
  null text      size 0
  size 0         taken 0; the document stands on the tape, but is copied once at most
  repeated rows  each counts as a document
  null source    a source of its own, last in order
  null doc_id    hashed as the word null
  no words       all targets are 0
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.llm.common import materialise, words_of

WEIGHTS = (5, 2, 1)
RAMPS = (-0.5, 0.0, 0.5)
CAP = 3


def _pick(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """(source, source_size, target, ramp) from rows (source, size). One row per source; windows run over these only."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    src = src.withColumn("k", (rank - 1) % len(weights)).withColumn("w", _pick(weights, F.col("k"))).withColumn("ramp", _pick(ramps, F.col("k")))
    src = src.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / after)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    src = src.withColumn("at", level.getField("level"))
    return src.select("source", "source_size", F.least((F.col("source_size") * cap).cast("double"), F.col("at") * F.col("w")).alias("target"), "ramp")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`")
    return [
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.size(words_of(F.coalesce(text, F.lit("")))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).cast("binary")).alias("key"),
        F.xxhash64(text).alias("tie"),
    ]


def _offsets(rows: DataFrame, digits: int, **options) -> DataFrame:
    """What each bucket of each source needs: words of the source before it, the source's size, target and ramp, and the totals."""
    sums = rows.groupBy("source", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("n"))
    sums = materialise(sums, "buckets")
    targets = materialise(source_targets(sums.select("source", F.col("n").alias("size")), **options), "targets")
    prefix = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(prefix), F.lit(0)))
    total = targets.agg(F.sum("target").alias("total"), F.sum(F.col("target") * F.col("ramp")).alias("tilt"))
    sums = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bucket", "base", "source_size", "target", "ramp")
    return materialise(sums.crossJoin(F.broadcast(total)), "offsets")  # total is one row


def _digits(n: int) -> int:
    """Hex digits of a bucket: 256 to 65536 buckets a source, so about two thousand rows each up to 1e8 rows and a few hundred thousand at 5e10."""
    return min(4, max(2, -(-((n // 2000).bit_length()) // 4)))


def _placed(rows: DataFrame, offsets: DataFrame, digits: int, cap: int) -> DataFrame:
    """`rows` (a struct column d with the fields of _rows) with source_size, target and positions, one for each copy."""
    inside = Window.partitionBy("d.source", "bucket").orderBy("d.key", "d.size", "d.tie").rowsBetween(Window.unboundedPreceding, -1)
    bucketed = rows.withColumn("bucket", F.substring("d.key", 1, digits)).withColumn("within", F.coalesce(F.sum("d.size").over(inside), F.lit(0)))
    o = offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "base", "source_size", "target", "ramp", "total", "tilt")
    joined = bucketed.join(o, F.col("d.source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    size, target, ramp = F.col("d.size"), F.col("target"), F.col("ramp")
    middle = F.col("base") + F.col("within") + size / 2
    places = F.filter(F.array(*[middle + F.col("source_size") * e for e in range(cap)]), lambda x: x <= target)
    joined = joined.withColumn("places", F.when(size == 0, F.slice(places, 1, 1)).otherwise(places))
    times = F.transform(F.col("places"), lambda x: _time(F.when(target > 0, x / target).otherwise(F.lit(0.0)), ramp))
    # Demand of all sources up to time t: sum of target * ((1 - c) t + c t^2).
    positions = F.transform(times, lambda t: (F.col("total") - F.col("tilt")) * t + F.col("tilt") * t * t)
    return joined.select(*rows.columns, "source_size", "target", positions.alias("positions"))


def _time(y: Column, c: Column) -> Column:
    """The time at which the share y of a source's demand has been met: the root of (1 - c) t + c t^2 = y."""
    b = F.lit(1.0) - c
    return F.when(c == 0, y).otherwise((F.sqrt(b * b + F.lit(4.0) * c * y) - b) / (F.lit(2.0) * c))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies, taken, positions."""
    rows = materialise(docs.select(*_rows(docs, id_col, text_col, source_col)), "sizes")
    digits = _digits(rows.count())
    offsets = _offsets(rows, digits, cap=cap, **options)
    out = _placed(rows.select(F.struct("*").alias("d")), offsets, digits, cap)
    copies = F.size("positions").cast("long")
    return out.select("d.doc_id", "d.source", "d.size", "source_size", "target", copies.alias("copies"), (F.col("d.size") * copies).alias("taken"), "positions")


def curriculum_order(plan: DataFrame) -> DataFrame:
    """The plan range-sorted by first training position; documents that the mix doesn't take come last."""
    return plan.orderBy(F.get(F.col("positions"), 0).asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, **options) -> DataFrame:
    """The mixed corpus with the columns of `docs`: each row as often as the mix takes it, range-sorted by training position.

    The first pass moves one narrow row a document. The text moves twice: to
    its bucket and to its place in the order.
    """
    narrow = materialise(docs.select(*_rows(docs, id_col, text_col, source_col)), "sizes")
    digits = _digits(narrow.count())
    offsets = _offsets(narrow, digits, cap=cap, **options)
    rows = docs.select(F.struct(*_rows(docs, id_col, text_col, source_col)).alias("d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    out = _placed(rows, offsets, digits, cap).select("all", F.explode("positions").alias("at"))
    out = out.orderBy("at", "all." + f"`{id_col}`")
    return out.select(*[F.col("all").getField(c).alias(c) for c in docs.columns])
