"""Exact dedup: two-pass Bloom filtering, DataFrame functions only.

Pass 1 is a filter of 2**64 cells, one a text, that is spread over the cluster:
each text sets the cell of its hash, and the cells that were set twice or more
stay. What shuffles is 8 bytes a text, aggregated before. These cells make the
second filter, which is broadcast: K bits each of M. Pass 2 probes it: a text
with all of its bits set is possibly repeated. Only those rows shuffle; the
others are known to be single and pass straight through their scan task.

M is 16 bits for each repeated hash (not for each row) and at most `max_bits`
(2**32, 512 MB: 270 million repeated hashes), so what is broadcast has a fixed
bound. Single rows pass for repeated ones in 1 to 4 of 100 cases up to that
bound, however many rows there are; beyond it more of them reach the shuffle,
and no result changes.

Defined results
  null text       equals the empty text
  equal texts     identical after each run of ASCII white space became one
                  space (leading and trailing runs too); compared by SHA-256
  ties            of rows with the same smallest doc_id exactly one stays
  null doc_id     sorts after every other doc_id
  empty table     empty result
  extra columns   pass through untouched, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import WS, fresh, materialise

K = 2
WORD = 32768  # bits in one row of the filter
MAX_BITS = 1 << 32


def normal_text(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), WS, " ")


def text_key(text: str) -> Column:
    """SHA-256, in hex, of the normalised text."""
    return F.sha2(normal_text(text).cast("binary"), 256)


def _cells(key: str, bits: int) -> list[Column]:
    h = F.xxhash64(F.col(f"`{key}`"))
    return [F.pmod(x, F.lit(bits)) for x in (h, F.shiftrightunsigned(h, 32))]


def filter_bits(hashes: int, max_bits: int = MAX_BITS) -> int:
    """Bits for so many repeated hashes, a power of two."""
    return min(max_bits, max(WORD, 1 << (16 * max(1, hashes) - 1).bit_length()))


def repeated_keys(keys: DataFrame, key: str) -> DataFrame:
    """Pass 1: (h), the hashes that stand in the column more than once."""
    hashes = keys.select(F.xxhash64(F.col(f"`{key}`")).alias("h"))
    return hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def bitmaps(repeated: DataFrame, bits: int) -> DataFrame:
    """The second filter, as rows (part, bitmap) of 4 KB."""
    cells = repeated.select(F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(bits)))).alias("cell"))
    return cells.groupBy(F.expr(f"cell div {WORD}").alias("part")).agg(F.bitmap_construct_agg(F.col("cell") % WORD).alias("bitmap"))


def repeated_cells(keys: DataFrame, key: str, bits: int) -> DataFrame:
    return bitmaps(repeated_keys(keys, key), bits)


def bloom_filter(keys: DataFrame, key: str, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """The filter of the repeated values of a column, and its bits."""
    repeated = materialise(repeated_keys(keys, key), "repeated")
    bits = filter_bits(repeated.count(), max_bits)
    return materialise(bitmaps(repeated, bits), "bloom"), bits


def probe(rows: DataFrame, key: str, bloom: DataFrame, bits: int, flag: str) -> DataFrame:
    """Pass 2: `rows` with `flag`, true where `key` is possibly repeated."""
    out, hits = rows, []
    for i, cell in enumerate(_cells(key, bits)):
        part, bitmap, at = (fresh(rows, f"__{x}{i}") for x in ("part", "bitmap", "at"))
        side = bloom.select(F.col("part").alias(part), F.col("bitmap").alias(bitmap))
        out = out.withColumn(at, cell)
        out = out.join(F.broadcast(side), F.expr(f"`{at}` div {WORD}") == F.col(part), "left")
        byte = F.substring(F.col(bitmap), F.expr(f"cast((`{at}` % {WORD}) div 8 + 1 as int)"), F.lit(1))
        hits.append(F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col(at) % 8).cast("int")) == 1, F.lit(False)))
    hit = hits[0]
    for h in hits[1:]:
        hit = hit & h
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias(flag))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with the columns of `docs`.

    Rows that the filter shows to be single never leave their task. The others
    are grouped by text; the aggregate keeps one row a group on the map side,
    so a text with a third of all rows sends one row a task. The filter is of
    hashes of normalised texts; only possibly repeated ones get a SHA-256.
    """
    key, flag, row, normal = (fresh(docs, x) for x in ("__sha", "__maybe", "__row", "__normal"))
    # A one-element explode: a text is normalised once, not for each use.
    keyed = docs.withColumn(normal, F.explode(F.array(normal_text(text_col)))).withColumn(key, F.xxhash64(normal))
    bloom, bits = bloom_filter(keyed, key, max_bits)
    probed = probe(keyed, key, bloom, bits, flag)
    single = probed.filter(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])
    everything = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")))
    maybe = probed.filter(F.col(flag)).withColumn(key, F.sha2(F.col(normal).cast("binary"), 256))
    first = maybe.groupBy(key).agg(F.min_by(everything, order).alias(row))
    return single.unionByName(first.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_key(text_col).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "keys")
    bloom, bits = bloom_filter(rows, "text_sha256", max_bits)
    probed = probe(rows, "text_sha256", bloom, bits, "maybe")
    single = probed.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = probed.filter("maybe")
    groups = maybe.groupBy("text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row"))).alias("first"), F.count("*").alias("group_size"))
    # Written, so that both sides of the join are plain exchanges and adaptive execution can split a hot text.
    groups = materialise(groups, "groups")
    found = maybe.join(groups, "text_sha256").select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return single.unionByName(found)
