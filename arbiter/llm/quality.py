"""Quality rules by host, DataFrame functions only.

Each text gets counts and rule failures. A host's failures are aggregated, its
failure rate is shrunk with a beta prior fitted to all hosts, and a host whose
shrunk rate is above `max_rate` is rejected with all its documents. The verdict
is joined back to the documents; a document also goes when the base rule fails.

Rules, one failure bit each: short (under 50 words), repeats (over half of the
words stand in repeated 3-word windows), symbols (over 0.3 a word), lines (over
0.3 of the lines repeat an earlier one), words (mean length outside 2 to 12).

Prior: alpha + beta and the mean by the method of moments over hosts, each host
weighing the same; with fewer than two hosts or no spread beyond sampling, the
strength is `max_strength`.

Defined results
  null or empty text   no words: base_failed
  null host            a host of its own
  repeated rows        each counts and is judged by itself
  equal lines          exact equality; lines without a word don't count
  extra columns        pass through
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import fresh, materialise, words_of

MAX_RATE = 0.8
MAX_STRENGTH = 1000.0
SYMBOLS = "#*$%&|<>"
_H, _P = "h", "p"


def features(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of every row's whole text."""
    t, w, tri, srt, pos, lines = (fresh(docs, f"__{x}") for x in ("t", "w", "tri", "srt", "pos", "lines"))
    kept = keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select(*kept, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(t))
    names = [c for c in df.columns if c != t]
    carry = [F.col(f"`{c}`") for c in names]
    # One-element explodes keep each array a column of its own: Catalyst would put its expression in place of every use.
    once = lambda x: F.explode(F.array(x))
    df = df.select(*carry, t, once(words_of(F.col(t))).alias(w))
    df = df.select(*carry, t, w, once(F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).alias(lines))
    # Whole 64-bit hashes of the windows: within one text, two different windows share one with a chance of n^2 / 2^65.
    windows = F.arrays_zip(F.col(w).alias("a"), F.slice(F.col(w), 2, F.greatest(F.size(w), F.lit(1))).alias("b"), F.slice(F.col(w), 3, F.greatest(F.size(w), F.lit(1))).alias("c"))
    hashed = F.transform(F.slice(windows, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    df = df.select(
        *carry,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        once(F.when(F.size(w) >= 4, hashed).otherwise(F.array().cast("array<bigint>"))).alias(tri),
    )
    counts = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines")]
    zipped = F.sort_array(F.arrays_zip(F.col(tri).alias("h"), F.sequence(F.lit(0), F.size(tri) - 1).alias("p")))
    df = df.select(*carry, *counts, once(F.when(F.size(F.array_distinct(tri)) < F.size(tri), zipped)).alias(srt))
    near = lambda i, d: F.get(F.col(srt), i + d)[_H]
    same = F.filter(F.col(srt), lambda x, i: F.coalesce(x[_H] == near(i, -1), F.lit(False)) | F.coalesce(x[_H] == near(i, 1), F.lit(False)))
    df = df.select(*carry, *counts, once(F.transform(same, lambda x: x[_P])).alias(pos))
    covered = F.size(F.array_distinct(F.concat(F.col(pos), F.transform(F.col(pos), lambda x: x + 1), F.transform(F.col(pos), lambda x: x + 2))))
    return df.select(*carry, *counts, F.when(F.col(pos).isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def any_failed() -> Column:
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return base_failed() | (F.col("n_symbols") > 0.3 * F.col("n_words")) | (F.col("n_dup_lines") > 0.3 * F.col("n_lines")) | (mean < 2) | (mean > 12)


def host_verdicts(judged: DataFrame, host: str, max_rate: float = MAX_RATE, max_strength: float = MAX_STRENGTH) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_ok) from rows (host, failed). One row a host."""
    hosts = materialise(judged.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    p = F.col("n_failed") / F.col("n_docs")
    # Method of moments: var(p) = m (1 - m) (1/s' + ...), where the mean binomial noise m (1 - m) mean(1/n) is taken off first.
    prior = hosts.agg(F.avg(p).alias("m"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("noise"))
    m = F.col("m")
    extra = F.col("v") - m * (1 - m) * F.col("noise")
    strength = F.when(extra > 0, F.least(F.greatest(m * (1 - m) / F.nullif(extra, F.lit(0.0)) - 1, F.lit(1e-6)), F.lit(max_strength))).otherwise(F.lit(max_strength))
    prior = prior.select(m, strength.alias("s"))
    rate = (F.col("n_failed") + m * F.col("s")) / (F.col("n_docs") + F.col("s"))
    return hosts.crossJoin(F.broadcast(prior)).select(host, "n_docs", "n_failed", rate.alias("rate"), (rate <= max_rate).alias("host_ok"))  # prior is one row


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """One row per row of `docs` with counts, base_failed, kept and the host's shrunk rate."""
    rows = materialise(features(docs, text_col, [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host")]), "features")
    hosts = materialise(host_verdicts(rows.select("host", any_failed().alias("failed")), "host", **options), "verdicts")
    hosts = hosts.select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "host_ok")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    bad = base_failed()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", bad.alias("base_failed"), (~bad & F.col("host_ok")).alias("kept"), F.round("host_rate", 6).alias("host_rate"))


def quality_filter(docs: DataFrame, text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows that stay, with the columns of `docs`.

    Each text is counted once, beside its row, and the rows that the base rule
    doesn't reject are written with their host: they are needed once the
    hosts' verdicts are known. Texts never shuffle, and only the rejected hosts
    are joined back.
    """
    host, copy, row, failed = (fresh(docs, x) for x in ("__host", "__copy", "__row", "__failed"))
    everything = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)
    counted = features(docs.select(everything, F.col(f"`{text_col}`").alias(copy), F.col(f"`{host_col}`").alias(host)), copy, [F.col(row), F.col(host)])
    # A row that the base rule rejects counts for its host, but its text isn't written.
    kept = F.when(~base_failed(), F.col(row)).alias(row)
    counted = materialise(counted.select(host, any_failed().alias(failed), kept), "counted")
    hosts = host_verdicts(counted.select(host, F.col(failed).alias("failed")), host, **options)
    bad = materialise(hosts.filter(~F.col("host_ok")).select(F.col(host).alias(f"{host}_bad")), "rejected")
    good = counted.filter(F.col(row).isNotNull()).join(bad, F.col(host).eqNullSafe(F.col(f"{host}_bad")), "left_anti")
    return good.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
