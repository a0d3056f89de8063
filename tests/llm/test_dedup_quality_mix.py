"""Exact dedup, quality rules, mixing and SimHash against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from arbiter.llm import components, exact_dedup, mixing, quality, simhash
from arbiter.llm.queries import op3_exact_dedup, op4_quality_rules, op5_mixing, op9_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

LONG = " ".join(f"w{i % 701}x{i % 97}" for i in range(30_000))
TEXTS = [
    None, "", " ", "\t\n", "a  b", "a b", "a\tb\n", "a b ", "a b c", "é a", "É a", "a b", "x" * 50_000, LONG, LONG, LONG + " tail", "one two three four five", "one two three four five",
    "#*$ | <> &", "same line\nsame line\nother\n\n\nsame line", "r s t " * 40, "r s t " * 40, " ".join(f"good{i}" for i in range(60)), " ".join(f"good{i}" for i in range(60)) + " more", "A B C D E", "a b c d e", "a\x85b\x1cc",
]


def docs(spark, texts=TEXTS, sources=("s1", "s2", None), ids=None, extra=True):
    rows = [(ids[i] if ids else 7 * i % 101, t, "en", sources[i % len(sources)], len(t or ""), i) for i, t in enumerate(texts)]
    # Names that operators could use themselves, in clashing letter cases.
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, KEY long")
    return df.withColumns({"__sha": F.lit(1), "bucket": F.lit("b"), "Size": F.lit(2), "host": F.lit("h"), "fp": F.lit(0), "__row": F.lit(3), "d": F.lit(4)}) if extra else df.drop("KEY")


def table(spark, tmp_path, texts=TEXTS, **k):
    docs(spark, texts, extra=False, **k).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return f"{tmp_path}"


# Exact dedup ------------------------------------------------------------------


def normal(t):
    return SPACE.sub(" ", t or "")


@pytest.mark.parametrize("bits", [None, 64])
def test_exact_report_equals_grouping(spark, bits):
    df = docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    # A filter of 64 bits lets nearly all rows through and must change nothing.
    got = exact_dedup.duplicate_report(df, **({"max_bits": 32768} if bits is None else {"max_bits": bits})).collect()
    want = {(i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {min(g) for g in groups.values()}


def test_exact_ties_nulls_and_empty_tables(spark):
    df = docs(spark, ["x", "x", "x", "y", None], ids=[5, 5, None, None, 1])
    got = exact_dedup.duplicate_report(df).collect()
    assert sorted((r.keep_id is None, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(False, 1, 1, True), (False, 5, 3, False), (False, 5, 3, False), (False, 5, 3, True), (True, 0, 1, True)]
    assert exact_dedup.exact_dedup(df).count() == 3
    none = df.limit(0)
    assert exact_dedup.duplicate_report(none).count() == 0 and exact_dedup.exact_dedup(none).columns == df.columns


def test_only_possible_repeats_are_grouped(spark):
    df = docs(spark, [f"text {i}" for i in range(2000)] + ["twice", "twice"], ids=list(range(2002)))
    keyed = df.withColumn("k", exact_dedup.text_key("text"))
    bits = exact_dedup.filter_bits(2002)
    through = exact_dedup.probe(keyed, "k", exact_dedup.repeated_cells(keyed, "k", bits), bits, "maybe").filter("maybe")
    found = {r.doc_id for r in through.collect()}
    assert {2000, 2001} <= found and len(found) < 200


@pytest.mark.parametrize("rows", [2_000, 50_000])
def test_single_rows_pass_the_filter_however_many_there_are(spark, rows):
    """The filter holds repeated hashes alone: with bits for these, 5 of 100 single rows at most are grouped."""
    df = spark.range(rows + 2000).select("id", F.when(F.col("id") < 2000, F.col("id") % 1000).otherwise(F.col("id")).cast("string").alias("k"))
    bloom, bits = exact_dedup.bloom_filter(df, "k", 32_768)
    through = exact_dedup.probe(df, "k", bloom, bits, "maybe").filter("maybe")
    assert bits == 16_384 * 2 and through.filter("id < 2000").count() == 2000 and through.filter("id >= 2000").count() <= 0.05 * rows


def test_op3_reads_a_table(spark, tmp_path):
    assert op3_exact_dedup(spark, table(spark, tmp_path)).count() == len(TEXTS)


# Quality ------------------------------------------------------------------------


def counts(t):
    words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(lines)


def verdicts(rows, max_rate=quality.MAX_RATE):
    """(kept of each row) by the documented prior, in plain Python."""
    fails, hosts = [], defaultdict(list)
    for t, h in rows:
        n, chars, symbols, dup, rep, lines = counts(t)
        base = n < 50 or 100 * rep > 50 * n
        fails.append((base, base or symbols > 0.3 * n or dup > 0.3 * lines or not 2 <= chars / max(n, 1) <= 12))
        hosts[h].append(fails[-1][1])
    rates = [sum(f) / len(f) for f in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((p - m) ** 2 for p in rates) / (len(rates) - 1) if len(rates) > 1 else 0.0
    extra = v - m * (1 - m) * sum(1 / len(f) for f in hosts.values()) / len(rates)
    s = min(max(m * (1 - m) / extra - 1, 1e-6), quality.MAX_STRENGTH) if extra > 0 else quality.MAX_STRENGTH
    ok = {h: (sum(f) + m * s) / (len(f) + s) <= max_rate for h, f in hosts.items()}
    return [not b and ok[h] for (b, _), (_, h) in zip(fails, rows)]


def test_quality_counts_and_verdicts(spark, tmp_path):
    rows = docs(spark).select("doc_id", "text", "source").collect()
    got = {r.doc_id: r for r in op4_quality_rules(spark, table(spark, tmp_path)).collect()}
    assert len(got) == len(rows)
    for (i, t, _), kept in zip(rows, verdicts([(r.text, r.source) for r in rows])):
        n, chars, symbols, dup, rep, _ = counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t and t[:40]
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and r.kept == kept


def test_bad_hosts_take_their_documents_with_them(spark):
    good = [" ".join(f"word{i}{k}" for i in range(60)) for k in range(40)]
    symbols = ["# " * 40 + g for g in good]
    rows = [(g, "fine") for g in good] + [(s, "spam") for s in symbols[:38]] + [(g, "spam") for g in good[:2]] + [(g, "other") for g in good] + [("short", "lone")]
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string")
    want = {i for i, k in enumerate(verdicts(rows)) if k}
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want and {rows[i][1] for i in want} == {"fine", "other"}
    report = quality.quality_report(df)
    assert {r.doc_id for r in report.filter("kept").collect()} == want


def test_quality_of_clashing_columns_and_empty_tables(spark):
    df = docs(spark)
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns
    assert quality.quality_filter(df.limit(0)).count() == 0 and quality.quality_report(df.limit(0)).count() == 0


# Mixing ---------------------------------------------------------------------------


def targets(sizes: dict, cap=3):
    """Water-filling as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > cap * sizes[s]]
        if not over:
            return fixed | want
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_mix_meets_its_targets(spark, tmp_path):
    texts = [" ".join(["w"] * (1 + i % 9)) for i in range(3000)]
    sources = ["big"] * 12 + ["tiny"] + ["a", "b", None, "é"]
    where = table(spark, tmp_path, texts, sources=sources, ids=list(range(3000)))
    rows = op5_mixing(spark, where).collect()
    size, taken, source = Counter(), Counter(), {i: sources[i % len(sources)] for i in range(3000)}
    for r in rows:
        assert r.size == 1 + r.doc_id % 9 and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = targets(size)
    for r in rows:
        assert r.source_size == size[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    assert all(abs(taken[s] - want[s]) <= 18 for s in size) and sum(want.values()) == pytest.approx(sum(size.values()))
    again = op5_mixing(spark, where).collect()
    assert sorted(again) == sorted(rows)
    places = [r.first_position for r in rows if r.taken]
    assert places == sorted(places) and places[0] >= 0 and all(r.first_position == -1 for r in rows if not r.copies)


def test_mixed_rows_stand_in_training_order(spark):
    df = docs(spark, [" ".join(["w"] * 5)] * 600, sources=("a", "b", "c"), ids=list(range(600)))
    out = mixing.mix(df)
    assert out.columns == df.columns
    rows = out.collect()
    half = len(rows) // 2
    early, late = Counter(r.source for r in rows[:half]), Counter(r.source for r in rows[half:])
    # The third source's rate rises with time, the first one's falls.
    assert early["a"] > late["a"] and late["c"] > early["c"]
    copies = Counter(r.doc_id for r in rows)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(df).collect()}
    assert all(copies[i] == n for i, n in plan.items())


def test_mixing_nothing_and_nulls(spark):
    df = docs(spark, [None, "", " "], ids=[1, None, 1])
    got = mixing.mix_plan(df).collect()
    assert len(got) == 3 and all((r.size, r.taken, r.target) == (0, 0, 0.0) for r in got)
    assert mixing.mix_plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


# SimHash ----------------------------------------------------------------------------


def fingerprint(t):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps: dict):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_texts():
    base = [" ".join(f"t{(i * 37 + k * k) % 997}" for i in range(400)) for k in range(12)]
    out = []
    for b in base:
        words = b.split()
        for k in range(8):
            w = list(words)
            if k:
                w[(k * 50) % 400] = f"changed{k}"
            out.append(" ".join(w))
    return out + TEXTS


@pytest.mark.parametrize("shard_rows", [2048, 3])
def test_simhash_equals_brute_force(spark, tmp_path, shard_rows):
    texts = near_texts()
    df = docs(spark, texts, ids=[1000 - i for i in range(len(texts))])
    fps = {r.doc_id: fingerprint(r.text) for r in df.collect()}
    want = roots(fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(df, shard_rows=shard_rows).collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fps and {i: r.component_id for i, r in got.items()} == want
    kept = simhash.near_dedup(df, shard_rows=shard_rows)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    if shard_rows > 3:
        rows = op9_simhash(spark, table(spark, tmp_path, texts, ids=[1000 - i for i in range(len(texts))])).collect()
        assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}


def test_chains_of_links_are_one_component(spark):
    fps = [(0b1111 << 4 * k) - (0b1111 if k else 0) if k else 0 for k in range(3)]
    fps = [0, 0b1111, 0b11111111, 0b111111111111, 1 << 63 | 0x7FFF << 40]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, id long")
    links = simhash.shard_links(df)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {1: 0, 2: 0, 3: 0} or got == {0: 0, 1: 0, 2: 0, 3: 0}


def test_bk_tree_finds_what_a_scan_finds():
    import numpy as np

    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    queries = np.concatenate([base ^ np.uint64(3), r.integers(0, 1 << 63, 40, dtype=np.uint64)])
    got = {(int(a), int(q)) for a, hit in simhash.BKTree(values).search(queries, 4) for q in hit}
    assert got == {(i, j) for i, v in enumerate(values) for j, q in enumerate(queries) if int(v ^ q).bit_count() <= 4}
    assert list(simhash.BKTree(values[:0]).search(queries, 4)) == []


def test_simhash_nulls_and_empty_tables(spark):
    df = docs(spark, ["a b c d e", "a b c d e", None, ""], ids=[None, 4, 9, 7])
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 4), (4, 4), (7, 7), (9, 7)]
    assert simhash.near_dedup(df).count() == 3
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("finish", [0, 1_000_000])
def test_component_rounds(spark, finish):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 4000), (4000, 3000), (9, 9)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), finish_rows=finish).collect()}
    assert all(got.get(i, 0) == 0 for i in range(201)) and all(got[1000 + k] == 1000 for k in range(1, 300)) and got[5000] == 3000 and got[4000] == 3000


def test_components_that_dont_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(401)], "u long, v long")
    with pytest.raises(RuntimeError, match="not settled"):
        components.connected_components(chain, finish_rows=0, max_rounds=1)


@pytest.mark.parametrize("blocks, shard_rows", [(5, 2048), (5, 40), (6, 10), (7, 2048), (8, 3)])
def test_any_number_of_blocks_finds_the_same_components(spark, blocks, shard_rows):
    r = random.Random(blocks)
    fps = [r.getrandbits(64) for _ in range(150)]
    for _ in range(600):
        f = r.choice(fps)
        for bit in r.sample(range(64), r.randint(1, 5)):
            f ^= 1 << bit
        fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, id long")
    got = {x.node: x.root for x in components.connected_components(simhash.shard_links(df, shard_rows=shard_rows, blocks=blocks)).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == roots(dict(enumerate(fps)))


def test_shards_keep_their_size_as_fingerprints_grow():
    from math import comb

    assert simhash.block_count(100_000) == simhash.block_count(1_000_000) == 5
    for n in (10**k for k in range(3, 12)):
        b = simhash.block_count(n)
        assert comb(b, 4) <= (35 if n <= 10**10 else 70) and n / 2 ** (64 * (b - 4) / b) < 3_000  # rows of a fingerprint, and fingerprints of a shard
    for b in (5, 6, 7):
        for mask, parts in simhash.shard_keys(b):
            assert mask | sum(parts) == (1 << 64) - 1 and sum(p.bit_count() for p in parts) + mask.bit_count() == 64


def test_near_dedup_keeps_clashing_columns(spark):
    df = docs(spark).withColumns({"__gone": F.lit(5), "component_id": F.lit(6), "node": F.lit(7)})
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns and kept.count() <= df.count() and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}
