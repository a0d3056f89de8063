"""Near-duplicate passages against planted ones, and windows against their definition."""

from __future__ import annotations

import random

import numpy as np
import pytest

from arbiter.llm import substring as sub
from arbiter.llm.components import connected_components
from arbiter.llm.queries import op6_substring_dedup


def words(r, n):
    return [f"w{r.randrange(10_000)}" for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")


def similarity(a, b):
    grams = lambda w: {tuple(x.lower() for x in w[i : i + 5]) for i in range(len(w) - 4)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_runs_are_those_of_the_definition():
    """Every stretch of a document has the least shingles of both functions as its key, and lies in that key's run."""
    r = np.random.default_rng(3)
    docs = [r.integers(0, n, n, dtype=np.uint64) + np.uint64(1) for n in (30, 8, 57, 7)]
    width = 8
    w = sub.Windows(docs, width)
    got = list(w.runs())
    assert len(got) == sub.FUNCTIONS // 2
    for pair, (key, sketch, start, end) in enumerate(got):
        found: dict[tuple, list[tuple[int, int]]] = {}
        for k, a, b in zip(key.tolist(), start.tolist(), end.tolist()):
            found.setdefault((int(np.searchsorted(w.starts, a, side="right")), k), []).append((a, b))
        name: dict[tuple, int] = {}
        n = 0
        for doc, (first, d) in enumerate(zip(w.starts.tolist(), docs), 1):
            for at in range(first, first + len(d) - width + 1):
                least = tuple(int(w.flat[at + np.argmin(w.order(f)[at : at + width])]) for f in (2 * pair, 2 * pair + 1))
                inside = [k for (x, k), spans in found.items() if x == doc and any(a <= at and at + width - 1 <= b for a, b in spans)]
                name[least] = name.get(least) or next(k for k in inside if k not in name.values())
                assert name[least] in inside
                n += 1
        assert n == sum(max(0, len(d) - width + 1) for d in docs) and set(key.tolist()) == set(name.values())


def brute_nearest(key, sketch, doc):
    out = {}
    half = lambda x, y, side: sum((x >> side + 4 * k) & 15 == (y >> side + 4 * k) & 15 for k in range(8))
    for i in range(len(key)):
        scores = []
        for j in range(i):
            left, right = (half(int(sketch[i]), int(sketch[j]), side) for side in (0, 32))
            if key[j] == key[i] and doc[j] != doc[i] and max(left, right) >= sub.AGREE:
                scores.append((left + right, -j))
        if scores:
            out[i] = min(-j for alike, j in scores if alike >= max(scores)[0] - sub.ABOUT)
    return out


@pytest.mark.parametrize("dense", [1024, 8])
def test_each_run_is_linked_to_the_most_alike_of_its_key(monkeypatch, dense):
    monkeypatch.setattr(sub, "DENSE", dense)
    r = np.random.default_rng(4)
    key = np.sort(r.integers(0, 12, 400).astype(np.int64) * 4)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    sketch = base[r.integers(0, 40, 400)]
    for k in range(16):
        sketch = np.where(r.random(400) < 0.3, sketch ^ (r.integers(1, 16, 400, dtype=np.uint64) << np.uint64(4 * k)), sketch)
    doc = np.arange(400) // 2
    got = dict(zip(*(x.tolist() for x in sub.nearest(key, sketch, doc))))
    want = brute_nearest(key, sketch, doc)
    assert len(want) > 50
    if dense == 1024:
        assert got == want
    else:  # more than `dense` that agree in four functions may be compared in blocks: hardly any run is left without a link
        assert set(got) <= set(want) and len(got) >= 0.98 * len(want)


def planted(seed=5):
    """Documents, and the (doc, start, end, doc, start, end) of the passages planted in them."""
    r = random.Random(seed)
    docs = {i: words(r, r.randint(80, 400)) for i in range(60)}
    found = []
    for k in range(12):
        passage = words(r, r.randint(60, 150))
        a, b = 2 * k, 2 * k + 30 if 2 * k + 30 < 60 else 59
        other = list(passage)
        if k % 2:
            other[len(other) // 2] = "CHANGED"
        for d, p in ((a, passage), (b, other)):
            at = r.randint(0, len(docs[d]))
            docs[d][at:at] = p
        found.append((a, b, passage))
    return {i: " ".join(w) for i, w in docs.items()}, found


def test_planted_passages_are_found_and_nothing_else(spark, tmp_path):
    docs, passages = planted()
    table(spark, docs.items()).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_substring_dedup(spark, str(tmp_path)).collect()
    want = {(max(a, b), min(a, b)) for a, b, _ in passages}
    assert {(r.doc_id, r.other_id) for r in rows} == want
    for r in rows:
        a, b = docs[r.doc_id].split()[r.start_word : r.end_word], docs[r.other_id].split()[r.other_start : r.other_end]
        assert len(a) >= 50 and len(b) >= 50 and similarity(a, b) >= 0.8 and similarity(a, b) == pytest.approx(r.similarity)
    for a, b, p in passages:
        got = [x for x in rows if (x.doc_id, x.other_id) == (max(a, b), min(a, b))]
        assert max(x.end_word - x.start_word for x in got) >= 0.9 * len(p)


def test_a_passage_of_many_documents_links_each_of_them(spark):
    r = random.Random(8)
    passage = " ".join(words(r, 80))
    rows = [(i, " ".join(words(r, 60)) + " " + passage + "\n" + " ".join(words(r, 60))) for i in range(200)] + [(1000 + i, " ".join(words(r, 150))) for i in range(50)]
    found = sub.repeated_passages(table(spark, rows)).collect()
    assert {x.doc_id for x in found} | {x.other_id for x in found} == set(range(200))
    assert len(found) < 3 * 200  # links grow with the documents, not with their pairs


def test_copies_nulls_short_and_repeated_rows(spark):
    r = random.Random(9)
    text = " ".join(words(r, 120))
    rows = [(1, text), (2, text.upper()), (2, text), (3, None), (4, ""), (5, " ".join(text.split()[:49])), (None, text), (6, text.replace(" ", " \t\n")), (7, "same " * 500)]
    found = sub.repeated_passages(table(spark, rows)).collect()
    assert {x for f in found for x in (f.doc_id, f.other_id)} == {1, 2, 6} and all(f.similarity == 1.0 for f in found)
    assert sub.repeated_passages(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1_500_000, 40])
def test_blocks_link_the_same_documents(spark, monkeypatch, block):
    """A passage of all documents sends one run a block, whatever the block's size."""
    import arbiter.llm.substring

    r = random.Random(12)
    passage = " ".join(words(r, 70))
    rows = [(i, " ".join(words(r, 50)) + " " + passage) for i in range(150)]
    monkeypatch.setattr(arbiter.llm.substring, "COMBINE", block)
    found = sub.repeated_passages(table(spark, rows)).collect()
    links = spark.createDataFrame([(x.doc_id, x.other_id) for x in found], "u long, v long")
    assert {(x.node, x.root) for x in connected_components(links).collect()} == {(i, 0) for i in range(1, 150)} and len(found) < 4 * 150


def test_a_text_above_the_place_bits_is_cut_with_overlap(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sub, "PART", 400)
    monkeypatch.setattr(sub, "OVERLAP", 100)
    text = " ".join(words(random.Random(3), 1500))
    whole, parts = sub.shingles(text), []
    for ids, places, docs in sub._laid_out(iter([pa.RecordBatch.from_pydict({"doc_id": [7], "text": [text]})])):
        parts += list(zip(ids, places, docs))
    assert all(i == 7 and (whole[at : at + len(d)] == d).all() for i, at, d in parts)
    covered = {k for _, at, d in parts for k in range(at, at + len(d) - sub.WIDTH + 1)}
    assert covered == set(range(len(whole) - sub.WIDTH + 1)) and max(len(d) for *_, d in parts) <= 400


@pytest.mark.parametrize("n", [60, 120])
@pytest.mark.parametrize("holders", [1, 3, 8])
def test_common_phrases_do_not_hide_a_passage(spark, n, holders):
    """Passages of two documents are found though earlier documents hold each of their phrases."""
    r = random.Random(100 * n + holders)
    rows, pairs = [], []
    for k in range(20):
        passage = words(r, n)
        for at in range(0, n - 4):
            if at % 2 == 0:
                rows += [(1000 * k + at * holders + h, " ".join(words(r, 30) + passage[at : at + 5] + words(r, 30))) for h in range(holders)]
        rows += [(100_000 + 2 * k + j, " ".join(words(r, 40) + passage + words(r, 40))) for j in (0, 1)]
        pairs.append((100_000 + 2 * k + 1, 100_000 + 2 * k))
    found = {(x.doc_id, x.other_id) for x in sub.repeated_passages(table(spark, rows)).collect()}
    assert found == set(pairs)


def test_very_long_texts_and_their_copies(spark):
    r = random.Random(10)
    long = words(r, 60_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[20_000:20_200])), (3, " ".join(words(r, 300)))]
    found = sub.repeated_passages(table(spark, rows)).collect()
    assert {(x.doc_id, x.other_id) for x in found} == {(2, 1)} and max(x.end_word - x.start_word for x in found) == 200


def test_no_exact_passage_is_missed(spark):
    """Every run of 50 words that two documents share, by brute force, links its documents."""
    r = random.Random(14)
    shared = [words(r, r.randint(50, 120)) for _ in range(25)]
    docs = []
    for i in range(120):
        w = words(r, r.randint(20, 200))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        docs.append((i, " ".join(w)))
    docs += [(500 + i, docs[3 * i][1].replace("w1", "w2", 1)) for i in range(20)]
    runs: dict[tuple, set[int]] = {}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    groups = [g for g in runs.values() if len(g) > 1]
    found = sub.repeated_passages(table(spark, docs)).collect()
    links = spark.createDataFrame([(x.doc_id, x.other_id) for x in found], "u long, v long")
    root = {x.node: x.root for x in connected_components(links).collect()}
    assert len(groups) > 500 and all(len({root.get(i, i) for i in g}) == 1 for g in groups)
    clean = {i for i, _ in docs} - {i for g in groups for i in g}
    texts = dict(docs)
    for x in found:
        a, b = texts[x.doc_id].split()[x.start_word : x.end_word], texts[x.other_id].split()[x.other_start : x.other_end]
        assert similarity(a, b) >= 0.8
    assert len(clean & {i for x in found for i in (x.doc_id, x.other_id)}) <= 20


def test_partial_variants_before_do_not_hide_a_passage(spark):
    """Two documents with one passage are linked, whatever documents with parts of it come first."""
    r = random.Random(15)
    rows, pairs = [], []
    for k in range(40):
        passage = words(r, 60)
        for v in range(10):
            variant = list(passage)
            for at in r.sample(range(60), r.randint(3, 5)):
                variant[at] = f"x{r.randrange(10_000)}"
            rows.append((100 * k + v, " ".join(words(r, 60) + variant + words(r, 60))))
        rows += [(100 * k + v, " ".join(words(r, 60) + passage + words(r, 60))) for v in (50, 51)]
        pairs.append((100 * k + 51, 100 * k + 50))
    links = [(x.doc_id, x.other_id) for x in sub.repeated_passages(table(spark, rows)).collect()]
    roots = {x.node: x.root for x in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert [p for p in pairs if p not in links and roots.get(p[0], p[0]) != roots.get(p[1], p[1])] == []


@pytest.mark.parametrize("n, changes", [(55, 1), (60, 1), (110, 2), (150, 3)])
def test_recall_of_changed_passages(spark, n, changes):
    """Pairs at a similarity a little above 0.8, against brute force: at least 95 of 100 are linked."""
    r = random.Random(n)
    rows, pairs = [], []
    for k in range(100):
        p = words(r, n)
        q = list(p)
        for c in range(changes):
            q[(2 * c + 1) * n // (2 * changes)] = f"x{r.randrange(10_000)}"
        assert similarity(p, q) >= 0.8
        rows += [(2 * k, " ".join(words(r, 50) + p + words(r, 50))), (2 * k + 1, " ".join(words(r, 50) + q + words(r, 50)))]
        pairs.append((2 * k + 1, 2 * k))
    found = {(x.doc_id, x.other_id) for x in sub.repeated_passages(table(spark, rows)).collect()}
    assert found <= set(pairs) and len(found) >= 95


@pytest.mark.parametrize("n, more", [(50, 2), (55, 3), (60, 4), (70, 7), (80, 8)])
def test_a_passage_with_an_insertion_is_verified_from_both_sides(n, more):
    r = random.Random(n)
    p = words(r, n)
    q = p[: n // 2] + words(r, more) + p[n // 2 :]
    assert similarity(p, q) >= 0.8
    x, y = (sub._short(" ".join(words(r, 30) + w + words(r, 30))) for w in (p, q))
    for a, b in ((x, y), (y, x)):
        (found,) = sub.verify(a, b)
        assert found[4] >= 0.8 and found[1] - found[0] >= n - 8 and found[3] - found[2] >= n - 8


def test_clashing_column_names_are_left_alone(spark):
    from pyspark.sql import functions as F

    r = random.Random(21)
    p = words(r, 80)
    df = table(spark, [(1, " ".join(p)), (2, " ".join(words(r, 20) + p))]).withColumns({"a": F.lit(9), "b": F.lit(8), "key": F.lit("k"), "side": F.lit(0), "h": F.lit(b"x"), "place": F.lit(1)})
    assert [(x.doc_id, x.start_word, x.end_word, x.other_id) for x in sub.repeated_passages(df).collect()] == [(2, 20, 100, 1)]


def test_many_holders_of_a_part_do_not_hide_a_passage(spark):
    """Two documents with one passage are linked, however many earlier ones hold a shorter part of it."""
    r = random.Random(31)
    rows, pairs = [], set()
    for k in range(40):
        passage = words(r, 54)
        rows += [(1000 * k + v, " ".join(words(r, 40) + passage[7:47] + words(r, 40))) for v in range(60)]
        rows += [(1000 * k + v, " ".join(words(r, 40) + passage + words(r, 40))) for v in (500, 501)]
        pairs.add((1000 * k + 501, 1000 * k + 500))
    found = {(x.doc_id, x.other_id) for x in sub.repeated_passages(table(spark, rows)).collect()}
    assert found == pairs


def test_pairs_link_all_that_every_pair_would(monkeypatch):
    """Components of stretches, against the verification of each with each."""
    r = np.random.default_rng(1)
    n = 24

    def components(of, edges):
        for i, j in edges:
            of = np.where(of == max(of[i], of[j]), min(of[i], of[j]), of)
        return [of.tolist().index(c) for c in of]

    for trial in range(30):
        monkeypatch.setattr(sub, "PAIRS", (1 << 22, 3)[trial % 2])
        base, h = r.integers(0, 1 << 32, 120, dtype=np.uint32), []
        for _ in range(n):
            at = int(r.integers(0, 40))
            x = base[at : at + int(r.integers(50, 110))].copy()
            changed = r.random(len(x)) < r.choice([0, 0.03, 0.06, 0.1, 0.2])
            x[changed] = r.integers(0, 1 << 32, int(changed.sum()), dtype=np.uint32)
            h.append(np.concatenate([x[:20], x[:20], x[20:]]) if r.random() < 0.2 else x)
        doc, of = np.arange(n), r.integers(0, 8, n) if trial % 3 else np.arange(n)
        every = {(i, j) for i in range(n) for j in range(i + 1, n) if sub.verify(h[i], h[j])}
        got = set(zip(*(x.tolist() for x in sub._Alike(doc, h, sub.SIMILARITY).pairs(of))))
        assert components(of, got & every) == components(of, every)


def test_similar_components_are_linked_by_few_pairs():
    """Of two components whose neighbours aren't similar one pair of similar stretches is enough, not each with each."""
    r = np.random.default_rng(2)
    fresh = lambda n: r.integers(0, 1 << 32, n, dtype=np.uint32)
    passage = fresh(80)
    thin = lambda: np.stack([passage, fresh(80)], axis=1).ravel()
    whole = lambda: np.concatenate([fresh(5), passage, fresh(5)])
    h = [*(whole() for _ in range(30)), thin(), thin(), *(whole() for _ in range(30))]
    i, j = sub._Alike(np.arange(62), h, sub.SIMILARITY).pairs(np.repeat([0, 31], 31))
    assert 1 <= len(i) <= 3 and any(len(sub.verify(h[a], h[b])) and a < 31 <= b for a, b in zip(i, j))


def test_stretches_with_too_few_shared_shingles_have_no_segments():
    r = np.random.default_rng(8)
    a, b = (r.integers(0, 1 << 32, 200, dtype=np.uint32) for _ in range(2))
    b[100:136] = a[20:56]  # 36 of 46 are less than 0.8
    assert sub.verify(a, b) == [] and sub.verify(a[:0], b) == [] and sub.verify(a, b[:0]) == []
    b[100:146] = a[20:66]
    ((lo, hi, low, high, s),) = sub.verify(a, b)
    assert lo <= 20 and hi >= 66 and low <= 100 and high >= 146 and s >= 0.8


def test_stretches_that_share_too_little_are_left_out_before_they_are_compared():
    r = np.random.default_rng(7)
    h = [r.integers(0, 1 << 32, 92, dtype=np.uint32) for _ in range(12)]
    h[1][10:70] = h[0][20:80]  # similar
    h[3][40:60] = h[2][5:25]  # not enough
    h[5][:60] = h[4][:60]  # of one component
    h[7][:60] = h[6][:60]  # of one document
    group, component, doc = np.arange(12) // 2, np.arange(12), np.arange(12)
    component[5], doc[7] = 4, 6
    assert sub._sharing(group, component, doc, h, sub.SIMILARITY).tolist() == [0, 1]


def test_only_keys_that_passages_leave_apart_are_looked_at_again():
    """Runs of one key are together by labels in common; a large group is dealt so that any two components of it meet."""
    rows = [(1, 10, 0, 50, 7, 0), (1, 11, 0, 50, 7, 8), (1, 12, 0, 50, 8, 0), (2, 10, 5, 60, 7, 0), (2, 11, 5, 60, 9, 0), (2, 12, 5, 60, 0, 0), (3, 10, 0, 50, 0, 0), (3, 10, 90, 150, 0, 0)]
    key, of, doc, lo, hi = sub.apart(*(np.array(c) for c in zip(*rows)))
    assert key.tolist() == [2, 2, 2] and len(set(of.tolist())) == 3 and doc.tolist() == [10, 11, 12]


@pytest.mark.parametrize("together", [2, 3, 50])
def test_two_components_of_a_key_meet_in_some_task(monkeypatch, together):
    monkeypatch.setattr(sub, "TOGETHER", together)
    r = np.random.default_rng(6)
    key, of = np.sort(r.integers(0, 3, 40)).astype(np.int64), r.integers(0, 9, 40)
    met = set()
    for name, c, doc in sub._dealt(key, of, np.arange(40)):
        for k in set(name.tolist()):
            part = doc[name == k].tolist()
            met |= {(i, j) for i in part for j in part if i < j and of[i] != of[j]}
            assert len(part) <= 2 * together
    assert met == {(i, j) for i in range(40) for j in range(i + 1, 40) if key[i] == key[j] and of[i] != of[j]}
