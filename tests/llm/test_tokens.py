"""BPE, token files, chat formatting, toxicity and language ID."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbiter.llm import bpe, chat, langid, tokenfile, toxicity
from arbiter.llm.queries import op1_chat_formatting, op2_token_files, op7_bpe, op8_toxicity, op10_language_id

NASTY = [
    None, "", "   ", "Hello world!", "it's we'll I'VE you'd", "don''t 'S ' s", "a1b22c333", "<|startoftext|>x<|endoftext|>", "x<|endoftext|>y <|endoftext", "ÀÉÎõü ßẞ İi ıI ſ", "ﬁﬂ ½ ² ①", "日本語 テスト 한국어", "مرحبا שלום हिन्दी",
    "👩‍👩‍👧 🇩🇪 é", "a\u0000b\u001cc\u0085d e​f　g", "\r\n\t x\x0b\x0cy", "_under_score__ -- ... !!!???", "x" * 3000, "ab" * 2000 + "!" * 500, "ςΣσ ΑΒΓ", "́ ̀a", "ǅ ǈ K Å ℵ", "\x7f\x80\x9f", "´ ¨ ¸ ¯ µ", "A" * 60 + "é" * 60, "１２３ ٣٤",
]


def library():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def documents(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def put(df, tmp_path, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return f"{tmp_path}"


def fuzz(n=400):
    r = random.Random(11)
    pools = ["abcdefghij '", "ABCé'st ", "0123 ab", "!?._- a", "日本 a", "́aé ", "<|endoftext|> ", "".join(map(chr, range(32, 384))), "".join(map(chr, range(0x370, 0x590)))]
    return ["".join(r.choice(p) for _ in range(r.randint(1, 40))) for p in pools for _ in range(n // len(pools))]


def test_bpe_equals_the_library(spark, tmp_path):
    texts = NASTY + fuzz()
    t = library()
    got = {r.doc_id: r for r in op7_bpe(spark, put(documents(spark, texts), tmp_path, "documents")).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        want = (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, repr(x)[:80]


def test_cuts_are_certain_and_fragments_join():
    e = bpe.Encoder()
    for word in ("internationalization", "qzxjkvq", "aaaaaaaaaa" * 30, "zqzqzq"):
        s = "".join(e.alphabet[b] for b in word.encode())
        pieces = e.cuts(s)
        assert "".join(pieces) == s and all(a[-1] + b[0] not in e.inside for a, b in zip(pieces, pieces[1:]))
        assert np.frombuffer(e.pre_token(s), "<u4").tolist() == library().encode(word, add_special_tokens=False).ids
    assert e.merge("a" * 47, True) == e._merge_short([*"a" * 46, "a" + e.suffix])


def test_caches_forget_and_stay_right(monkeypatch):
    made = []
    cache = bpe.Generations(lambda k: made.append(k) or k.encode(), most=2)
    assert [cache[k] for k in ("a", "b", "c", "a", "b", "c")] == [b"a", b"b", b"c", b"a", b"b", b"c"] and len(cache) <= 2
    monkeypatch.setattr(bpe, "CACHE", 1)
    assert bpe.Encoder().encode("zq xq zq " * 5) == np.array(library().encode("zq xq zq " * 5, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_large_batch_is_encoded_in_small_blocks():
    """What a worker holds beside the texts does not grow with the rows of a batch."""
    r = random.Random(3)
    some = ["".join(r.choice("abcdefgh  ") for _ in range(400)) for _ in range(200)]
    e = bpe.Encoder()
    peaks, out = [], []
    for times in (15, 60):
        texts = some * times
        tracemalloc.start()
        out.append([x.tobytes() for x in e.encode_all(texts)])
        peaks.append(tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()
    assert out[1] == out[0] * 4 and out[0][:200] == [e.encode(t) for t in some]
    assert max(peaks) < 40e6


def test_bpe_keeps_texts_on_demand_and_empty_tables(spark):
    df = documents(spark, ["Hello there", None])
    rows = {r.doc_id: r for r in bpe.encode_decode(df, texts=True).collect()}
    assert rows[0].decoded == "hello</w> there</w>" and bytes(rows[1].ids) == b"" and bpe.encode_decode(df.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 4])
def test_token_files_round_trip(spark, tmp_path, shards):
    texts = NASTY + ["word " * 3000] + fuzz(90)
    ids = [(7919 * i) % 1009 for i in range(len(texts))]
    df = documents(spark, texts, ids)
    index = tokenfile.write_tokens(df, folder=f"file://{tmp_path}/tokens", length=64, rows=4, shards=shards)
    t, start, got = library(), 0, {r.doc_id: r for r in tokenfile.read_tokens(index, ids=True).collect()}
    for i, x in sorted(zip(ids, texts)):
        want = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        start += len(want)
    total = 0
    for path in {r.path for r in index.collect()}:
        s = tokenfile.Shard(path)
        assert s.file.schema.field("input_ids").type.list_size == 64 and s.file.schema.field("mask").type.list_size == 64
        real = sum(sum(s.sequence(k)[1].to_pylist()) for k in range(len(s)))
        assert len(s.sequence(len(s) - 1)[0]) == 64
        total += real
        s.close()
    assert total == start


def test_token_files_of_nulls_ties_and_nothing(spark, tmp_path):
    df = documents(spark, ["b", "a", "c", None], [2, 2, None, 1])
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.read_tokens(tokenfile.write_tokens(df)).collect())
    assert [g[1] for g in got] == [None, 1, 2, 2] and [g[0] for g in got] == [0, 2, 3, 5]
    assert tokenfile.read_tokens(tokenfile.write_tokens(df.limit(0))).count() == 0
    assert op2_token_files(spark, put(df, tmp_path, "documents")).count() == 4


def test_a_sequence_is_a_view_of_the_file(spark, tmp_path):
    index = tokenfile.write_tokens(documents(spark, ["one two three"] * 50), folder=f"file://{tmp_path}/t", length=16, rows=2, shards=1)
    s = tokenfile.Shard(index.first().path)
    ids, mask = s.sequence(3)
    assert ids.base is not None and not ids.flags.owndata and len(mask) == 16


# Chat -------------------------------------------------------------------------------


def cheapest(roles):
    """Least (cost, turns, inserted) over all labelings, merges and insertions."""
    best = None
    for states in product((1, 2, 3), repeat=len(roles)):
        options = [[]]
        p = 0
        for t, role in zip(states, roles):
            ways = []
            relabel = chat.RELABEL * (t != role)
            if p == t:
                ways.append((relabel + chat.MERGE, 0, 0))
            if (path := chat.between(p, t)) is not None:
                ways.append((relabel + chat.INSERT * len(path), 1 + len(path), len(path)))
            options = [[*o, w] for o in options for w in ways]
            p = t
        for o in options:
            total = tuple(map(sum, zip(*o, chat.ending(p)[0])))
            best = total if best is None or total < best else best
    return best


def test_repairs_are_the_cheapest():
    for n in range(1, 5):
        for roles in product(range(4), repeat=n):
            cost, ways = chat.repair(roles)
            assert cost == cheapest(roles)
            state = 0
            for t, merged, inserted in ways:
                if merged:
                    assert t == state
                else:
                    for q in (*inserted, t):
                        assert q in chat.LEGAL[state]
                        state = q
            for q in chat.ending(state)[1]:
                assert q in chat.LEGAL[state]
                state = q
            assert state == chat.ACCEPT


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.piece)):
        out[r.conv_id] = out.get(r.conv_id, "") + r.text
    return out


def test_rendering(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "system", "s"), (2, 1, "Human ", "q1"), (2, 2, "user", "q2"), (3, 0, "assistant", "a"), (4, 5, "user", None), (5, 0, "user", "<|im_end|>"), (5, 1, "gpt", "x"), (None, None, None, "odd")]
    head = lambda r: f"<|im_start|>{r}\n"
    got = rendered(chat.format_chats(turns(spark, rows)))
    assert got[1] == f"{head('user')}hi<|im_end|>\n{head('assistant')}hello<|im_end|>\n"
    # A relabel costs as much as a merge and an inserted answer, and inserts nothing.
    assert got[2] == f"{head('system')}s<|im_end|>\n{head('user')}q1<|im_end|>\n{head('assistant')}q2<|im_end|>\n"
    assert got[3] == f"{head('user')}<|im_end|>\n{head('assistant')}a<|im_end|>\n"
    assert got[4] == f"{head('user')}<|im_end|>\n{head('assistant')}<|im_end|>\n" and "< |im_end|>" in got[5] and "odd" in got[None]


def test_a_conversation_over_many_partitions_is_one_problem(spark):
    r = random.Random(2)
    big = [(7, i, r.choice(["user", "user", "assistant", "system", "tool"]), f"t{i}") for i in range(900)]
    small = [(k, i, r.choice(["user", "assistant", "x"]), f"s{i}") for k in range(20) if k != 7 for i in range(r.randint(1, 6))]
    rows = big + small
    df = chat.format_chats(turns(spark, rows))
    assert df.rdd.getNumPartitions() > 1
    pieces = df.collect()
    by = {}
    for conv, *_ in rows:
        by[conv] = tuple(chat.role_state(x[2]) for x in rows if x[0] == conv)
    for conv, roles in by.items():
        mine = sorted((p for p in pieces if p.conv_id == conv), key=lambda p: p.piece)
        assert [p.piece for p in mine] == list(range(len(mine)))
        cost = sum({"insert": chat.INSERT, "keep": 0, "merge": chat.MERGE, "relabel": chat.RELABEL, "relabel_merge": chat.RELABEL + chat.MERGE}[p.action] for p in mine)
        n_out, n_in = mine[-1].out_turn + 1, sum(p.action == "insert" for p in mine)
        assert (cost, n_out, n_in) == chat.repair(roles)[0]
        assert [p.turn for p in mine if p.turn is not None] == sorted(x[1] for x in rows if x[0] == conv)


def test_chats_of_nothing(spark, tmp_path):
    df = turns(spark, [(1, 0, "user", "x")])
    assert chat.format_chats(df.limit(0)).count() == 0
    assert op1_chat_formatting(spark, put(df.withColumn("piece", F.lit(1)), tmp_path, "conversations")).count() == 2


# Classifiers ------------------------------------------------------------------------


def corpus(n=600):
    r = random.Random(4)
    words = {"en": "the cat sits on a warm mat and looks at birds".split(), "fr": "le chat dort sur une chaise près de la fenêtre ouverte".split(), "de": "die katze schläft gerne über dem warmen ofen im haus".split()}
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        toxic = int(i % 4 == 0)
        text = [r.choice(words[lang]) for _ in range(40)]
        if toxic:
            for _ in range(3):
                text.insert(r.randint(0, 40), r.choice(["vilex", "scumz", "hateq"]))
        rows.append((i, " ".join(text), lang, toxic))
    return rows


def test_toxicity_learns_only_from_its_fold(spark, tmp_path):
    rows = corpus()
    put(spark.createDataFrame([(i, t, g, "s") for i, t, g, _ in rows] + [(9001, None, None, None), (9002, "", "en", "s")], "doc_id long, text string, lang string, source string"), tmp_path, "documents")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    labels = lambda flip: spark.createDataFrame([(i, 1, 1 - y if flip and held[i] else y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    put(labels(False), tmp_path, "labels")
    got = {r.doc_id: r for r in op8_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 602 and all(got[i].held_out == held[i] for i in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    mine = [(got[i].predicted, y) for i, _, _, y in rows if held[i]]
    assert sum(a == b for a, b in mine) / len(mine) > 0.97 and got[9001].score == got[9002].score < 0.7
    put(labels(True), tmp_path, "labels")
    assert {r.doc_id: r.score for r in op8_toxicity(spark, str(tmp_path)).collect()} == {i: r.score for i, r in got.items()}


def test_toxicity_without_labels_and_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert {r.score < 1e-6 for r in toxicity.toxicity_report(df, none).collect()} == {True}
    text = " ".join(f"w{i}" for i in range(100))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert (toxicity.features(text) == whole).all() and len(toxicity.features(None)) == 0


def test_ftrl_weights_are_sparse_and_learn():
    m = toxicity.FTRL(8, alpha=0.5, l1=0.5)
    for _ in range(50):
        m.learn(np.array([1, 2]), 1)
        m.learn(np.array([2, 3]), 0)
    at, w = m.sparse()
    v = dict(zip(at.tolist(), w.tolist()))
    assert v[1] > 0 > v[3] and set(v) <= {1, 2, 3, 256}


def test_language_id_learns_only_from_its_fold(spark, tmp_path):
    rows = corpus()
    extra = [(9001, None, "en"), (9002, "12 !? 3", "fr"), (9003, "le chat sur la fenêtre", None), (9004, "xy " * 400_000, "en")]
    base = [(i, t, g) for i, t, g, _ in rows]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in base + extra}
    df = lambda flip: spark.createDataFrame([(i, t, ("zz" if flip and held[i] else g), "s") for i, t, g in base + extra], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in op10_language_id(spark, put(df(False), tmp_path, "documents")).collect()}
    assert len(got) == 604 and all(got[i].held_out == h for i, h in held.items()) and all(0 <= r.score <= 1 for r in got.values())
    mine = [(got[i].lang_pred, g) for i, _, g in base if held[i]]
    assert sum(a == b for a, b in mine) / len(mine) > 0.99
    assert got[9001].lang_pred == got[9002].lang_pred == "und" and got[9003].lang_pred == "fr"
    again = {r.doc_id: (r.lang_pred, r.score) for r in op10_language_id(spark, put(df(True), tmp_path, "documents")).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_hypervectors_bundle_by_blocks_and_survive_a_full_table(monkeypatch):
    texts = ["Abc déf ghi", "zzz yyy", None, "..", "a"]
    whole = langid.Items(64, 1).vectors(texts)
    assert not whole[2].any() and not whole[3].any() and whole[4].any()
    monkeypatch.setattr(langid, "BLOCK", 3)
    assert np.array_equal(langid.Items(64, 1).vectors(texts), whole)
    monkeypatch.setattr(langid, "ITEMS", 4)
    assert np.array_equal(langid.Items(64, 1).vectors(texts), whole)


def test_languages_of_nothing(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "x", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.language_report(df).collect()} == {("und", 0.0)}
    assert langid.language_report(df.limit(0)).count() == 0


def plain_ftrl(texts, epochs, positive, alpha, beta, l1, l2):
    """FTRL-proximal coordinate by coordinate, on feature sets; weights as a dict."""
    z, n = {}, {}

    def weight(i):
        zi, edge = z.get(i, 0.0), 0.0 if i == "bias" else l1
        return 0.0 if abs(zi) <= edge else -(zi - math.copysign(edge, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for features, y in texts:
            for _ in range(positive if y else 1):
                w = {i: weight(i) for i in [*features, "bias"]}
                g = 1 / (1 + math.exp(-sum(w.values()))) - y
                for i in w:
                    step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                    z[i] = z.get(i, 0.0) + g - step * w[i]
                    n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i)) != 0.0}


def test_toxicity_scores_equal_a_plain_ftrl(spark):
    """Features as word strings and weights in a dict; no two of these features share a hash."""
    rows = corpus(90)
    words = lambda t: [w.lower().strip("!.,") for w in t.split()]
    grams = lambda w: {("1", *x) for x in zip(w)} | {("2", *x) for x in zip(w, w[1:])} | {("s", *x) for x in zip(w, w[2:])}
    df = spark.createDataFrame([(i, t.upper() + "!") for i, t, _, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    order = df.select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1))).collect()
    known = {i: (grams(words(t)), y) for i, t, _, y in rows}
    assert len({f for g, _ in known.values() for f in g}) == len({f for t in df.collect() for f in toxicity.features(t.text).tolist()})
    want = plain_ftrl([known[r.doc_id] for r in order], toxicity.EPOCHS, toxicity.POSITIVE, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    for i, (features, _) in known.items():
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(want.get(f, 0.0) for f in [*features, "bias"]))), abs=1e-5)


def test_toxicity_of_repeated_labels_rows_and_an_empty_table(spark):
    rows = corpus(80)
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    once = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    twice = once.union(once).union(once.select("doc_id", F.lit(0)))  # an id is toxic if any label says so
    score = lambda labels: {r.doc_id: r.score for r in toxicity.toxicity_report(df, labels).collect()}
    assert score(once) == score(twice)
    assert toxicity.toxicity_report(df.limit(0), once).count() == 0
    assert toxicity.toxicity_report(df.union(df), once).count() == 160


def plain_profiles(rows, dims, seed):
    """Hypervectors trigram by trigram: (vector of a text, prototypes by language)."""
    letter = lambda c: np.random.Generator(np.random.PCG64([seed, ord(c) if c else 0])).integers(0, 2, dims) * 2 - 1

    def vector(text):
        marks = [c if c.isalpha() else "" for c in f" {text.lower()} "]
        marks = [c for k, c in enumerate(marks) if c or k == 0 or marks[k - 1]]
        total = np.zeros(dims)
        for a, b, c in zip(marks, marks[1:], marks[2:]):
            total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return total

    sums = {}
    for t, lang in rows:
        v = vector(t)
        sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    return vector, {k: v / np.linalg.norm(v) for k, v in sums.items()}


@pytest.mark.parametrize("together", [1024, 2])
def test_languages_equal_plain_profiles(spark, together):
    rows = corpus(60)
    df = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows], "doc_id long, text string, lang string").repartition(3)
    vector, prototypes = plain_profiles([(t, g) for _, t, g, _ in rows], langid.DIMS, langid.SEED)
    tags, found = langid.train(df)
    assert tags == sorted(prototypes) and np.allclose(found, [prototypes[k] for k in tags], atol=1e-4)
    got = {r.doc_id: r for r in langid.predict(df, tags, found).collect()}
    for i, t, _, _ in rows:
        v = vector(t)
        cosine = {k: float(v @ p / np.linalg.norm(v)) for k, p in prototypes.items()}
        assert got[i].lang_pred == max(cosine, key=cosine.get) and got[i].score == pytest.approx(max(cosine.values()), abs=1e-3)


def test_equal_cosines_repeated_rows_and_many_languages(spark, monkeypatch):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["b", "a", "a", "c"] * 5)]
    df = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string")
    tags, found = langid.train(df)
    assert {(r.lang_pred, r.score) for r in langid.predict(df, tags, found).collect()} == {("a", 1.0)}
    assert langid.language_report(df).count() == 40
    many = spark.createDataFrame([(k, f"{chr(97 + k % 26) * 3} {chr(97 + k // 26) * 3}", f"l{k:03d}") for k in range(300)], "doc_id long, text string, lang string")
    tags, found = langid.train(many)
    assert tags == [f"l{k:03d}" for k in range(300)]
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 299)
    with pytest.raises(ValueError, match="languages"):
        langid.train(many)
