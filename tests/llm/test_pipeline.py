"""The pipeline against a plain Python version of its stages."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import numpy as np
from test_dedup_quality_mix import fingerprint, normal, roots, verdicts
from test_tokens import library

import corpus_pipeline
from arbiter.llm import mixing
from arbiter.llm.common import materialise


def corpus(spark):
    r = random.Random(1)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(240):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        rows.append((" ".join(words), f"s{i % 5}"))
    for i in range(0, 60, 3):
        rows.append((rows[i][0].replace(" ", "  ", 3), "s1"))
        rows.append((rows[i][0] + " tail", "s2"))
    rows += [(None, "s0"), ("short", None), ("# " * 100, "spam"), ("a b c " * 50, "s3")]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def expected(spark, df):
    rows = df.collect()
    kept = [r for r, ok in zip(rows, verdicts([(r.text, r.source) for r in rows])) if ok]
    first = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r)
    kept = list(first.values())
    root = roots({r.doc_id: fingerprint(r.text) for r in kept})
    kept = [r for r in kept if root[r.doc_id] == r.doc_id]
    return kept


def test_the_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    df = corpus(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = expected(spark, df)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(spark.createDataFrame(kept, df.schema)).collect()}
    t, want = library(), []
    for r in kept:
        ids = t.encode(r.text, add_special_tokens=False).ids
        row = (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * plan[r.doc_id]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_every_stage_but_the_last_keeps_the_columns(spark, tmp_path):
    df = corpus(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        df = materialise(out, "stage")
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == df.count()


def test_the_pipeline_takes_an_empty_table(spark, tmp_path):
    corpus(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_registry_guards_imports():
    for path in ("corpus_pipeline.py", "arbiter/llm/queries.py"):
        text = (Path(corpus_pipeline.__file__).parent / path).read_text()
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", text)
