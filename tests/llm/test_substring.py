import hashlib
import random

import numpy as np

from corvane.llm import segments, substring


def brute(rows, window=20):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        words = (rows[i][1] or "").encode().split()
        keep = [True] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                keep[s : s + window] = [False] * window
            seen.add(key)
        kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
        out.append((rows[i][0], len(words), keep.count(False), kept.decode()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, seg string").repartition(4)
    return sorted(((r.doc_id, r["__words"], r["__removed"], r.text) for r in substring.deduplicate(df, **kw).collect()), key=str)


def test_against_brute_force(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in brute(rows)}
    assert sum(x[1] for x in want.values()) > 0
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op5_substring(spark, sf_dir).collect()}
    assert got == want


def test_planted_repeats_over_many_segments(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "c", "déf", "x" * 40, "Q", "q"]) + str(rng.randrange(9))
    shared = [[word() for _ in range(rng.choice([19, 20, 21, 55]))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(4)):
            words += [word() for _ in range(rng.randrange(60))] + rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, " ".join(shared[0] * 3)), (504, "same " * 45), (600, rows[3][1]), (None, rows[4][1]), (2, "a b"), (700, "long " * 20_000 + "end")]
    
    monkeypatch.setattr(segments, "SLICE_BYTES", 700)
    monkeypatch.setattr(segments, "BUCKET_BYTES", 1000)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_is_not_shuffled(spark, sf_dir):
    plan = substring.op5_substring(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in " ".join(x for x in plan.splitlines() if "Exchange" in x)


def test_packing():
    rng = np.random.default_rng(2)
    for v in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))):
        assert (segments.unpack_sorted(segments.pack_sorted(v)) == v).all() and (segments.unpack(segments.pack(v)) == v).all()
        assert (segments.find(v, v) == np.arange(len(v))).all()
        pieces = segments.cut(v, 4)
        assert sum(s.stop - s.start for _, s in pieces) == len(v)
