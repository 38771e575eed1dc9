import random

import xxhash

from corvane.llm import simhash


def plain(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(rows):
    fps, up = [plain(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d is None, d), f"{fps[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = simhash.op8_simhash(spark, sf_dir).collect()
    assert sorted(((False, r.doc_id), r.fingerprint, r.component_id) for r in got) == roots(rows)


def test_odd_rows(spark):
    long = "lorem ipsum " * 4000
    rows = [(5, None), (4, ""), (9, " \t\n"), (7, "A b"), (8, "a B"), (None, "a b"), (11, long), (11, long), (12, long + "dolor"), (None, "alone here now")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((((r.doc_id is None, r.doc_id), r.fingerprint, r.component_id) for r in got), key=str) == sorted(roots(rows), key=str)
    kept = simhash.drop_near_duplicates(docs).collect()
    named = {d for (_, d), _, c in roots(rows) if d == c}
    assert None in named and sorted((r.doc_id for r in kept), key=str) == sorted(named, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(80))
    rows = [(1, words("a")), (7, words("b")), (7, words("c")), (8, words("a")), (8, words("d")), (9, words("d")), (9, words("d")), (None, words("e")), (None, words("e")), (None, words("c"))]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, __kind string, n int").repartition(3)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("1", "a"), ("7", "b"), ("7", "c"), ("8", "d"), ("None", "e")]


def test_links_between_planted_fingerprints(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        a = rng.getrandbits(64)
        for n in (0, 1, 1, 2, 2, 3, 4):
            b = a
            for bit in rng.sample(range(64), n):
                b ^= 1 << bit
            fps.add(b - (1 << 64) if b >> 63 else b)
    fps = sorted(fps)
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2}
    assert got == want


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("the quick brown"))).first()[0] & 0xFFFFFFFFFFFFFFFF == xxhash.xxh64_intdigest(b"the quick brown", 42)
