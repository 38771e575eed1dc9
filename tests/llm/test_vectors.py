import numpy as np
import pytest

from corvane.llm import ann, exact_search

NAN, INF = float("nan"), float("inf")
ODD = [(50, None), (100, [1.0, None, 0.0]), (150, [NAN, 1.0, 1.0]), (200, [INF, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (250, [0.0, 0.0, 0.0]), (300, [1.0, 2.0])]


def rows(seed=3, n=400, dim=3):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dim)), 1)
    return [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]


def brute(data, every, k, score):
    out = []
    for q, a in data:
        if q % every:
            continue
        found = sorted((-score(a, b), i) for i, b in data if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def exact(a, b):
    return int(sum(np.floor(256 * np.array(a)) * np.floor(256 * np.array(b))))


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "BLOCK_ROWS", 16)
    data = [r for r in rows() if r[0] not in (50, 100, 150, 200, 250, 300)] + [(250, [0.0, 0.0, 0.0]), (300, [1.0, 2.0]), (301, [1.0, 2.5]), (7000, [0.5, 0.5, 0.5]), (7001, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data + [o for o in ODD if o[0] not in (250, 300)]], "vec_id long, embedding array<double>, score string").repartition(5)
    for limit in (32 << 20, 1):
        got = exact_search.exact_top_k(df, df.where("vec_id % 50 = 0"), query_bytes=limit)
        assert sorted(map(tuple, got.collect())) == brute(data, 50, 5, exact)


def test_exact_search_wide_weights():
    assert exact_search._product(np.array([[2**40, 1]]), np.array([[2**20, 5]])).tolist() == [[2**60 + 5]]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame(rows(n=n), "vec_id long, embedding array<double>")
    assert exact_search.exact_top_k(df, df).count() == n * (n - 1)
    assert ann.nearest(df, df).count() == n * (n - 1)


def test_ann_recall_and_scores(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, np.array(r.embedding, np.float64)) for r in v.collect()]
    got = ann.nearest(v, v.where("vec_id % 20 = 0")).collect()
    want = brute(data, 20, 20, lambda a, b: float(a @ b))
    assert len(got) == len(want)
    pairs = {(q, i) for q, _, i, _ in want}
    assert sum((r.query_id, r.vec_id) in pairs for r in got) >= 0.9 * len(pairs)
    by_id = dict(data)
    assert all(abs(r.score - by_id[r.query_id] @ by_id[r.vec_id]) < 1e-12 for r in got)
    last = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert last.get(r.query_id, (INF, -1)) <= (INF, -1) or (-last[r.query_id][0], last[r.query_id][1]) < (-r.score, r.vec_id)
        last[r.query_id] = (r.score, r.vec_id)


def test_ann_ties_and_odd_rows(spark):
    data = [(i, [1.0, 0.0, 0.0]) for i in range(1000, 1300)] + [(20, [1.0, 0.0, 0.0]), (40, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data + ODD], "vec_id long, embedding array<double>, rank string").repartition(5)
    got = ann.nearest(df, df.where("vec_id = 20")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1000, 1020)) and {r.score for r in got} == {1.0}


def clustered(n, size, dim, spread, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.repeat(centres, size, axis=0) + rng.normal(scale=spread, size=(n * size, dim))
    return [(int(i), [float(x) for x in v[j]]) for i, j in enumerate(rng.permutation(len(v)))]


def test_bounds_skip_most_blocks_of_clustered_rows(spark):
    data = clustered(60, 64, 32, 0.02)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    tally = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    got = exact_search.exact_top_k(df, df.where("vec_id % 50 = 0"), tally=tally)
    assert sorted(map(tuple, got.collect())) == brute(data, 50, 5, exact)
    assert 0 < tally[1].value < 0.5 * tally[0].value


def test_ann_always_finds_k(spark):
    # Tight clusters smaller than k, and pairs of far vectors whose list holds two rows.
    data = clustered(60, 30, 16, 0.001)
    rng = np.random.default_rng(9)
    for j in range(8):
        far = rng.normal(size=16) * 50
        data += [(10_000 + 2 * j, [float(x) for x in far]), (10_001 + 2 * j, [float(x) for x in far * 1.01])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    counts = {r.query_id: r["count"] for r in ann.nearest(df, df).groupBy("query_id").count().collect()}
    assert len(counts) == len(data) and set(counts.values()) == {20}
    twice = df.union(df.where("vec_id < 30").withColumn("vec_id", df.vec_id * 0 + 7))
    assert {r["count"] for r in ann.nearest(twice, df.where("vec_id = 7"), 40).groupBy("query_id").count().collect()} == {40}


def test_ann_scores_small_blocks_together(monkeypatch):
    import numpy as np

    from corvane.llm import ann

    rng = np.random.default_rng(1)
    m = rng.normal(size=(600, 16))
    fitted, pushes, push = ann.Quantiser(m, 5, 20, 4, 0.97), [], ann.Best.push
    at = fitted.nearest(m)
    code = fitted.codes(m, at)
    blocks = [(int(at[r[0]]), r, code[r], m[r]) for x in np.unique(at) for r in np.array_split(np.nonzero(at == x)[0], 3) if len(r)]
    monkeypatch.setattr(ann.Best, "push", lambda self, *x: pushes.append(1) or push(self, *x))
    best, asked = ann.Best(10, 5, np.float64), np.arange(10)
    ann._search(blocks, best, asked, m[:10], fitted, 600, np.ones((10, len(fitted.coarse)), bool))
    scores = m[:10] @ m.T
    scores[asked, asked] = -np.inf
    assert (best.id == np.argsort(-scores, axis=1)[:, :5]).all() and len(pushes) < 5
