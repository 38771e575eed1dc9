import random

import numpy as np

from corvane.llm import toxicity


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = toxicity.op6_toxicity(spark, d).collect()
    assert len(got) == 10_000
    held = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    hit, toxic, said = sum(a and b for a, b in held), sum(a for a, _ in held), sum(b for _, b in held)
    assert hit > 0.8 * toxic and hit > 0.9 * said
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_pairs_that_a_sum_of_weights_misses(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"word{rng.randrange(50)}" for _ in range(12)] + ["vile"] * insult + ["group"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult == group)))  # neither term alone tells anything
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = toxicity.toxicity(docs, spark.createDataFrame(labels[:900], "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [(r.toxicity >= 0.5) == truth[r.doc_id] for r in got if r.doc_id >= 900]
    assert len(held) == 300 and sum(held) >= 0.98 * len(held)


def test_scores_by_the_plain_formula():
    model = toxicity.Machine(np.unique(toxicity.terms(["vile group"])[0]))
    rng = np.random.default_rng(0)
    model.bias, model.w, model.v = 0.25, rng.normal(size=model.w.shape), rng.normal(size=model.v.shape)
    for text in ("", "vile", "Group group", "a VILE, vile group!", "nothing known"):
        held = sorted({int(model.row[b]) for b in toxicity.terms([text])[0]} - {-1})
        raw = model.bias + sum(model.w[i] for i in held)
        raw += sum(float(model.v[i] @ model.v[j]) for a, i in enumerate(held) for j in held[a + 1 :])
        assert abs(model.score([text])[0] - 1 / (1 + np.exp(-raw))) < 1e-12


def test_odd_rows(spark):
    rows = [(i, ("you fool " if i % 2 else "fine day ") + "lorem ipsum", "x") for i in range(60)]
    odd = [(100, None, "x"), (101, "", "x"), (102, "FOOL!! " * 20_000, "x"), (102, "FOOL!!", "x"), (None, "fine", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, toxicity string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r.toxicity for r in got}
    assert all((by[i] >= 0.5) == (i % 2 == 1) for i in range(60)) and by[102] >= 0.5 and by[100] == by[101]
    assert {r.toxicity for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
