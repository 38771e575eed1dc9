import re

import pytest

from corvane.llm import mixing


def goals(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Shares the excess round after round, as stated."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t, over, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while left > 1e-9 and len(over) < len(names):
        free = [s for s in names if s not in over]
        total = sum(w[s] for s in free)
        for s in free:
            t[s] += left * w[s] / total
        left = 0.0
        for s in free:
            if t[s] >= cap * sizes[s]:
                left += t[s] - cap * sizes[s]
                t[s] = cap * sizes[s]
                over.add(s)
    return t


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = mixing.op7_mixing(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    by = {}
    for i, r in docs.items():
        by[r.source] = by.get(r.source, 0) + size[i]
    want, taken = goals(by), dict.fromkeys(by, 0)
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == by[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), (s, taken[s], want[s])
    assert sorted(map(tuple, mixing.op7_mixing(spark, d).collect())) == sorted(map(tuple, got))


def test_odd_rows(spark):
    rows = [(1, "b", "x y", "k"), (1, "b", "x y", "k"), (2, None, None, None), (3, None, "z", None), (None, "a", "p q r", ""), (5, "é", "", ""), (6, "a", " \t", "")] + [(i, "b", "w " * 3, "") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n string").repartition(3)
    got = mixing.mix(docs, size=mixing.words("text")).collect()
    assert len(got) == len(rows) and {r.n for r in got} == {r[3] for r in rows}
    by = {"a": 3, "b": 4 + 3 * 390, "é": 0, None: 1}
    want, taken = goals(by), dict.fromkeys(by, 0)
    for r in got:
        assert 0 <= r["__copies"] <= 2 and abs(r["__target"] - want[r.source]) < 1e-6 and r["__source_size"] == by[r.source]
        taken[r.source] += r["__copies"] * r["__size"]
    assert all(abs(taken[s] - want[s]) <= 3 for s in by)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(docs).count() == 0


def test_no_python_in_plan(spark, sf_dir):
    plan = mixing.op7_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
