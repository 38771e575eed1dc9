import math
import zlib
from collections import Counter, defaultdict

import pytest

from corvane.llm import ppm, segments


class Trie:
    """The same model, symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.next, met = order, defaultdict(Counter), set()
        for t in texts:
            s = b"\n" * order + read(t)
            for i in range(order, len(s)):
                self.next[s[i - order : i]][s[i]] += 1
                for k in range(order):
                    if s[i - k - 1 : i + 1] not in met:  # the byte is new after the longer context
                        met.add(s[i - k - 1 : i + 1])
                        self.next[s[i - k : i]][s[i]] += 1

    def chance(self, context, byte):
        p, out = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = self.next.get(context[self.order - k :])
            if not seen:
                continue
            left = {b: n for b, n in seen.items() if b not in out}
            if not left:
                continue
            total = sum(left.values())
            if byte in left:
                return p * (left[byte] - ppm.DISCOUNT) / total
            p *= ppm.DISCOUNT * len(left) / total
            out |= set(left)
        return p / (ppm.SYMBOLS - len(out))

    def score(self, text):
        s = b"\n" * self.order + read(text)
        return sum(math.log10(self.chance(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def read(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def base(rows):
    count, total = Counter(), 0
    for t, train in rows:
        if train:
            tokens = [*(t or "").encode().lower().split(), None]
            count.update(tokens)
            total += len(tokens)
    floor = total + 0.5 * (len(count) + 1)
    for t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        yield len(tokens), sum(count[w] > 0 for w in tokens), total, sum(math.log10((count[w] + 0.5) / floor) for w in tokens)


@pytest.mark.parametrize("order", [2, 5, 6])
def test_against_a_plain_trie(spark, monkeypatch, order):
    monkeypatch.setattr(segments, "SLICE_BYTES", 300)
    monkeypatch.setattr(segments, "BUCKET_BYTES", 500)
    texts = ["the cat sat", "The CAT sat on the mat", "", None, " \n", "a", "émile où", "the the the the", "zzz qqq", "b " * 400, "x" * 700, "on\tthe\rmat ", "the cat sat"] * 2
    rows = [(i, t, i % 3 != 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, learn boolean, train int").repartition(3)
    got = {r.doc_id: r for r in ppm.score(df, df.learn, order=order).collect()}
    assert len(got) == len(rows)
    trie = Trie([t for _, t, learn in rows if learn], order)
    for (i, t, learn), want in zip(rows, base([(t, learn) for _, t, learn in rows]), strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and r.train == learn
        assert math.isclose(r.base_score, want[3], rel_tol=1e-9)
        assert math.isclose(r.score, trie.score(t), rel_tol=1e-5), (t, r.score, trie.score(t))
    context = b"\n" * order + b"the ca"
    assert math.isclose(sum(trie.chance(context[-order:], b) for b in [0x20, 0x0A, *(b for b in range(256) if b not in b" \t\n\r\x0b\x0c")]), 1.0)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    got = ppm.op1_ppm(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    ids = list(docs)
    want = dict(zip(ids, base([(docs[i], not held[i]) for i in ids]), strict=True))
    for r in got:
        assert r.held_out == held[r.doc_id] and (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)


def test_better_than_words_alone(spark):
    out = [r for r in ppm.op1_ppm(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(df, df.doc_id > 5).collect()}
    assert math.isclose(got[1].score, -3 * math.log10(252), rel_tol=1e-6) and got[2].n_tokens == 1 and got[1].n_known == 0
    assert ppm.score(df.limit(0), df.doc_id > 5).count() == 0
