import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corvane.llm import ppm, substring
from corvane.llm import token_files as tf
from corvane.llm.segments import Words

TEXTS = [None, "", " ", "\n", "abc", " abc", "a  b", "a\nb c\nd", "it's we'll 'tis", "tab\there", "émigré 日本語 😀\n12 345", "x <|endoftext|> y", "the the the", "w" * 3000, "word, " * 5000, "a b c", "a  b", "\ttab first", "1.5% of $20\nnew"]


def library():
    return Tokenizer.from_file(tf.vocabulary_path())


@pytest.mark.parametrize("entries", [1, 10_000])
def test_same_as_library(entries):
    lib, enc = library(), tf.Encoder(tf.vocabulary_path(), entries)
    for group in (TEXTS, TEXTS[::-1], *[[t] for t in TEXTS]):
        flat, n = enc.encode(group)
        at = np.concatenate([[0], np.cumsum(n)])
        for i, t in enumerate(group):
            assert flat[at[i] : at[i + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bits(width):
    ids = np.random.default_rng(0).integers(0, 1 << width, 1000).astype(np.uint32)
    data = tf.pack_bits(ids, width)
    assert len(data) == -(-1000 * width // 8) and (tf.unpack_bits(data, width, 1000) == ids).all()


def test_files(spark, tmp_path, monkeypatch):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)], "x") for i in range(101)]
    rows += [(5, "twice", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    manifest = tf.write_ids(df, str(tmp_path / "out"), shard=20_000)
    assert manifest.count() > 3
    lib, start = library(), 0
    want = []
    for i, ids in sorted(((i, lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tf.read_ids(manifest).collect()), key=lambda r: r[1])
    assert got == want
    shard = tf.Shard(manifest.orderBy("shard").first().file)
    monkeypatch.setattr(tf, "BLOCK", 7)
    flat = shard.ids(0, shard.n)
    path = tmp_path / "small.ids"
    path.write_bytes(tf.shard_bytes(shard.doc_ids, np.diff(shard.begin), flat, 17))
    again = tf.Shard(str(path))
    assert all((again.document(i) == shard.document(i)).all() for i in range(len(shard.doc_ids)))


def test_query(spark, sf_dir):
    lib, start, want = library(), 0, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tf.op9_token_files(spark, sf_dir).collect()} == want


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read_ids(tf.write_ids(df, str(tmp_path / "none"))).count() == 0


def twins(n):
    """Two unlike words of n (a power of two) letters whose sums of weighted bytes agree modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_sum_are_told_apart(spark):
    a, b = twins(4096)
    w = Words([f"{a} {b} {a}"])
    code, low, high = w.hashes()
    assert code.tolist() == [0, 1, 0] and low[0] != low[1] and high[0] != high[1]
    lib, enc = library(), tf.Encoder(tf.vocabulary_path())
    for text in (f"x {a} y", f"x {b} y", f"{a} {b} word", f"{b}\n{a}"):
        assert enc.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, " ".join([a] * 20)), (2, " ".join([a] * 19 + [b]))], "doc_id long, text string")
    assert {r.doc_id: r["__removed"] for r in substring.deduplicate(docs).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.n_known for r in ppm.score(docs, docs.doc_id == 1, order=1).collect()} == {1: 21, 2: 20}
