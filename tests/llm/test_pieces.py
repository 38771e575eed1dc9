import hashlib

import sentencepiece

from corvane.llm import pieces

TEXTS = [
    None, "", " ", "\n", "abc", " abc", "abc ", "a  b", "a\nb", "a \n b", "\n\na", "a\n", "x\x01y z", "▁x ▁▁y",
    "tab\there\r\n done", "émigré 日本語 😀 mixed\n\n  deep   runs\n", "the the the", "\x00", "<s> </s> <unk>", "w" * 5000, "word " * 3000,
]


def test_same_as_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in pieces.encode_pieces(df).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        want = sp.encode(text or "")
        assert list(got[i].ids) == want, repr(text)
        assert got[i].decoded == sp.decode(want)


def test_small_table_gives_the_same(spark):
    table, full = pieces.ChunkTable(pieces.model_path(), entries=1), pieces.ChunkTable(pieces.model_path())
    for text in TEXTS:
        assert table.encode([text or ""])[0].tolist() == full.encode([text or ""])[0].tolist()


def test_query(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in pieces.op2_sentencepiece(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = sp.encode(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode_pieces(df).count() == 0
