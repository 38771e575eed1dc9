import random

from pyspark.sql import functions as F

from corvane.llm import language


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = language.op4_language(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) > 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(i, t * (1 + i % 3), lang, "x") for i, (t, lang) in enumerate([("the house and the garden with ", "en"), ("das haus und der garten mit ", "de"), ("la maison et le jardin avec ", "fr"), ("ковш и сад ", "xx")] * 8)]
    odd = [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !? \n", "de", "x"), (103, "the garden", None, "x"), (None, "das haus und", "de", "x"), (104, "the " * 30_000, "en", "x"), (104, "the " * 30_000, "en", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string").repartition(3)
    got = language.identify(df, df.doc_id < 100).collect()
    assert len(got) == len(rows) + len(odd) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "lang_score"}
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and [by[i].lang_score for i in (100, 101, 102)] == [0.0] * 3
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de" and by[104].lang_pred == "en"
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 100)
    assert {r.lang_pred for r in language.identify(df, df.doc_id < 0).collect()} == {"und"}
    assert language.identify(df.limit(0), df.doc_id >= 0).count() == 0
    one = language.identify(df.where("lang = 'de'"), df.doc_id < 100).collect()
    assert {r.lang_pred for r in one} == {"de", "und"}


def test_every_language_is_learnt(spark):
    rng = random.Random(8)
    names = sorted(n for some in language.FAMILIES.values() for n in some.split())
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(25)] for n in names}
    rows = [(i * len(names) + k, " ".join(rng.choice(words[n]) for _ in range(60)), n) for i in range(7) for k, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.identify(docs, F.col("doc_id") >= len(names)).where(F.col("doc_id") < len(names)).collect()
    assert len(names) > 64 and len(got) == len(names)
    assert [(r.lang, r.lang_pred) for r in got if r.lang != r.lang_pred] == []


def test_letters():
    assert not any(map(language.has_letter, [None, "", "²½", "Ⅷ", "①②", "12 _!", "\u0301"]))
    assert all(map(language.has_letter, ["a", "1a", "é", "ж", "日", "ʰ", "ª"]))


def test_repeated_rows_count_once(spark):
    rows = [(1, "das haus und der garten mit", "de")] * 500 + [(i, f"the house and the garden with number {i}", "en") for i in range(2, 30)]
    rows += [(None, f"das haus und der hof {i}", "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = [sorted(map(tuple, language.identify(df, F.lit(True)).select("lang", "lang_pred", "lang_score").collect())) for _ in range(2)]
    assert got[0] == got[1] and all(a == b for a, b, _ in got[0])


def test_machines_vote_as_plain_loops_do():
    import numpy as np

    rng = np.random.default_rng(3)
    names = [n for n in ("en", "de", "fr", "es", "xx") for _ in range(12)]
    x = rng.normal(size=(len(names), 6)).astype(np.float32) + np.repeat(np.eye(5, 6, dtype=np.float32) * 4, 12, axis=0)
    model = language.Languages(x, names)
    got, score = model.predict(x)

    def best(members, pairs, begin, row):
        margins = [float(row @ model.weights[:-1, begin + k] + model.weights[-1, begin + k]) for k in range(len(pairs))]
        wins = [0.0] * len(members)
        for (i, j), m in zip(pairs, margins, strict=True):
            wins[i] += (m >= 0) + 1e-3 * np.tanh(m)
            wins[j] += (m < 0) - 1e-3 * np.tanh(m)
        return members[int(np.argmax(wins))]

    for r in range(len(names)):
        family = best(model.families, model.first, 0, x[r])
        begin, pairs = model.second[family]
        assert got[r] == best(model.members[family], pairs, begin, x[r]) and 0 <= score[r] <= 1
    assert sum(a == b for a, b in zip(got, names, strict=True)) >= 0.95 * len(names)
