import numpy as np

from corvane.operators import chunkers as ck


def test_short_neighbours_are_joined():
    assert ck.join_short(["aa", "bb", "cccccc", "d", "e"], 6) == ["aa bb", "cccccc", "d e"]
    assert ck.join_short([], 5) == [] and ck.join_short(["", "x"], 5) == ["x"]


def test_chunks_end_where_meaning_changes():
    text = "Cats purr softly. Cats purr loudly. Stocks fell today. Stocks fell again."
    same = lambda s: np.array([[1.0, 0.0] if "Cats" in x else [0.0, 1.0] for x in s])
    assert ck.semantic(text, same, least=10) == ["Cats purr softly. Cats purr loudly.", "Stocks fell today. Stocks fell again."]
    assert ck.semantic("One only.") == ["One only."] and ck.semantic("") == []
    assert ck.semantic(text, lambda s: np.ones((len(s), 2)), most=30, least=5) == ["Cats purr softly. Cats purr loudly.", "Stocks fell today. Stocks fell again."]


def test_words_are_never_cut():
    assert ck.by_words_hard("aaa bb cccc d", 8) == ["aaa bb", "cccc d"]
    assert ck.by_words_hard("abcdefghij k", 4) == ["abcdefghij", "k"] and ck.by_words_hard(" ", 4) == []


def test_rule_based_packs():
    assert ck.arabic_sentences("one, two. three", 5) == ["one", "two", "three"]
    assert ck.arabic_sentences("one, two. three", 20) == ["one, two", "three"]
    assert ck.rule_based(["aaaa", "bbbb", "cc"], "x", 8, 4, 0.0) == ["aaaa", "bbbb", "bbbb cc"]
    assert ck.rule_based(["aaaa", "bbb", "cc"], "x", 9, 3, 0.0) == ["aaaa bbb", "cc"]
    assert ck.rule_based([], " x ") == [" x "] and ck.rule_based([], " ") == []


def test_structure():
    text = "# T\nbody one.\n```py\nx = 1\n```\nafter"
    assert ck.sections(text) == [("heading", "T", "T"), ("body", "T", "body one."), ("code", "T", "```py\nx = 1\n```"), ("body", "T", "after")]
    assert ck.sections("a\n\nb") == [("body", None, "a"), ("body", None, "b")]
    assert ck.sections("<p>a</p><p>b</p>") == [("body", None, "a b")]
    assert ck.join_small([("body", None, "a"), ("body", None, "b"), ("code", None, "c"), ("body", None, "d")], 10) == [("body", None, "a b"), ("code", None, "c"), ("body", None, "d")]
    assert ck.split_large("Aaaa bbb. Cccc dd. Eeee.", 20) == ["Aaaa bbb. Cccc dd.", "Eeee."]
    assert ck.contextual("Aaaa bbb. Cccc ddd. Eeee fff.", 10, 0, 1, 5) == ["Aaaa bbb. Cccc ddd.", "Aaaa bbb. Cccc ddd. Eeee fff.", "Cccc ddd. Eeee fff."]


def test_strategies():
    assert ck.strategy_of("How to install? What is it?") == "faq"
    assert ck.strategy_of("a novel chapter, he said") == "narrative" and ck.strategy_of("plain words") == "general"
    assert ck.strategy_for("the API server", ["once upon a story", "a story chapter"]) == "narrative"
    assert ck.strategy_for("the API server", ["nothing", "here"]) == "technical"


def test_smart_overlap():
    encode = lambda s: np.array([[1.0, 0.0] if "cat" in x else [0.0, 1.0] for x in s])
    assert ck.smart_overlap(["a dog", "a cat", "cat two"], "cat chunk", encode, 20) == ["a cat", "cat two"]
    assert ck.smart_overlap(["a cat", "cat two"], "cat chunk", encode, 6) == ["a cat"] and ck.smart_overlap([], "x") == []


def test_manager(spark):
    docs = spark.createDataFrame([(1, "Same text.\n\nsame  TEXT.\n\n" + "Other words here now. " * 10), (2, None), (3, " ")], "doc_id long, text string")
    got = ck.chunked(docs, lambda t: [("p", None, p) for p in t.split("\n\n")]).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.total) for r in got] == [(1, 0, 2), (1, 1, 2)]
    for mode in [*ck.MODES, "auto"]:
        assert {r.doc_id for r in ck.chunked(docs, mode).collect()} == {1}
    assert all(0 <= r.score <= 1 for r in ck.enriched(ck.chunked(docs)).collect())
