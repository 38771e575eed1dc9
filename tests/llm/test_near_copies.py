import random

import corpus_pipeline
from corvane.llm import near_copies, simhash


def shingled(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9 if a and b else a == b


def kept(rows):
    """The smallest id of each component, by brute force."""
    sets, up = [shingled(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted(least.values())


def planted():
    rng = random.Random(6)
    rows = []
    for base in range(40):
        text = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((len(rows), " ".join(text)))
        # Each replaced word far from others changes five shingles: 0.97 to about 0.8, and some below.
        for n in (1, 2, 4, 5, 6, 7, 9):
            copy = list(text)
            for at in rng.sample(range(10, 290, 10), n):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    # A chain: each link is alike, its ends are not.
    text = [f"c{i}" for i in range(200)]
    for step in range(12):
        rows.append((len(rows), " ".join(text)))
        for at in (step * 15 + 5, step * 15 + 12):
            text[at] = f"y{step}-{at}"
    rng.shuffle(rows)
    return rows


def test_stage_on_planted_copies(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == kept(rows) and len(got) < len(rows) / 2


def test_near_copies_of_a_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = near_copies.drop_near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in got) == kept(rows)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, " \t"), (7, "A b"), (8, "a B"), (None, "a b"), (11, "z " * 400), (11, "z " * 400), (None, "alone here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id for r in near_copies.drop_near_copies(docs).collect()), key=str) == sorted([4, 7, 11, None], key=str)
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(80))
    rows = [(1, words("a")), (7, words("b")), (7, words("c")), (8, words("a") + " more"), (8, words("d")), (9, words("d")), (9, words("d")), (None, words("e")), (None, words("e")), (None, words("c"))]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, cls string, root int").repartition(3)
    kept = near_copies.drop_near_copies(docs).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("1", "a"), ("7", "b"), ("7", "c"), ("8", "d"), ("None", "e")]


def test_simhash_tables_alone_would_miss_most_links(spark):
    rows = planted()
    prints = {i: simhash.fingerprint(t, 5) & 0xFFFFFFFFFFFFFFFF for i, t in rows}
    sets = {i: shingled(t) for i, t in rows}
    alike_pairs = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    close = sum((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in alike_pairs)
    assert 0 < close < 0.3 * len(alike_pairs)


def test_texts_of_one_template_are_not_paired_with_each_other(spark, monkeypatch):
    rng = random.Random(3)
    base, rows = [f"t{i}" for i in range(150)], []
    for _ in range(160):
        text = list(base)
        for at in rng.sample(range(5, 145), rng.choice((1, 4, 5, 6))):
            text[at] = f"n{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(text)))
    asked, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for small, block in ((32, 512), (2, 30)):
        monkeypatch.setattr(near_copies, "SMALL", small)
        monkeypatch.setattr(near_copies, "BLOCK", block)
        asked.clear()
        assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == kept(rows)
        assert sum(asked) < 8 * len(rows)


def test_blocks_find_all_links(spark, monkeypatch):
    """Without rounds of leads and without small bands, the blocks alone connect all."""
    for name, value in (("SMALL", 1), ("BLOCK", 3), ("ROUNDS", 0)):
        monkeypatch.setattr(near_copies, name, value)
    rows = planted()[:150]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == kept(rows)
