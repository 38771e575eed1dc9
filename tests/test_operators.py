import zipfile

import pytest

from corvane.functions import text as tx
from corvane.operators import chunks, rows, search
from corvane.sources import docx, files, html
from corvane.streaming import events as ev


def test_row_store(spark):
    store = spark.createDataFrame([("c1", "d1"), ("c2", "d1"), ("c3", "d2")], "id string, doc string")
    assert rows.delete(store, spark.createDataFrame([("c1",)], "id string"), "id").count() == 2
    assert sorted(r.id for r in rows.fetch(store, spark.createDataFrame([("c1",), ("c1",), ("no",)], "id string"), "id").collect()) == ["c1"]
    new = rows.upsert(store, spark.createDataFrame([("c1", "d9"), ("c4", "d9")], "id string, doc string"), "id")
    assert sorted(map(tuple, new.collect())) == [("c1", "d9"), ("c2", "d1"), ("c3", "d2"), ("c4", "d9")]


def test_similar_pairs_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    sets = {}
    for r in docs.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.3}
    first = {d: min(e for e in sets if sets[e] == sets[d]) for d in sets}
    assert {r.doc_id: r.first for r in rows.copies(docs).collect()} == first
    assert {(r.a, r.b) for r in rows.similar_pairs(docs, 0.3).collect()} == {(a, b) for a, b in want if first[a] == a and first[b] == b}
    kept = []
    for d in sorted(sets):
        if all(alike(k, d) < 0.85 for k in kept):
            kept.append(d)
    assert sorted(r.doc_id for r in rows.drop_similar(docs.select("doc_id"), rows.similar_pairs(docs, 0.85), rows.copies(docs)).collect()) == kept


def test_chained_similarity_keeps_what_only_dropped_rows_resemble(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(r.doc_id for r in rows.drop_similar(docs, pairs).collect()) == [0, 2, 4]


def test_markdown_sections(spark):
    docs = spark.createDataFrame([(1, "# T\nbody\n```py\nx\n```\nafter"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.kind, r.heading, r.section) for r in chunks.markdown_sections(docs).orderBy("doc_id", "pos").collect()]
    assert got == [("heading", "T", "T"), ("body", "T", "body"), ("code", "T", "```py\nx\n```"), ("body", "T", "after")]


def test_recursive_chunks(spark):
    docs = spark.createDataFrame([(1, "aaaa bbbb. cccc dddd\n\neeee"), (2, None), (3, "x" * 25)], "doc_id long, text string")
    got = chunks.recursive(docs, 10, 0).orderBy("doc_id", "pos").collect()
    assert all(len(r.chunk) <= 12 for r in got) and {r.doc_id for r in got} == {1, 3}
    assert "".join(r.chunk for r in got if r.doc_id == 3) == "x" * 25


def test_html(spark):
    page = "<html lang='en'><head><title>T</title><script>no</script></head><body><h1>A</h1><p>b<p>c<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr><tr></tr></table></body>"
    got = html.extract(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).orderBy("kind").collect()
    assert [(r.page_id, r.kind, r.content) for r in got] == [(1, "table", "a | b\nc | d"), (1, "text", "T\nA\nb\nc\na\nb\nc\nd")]


def test_html_of_broken_pages():
    def read(page):
        r = html._Reader()
        r.feed(page)
        r.close()
        return r.text, [x for _, x in r.found]

    assert read("<table><tr><td>a</tr></td></table>") == (["a"], ["a"])
    assert read("<table><tr><td>a</td></table></tr>b") == (["a", "b"], ["a"])
    assert read("<header><nav>menu</header><p>body</p>") == (["body"], [])
    assert read("<p>one</p><nav>menu<p>body</p>") == (["one", "menu", "body"], [])
    assert read("<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>") == (["out", "in", "b"], ["out | b", "in"])
    assert read("<table><td>a<td>b<tr><td>c</table>") == (["a", "b", "c"], ["a | b\nc"])
    assert read("<footer>x</footer><script>no</script><p>y</nav></p>") == (["y"], [])


def test_recursive_chunks_by_literals(spark):
    docs = spark.createDataFrame([(1, "aaa bbb. cc dd. eeeeee ffffff ggg"), (2, "one two\n\nthree four five six"), (3, "abcdefghij")], "doc_id long, text string")
    got = chunks.recursive(docs, 8, 0).orderBy("doc_id", "pos").collect()
    assert [r.chunk for r in got if r.doc_id == 1] == ["aaa bbb", " cc dd", " eeeeee", "ffffff", "ggg"]
    assert [r.chunk for r in got if r.doc_id == 2] == ["one two", "three", "four five", "six"]
    assert [r.chunk for r in got if r.doc_id == 3] == ["abcdefgh", "ij"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.md").write_text("# Title\n\n**bold**")
    (tmp_path / "t.csv").write_text('a,b\n" x ",\n,\n1,2\n')
    (tmp_path / "l.jsonl").write_text('{"k": "v", "n": null, "d": {"x": 1}}\n{broken\n\n')
    (tmp_path / "r.json").write_text('[{"k": "v"}, {"k": "w"}]')
    assert sorted(r.page_content for r in files.text_files(spark, str(tmp_path / "[ab].txt")).collect()) == ["café", "one\ntwo\n"]
    assert files.markdown_files(spark, str(tmp_path / "sub"), strip=True).first().page_content == "Title\n\nbold"
    assert sorted(r.page_content for r in files.csv_files(spark, str(tmp_path / "t.csv")).collect()) == ["a: 1\nb: 2", "a: x"]
    assert [r.page_content for r in files.json_lines(spark, str(tmp_path / "l.jsonl")).collect()] == ['k: v\nd: {"x":1}']
    assert sorted(r.page_content for r in files.json_files(spark, str(tmp_path / "r.json"), "k").collect()) == ["v", "w"]
    listed = files.directory(spark, str(tmp_path), exclude=["*.csv"])
    assert {r.type: r.files for r in files.directory_stats(listed).collect()} == {"text": 2, "markdown": 1, "jsonl": 1, "json": 1}


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Head", "Heading2") + p("text") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert [(r.kind, r.text) for r in docx.docx_files(spark, str(tmp_path)).orderBy("pos").collect()] == [("heading", "## Head"), ("paragraph", "text"), ("table", "a | b")]


def test_bm25_prefers_the_rarer_word(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "other")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "rare common")], "query_id long, query string")
    got = [r.doc_id for r in search.bm25(docs, asked).orderBy("score", ascending=False).collect()]
    assert got == [1, 2]


@pytest.mark.parametrize("f,mode", [(ev.tumbling, "complete"), (ev.sliding, "complete")])
def test_stream_equals_batch(spark, sf_dir, tmp_path, f, mode):
    batch = f(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", tx.F.col("ts").cast("timestamp")))
    path = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(path))
    live = ev.run_once(f(ev.stream(spark, str(path))), f"s_{f.__name__}", mode, str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_moving_average_stream(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(path))
    live = ev.run_once(ev.moving_average(ev.stream(spark, str(path))), "averages", "update", str(tmp_path / "checkpoint"))
    want = {}
    for r in sorted(spark.read.parquet(str(path)).collect(), key=lambda r: (r.ts, r.event_id)):
        e, n = want.get(r.user_id, (0.5, 0))
        want[r.user_id] = (0.1 * (r.event_type != "error") + 0.9 * e, n + 1)
    got = {r.user_id: (r.ema, r.n) for r in live.collect()}
    assert got.keys() == want.keys() and all(abs(got[u][0] - want[u][0]) < 1e-9 and got[u][1] == want[u][1] for u in want)
