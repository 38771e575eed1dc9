"""Literal tests of stores, fixing, guards, prompts, steps and further sources."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import fixing as fx
from corvane.operators import embedding, guards, prompting, routing, stores
from corvane.plans import steps
from corvane.sources import auto, excel


def test_store_lifecycle(spark, tmp_path):
    rows = [("c1", "doc_1", "a", [1.0, 0.0]), ("c2", "doc_1", "b", [0.9, 0.1]), ("c3", "doc_2", "c", [0.0, 1.0]), ("c4", "doc_2", "d", [0.1, 0.9])]
    s = stores.Store(spark, str(tmp_path / "s"))
    assert len(s) == 0 and "c1" not in s
    s.add(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, embedding array<double>"))
    assert len(s) == 4 and "c1" in s
    assert {r.doc_id for r in s.related("doc_1", 2).collect()} == {"doc_2"}
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert [r.chunk_id for r in s.search(asked, 2).orderBy("rank").collect()] == ["c1", "c2"]
    assert [r.chunk_id for r in s.search(asked, 5, threshold=0.9).orderBy("rank").collect()] == ["c1", "c2"]
    s.save(str(tmp_path / "copy"))
    assert len(stores.Store(spark, str(tmp_path / "copy"))) == 4
    assert s.delete(doc_ids=["doc_1"]) == 2 and len(s) == 2 and s.delete() == 0 and s.delete(chunk_ids=["no"]) == 0
    with pytest.raises(ValueError):
        s.add(spark.createDataFrame([("x", "d", "t", [1.0])], "chunk_id string, doc_id string, text string, embedding array<double>"))
    with pytest.raises(ValueError):
        s.add(spark.createDataFrame([("x", "d", " ", [1.0, 2.0])], "chunk_id string, doc_id string, text string, embedding array<double>"))
    s.clear()
    assert len(s) == 0


def test_cache_encodes_each_text_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, " ")], "doc_id long, text string")
    empty = spark.createDataFrame([], "key string, embedding array<double>")
    got, grown = embedding.through_cache(docs, empty, lambda t: [[3.0, 4.0]] * len(t), "m")
    assert {r.doc_id: r.embedding for r in got.collect()} == {1: [0.6, 0.8], 2: [0.6, 0.8], 3: None, 4: None} and grown.count() == 1
    tries = []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return [[1.0]] * len(texts)

    assert embedding.with_retry(flaky)(["x"]) == [[1.0]] and len(tries) == 3


def test_repairs():
    assert fx.repaired("{a: 'x',}") == ('{"a": "x"}', "regex")
    assert fx.repaired('```json\n{"a": 1}\n```') == ('{"a": 1}', "regex")
    assert fx.repaired('{"a": 1} and more') == ('{"a": 1}', "regex")
    assert json.loads(fx.repaired("Full Name: Bo\nage = 3")[0]) == {"full_name": "Bo", "age": "3"}
    assert fx.repaired("just words") == ("just words", "none") and fx.repaired(None) == (None, "none")
    assert fx.valid_prefix("no json") is None


def test_scores_and_fields(spark):
    rows = [("a,b\n1,2\n3,4",), ("a;b;c\n1;2;3",), ("one line",), ("<a>x</a><b>y</b>",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(fx.csv_score(F.col("t")).alias("c"), fx.xml_score(F.col("t")).alias("x"), fx.delimiter(F.col("t")).alias("d")).collect()
    assert [r.c for r in got] == [0.8, 0.8, 0.0, 0.0, 0.0, 0.0] and [r.x for r in got][3] == 0.88 and [r.d for r in got][:3] == [",", ";", ","]
    kept = spark.range(1).select(fx.with_defaults(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string")), {"b": "x", "c": "y"}).alias("m")).first().m
    assert kept == {"a": "1", "b": "x", "c": "y"}
    typed = spark.createDataFrame([("about 42 items",)], "t string").select(fx.typed(F.col("t"), "int"), fx.typed(F.lit("Yes"), "bool"), fx.typed(F.lit("a; b"), "list")).first()
    assert tuple(typed) == ("42", "true", '["a","b"]')


def test_guard_literals(spark):
    rows = [("",), ("123456789",), ("a fine context\n---\nwith a source",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(guards.context_check(F.col("t")).alias("g")).collect()
    assert [(r.g.passed, r.g.warnings) for r in got] == [(False, ["empty"]), (False, ["short", "no source"]), (True, []), (False, ["empty"])]
    attacks = ["ignore previous", "System  prompt", "<script>", "; rm -rf", "../etc", "fine"]
    assert [r[0] for r in spark.createDataFrame([(a,) for a in attacks], "t string").select(guards.attacked(F.col("t"))).collect()] == [True] * 5 + [False]


def test_prompt_literals(spark):
    df = spark.createDataFrame([("A rule that is longer than thirty characters.", "Question?\n\nA rule that is longer than thirty characters.")], "s string, u string")
    assert df.select(prompting.without_repeats(F.col("s"), F.col("u"))).first()[0] == "Question?"
    turns = spark.createDataFrame([([("user", str(i)) for i in range(12)],)], "m array<struct<role:string,content:string>>")
    said = turns.select(prompting.messages(F.lit("s"), F.col("m"), F.lit("u")).alias("x")).first().x
    assert [m.content for m in said] == ["s", *map(str, range(2, 12)), "u"]
    assert json.loads(turns.select(prompting.anthropic(F.lit("s"), F.slice("m", 1, 1), F.lit("u")).alias("x")).first().x) == {"system": "s", "messages": [{"role": "user", "content": "0"}, {"role": "user", "content": "u"}]}
    got = spark.range(1).select(*[prompting.user_prompt(n, F.lit("ctx"), F.lit(""), F.lit("q?")).alias(n) for n in prompting.SECTIONS], prompting.system_prompt(F.lit("rules"), F.lit("executive"), F.lit("French")).alias("sys")).first()
    assert got.simple == "## Context\nctx\n\n## Question\nq?\n\n## Answer" and got.react.endswith("## Task\nq?\n\nThought:")
    assert got.sys.split("\n\n")[2:] == ["Respond in French.", "rules"]


def test_fallback_route(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    routed = spark.createDataFrame([(1, 1, "a", 0.9, "high"), (1, 2, "b", 0.1, "none")], "query_id long, rank int, route string, score double, confidence string")
    assert sorted(map(tuple, routing.with_fallback(asked, routed, "help").collect())) == [(1, "a", 0.9, "high"), (2, "help", 0.0, "none")]


def test_steps(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "id long, x long")
    double, fails = steps.Step(lambda d: d.withColumn("x", d.x * 2), "double"), steps.Step(lambda d: d.select("none"), "fails")
    both = steps.parallel({"a": double, "b": steps.Step(lambda d: d.where("x > 2"), "some")}, "id")(df)
    assert sorted(map(tuple, both.select("id", "a_x", "b_x").collect())) == [(1, 4, None), (2, 6, 3)]
    traces = []
    assert steps.guarded(fails, double, 2, traces)(df).count() == 2 and [t[:2] for t in traces] == [("fails", 1), ("fails", 2)]
    with pytest.raises(Exception, match="none"):
        steps.guarded(fails)(df)
    once = steps.cached(double)
    assert once(df).inputFiles() == once(df).inputFiles()
    r = steps.Registry()
    r.register("d", double, ("math",))
    with pytest.raises(ValueError):
        r.register("d", double)
    assert r.names("math") == ["d"] and r.get("d") is double and r.unregister("d") and not r.unregister("d") and r.names() == []


def workbook(path):
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {n} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {n}><si><t>name</t></si><si><t>Bo</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {n}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>age</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row><row><c r="B3"><v>4</v></c></row><row/></sheetData></worksheet>')


def test_excel_and_auto(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    assert [(r.sheet, r.row, r.text) for r in excel.excel_files(spark, str(tmp_path)).orderBy("row").collect()] == [("One", 0, "name: Bo\nage: 3"), ("One", 1, "age: 4")]
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "c.md").write_text("# T\n\nbody")
    (tmp_path / "d.csv").write_text("k,v\n1,2\n")
    (tmp_path / "e.html").write_text("<title>T</title><p>para</p>")
    (tmp_path / "f.bin").write_bytes(b"x")
    got = sorted(r.page_content for r in auto.load(spark, str(tmp_path)).collect())
    assert got == sorted(["one", "two", "# T\n\nbody", "k: 1\nv: 2", "T\npara", "name: Bo\nage: 3", "age: 4"])
    assert [r.path.rsplit("/", 1)[-1] for r in auto.unread(spark, str(tmp_path)).collect()] == ["f.bin"]
    from corvane.sources import files

    assert {r.path.rsplit("/", 1)[-1]: r.problem for r in auto.problems(files.directory(spark, str(tmp_path))).collect() if r.problem} == {"f.bin": "unknown type"}
    assert {r.kind for r in auto.load_and_split(spark, str(tmp_path / "c.md")).collect()} == {"heading", "body"}


def test_entities_of_a_table(spark, sf_dir):
    import re

    from corvane import catalog

    pattern = re.compile(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|[\u0600-\u06FF]{3,}(?:\s+[\u0600-\u06FF]{3,}){1,3})\b")
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        found = list(dict.fromkeys(m.group() for m in pattern.finditer(r.text)))
        want[r.doc_id] = (len(found), found[0] if found else "")
    assert {r.doc_id: (r.distinct_entities, r.first) for r in catalog.QUERIES["entities"](spark, sf_dir).collect()} == want


def test_budget_suggested_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Twelve values whose mean is exactly 50: as doubles, summed in this order, they fall short of it."""
    from corvane import catalog

    values = [85.05, 75.57, 16.95, 86.44, 24.52, 77.8, 33.46, 45.21, 24.9, 82.86, 22.81, 24.43]
    rows = [(1, v) for v in values] + [(2, v) for v in reversed(values)] + [(3, v) for v in values] + [(3, None)] + [(4, 50.0)] * 9 + [(5, float("nan"))] + [(5, 1e300)] * 12 + [(6, 1 / 3)] * 12
    spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.budget for r in catalog.QUERIES["budget_suggested"](spark, str(tmp_path)).collect()}
    assert got == {1: 650, 2: 650, 3: 650, 4: 2000, 5: 2000, 6: 200}
