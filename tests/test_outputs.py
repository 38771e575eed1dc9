import json

from pyspark.sql import functions as F

from corvane.functions import validation as va
from corvane.operators import parsed, prompts, routing
from corvane.plans.steps import Step, branch, from_spec


def test_parse(spark):
    cases = [
        ("json", 'Sure: {"a": {"b": 1}} and more', {"a": {"b": 1}}), ("json", "```json\n[1, 2]\n```", [1, 2]), ("yaml", "```yaml\na: 1\nb: [x]\n```", {"a": 1, "b": ["x"]}),
        ("csv", "a, b\n1, 2\n", [{"a": "1", "b": "2"}]), ("markdown_table", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |", [{"a": "1", "b": "2"}]), ("xml", "<a>1</a><b> 2 </b><a>3</a>", {"a": "3", "b": "2"}),
        (None, "just words", {"answer": "just words"}),
    ]
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(cases)] + [(90, "json", "no"), (91, None, None), (92, None, " ")], "i int, kind string, output string")
    got = {r.i: r for r in parsed.parse(df, format="kind").collect()}
    assert all(json.loads(got[i].parsed) == want and got[i].error is None for i, (_, _, want) in enumerate(cases))
    assert all(got[i].parsed is None and got[i].error for i in (90, 91, 92))


def test_keyword_scores(spark):
    words = lambda *x: F.array(*[F.lit(w) for w in x]) if x else F.expr("cast(array() as array<string>)")
    many = words(*"abcdefgh")
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(routing.keyword_score(F.lit("A B"), words(), many, words())) == 0.25
    assert one(routing.keyword_score(F.lit("a b x"), words(), many, words("X"))) == 0.0
    assert one(routing.keyword_score(F.lit("a"), words("z"), many, words())) == 0.0
    assert one(routing.keyword_score(F.lit("a"), words(), words(), words())) == 0.1
    assert [one(routing.confidence(F.lit(x))) for x in (0.85, 0.849, 0.6, 0.4, 0.399)] == ["high", "medium", "medium", "low", "none"]


def test_prompts_and_validation(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(prompts.without_filler(F.lit("Certainly! Here it is"))) == "Here it is"
    assert one(prompts.tidy(F.lit("a  b\n\n\n\nc "))) == "a b\n\nc"
    assert [m.role for m in one(prompts.messages(F.lit("s"), F.lit("u")))] == ["system", "user"]
    assert [one(va.field(F.lit(v), r, d)) for v, r, d in (("1", True, "int"), (" 1", True, "int"), ("x", True, "int"), (None, False, "str"), (None, True, "str"))] == ["passed", "warning", "failed", "skipped", "failed"]
    assert [one(va.clamp_confidence(F.lit(x))) for x in ("0.5", "7", "-1", "high")] == [0.5, 1.0, 0.0, 1.0]


def test_steps(spark):
    df = spark.range(6)
    even, odd = Step(lambda d: d.withColumn("k", F.lit("even"))), Step(lambda d: d.withColumn("k", F.lit("odd")))
    whole = Step(lambda d: d.where("id > 1")) >> branch(F.col("id") % 2 == 0, even, odd)
    assert sorted(map(tuple, whole(df).collect())) == [(2, "even"), (3, "odd"), (4, "even"), (5, "odd")]
    made = from_spec([{"step": "least", "with": {"n": 4}}, {"step": "count"}], {"least": lambda d, n: d.where(F.col("id") >= n), "count": lambda d: d.groupBy().count()})
    assert made(df).first()["count"] == 2
