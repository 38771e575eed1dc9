"""What a question asks for: intent, complexity, keywords, entities, budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.let import let

# Signals of each intent, in order of precedence, and word lists.
INTENTS = {
    "factual": "ما|من|متى|أين|كم|ما هو|ما هي|ما اسم|من هو|من هي|what|who|when|where|which|how many|how much",
    "reasoning": "لماذا|كيف|ما سبب|ما علة|فسّر|وضّح|اشرح|why|how|explain|describe|elaborate|analyze|reason",
    "comparative": "قارن|الفرق|أيهما|أفضل|مقارنة|مقابل|بين|compare|difference|versus|vs|better|worse|contrast",
    "procedural": "كيفية|خطوات|طريقة|كيف أفعل|كيف يمكن|آلية|how to|steps|procedure|process|guide|tutorial|implement",
    "code": "كود|برمجة|دالة|كلاس|مثال كود|اكتب كود|برمج|code|function|class|implement|script|program|snippet",
    "summarize": "لخّص|ملخص|باختصار|أعطني فكرة|شرح مختصر|ما هي النقاط|summarize|summary|overview|briefly|tldr|main points",
}
HIGH = r"(?i)\b(analyze|compare|evaluate|critique|pros.and.cons|trade.?off|قارن|حلل|قيّم|عوامل|مزايا وعيوب|الفرق بين)\b"
STOP_EN = "the a an and or but in on at to for of with by from is are was were be been have has had do does did will would could should this that these those it its we you he she they them their our your my i not can get".split()
STOP_AR = "في من إلى على عن مع هذا هذه ذلك التي الذي أن إن كان كانت هو هي هم نحن أنت ما لا لم قد كل بعض بين حيث ثم أو لكن و ب ل".split()
WH = "what who when where how why which".split()
WH_AR = "ما من متى أين كيف لماذا كم".split()
YES_NO_AR = "هل أ".split()
YES_NO = "is are was were do does did can could will".split()
BUDGETS = {"low": 800, "medium": 2000, "high": 4000}
ENTITY = r"(?<![\p{L}\p{N}_])(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|[\x{0600}-\x{06FF}]{3,}(?:\s+[\x{0600}-\x{06FF}]{3,}){1,3})(?![\p{L}\p{N}_])"


def normalise(c: Column) -> Column:
    return tx.collapse(tx.replace(tx.replace(tx.strip(c), r"[\x{064B}-\x{0652}]", ""), "[إأآا]", "ا"))


def intent(c: Column) -> Column:
    """The intent of which most signals are contained; the first of equals; factual if none is."""
    low = F.lower(c)
    hits = {k: sum((F.contains(low, F.lit(s)).cast("int") for s in v.split("|")), F.lit(0)) for k, v in INTENTS.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, "factual")
    for k, n in hits.items():
        out = out.when(n == most, k)
    return out


def complexity(c: Column) -> Column:
    n = F.size(tx.words(c))
    return F.when(c.rlike(HIGH) | (n > 20), "high").when(n <= 12, "low").otherwise("medium")


def budget(level: Column) -> Column:
    return F.when(level == "low", BUDGETS["low"]).when(level == "medium", BUDGETS["medium"]).otherwise(BUDGETS["high"])


def question_type(c: Column) -> Column:
    """wh-question, yes/no or open, by the first word in the question's own language: Arabic if 30 % of its characters are."""
    low = F.lower(tx.strip(c))
    begins = lambda words: low.rlike("^(" + "|".join(words) + ")")
    arabic = tx.is_arabic(c)
    return F.when(arabic & begins(WH_AR) | ~arabic & begins(WH), "wh-question").when(arabic & begins(YES_NO_AR) | ~arabic & begins(YES_NO), "yes/no").otherwise("open")


def entities(c: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0))), 1, most)


def keywords(c: Column, most: int = 12) -> Column:
    """Words of two letters or more but the stop words of the question's language, by count times 1 + 0.05 length; equals in order of first place."""
    def scores(w: Column) -> Column:
        return F.transform(F.array_distinct(w), lambda x: F.struct((-F.round(F.size(F.filter(w, lambda y: y == x)) * (1 + F.length(x) * 0.05), 6)).alias("s"), F.array_position(w, x).alias("at"), x.alias("word")))

    arabic = tx.is_arabic(c)
    scored = let(F.filter(tx.tokens(c), lambda x: (F.length(x) >= 2) & F.when(arabic, ~x.isin(STOP_AR)).otherwise(~x.isin(STOP_EN))), scores)
    return F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: x["word"])


def contained_share(c: Column, keys: Column) -> Column:
    held = let(F.lower(c), lambda low: F.size(F.filter(keys, lambda k: F.contains(low, k))))
    return F.when(F.size(keys) == 0, 0.0).otherwise(F.least(F.lit(1.0), held / F.size(keys)))
