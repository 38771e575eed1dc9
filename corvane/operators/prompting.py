"""Whole prompts: guardrails by what a request is, strategies' sections, memory, and instructions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import prompts

# Guardrails and their priorities, and what each strategy's prompt has, in order.
GUARDRAILS = {"safe_output": 110, "pii_protection": 105, "grounding": 100, "no_fabrication": 95, "uncertainty": 90, "cite_sources": 80, "stay_on_topic": 70, "no_personal_opinions": 60, "show_reasoning": 50, "self_check": 45, "concise": 40, "no_markdown_leakage": 30}
REASONED = ["chain_of_thought", "multi_hop", "least_to_most"]
SECTIONS = {
    "simple": ("Context", "Conversation History", "Question", "Answer"),
    "chain_of_thought": ("Context", "Conversation History", "Question", "Reasoning Process"),
    "multi_hop": ("Context Documents", "Conversation History", "Main Question", "Analysis"),
    "self_consistent": ("Context", None, "Question", "Task"),
    "step_back": ("Context", None, "Specific Question", "Step 1 — Abstraction"),
    "react": ("Available Information", "Prior Conversation", "Task", None),
    "least_to_most": ("Context", None, "Problem", "Solution"),
}
#: Instructions in words of our own; a table of others may be given.
INSTRUCTIONS = {
    "safe_output": "Decline what would harm or demean, and say why.",
    "pii_protection": "Leave out names, addresses, numbers and other personal data.",
    "grounding": "Use only what the context says.",
    "no_fabrication": "Invent no facts, figures, dates or quotations.",
    "uncertainty": "If the context does not tell, say that it does not.",
    "cite_sources": "Mark each claim with the number of its source, like [1].",
    "stay_on_topic": "Answer the question and nothing else.",
    "show_reasoning": "Show the steps that lead to the answer.",
    "self_check": "Check the answer against the context before giving it.",
    "concise": "Be brief.",
    "no_personal_opinions": "Give no opinions of your own.",
    "no_markdown_leakage": "Write no markup unless asked to.",
}
PERSONAS = {"technical": "Be exact and use technical terms.", "academic": "Write formally and cite evidence.", "executive": "Put the outcome first, in few words.", "general": "Use plain words."}


def guardrails(documents: Column, strategy: Column, complexity: Column, kind: Column, enabled: Column | None = None, extra: dict[str, int] | None = None) -> Column:
    """The names of the guardrails that apply to a request, the highest priority first, each once."""
    on = enabled if enabled is not None else F.lit(True)
    some = documents > 0
    applies = {
        "safe_output": F.lit(True), "concise": F.lit(True), "grounding": on & some, "no_fabrication": on & some, "uncertainty": on, "cite_sources": on & some,
        "stay_on_topic": on & ~kind.isin("agent", "tool_use"), "pii_protection": on, "show_reasoning": strategy.isin(REASONED), "self_check": complexity.isin("complex", "expert"),
    }
    all_ = {**{n: (GUARDRAILS[n], use) for n, use in applies.items()}, **{n: (p, F.lit(True)) for n, p in (extra or {}).items() if n not in applies}}
    ordered = sorted(all_.items(), key=lambda x: -x[1][0])
    return F.filter(F.array(*[F.when(use, n) for n, (_, use) in ordered]), lambda x: x.isNotNull())


def guardrail_block(names: Column, texts: dict[str, str] | None = None) -> Column:
    """Numbered instructions under a heading; empty without guardrails."""
    known = F.create_map(*[F.lit(x) for p in (texts or INSTRUCTIONS).items() for x in p])
    lines = F.transform(names, lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(known[n], n)))
    return F.when(F.size(names) == 0, "").otherwise(F.concat(F.lit("## Instructions & Constraints\n"), F.array_join(lines, "\n")))


def strategy(complexity: Column, kind: Column) -> Column:
    """Which strategy a request gets when it names none."""
    return F.when(kind == "agent", "react").when(kind == "comparison", "multi_hop").when((kind == "reasoning") | (complexity == "complex"), "chain_of_thought").otherwise("simple")


def user_prompt(name: str, context: Column, memory: Column, question: Column) -> Column:
    """A strategy's sections that have something in them, parted by blank lines."""
    for_context, for_memory, for_question, last = SECTIONS[name]
    part = lambda title, c: F.when(c != "", F.concat(F.lit(f"## {title}\n"), c))
    parts = [part(for_context, context), part(for_memory, memory) if for_memory else None, F.concat(F.lit(f"## {for_question}\n"), question), F.lit(f"## {last}") if last else F.lit("Thought:")]
    return F.concat_ws("\n\n", *[p for p in parts if p is not None])


def system_prompt(block: Column, profile: Column | None = None, language: Column | None = None, role: str = "You answer questions from documents.") -> Column:
    """The role, how to speak to whom, in which language unless English, and the guardrails."""
    persona = F.create_map(*[F.lit(x) for p in PERSONAS.items() for x in p])[profile] if profile is not None else F.lit(None)
    tongue = F.when(language.isNotNull() & ~F.lower(language).isin("en", "english"), F.concat(F.lit("Respond in "), language, F.lit("."))) if language is not None else F.lit(None)
    return F.concat_ws("\n\n", F.lit(role), persona, tongue, F.nullif(block, F.lit("")))


def messages(system: Column, memory: Column, user: Column, most: int = 10) -> Column:
    """System, the last ``most`` of the earlier turns (array of role and content), and the user's."""
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), F.slice(memory, F.greatest(F.size(memory) - most + 1, F.lit(1)), most), F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))))


def anthropic(system: Column, memory: Column, user: Column) -> Column:
    """JSON with the system text apart from the turns."""
    return F.to_json(F.struct(system.alias("system"), F.filter(messages(system, memory, user), lambda m: m["role"] != "system").alias("messages")))


def without_repeats(system: Column, user: Column) -> Column:
    """The user prompt without paragraphs of over 30 characters that the system prompt holds too."""
    held = F.filter(F.transform(F.split(system, "\n\n"), tx.strip), lambda p: F.length(p) > 30)
    return F.array_join(F.filter(F.split(user, "\n\n"), lambda p: ~F.array_contains(held, tx.strip(p))), "\n\n")


def built(requests: DataFrame) -> DataFrame:
    """``requests`` (query, context, memory, documents) with kind, complexity, strategy, system and user prompt, and tokens of both."""
    kind = prompts.prompt_type(F.col("query"))
    out = requests.withColumns({"kind": kind, "complexity": prompts.complexity(F.col("query"), F.col("documents"))})
    out = out.withColumn("strategy", strategy(F.col("complexity"), F.col("kind")))
    out = out.withColumn("system", system_prompt(guardrail_block(guardrails(F.col("documents"), F.col("strategy"), F.col("complexity"), F.col("kind")))))
    user = F.coalesce(*[F.when(F.col("strategy") == n, user_prompt(n, F.col("context"), F.col("memory"), F.col("query"))) for n in SECTIONS])
    out = out.withColumn("user", prompts.tidy(without_repeats(F.col("system"), prompts.without_filler(user))))
    return out.withColumn("tokens", tx.token_estimate(F.concat_ws(" ", "system", "user")))
