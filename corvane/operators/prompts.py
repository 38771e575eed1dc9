"""Prompts: what goes into a model's context window, and in which words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as tx

# Filler phrases.
FILLER = r"(?i)\b(certainly[!,]?\s*|great question[!,]?\s*|of course[!,]?\s*|absolutely[!,]?\s*|i'd be happy to help\.?\s*|i'm happy to assist\.?\s*|let me help you with that\.?\s*|sure[!,]?\s*|definitely[!,]?\s*)"
TYPES = (("summarization", ("summarize", "summarise", "summary", "overview")), ("comparison", ("compare", "contrast", "difference", "versus", "vs")), ("extraction", ("extract", "list all", "find all", "enumerate")), ("reasoning", ("why", "how", "explain", "reason", "cause")))


def prompt_type(question: Column) -> Column:
    """What kind of answer a question asks for, the first kind of which a word is contained; qa else."""
    low, out = F.lower(question), None
    for name, words in TYPES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("qa")


def complexity(question: Column, documents: Column) -> Column:
    n = F.size(tx.words(question))
    return F.when((n > 40) | (documents > 5), "complex").when((n > 20) | (documents > 2), "moderate").otherwise("simple")


def without_filler(c: Column) -> Column:
    return tx.strip(tx.replace(c, FILLER, ""))


def tidy(c: Column) -> Column:
    return tx.strip(tx.replace(tx.replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def capped(c: Column, tokens: int) -> Column:
    """The first words that ``tokens`` hold, marked if there were more."""
    w, most = tx.words(c), int(tokens / 1.3)
    return F.when(F.size(w) <= most, c).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit(" [...]")))


def context_block(docs: Column) -> Column:
    """Numbered blocks of an array of structs (source, score, content)."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d["source"], F.lit(" (relevance: "), F.format_number(d["score"], 2), F.lit(")\n"), d["content"])), "\n\n")


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
