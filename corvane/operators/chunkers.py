"""Chunkers that use meaning or structure, and the manager that chooses among them.

A text's pieces depend on one another in order, so each text is cut in one place,
in Arrow batches; documents never meet, and nothing is shuffled. Every chunker
gives (id, pos, total, kind, heading, chunk); null and blank texts have no chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.chunks import _windows

# Where sentences end, what a strategy is recognised by, and its sizes.
SENTENCE_END = r"(?<=[.!?؟۔])\s+|\n{2,}"
CONTEXT_SENTENCE_END = r"(?<=[.!?؟۔،])\s+|\n{2,}"
ARABIC_DELIMITERS = r"[.!?؟\n]"
SIGNS = {
    "faq": [r"\b(FAQ|frequently asked|what is|how to|how do|كيف|ما هو|ما هي|هل يمكن|لماذا)\b", r"\?"],
    "documentation": [r"\b(documentation|manual|guide|reference|overview|introduction|مقدمة|دليل|توثيق)\b", r"^#{1,3}\s"],
    "technical": [r"\b(API|SDK|function|class|method|algorithm|database|server|config|import|def |class )\b", r"```", r"\b(pip install|npm install|sudo)\b"],
    "narrative": [r"\b(story|chapter|novel|narrative|قصة|رواية|فصل|حكاية)\b", r"said|replied|whispered|قال|أجاب"],
}
STRATEGIES = {"faq": (256, 32, "semantic"), "documentation": (768, 128, "hybrid"), "technical": (400, 80, "adaptive"), "narrative": (1024, 200, "contextual"), "general": (512, 128, "structural")}

Piece = tuple[str, str | None, str]  # kind, heading, text


def hashed_vectors(sentences: list[str], buckets: int = 256) -> np.ndarray:
    """Counts of words by bucket: the encoder that needs no model."""
    out = np.zeros((len(sentences), buckets))
    for row, s in zip(out, sentences, strict=True):
        for w in regex.findall(r"[\p{L}\p{N}_]+", s.lower()):
            row[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % buckets] += 1
    return out


def sentences(text: str, end: str = SENTENCE_END) -> list[str]:
    return [s for s in (p.strip() for p in re.split(end, text)) if s]


def neighbour_similarity(vectors: np.ndarray) -> np.ndarray:
    """Cosine of each vector and the next; 0 beside a zero vector."""
    n = np.linalg.norm(vectors, axis=1)
    m = n[:-1] * n[1:]
    return np.divide((vectors[:-1] * vectors[1:]).sum(1), m, out=np.zeros(len(m)), where=m > 0)


def join_short(parts: list[str], least: int) -> list[str]:
    """Neighbours put together while both lengths together stay below ``least``."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(p) < least:
            out[-1] = f"{out[-1]} {p}".strip()
        else:
            out.append(p)
    return [p for p in out if p]


def semantic(text: str, encode: Callable = hashed_vectors, threshold: float = 0.75, most: int = 2048, least: int = 50) -> list[str]:
    """A chunk ends where the next sentence is less like this one than ``threshold``, or where it has ``most`` characters; short ones are joined."""
    s = sentences(text)
    if len(s) < 2:
        return s
    groups = [[s[0]]]
    for following, like in zip(s[1:], neighbour_similarity(encode(s)), strict=True):
        if like < threshold or sum(map(len, groups[-1])) + len(groups[-1]) - 1 >= most:
            groups.append([])
        groups[-1].append(following)
    return join_short([" ".join(g) for g in groups], least)


def by_words_hard(text: str, size: int) -> list[str]:
    """Cuts between words, each word counted with one blank."""
    words, out = text.split(), []
    reach = [0, *accumulate(len(w) + 1 for w in words)]
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(reach, reach[at] + size, side="right")) - 1)
        out.append(" ".join(words[at:end]))
        at = end
    return out


def arabic_sentences(text: str, size: int) -> list[str]:
    """Pieces between closing marks; those over ``size`` are cut at commas and semicolons."""
    parts = [p.strip() for p in re.split(ARABIC_DELIMITERS, text)]
    return [s for p in parts if p for s in ([x.strip() for x in re.split(r"[،,;؛]", p)] if len(p) > size else [p]) if s]


def rule_based(parts: list[str], text: str, size: int = 512, overlap: int = 64, tolerance: float = 0.05, strict: bool = True) -> list[str]:
    """Packs of sentences up to ``tolerance`` over ``size``; with ``strict``, what blanks make longer is cut between words."""
    most = int(size * (1 + tolerance))
    if not parts:
        return [text] if text.strip() else []
    packed = [" ".join(parts[a:b]) for a, b in _windows([len(p) for p in parts], most, overlap)]
    return [c for p in packed for c in (by_words_hard(p, size) if strict and len(p) > most else [p]) if c.strip()]


def by_similarity(parts: list[str], text: str, encode: Callable = hashed_vectors, size: int = 512, overlap: int = 64, tolerance: float = 0.05, threshold: float = 0.75) -> list[str]:
    """Rule-based packs that also end where a sentence is unlike the one before; a text of one sentence goes by rules alone."""
    if len(parts) < 2:
        return rule_based(parts, text, size, overlap, tolerance)
    most, like = int(size * (1 + tolerance)), neighbour_similarity(encode(parts))
    out, first, n = [], 0, len(parts[0])
    for i in range(1, len(parts)):
        if like[i - 1] < threshold or n + len(parts[i]) > most:
            out.append(" ".join(parts[first:i]))
            kept, first = 0, i
            while first > 0 and kept + len(parts[first - 1]) <= overlap:
                first -= 1
                kept += len(parts[first])
            n = kept
        n += len(parts[i])
    out.append(" ".join(parts[first:]))
    return [c for p in out for c in (by_words_hard(p, size) if len(p) > most else [p]) if c.strip()]


def smart_overlap(last: list[str], chunk: str, encode: Callable = hashed_vectors, overlap: int = 64, threshold: float = 0.75) -> list[str]:
    """Of a chunk's last five sentences those most like the chunk, best first, while they fit."""
    some = last[-5:]
    if not some:
        return []
    v = encode([chunk, *some])
    n = np.linalg.norm(v, axis=1)
    like = np.divide(v[1:] @ v[0], n[1:] * n[0], out=np.zeros(len(some)), where=n[1:] * n[0] > 0)
    best = [some[i] for i in np.argsort(-like, kind="stable") if like[i] >= threshold]
    fits = list(accumulate(map(len, best)))
    return [s for s, reach in zip(best, fits, strict=True) if reach <= overlap]


def contextual(text: str, size: int = 512, overlap: int = 64, window: int = 1, least: int = 20) -> list[str]:
    """Packs of sentences, each with ``window`` sentences on either side."""
    s = sentences(text, CONTEXT_SENTENCE_END)
    if not s:
        return []
    out = [" ".join(s[max(0, a - window) : b + window]).strip() for a, b in _windows([len(x) for x in s], size, overlap)]
    return [c for c in out if len(c) >= least]


def sections(text: str) -> list[Piece]:
    """Markdown's headings, fenced code and bodies; of other texts the paragraphs; of pages the visible text's."""
    if re.search(r"(?i)<(html|body|div|p|h[1-6]|ul|ol|li|table)[^>]*>", text):
        text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()
    elif re.search(r"(?m)^#{1,6}\s|```|\*\*.+?\*\*", text):
        return markdown(text)
    return [("body", None, p) for p in (x.strip() for x in re.split(r"\n{2,}", text)) if p]


def markdown(text: str) -> list[Piece]:
    out, heading = [], None
    for m in re.finditer(r"(?ms)^\s*```.*?(?:^\s*```[^\n]*$|\Z)|^#{1,6}\s+[^\n]*$|(?:(?!^\s*```|^#{1,6}\s).)+", text):
        piece = m.group().strip()
        if piece.startswith("```"):
            out.append(("code", heading, piece))
        elif re.match(r"#{1,6}\s", piece):
            heading = piece.lstrip("#").strip()
            out.append(("heading", heading, heading))
        elif piece:
            out.append(("body", heading, piece))
    return out


def join_small(pieces: list[Piece], least: int) -> list[Piece]:
    """Bodies that follow one another put together while the first or both are below ``least``; headings and code stand alone."""
    out: list[Piece] = []
    for kind, heading, text in pieces:
        last = out[-1] if out else None
        both = f"{last[2]} {text}".strip() if last else ""
        if kind == "body" and last and last[0] == "body" and (len(both) < least or len(last[2]) < least):
            out[-1] = (last[0], last[1], both)
        else:
            out.append((kind, heading, text))
    return out


def split_large(text: str, most: int) -> list[str]:
    """Sentences put together up to ``most`` characters, without the blanks between; a longer sentence stays whole."""
    if len(text) <= most:
        return [text]
    out = [""]
    for s in re.split(SENTENCE_END, text):
        if out[-1] and len(out[-1]) + len(s) > most:
            out.append(s)
        else:
            out[-1] = f"{out[-1]} {s}".strip()
    return [c.strip() for c in out if c.strip()]


def structural(text: str, most: int = 1500, least: int = 100) -> list[Piece]:
    """Sections: code whole, small bodies joined, large ones cut at sentences."""
    return [(k, h, c) for k, h, t in join_small(sections(text), least) for c in ([t] if k != "body" else split_large(t, most))]


def hybrid(text: str, size: int = 512, **how) -> list[Piece]:
    """Sections, and within those of more than one and a half times ``size`` chunks by meaning."""
    return [(k, h, c) for k, h, t in structural(text) for c in (semantic(t, **how) if len(t) > 1.5 * size else [t])]


def strategy_of(text: str) -> str:
    """The strategy whose signs a text shows most, the first of equals; general if it shows none."""
    hits = {name: sum(len(re.findall(p, text, re.I | re.M)) for p in signs) for name, signs in SIGNS.items()}
    hits = {n: hits[n] for n in ("faq", "documentation", "technical", "narrative")}
    best = max(hits, key=hits.__getitem__)
    return best if hits[best] else "general"


def strategy_for(text: str, queries: list[str] | None = None) -> str:
    """The strategy of sample questions by vote, unless that is general; else the text's own."""
    if queries:
        votes = [strategy_of(q) for q in queries]
        names = list(STRATEGIES)
        best = max(names, key=lambda n: (votes.count(n), -names.index(n)))
        if best != "general":
            return best
    return strategy_of(text)


def adaptive(text: str, least: int = 100, most: int = 1500) -> list[str]:
    """Sentences packed up to a size that falls as distinct words grow."""
    words = regex.findall(r"[\p{L}\p{N}_]+", text.lower())
    rich = len(set(words)) / max(1, len(words))
    target = max(least, min(most, int(most - rich * (most - least))))
    s = sentences(text)
    return [" ".join(s[a:b]) for a, b in _windows([len(x) for x in s], target, 0)] if s else []


MODES: dict[str, Callable[[str], list[Piece]]] = {
    "semantic": lambda t: [("semantic", None, c) for c in semantic(t)],
    "adaptive": lambda t: [("adaptive", None, c) for c in adaptive(t)],
    "structural": structural,
    "contextual": lambda t: [("contextual", None, c) for c in contextual(t)],
    "hybrid": hybrid,
    "arabic": lambda t: [("paragraph", None, c) for c in rule_based(arabic_sentences(t, 512), t)],
    "arabic_semantic": lambda t: [("semantic", None, c) for c in by_similarity(arabic_sentences(t, 512), t)],
}


def chunked(docs: DataFrame, mode: str | Callable[[str], list[Piece]] = "structural", queries: list[str] | None = None, id_col: str = "doc_id", text: str = "text", deduplicate: bool = True) -> DataFrame:
    """Chunks of every document by a mode, or by ``auto``: the strategy of the sample questions or of the text.

    With ``deduplicate`` a chunk that repeats an earlier one of its document,
    but for case and white space, goes. Positions and totals are of what stays.
    """
    cut = MODES.get(mode, mode) if isinstance(mode, str) else mode
    if mode != "auto" and not callable(cut):
        raise ValueError(f"unknown mode {mode}")

    def pieces(t: str | None) -> list[Piece]:
        if not t or not t.strip():
            return []
        found = (MODES[STRATEGIES[strategy_for(t, queries)][2]] if mode == "auto" else cut)(t)
        if deduplicate:
            first = {}
            for i, (_, _, c) in enumerate(found):
                first.setdefault(re.sub(r"\s+", " ", c).strip().lower(), i)
            found = [found[i] for i in sorted(first.values())]
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces(t) for t in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(p) for p in found])
            flat = [p for some in found for p in some]
            numbers = [(k, len(some)) for some in found for k in range(len(some))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array([n[i] for n in numbers], pa.int32()) for i in (0, 1)), *(pa.array([p[i] for p in flat], pa.string()) for i in (0, 1, 2))], names=[id_col, "pos", "total", "kind", "heading", "chunk"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, pos int, total int, kind string, heading string, chunk string")


def enriched(chunks: DataFrame) -> DataFrame:
    """Chunks with words, keyword density, length and position scores, and ``score``: 0.4, 0.2 and 0.3 of these and 0.1 for headings, 1 at most."""
    from corvane.functions import text as tx

    c = F.col("chunk")
    out = chunks.withColumns({"words": F.size(tx.words(c)), "density": tx.keyword_density(c), "length_score": tx.length_score(c), "position_score": tx.position_score(F.col("pos"), F.col("total"))})
    score = 0.4 * F.col("density") + 0.2 * F.col("length_score") + 0.3 * F.col("position_score") + F.when(F.col("kind") == "heading", 0.1).otherwise(0.0)
    return out.withColumn("score", F.round(F.least(F.lit(1.0), score), 6))
