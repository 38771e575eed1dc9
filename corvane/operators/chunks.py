"""Documents into chunks: one row of a document becomes its numbered chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.folds import pack, word_windows

SEPARATORS = ["\n\n", "\n", ".", "؟", "!", "،", "؛", " ", ""]


def numbered(docs: DataFrame, parts: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, total, chunk): explodes an array of chunks and numbers them from 0."""
    cut = docs.select(id_col, parts.alias("__parts"))
    return cut.select(id_col, F.size("__parts").alias("total"), F.posexplode("__parts").alias("pos", "chunk")).select(id_col, "pos", "total", "chunk")


def by_sentence(docs: DataFrame, size: int = 512, overlap: int = 0, text: str = "text") -> DataFrame:
    return numbered(docs, pack(tx.sentences(F.col(text)), size, overlap))


def by_separator(docs: DataFrame, separator: str = "\n", size: int = 1000, overlap: int = 200, text: str = "text") -> DataFrame:
    return numbered(docs, pack(F.split(F.col(text), f"\\Q{separator}\\E"), size, overlap, separator))


def by_words(docs: DataFrame, size: int = 200, overlap: int = 20, text: str = "text") -> DataFrame:
    return numbered(docs, word_windows(tx.words(F.col(text)), size, overlap))


def by_delimiter(docs: DataFrame, size: int = 512, overlap: int = 0, text: str = "text") -> DataFrame:
    """Arabic-aware: normalised text, pieces between closing marks, packs up to 5 % over ``size``."""
    return numbered(docs, pack(tx.delimited_sentences(F.col(text)), int(size * 1.05), overlap))


def adaptive(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sentences packed up to a size that the document's information density sets."""
    cut = docs.select("doc_id", tx.sentences(F.col(text)).alias("s"), tx.adaptive_target(tx.density(F.col(text))).alias("target"))
    long = cut.select("doc_id", "target", F.posexplode("s").alias("i", "sentence"))
    before = F.sum(F.length("sentence")).over(Window.partitionBy("doc_id").orderBy("i"))
    group = long.withColumn("g", F.floor((before - 1) / F.col("target")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ")
    packed = group.groupBy("doc_id", "g").agg(F.min("i").alias("i"), joined.alias("chunk"))
    return packed.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).alias("pos"), "chunk")


def with_window(docs: DataFrame, window: int = 2, text: str = "text") -> DataFrame:
    """Each sentence with its neighbours up to ``window`` away on either side."""
    s = tx.sentences(F.col(text))
    cut = docs.select("doc_id", s.alias("s")).select("doc_id", "s", F.posexplode("s").alias("pos", "core"))
    first = F.greatest(F.col("pos") - window, F.lit(0))
    last = F.least(F.col("pos") + window, F.size("s") - 1)
    return cut.select("doc_id", "pos", "core", F.array_join(F.slice("s", first + 1, last - first + 1), " ").alias("chunk"))


def _windows(lengths: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first, end) of packs of neighbouring pieces: as many as fit ``size``, one at least, each pack from where the last one's ``overlap`` begins."""
    reach = [0, *accumulate(lengths)]
    first, least = 0, 1
    while True:
        end = max(least, bisect_right(reach, reach[first] + size) - 1)
        yield first, end
        if end >= len(lengths):
            return
        first, least = bisect_left(reach, reach[end] - overlap, first, end), end + 1


def split_recursive(text: str, size: int, overlap: int, marks: list[str]) -> list[str]:
    """Chunks of a text: split at the first separator that it holds; runs of pieces shorter than ``size`` are packed, each other piece is split by the separators left.

    Pieces wait on a stack, the next one in document order on top, beside the
    separators that are still to be tried on them.
    """
    out, todo = [], [(text, list(marks))]
    while todo:
        piece, left = todo.pop()
        if isinstance(left, str):  # a run of short pieces and what joins them
            out += [left.join(piece[a:b]) for a, b in _windows([len(p) for p in piece], size, overlap)]
            continue
        mark = next((m for m in left if m in piece), left[-1])
        parts = piece.split(mark) if mark else list(piece)
        rest = [m for m in left if m != mark] or [""]
        runs = [(list(g), mark) if short else [(p, rest) for p in g] for short, g in groupby(parts, lambda p: len(p) < max(size, 2))]
        flat = [x for r in runs for x in (r if isinstance(r, list) else [r])]
        todo += flat[::-1]
    return [c for c in out if c.strip()]


def recursive(docs: DataFrame, size: int = 1000, overlap: int = 200, separators: list[str] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, chunk): each text's chunks by ``split_recursive``; null and empty texts have none."""
    marks = separators or SEPARATORS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [split_recursive(t, size, overlap, marks) if t else [] for t in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array([k for c in cut for k in range(len(c))], pa.int32()), pa.array([x for c in cut for x in c], pa.string())], names=[id_col, "pos", "chunk"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, pos int, chunk string")


def markdown_sections(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, kind, heading, section): headings, fenced code and bodies in order."""

    def sections(t: str) -> Iterator[tuple[str, str | None, str]]:
        heading, body, code = None, [], None

        def flush() -> Iterator[tuple[str, str | None, str]]:
            joined = "\n".join(body).strip()
            body.clear()
            if joined:
                yield "body", heading, joined

        for line in t.split("\n"):
            if code is not None:
                code.append(line)
                if line.lstrip().startswith("```"):
                    yield "code", heading, "\n".join(code)
                    code = None
            elif line.lstrip().startswith("```"):
                yield from flush()
                code = [line]
            elif line.startswith("#") and line.lstrip("#")[:1].isspace() and len(line) - len(line.lstrip("#")) <= 6:
                yield from flush()
                heading = line.lstrip("#").strip()
                yield "heading", heading, heading
            else:
                body.append(line)
        if code is not None:
            yield "code", heading, "\n".join(code)
        yield from flush()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(sections(t)) if t else [] for t in batch.column(1).to_pylist()]
            of = [i for i, p in enumerate(found) for _ in p]
            flat = [x for p in found for x in p]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array([k for p in found for k in range(len(p))], pa.int32()), *(pa.array([x[j] for x in flat], pa.string()) for j in range(3))], names=[id_col, "pos", "kind", "heading", "section"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, pos int, kind string, heading string, section string")


def sentence_similarity(docs: DataFrame, text: str = "text", buckets: int = 256) -> DataFrame:
    """(doc_id, pos, similarity) of each sentence to the one before, as cosine of hashed word counts; sentences without words take no part.

    Neighbours stand in one row, so nothing is shuffled: words come as arrays
    from the JVM, and a batch's counts are rows of one sparse table.
    """
    from hashlib import md5

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                per_doc = np.diff(batch.column(1).offsets.to_numpy())
                parts = batch.column(1).flatten()
                per_part, words = np.diff(parts.offsets.to_numpy()), parts.flatten().dictionary_encode()
                bucket = np.array([int(md5(w.encode()).hexdigest()[:7], 16) % buckets for w in words.dictionary.to_pylist()], np.int64)
                counts = np.bincount(np.repeat(np.arange(len(per_part)), per_part) * buckets + bucket[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64), minlength=len(per_part) * buckets).reshape(-1, buckets).astype(np.float64)
                doc, norm = np.repeat(np.arange(len(per_doc)), per_doc), np.sqrt((counts**2).sum(1))
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                here = np.nonzero((doc[1:] == doc[:-1]) & (norm[1:] > 0) & (norm[:-1] > 0))[0] + 1
                like = (counts[here] * counts[here - 1]).sum(1) / (norm[here] * norm[here - 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[here])), pa.array(pos[here], pa.int32()), pa.array(np.round(like, 6))], names=["doc_id", "pos", "similarity"])

    words = F.transform(tx.sentences(F.col(text)), tx.tokens)
    return docs.where(F.col(text).isNotNull()).select("doc_id", words.alias("w")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int, similarity double")
