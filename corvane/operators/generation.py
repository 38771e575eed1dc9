"""Calls of a language model over rows: messages, batches, retries, streamed pieces, and answers that are read, mended or replaced.

The model is a function that the caller gives; nothing here reaches a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import fixing as fx
from corvane.functions import text as tx
from corvane.operators import parsed


def chat(system: Column, prompt: Column) -> Column:
    """The messages of one call: the system's, unless it is blank, and the user's."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.when(F.coalesce(tx.strip(system), F.lit("")) == "", F.array(said("user", prompt))).otherwise(F.array(said("system", system), said("user", prompt)))


def generated(requests: DataFrame, call: Callable[[list[list[dict]]], list[str]], messages: str = "messages", answer: str = "answer", error: str = "error", batch: int = 16, tries: int = 3, wait: float = 0.0, per_second: float | None = None) -> DataFrame:
    """``requests`` with ``answer`` and ``error``, one of which is null.

    ``call`` gets the messages of at most ``batch`` rows. A call that raises is
    made again, after waits that double; a batch that fails to the end is called
    row by row, so that one bad row costs no other its answer. ``per_second``
    bounds the rows that a task sends in a second. A null in ``messages`` gets an
    error and no call.
    """
    kept = [f for f in requests.schema.fields if f.name not in (answer, error)]
    names = [f.name for f in kept]
    at = names.index(messages)

    def tried(some: list[list[dict]]) -> list[str]:
        for n in range(tries):
            try:
                return call(some)
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError

    def each(some: list[list[dict]]) -> list[tuple[str | None, str | None]]:
        try:
            return [(a, None) for a in tried(some)]
        except Exception as e:  # noqa: BLE001  a model's failure is a result
            if len(some) == 1:
                return [(None, f"{type(e).__name__}: {e}"[:300])]
        return [r for m in some for r in each([m])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = 0.0
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                b = whole.slice(a, batch)
                asked = b.column(at).to_pylist()
                full = [i for i, m in enumerate(asked) if m is not None]
                if per_second:
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = max(free, time.monotonic()) + len(full) / per_second
                out: list = [(None, "no messages")] * len(asked)
                for i, r in zip(full, each([asked[i] for i in full]) if full else [], strict=True):
                    out[i] = r
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=[*names, answer, error])

    return requests.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField(answer, T.StringType()), T.StructField(error, T.StringType())]))


def streamed(answers: DataFrame, id_col: str, answer: str = "answer") -> DataFrame:
    """(id, pos, piece): an answer in the pieces that a stream gives, words with the blank before them, in order."""
    return answers.select(id_col, F.posexplode(F.regexp_extract_all(answer, F.lit(r"\s*\S+|\s+$"), F.lit(0))).alias("pos", "piece"))


def parsed_or(outputs: DataFrame, default: str = "{}", text: str = "output", query: str | None = None) -> DataFrame:
    """``outputs`` with ``parsed`` (JSON) and ``how``: read as it is, mended, or a fallback that carries the raw text and the question.

    The readers are tried first, then the repairs and the readers again, so a
    text is given up only after both.
    """
    kept = [f for f in outputs.schema.fields if f.name not in ("parsed", "how")]
    names = [f.name for f in kept]

    def one(raw: str | None, asked: str | None) -> tuple[str, str]:
        for value, how in ((raw, "read"), (fx.repaired(raw)[0], "mended")):
            try:
                if value and value.strip():
                    return json.dumps(parsed.from_json(value), ensure_ascii=False), how
            except ValueError:
                continue
        lost = {"answer": raw.strip() if raw and raw.strip() else "Unable to parse response", "sources": [], "confidence": 0.0, "_parse_error": True, "_raw": (raw or "")[:500], "_query": (asked or "")[:200]}
        return (json.dumps({**json.loads(default), **lost}, ensure_ascii=False), "fallback")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(names.index(query)).to_pylist() if query else [None] * b.num_rows
            out = [one(x, q) for x, q in zip(b.column(names.index(text)).to_pylist(), asked, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([o[i] for o in out], pa.string()) for i in (0, 1))], names=[*names, "parsed", "how"])

    return outputs.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField("parsed", T.StringType()), T.StructField("how", T.StringType())]))


def cast_to(parsed_json: Column, schema: str) -> Column:
    """Parsed JSON as a struct of a DDL schema; null where a value doesn't fit its type or the whole isn't an object."""
    return F.from_json(parsed_json, schema)


def answer_schema(c: Column) -> Column:
    """struct(answer, sources, confidence) of an answer's JSON: sources without blanks, confidence within 0 and 1."""
    s = F.from_json(c, "answer string, sources array<string>, confidence string")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(s["confidence"].try_cast("double"), F.lit(1.0))))
    sources = F.filter(F.coalesce(s["sources"], F.expr("cast(array() as array<string>)")), lambda x: tx.strip(x) != "")
    return F.when(s["answer"].isNotNull(), F.struct(tx.strip(s["answer"]).alias("answer"), sources.alias("sources"), sure.alias("confidence")))


def retry_prompt(question: Column, output: Column, problem: Column) -> Column:
    """What a model is asked when its output could not be used."""
    return F.concat_ws("\n\n", F.concat(F.lit("The last answer could not be used: "), problem), F.concat(F.lit("It was:\n"), F.substring(output, 1, 500)), F.concat(F.lit("Answer again, in the asked format only:\n"), question))
