"""Model output into JSON where patterns are not enough: fenced or buried JSON, YAML, CSV, tables, XML."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _fenced(text: str, names: str) -> str:
    found = re.search(rf"```(?:{names})?\s*\n?([\s\S]*?)```", text, re.IGNORECASE)
    return (found.group(1) if found else text).strip()


def from_json(text: str) -> object:
    """The fenced block or the whole text, else the first object or list that can be read from where it begins."""
    inner = _fenced(text, "json")
    for begin in [0, *(m.start() for m in re.finditer(r"[{\[]", inner))]:
        try:
            value, _ = json.JSONDecoder().raw_decode(inner[begin:])
        except ValueError:
            continue
        return value
    raise ValueError("no JSON")


def from_yaml(text: str) -> object:
    import yaml

    value = yaml.safe_load(_fenced(text, "yaml|yml"))
    if value is None:
        raise ValueError("no YAML")
    return value


def from_csv(text: str) -> object:
    rows = list(csv.DictReader(io.StringIO(_fenced(text, "csv"))))
    if not rows:
        raise ValueError("no rows")
    return [{k.strip(): (v or "").strip() for k, v in r.items() if k} for r in rows]


def from_table(text: str) -> object:
    """A pipe table's rows; those of fewer cells than the header go."""
    lines = [x for x in text.splitlines() if "|" in x]
    if len(lines) < 2:
        raise ValueError("no table")
    cells = lambda x: [c.strip() for c in x.split("|") if c.strip()]
    head = cells(lines[0])
    rows = [cells(x) for x in lines[1:] if not re.fullmatch(r"\s*\|?[-| :]+\|?\s*", x)]
    return [dict(zip(head, r, strict=False)) for r in rows if len(r) >= len(head)]


def from_xml(text: str) -> object:
    """Values by tag; of a repeated tag the last counts."""
    found = {m["tag"]: m["value"].strip() for m in re.finditer(r"<(?P<tag>[a-zA-Z][\w\-]*)>(?P<value>.*?)</(?P=tag)>", text, re.DOTALL)}
    if not found:
        raise ValueError("no tags")
    return found


READERS: dict[str, Callable[[str], object]] = {"json": from_json, "yaml": from_yaml, "csv": from_csv, "markdown_table": from_table, "xml": from_xml}


def parse(outputs: DataFrame, text: str = "output", format: str | None = None, parsed: str = "parsed", error: str = "error") -> DataFrame:
    """``outputs`` with ``parsed``, JSON text, and ``error``; exactly one of them is null.

    ``format`` names a column with a reader's name; without one, or for a name
    without a reader, readers are tried in order and the first that succeeds
    counts, else the text itself is the answer.
    """
    kept = [f for f in outputs.schema.fields if f.name not in (parsed, error)]
    names = [f.name for f in kept]

    def one(value: str | None, kind: str | None) -> tuple[str | None, str | None]:
        if value is None or not value.strip():
            return None, "empty"
        for reader in [READERS[kind]] if kind in READERS else [from_json, from_table, from_xml]:
            try:
                return json.dumps(reader(value), ensure_ascii=False, default=str), None
            except Exception as e:  # noqa: BLE001  a reader's failure is a result
                said = str(e)
        return (None, said) if kind in READERS else (json.dumps({"answer": value.strip()}, ensure_ascii=False), None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(names.index(format)).to_pylist() if format else [None] * b.num_rows
            found = [one(v, k) for v, k in zip(b.column(names.index(text)).to_pylist(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=[*names, parsed, error])

    from pyspark.sql import types as T

    return outputs.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField(parsed, T.StringType()), T.StructField(error, T.StringType())]))
