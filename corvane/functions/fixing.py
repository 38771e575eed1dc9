"""Mending and reading model output: further format scores, delimiters, fields, a cascade of repairs, defaults."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import parsing as px
from corvane.functions import text as tx
from corvane.functions.let import let

# Delimiters in order of trial, and what a pair of tags looks like.
DELIMITERS = [",", ";", "\t", "|"]
TAGS = r"<([a-zA-Z][\w\-]*)>[\s\S]*?</[a-zA-Z][\w\-]*>"


def csv_score(c: Column) -> Column:
    """0.5 and up to 0.3 for the first delimiter of the header that three of four of the next lines hold about as often; 0 without one, and for null."""
    lines = F.filter(F.split(tx.strip(c), r"\r?\n"), lambda x: tx.strip(x) != "")

    def of(ls: Column) -> Column:
        out = F.when(F.size(ls) < 2, 0.0)
        for d in DELIMITERS:
            many = lambda x, d=d: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))
            seen = F.slice(ls, 2, 4)
            even = F.size(F.filter(seen, lambda x, d=d: F.abs(many(x) - many(ls[0])) <= 1))
            ratio = even / F.least(F.lit(4), F.size(ls) - 1)
            out = out.when((many(ls[0]) >= 1) & (ratio >= 0.75), F.round(0.5 + 0.3 * ratio, 6))
        return out.otherwise(0.0)

    return let(lines, of)


def xml_score(c: Column) -> Column:
    return F.when(tx.count(c, TAGS) >= 2, 0.88).when(c.rlike(r"<\w+\s*/?>"), 0.35).otherwise(0.0)


def delimiter(c: Column) -> Column:
    """The delimiter that the first line holds most, the first of equals; a comma if it holds none."""
    line = F.split(c, "\n")[0]
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most, out = F.greatest(*counts), None
    for d, n in zip(DELIMITERS, counts, strict=True):
        out = F.when(n == most, d) if out is None else out.when(n == most, d)
    return F.when(most == 0, ",").otherwise(out)


def field_value(c: Column, names: list[str]) -> Column:
    """The value of a field under the first of its names that is there: in tags, after a bold name, after ``name:`` or ``name =``."""
    found = []
    for name in names:
        n = re.escape(name)
        found += [(rf"(?is)<{n}>\s*(.*?)\s*</{n}>", c), (rf"(?is)\*\*{n}\*\*\s*[:\-=]\s*(.+?)(?=\n\s*\*\*|\z)", c), (rf"(?im)^{n}\s*:[ \t]*(\S[^\n]*)$", c), (rf"(?im)^{n}\s*=[ \t]*(\S[^\n]*)$", c)]
    values = [F.nullif(tx.collapse(tx.strip(F.regexp_extract(col, p, 1))), F.lit("")) for p, col in found]
    return F.coalesce(*values)


def typed(c: Column, kind: str) -> Column:
    """Text as int, float, bool or list, in JSON; null if it can't be read so."""
    if kind == "list":
        return F.to_json(px.to_list(c))
    return {"str": tx.strip(c), "int": px.to_int(c).cast("string"), "float": px.to_float(c).cast("string"), "bool": px.to_bool(c).cast("string")}[kind]


def valid_prefix(text: str) -> str | None:
    """The JSON value that begins at the first brace or bracket, without what trails it; cut-off values are closed after their last whole member."""
    begin = re.search(r"[{\[]", text)
    if not begin:
        return None
    rest = text[begin.start() :]
    try:
        return rest[: json.JSONDecoder().raw_decode(rest)[1]]
    except ValueError:
        return None


def repaired(text: str | None) -> tuple[str | None, str]:
    """(text, how): JSON as it is, with commas, quotes and keys mended, cut at its end, or made from ``key: value`` lines; else the text, and none."""
    if not text or not text.strip():
        return text, "none"
    bare = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```\w*\s*", "", text)).strip()
    mended = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', re.sub(r",\s*([}\]])", r"\1", bare))
    for candidate in (bare, mended, mended.replace("'", '"')):
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate, "regex"
    for candidate in (mended, mended.replace("'", '"')):
        if (cut := valid_prefix(candidate)) is not None:
            return cut, "regex"
    pairs = {k.strip().lower().replace(" ", "_"): v.strip() for k, v in re.findall(r"(?m)^\s*\*{0,2}([A-Za-z_][\w ]*?)\*{0,2}\s*[:=]\s*(.+?)\s*$", text)}
    return (json.dumps(pairs, ensure_ascii=False), "fallback") if pairs else (text, "none")


def with_defaults(parsed: Column, defaults: dict[str, str | None]) -> Column:
    """A string map with the missing or null fields of ``defaults`` filled in."""
    held = F.coalesce(parsed, F.expr("cast(map() as map<string,string>)"))
    given = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v).cast("string"))]) if defaults else F.expr("cast(map() as map<string,string>)")
    return F.map_concat(F.map_filter(given, lambda k, v: F.element_at(held, k).isNull()), F.map_filter(held, lambda k, v: ~F.map_contains_key(given, k) | v.isNotNull()))
