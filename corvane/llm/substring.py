"""Removing passages that repeat, by fixed-block anchors.

Reference blocks are the non-overlapping runs of ten words of each document.
Any window of twenty words holds a whole block of its document, so if it repeats
anywhere, every copy holds the ten words of that block. First exchange: every
rolling window of ten words probes the index of blocks; those that meet a block
elsewhere are anchors. Second exchange: anchors are extended, that is, all
windows of twenty words that hold an anchor are compared, and each unit of
documents learns which of its windows start earlier elsewhere. Last, windows
that start earlier, elsewhere or in the unit, cover maximal repeats, and their
words go.

Windows are compared by 112 bits, put together from 128 bits of each word's
XXH3 hash by steps that are no sums of word hashes. Of 2e13 windows (100 TB) the
chance that any two unlike ones meet is below 1e-7.

A window's first place is that of the smallest id; nothing is paired, so a
passage in a third of all documents costs one entry for each unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import give_back, read
from corvane.llm.segments import U, Units, Words, find, message, pack, pack_sorted, slices, table_of, unpack, unpack_sorted

#: Leading bits of a ten-word window's hash that are exchanged. More bits would only spare needless candidates.
ANCHOR_BITS = 44
#: Further bits of a twenty-word window, beside 64.
MORE_BITS = 48
#: Bytes of text of a unit at most.
UNIT = 16 << 20
_MIN = np.iinfo(np.int64).min


def _member(sorted_values: np.ndarray, v: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(v), bool)
    return sorted_values[find(sorted_values, v)] == v


class _Unit:
    """A unit's rows as stored, slice by slice, and the windows of ``block`` and of ``window`` words in them."""

    def __init__(self, table: pa.Table, text: str, window: int):
        self.batches, self.window, self.block = list(slices(table)), window, window // 2
        self.words, self.low, self.high = [], [], []
        for batch in self.batches:
            w = Words(batch.column(text).to_pylist())
            code, low, high = w.hashes()
            self.words.append(w), self.low.append(low[code]), self.high.append(high[code])
        self.begins = np.cumsum([0, *(len(x) for x in self.low)])
        self.before = np.concatenate([[0], *(w.before[1:] + at for w, at in zip(self.words, self.begins, strict=False))])

    def __len__(self) -> int:
        return int(self.begins[-1])

    def blocks(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, exchanged hashes, and whether each is a reference block, of one slice."""
        w = self.words[part]
        first = w.inside(self.block)
        text = np.searchsorted(w.before, first, side="right") - 1
        return first + self.begins[part], w.windows(self.low[part], self.block)[first] >> U(64 - ANCHOR_BITS), (first - w.before[text]) % self.block == 0

    def wide(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, hashes and further bits."""
        out = []
        for part, w in enumerate(self.words):
            first = w.inside(self.window)
            out.append((first + self.begins[part], w.windows(self.low[part], self.window)[first], w.windows(self.high[part], self.window, 1)[first] >> U(64 - MORE_BITS)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def rows(self, first: np.ndarray) -> np.ndarray:
        """The row of each word."""
        return np.searchsorted(self.before, first, side="right") - 1

    def ids(self, id_col: str) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids, nulls as the least, and each row's place by id, those with equal ids as stored."""
        ids = np.concatenate([np.array(pa.compute.fill_null(b.column(id_col).cast(pa.int64()), _MIN), np.int64) for b in self.batches])
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        return ids, place


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, words: str = "__words", removed: str = "__removed") -> DataFrame:
    """``docs`` without repeated passages: ``text`` is the kept words joined by one space; columns ``words`` and ``removed`` count.

    A word goes if a window of ``window`` (even) words covers it whose sequence
    also starts earlier: in a row of smaller id, or earlier in the same row. A
    null id counts as smaller than any; rows that share an id are ordered as
    stored. A null or empty text has no words and becomes the empty text. An
    empty table gives an empty table. All other columns and all rows stay;
    columns named as the counts are replaced.
    """
    if window % 2:
        raise ValueError("a window is an even number of words")
    docs = docs.drop(*[c for c in (words, removed) if c not in (id_col, text)])
    units = Units(docs, text, UNIT)
    bits = units.bits
    sent_schema = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("v", pa.binary())])
    wide_schema = pa.schema([*sent_schema, ("more", pa.binary()), ("id", pa.binary()), ("least", pa.int64())])
    found_schema = pa.schema([("unit", pa.int64()), ("v", pa.binary()), ("more", pa.binary())])

    def probes(table: pa.Table) -> pa.Table:
        parts = []
        unit = _Unit(table, text, window)
        for part in range(len(unit.words)):
            _, h, fixed = unit.blocks(part)
            v = np.sort((h << U(1)) | fixed)
            key = v >> U(1)
            first = np.nonzero(np.diff(key, prepend=~key[:1]))[0]
            n = np.diff(np.append(first, len(key)))
            fixed_any = (v & U(1))[np.append(first[1:], len(key)) - 1] if len(key) else np.zeros(0, U)
            parts.append((key[first] << U(2)) | (fixed_any << U(1)) | (n > 1))
        v = np.sort(np.concatenate(parts))
        key = v >> U(2)
        first = np.nonzero(np.diff(key, prepend=~key[:1]))[0]
        if len(first):
            twice = np.bitwise_or.reduceat(v & U(1), first) | (np.diff(np.append(first, len(key))) > 1)
            v = (key[first] << U(2)) | np.bitwise_or.reduceat(v & U(2), first) | twice
        return table_of(message(table.column("unit")[0].as_py(), bits, v << U(62 - ANCHOR_BITS)), sent_schema)

    def anchors(table: pa.Table) -> pa.Table:
        units_, parts = table.column("unit").to_pylist(), [unpack_sorted(b) >> U(62 - ANCHOR_BITS) for b in table.column("v").to_pylist()]
        of, v = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts)
        order = np.argsort(v, kind="stable")
        of, v = of[order], v[order]
        key = v >> U(2)
        first = np.nonzero(np.diff(key, prepend=~key[:1]))[0]
        n = np.add.reduceat(1 + (v & U(1)).astype(np.int64), first)
        fixed = np.logical_or.reduceat((v & U(2)) > 0, first)
        hit = np.repeat((n > 1) & fixed, np.diff(np.append(first, len(v))))
        of, key = of[hit], key[hit]
        order = np.argsort(of, kind="stable")
        of, key = of[order], key[order]
        ends = np.searchsorted(of, np.arange(len(parts) + 1))
        return table_of([(units_[i], pack_sorted(key[a:b])) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a], pa.schema([("unit", pa.int64()), ("v", pa.binary())]))

    hits = units.grouped().applyInArrow(probes, "bucket int, unit long, v binary").groupBy("bucket").applyInArrow(anchors, "unit long, v binary")

    def extended(table: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not table.num_rows:
            return wide_schema.empty_table()
        unit = _Unit(table, text, window)
        anchor = np.sort(np.concatenate([unpack_sorted(b) for b in found.column("v").to_pylist()]))
        hit = np.zeros(len(unit) + 1, np.int64)
        for part in range(len(unit.words)):
            first, h, _ = unit.blocks(part)
            hit[1 + first[_member(anchor << U(64 - ANCHOR_BITS), h << U(64 - ANCHOR_BITS))]] = 1
        hit = np.cumsum(hit)
        first, h, more = unit.wide()
        some = hit[first + unit.window - unit.block + 1] > hit[first]
        first, h, more = first[some], h[some], more[some]
        ids, place = unit.ids(id_col)
        order = np.lexsort((first, place[unit.rows(first)], more, h))
        first, h, more = first[order], h[order], more[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
        first, h, more = first[new], h[new], more[new]
        owner = ids[unit.rows(first)]
        least = int(owner.min()) if len(owner) else 0
        return table_of([(*r, least) for r in message(table.column("unit")[0].as_py(), bits, h, more, owner.astype(U) - np.array(least).astype(U))], wide_schema)

    def earlier(table: pa.Table) -> pa.Table:
        v = [unpack_sorted(b) for b in table.column("v").to_pylist()]
        more = np.concatenate([unpack(b) for b in table.column("more").to_pylist()])
        ids = np.concatenate([(unpack(b) + np.array(least).astype(U)).astype(np.int64) for b, least in zip(table.column("id").to_pylist(), table.column("least").to_pylist(), strict=True)])
        of, h = np.repeat(np.array(table.column("unit"), np.int64), [len(x) for x in v]), np.concatenate(v)
        order = np.lexsort((of, ids, more, h))
        of, h, more = of[order], h[order], more[order]
        later = np.zeros(len(h), bool)
        later[1:] = (h[1:] == h[:-1]) & (more[1:] == more[:-1])
        of, h, more = of[later], h[later], more[later]
        order = np.argsort(of, kind="stable")
        of, h, more = of[order], h[order], more[order]
        cuts = np.nonzero(np.diff(of, prepend=-1))[0]
        return table_of([(int(of[a]), pack_sorted(h[a:b]), pack(more[a:b])) for a, b in zip(cuts, [*cuts[1:], len(of)], strict=False)], found_schema)

    answers = units.grouped().cogroup(units.answers(hits)).applyInArrow(extended, "bucket int, unit long, v binary, more binary, id binary, least long").groupBy("bucket").applyInArrow(earlier, "unit long, v binary, more binary")
    fields = [T.StructField(text, T.StringType()) if f.name == text else f for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(words, T.LongType()), T.StructField(removed, T.LongType())])

    def cleaned(table: pa.Table, found: pa.Table) -> pa.Table:
        unit = _Unit(table, text, window)
        _, place = unit.ids(id_col)
        first, h, more = unit.wide()
        order = np.argsort(place[unit.rows(first)], kind="stable")
        first, h, more = first[order], h[order], more[order]
        gone = np.zeros(len(h), bool)
        if found.num_rows:
            v, m = np.concatenate([unpack_sorted(b) for b in found.column("v").to_pylist()]), np.concatenate([unpack(b) for b in found.column("more").to_pylist()])
            order = np.lexsort((m, v))
            v, m = v[order], m[order]
            at = find(v, h)
            gone = (v[at] == h) & (m[at] == more)
            # Of two windows with one 64-bit hash, which differ in the further bits, the second stands next.
            twice = np.nonzero((v[at] == h) & ~gone)[0]
            while len(twice):
                at[twice] += 1
                twice = twice[at[twice] < len(v)]
                twice = twice[v[at[twice]] == h[twice]]
                gone[twice[m[at[twice]] == more[twice]]] = True
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h), bool)
        same[1:] = h[order[1:]] == h[order[:-1]]
        if (same[1:] & (more[order[1:]] != more[order[:-1]])).any():
            order = np.lexsort((np.arange(len(h)), more, h))
            same[1:] = (h[order[1:]] == h[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
        gone[order[same]] = True
        cover = np.zeros(len(unit) + 1, np.int64)
        np.add.at(cover, first[gone], 1)
        np.subtract.at(cover, first[gone] + window, 1)
        keep = np.cumsum(cover[:-1]) == 0
        left = np.diff(np.concatenate([[0], np.cumsum(keep)])[unit.before])
        n_words = np.diff(unit.before)
        kept = [x for w, at in zip(unit.words, unit.begins, strict=False) for x in w.kept(keep[at : at + len(w.start)])]
        rows = pa.Table.from_batches(unit.batches)
        del unit, h, more, order, same
        give_back()
        rows = rows.set_column(rows.column_names.index(text), text, pa.array(kept, pa.string()))
        return rows.append_column(words, pa.array(n_words, pa.int64())).append_column(removed, pa.array(n_words - left, pa.int64()))

    return units.grouped().cogroup(units.answers(answers)).applyInArrow(cleaned, schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", F.col("__words").alias("n_words"), F.col("__removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS gone FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM g WHERE gone),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, j) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
