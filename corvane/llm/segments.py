"""Corpus statistics that a task needs about its own text, without a row for each position.

Documents are written once, as stored, in files of record batches of a few MB
(slices); no later pass shuffles text. Neighbouring slices form a unit, which
one task reads slice by slice. A unit reduces its positions to sorted distinct
64-bit values, cuts them by their leading bits into messages of packed
differences (3 to 6 bytes a value), and gets back an answer for each of its
values. A value that fills a third of the corpus is one entry for each unit, so
no key is hot. The number of buckets goes by the bytes of text, so a bucket does
not grow with the corpus; a unit sends one message to a bucket at most, as a
task of any shuffle does.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import give_back, new_path, open_path, written

#: Bytes of text of a slice, of a unit at most, and of text whose messages make a bucket.
SLICE_BYTES, UNIT_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20, 8 << 20
#: Bytes of text of a file of slices, beyond which a task begins the next one.
FILE_BYTES = 256 << 20
U = np.uint64


class Units:
    """Documents as written slices: ``manifest`` (unit, path, slice), one row for each slice.

    A slice is at least one text, so a text is never cut; what a pass holds of
    it is some fifty bytes for each of its bytes.
    """

    def __init__(self, docs: DataFrame, text: str, most: int = UNIT_BYTES):
        spark, self.schema, at = docs.sparkSession, docs.schema, docs.columns.index(text)
        path = new_path(spark, "slices")
        fs, place = open_path(path)
        fs.create_dir(place, recursive=True)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context, done, sink, out = TaskContext.get(), 0, None, []
            begun = n = 0
            for batch in batches:
                size = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0), np.int64)
                piece = (np.cumsum(size) - size) // SLICE_BYTES
                for p in np.unique(piece):
                    rows = np.nonzero(piece == p)[0]
                    if sink is None or done - begun >= FILE_BYTES:
                        if sink:
                            sink.close()
                        begun, n, name = done, 0, f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow"
                        fs, file = open_path(name)
                        sink = pa.ipc.new_file(fs.open_output_stream(file), batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    sink.write_batch(batch.slice(rows[0], len(rows)))
                    mine = int(size[rows].sum())
                    out.append((context.partitionId(), done, mine, name, n))
                    done, n = done + mine, n + 1
            if sink:
                sink.close()
            give_back()
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["part", "before", "size", "path", "slice"])

        slices = written(docs.mapInArrow(run, "part long, before long, size long, path string, slice int"), "slices")
        self.bytes = slices.agg(F.sum("size")).first()[0] or 0
        # Units of a size that gives every core work on little text too.
        unit = max(SLICE_BYTES, min(most, self.bytes // (2 * spark.sparkContext.defaultParallelism)))
        number = F.shiftleft("part", 32) + F.floor(F.col("before") / unit).cast("long")
        self.manifest = slices.select(number.alias("unit"), "path", "slice")
        self.tasks = int(max(8, min(1 << 15, 4 * self.bytes // unit)))

    def grouped(self):
        """The manifest by unit. The number of tasks is fixed: manifests are small, and units would be put together by their size."""
        return self.manifest.repartition(self.tasks, "unit").groupBy("unit")

    def answers(self, df: DataFrame):
        """What units get back, by the column ``unit``, dealt as they are."""
        return df.repartition(self.tasks, "unit").groupBy("unit")

    @property
    def bits(self) -> int:
        """Leading bits that choose a message's bucket."""
        return max(3, min(24, (self.bytes // BUCKET_BYTES).bit_length()))


def slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The slices that rows (path, slice) of a manifest name, in order."""
    rows, name, file = sorted(zip(table.column("path").to_pylist(), table.column("slice").to_pylist(), strict=True)), None, None
    for path, n in rows:
        if path != name:
            fs, place = open_path(path)
            name, file = path, pa.ipc.open_file(fs.open_input_file(place))
        yield file.get_batch(n)


def _planes(v: np.ndarray) -> bytes:
    """Unsigned integers by byte plane, each plane compressed."""
    v = np.ascontiguousarray(v, "<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    raw = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return struct.pack("<IB", len(v), width) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unplanes(b: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", b)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[5:], max_output_size=n * width), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def pack(v: np.ndarray) -> bytes:
    """Any unsigned integers."""
    return _planes(v)


unpack = _unplanes


def pack_sorted(v: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    first = int(v[0]) if len(v) else 0
    return struct.pack("<Q", first) + _planes(np.diff(v, prepend=v[:1]))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b[8:]), dtype=U) + U(struct.unpack_from("<Q", b)[0])


def cut(v: np.ndarray, bits: int, width: int = 64) -> list[tuple[int, slice]]:
    """The stretches of ascending values of ``width`` bits that share their leading ``bits``."""
    at = np.searchsorted(v, np.arange(1 << bits, dtype=U) << U(width - bits))
    ends = [*at[1:].tolist(), len(v)]
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(at.tolist(), ends, strict=True)) if b > a]


def find(sorted_values: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of ``v`` in ascending values that are spread evenly over 64 bits; those absent get any position."""
    if not len(sorted_values):
        return np.zeros(len(v), np.int64)
    bits = max(1, len(sorted_values).bit_length())
    first = np.searchsorted(sorted_values, np.arange(1 << bits, dtype=U) << U(64 - bits)).astype(np.int64)
    at = first[(v >> U(64 - bits)).astype(np.int64)]
    last = len(sorted_values) - 1
    np.minimum(at, last, out=at)
    todo = np.nonzero(sorted_values[at] < v)[0]
    while len(todo):
        at[todo] += 1
        todo = todo[at[todo] <= last]
        todo = todo[sorted_values[at[todo]] < v[todo]]
    return np.minimum(at, last)


def mixed(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    v = (v ^ (v >> U(30))) * U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> U(27))) * U(0x94D049BB133111EB)
    return v ^ (v >> U(31))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_STEP, _WORD_STEP = 0x5851F42D4C957F2D, 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Hashes of values[start:end], the same wherever a run stands."""
    power = _powers(step, len(values))
    total = np.concatenate([np.zeros(1, U), np.cumsum(values * power, dtype=U)])
    back = _powers(pow(step, -1, 1 << 64), len(values) + 1)
    return (total[ends] - total[starts]) * back[starts]


def _same_bytes(data: np.ndarray, blank: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word (from ``start``) equals the word of its length that begins at ``other``. Words are all that is not blank."""
    spots = np.nonzero(~blank)[0]
    off = data[spots] != data[spots + np.repeat(other - start, length)]
    if not off.any():
        return np.ones(len(start), bool)
    return np.add.reduceat(off, np.cumsum(length) - length) == 0


def _stir(a: np.ndarray, b: np.ndarray, times: int, more: int) -> np.ndarray:
    """A hash of pairs of hashes, for either one a bijection of the other."""
    x = a * U(times) + b
    x ^= x >> U(32)
    x *= U(more)
    x ^= x >> U(29)
    return x


class Words:
    """The words of some texts as arrays: a text's words follow one another, texts in the order given."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode() for t in texts]
        self.bytes = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        if lower:
            self.bytes = _LOWER[self.bytes]
        length = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.text_end = np.cumsum(length)  # after the line feed that closes each text
        self.blank = _BLANK[self.bytes]
        edge = np.diff(self.blank.astype(np.int8), prepend=np.int8(1))
        self.start, self.end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        self.before = np.concatenate([[0], np.searchsorted(self.start, self.text_end)])  # words before each text, and in all
        self.count = np.diff(self.before)

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, low, high): the number of each word among the distinct ones, and 64 bits each of the hashes of these.

        Words are sorted out by a sum of their bytes that is quick to get, and
        each is held byte by byte against the first one of its number; where two
        words share a sum all are sorted out by their bytes instead. The hashes
        are XXH3's 128 bits of the bytes of each distinct word.
        """
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        length, data = self.end - self.start, self.bytes.tobytes()
        code, sums = pd.factorize(mixed(_runs(_VALUE[self.bytes], self.start, self.end, _STEP) + length.astype(U)))
        first = np.empty(len(sums), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        like = first[code]
        if not ((length == length[like]).all() and _same_bytes(self.bytes, self.blank, self.start, length, self.start[like]).all()):
            code, _ = pd.factorize(np.array([data[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)], object))
            first = np.empty(int(code.max()) + 1, np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        digest = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(self.start[first].tolist(), self.end[first].tolist(), strict=True)])
        both = np.frombuffer(digest, "<u8").reshape(-1, 2)
        return code.astype(np.int64), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def windows(self, lane: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
        """64-bit hashes of the ``length`` words from each word on; those that run past their text's end mean nothing.

        Runs of 1, 2, 4, ... words are put together from two halves, and a
        window from the runs that its length is the sum of, so that no sum or
        product of word hashes stands for a window.
        """
        out, run, size, done = None, lane, 1, 0
        while True:
            if length & size:
                out = run if out is None else _stir(out[: len(run) - done] if len(run) > done else out[:0], run[done:], _STEP + 2 * salt, _WORD_STEP)
                done += size
            if done == length:
                whole = np.zeros(len(lane), U)
                whole[: len(out)] = out
                return mixed(whole)
            run = _stir(run[:-size], run[size:], _WORD_STEP + 2 * salt, _STEP) if len(run) > size else run[:0]
            size *= 2

    def inside(self, length: int) -> np.ndarray:
        """The first words of all windows of ``length`` words inside one text."""
        return np.nonzero(np.repeat(self.before[1:], self.count) - np.arange(len(self.start)) >= length)[0]

    def kept(self, keep: np.ndarray) -> list[str]:
        """Each text's kept words, joined by single spaces."""
        grow = np.zeros(len(self.bytes) + 1, np.int8)
        grow[self.start[keep]], grow[self.end[keep]] = 1, -1
        mask = np.cumsum(grow[:-1], dtype=np.int8).astype(bool)
        mask[self.end[keep]] = True  # the blank after a word, which there always is
        spots = np.nonzero(keep)[0]
        last = np.searchsorted(spots, self.before[1:]) - 1
        some = np.searchsorted(spots, self.before[1:]) > np.searchsorted(spots, self.before[:-1])
        mask[self.end[spots[last[some]]]] = False
        out = np.where(self.blank, np.uint8(32), self.bytes)[mask].tobytes()
        cuts = np.concatenate([[0], np.cumsum(mask)[self.text_end - 1]]).tolist() if len(self.text_end) else [0]
        return [out[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def message(unit: int, bits: int, v: np.ndarray, *more: np.ndarray, width: int = 64) -> list[tuple]:
    """Rows (bucket, unit, values, further columns) for ascending values of ``width`` bits."""
    return [(i, unit, pack_sorted(v[s]), *(pack(m[s]) for m in more)) for i, s in cut(v, bits, width)]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
