"""Token ids in files of fixed-width bit packing.

Encoding. A byte-level piece never crosses from a character that is no white
space to one that is. So where no two white-space characters touch, each worker
has the tokenizers library encode a distinct chunk (a word with the blank before
it) once, many in one call, and joins the ids back by position; chunks are told
apart by their bytes. Texts where white space touches, or that hold a special
token, are encoded whole. The table of chunks lives as long as the worker and is
emptied when it is full, which costs time and changes no result.

Files. Ids of ascending documents follow one another, each in the fewest bits
that hold the vocabulary, least significant bit first, in blocks of 65 536 ids
that begin at whole bytes. A shard is one file: header, document ids, where each
document begins, where each block begins, blocks. A document is read by its one
or few blocks, which numpy unpacks at once.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import give_back, new_path, open_path, read, written
from corvane.llm.segments import U, _runs, _STEP, _VALUE, mixed

#: Ids of a block, bytes of text of a shard, quantiles of ids that are asked for, bytes of one piece of a task's work, and entries of a worker's table of chunks.
BLOCK, SHARD_BYTES, QUANTILES, PIECE_BYTES, TABLE_ENTRIES = 65_536, 24 << 20, 4096, 3 << 20, 1_500_000
_HEAD = struct.Struct("<4sIIIQQQ")
_MAGIC = b"CVTI"
_TOUCHING = re.compile(r"\s\s|^\s|\s\Z")
_NONE = np.iinfo(np.int64).min


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts, each distinct chunk encoded once."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        feed = self._ids("\n")
        if len(feed) != 1 or self._ids("a\nb") != self._ids("a") + feed + self._ids("b"):
            raise ValueError("this vocabulary joins line feeds to what stands beside them")
        self.feed, self.entries = feed[0], entries
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def clear(self) -> None:
        """Empties the table: sorted keys and their rows; for each row where its ids and its bytes begin, and how many there are."""
        self.keys, self.rows, self.n = np.zeros(0, U), np.zeros(0, np.int32), 0
        self.at = {name: np.zeros(1 << 12, np.int64) for name in ("ids", "bytes")}
        self.size = {name: np.zeros(1 << 12, np.int32) for name in ("ids", "bytes")}
        self.store, self.used = {"ids": np.zeros(1 << 16, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32), "bytes": np.zeros(1 << 16, np.uint8)}, {"ids": 0, "bytes": 0}

    def _put(self, name: str, flat: np.ndarray, size: np.ndarray) -> None:
        """Appends what new rows hold."""
        n, used = self.n, self.used[name]
        while n + len(size) > len(self.at[name]):
            self.at[name], self.size[name] = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at[name], self.size[name]))
        while used + len(flat) > len(self.store[name]):
            self.store[name] = np.concatenate([self.store[name], np.zeros_like(self.store[name])])
        self.store[name][used : used + len(flat)] = flat
        self.at[name][n : n + len(size)] = used + np.cumsum(size) - size
        self.size[name][n : n + len(size)] = size
        self.used[name] = used + len(flat)

    def _add(self, keys: np.ndarray, words: list[bytes], kind: np.ndarray) -> np.ndarray:
        """Encodes new chunks (words without a line feed; kind 0: as they are, 1: after a blank, 2: after a line feed); returns their rows."""
        text = "\n".join([(" " if k == 1 else "") + w.decode() for w, k in zip(words, kind.tolist(), strict=True)] + [""])
        flat = np.array(self._ids(text), self.store["ids"].dtype)
        after = (kind == 2).astype(np.int64)
        ends = np.nonzero(flat == self.feed)[0]
        size = np.diff(ends, prepend=-1) - 1
        if len(size) != len(words):
            raise ValueError("a chunk's ids hold a line feed's")
        # After a line feed a chunk's ids begin with the feed's, which stands before each chunk but the first.
        whole = np.concatenate([np.array([self.feed], flat.dtype), flat])
        begin = ends - size + 1 - after
        length = size + after
        own = whole[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        row = self.n + np.arange(len(keys))
        self._put("ids", own, length)
        self._put("bytes", np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))
        self.n += len(keys)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, row)
        return row

    def _even(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each text has, and whether it has to be encoded whole, of texts in which no two white-space characters touch."""
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        length = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        blank = (data == 32) | (data == 10)
        edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
        start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        feed = np.where(start > 0, data[start - 1] == 10, True)
        first = np.zeros(len(data) + 1, bool)
        first[np.cumsum(length) - length] = True
        kind = np.where(first[start], 0, np.where(feed, 2, 1))
        # Keys that are quick to get find a row; the row's bytes then decide.
        key = mixed(_runs(_VALUE[data], start, end, _STEP) + (end - start).astype(U)) ^ (kind.astype(U) * U(0x9E3779B97F4A7C15))
        code, distinct = pd.factorize(key)
        some = np.empty(len(distinct), np.int64)
        some[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        order = np.argsort(distinct)
        distinct, some = distinct[order], some[order]
        spot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == distinct[inside]
        row = np.zeros(len(distinct), np.int64)
        row[known] = self.rows[spot[known]]
        new = np.nonzero(~known)[0]
        if len(new):
            joined = data.tobytes()
            row[new] = self._add(distinct[new], [joined[a:b] for a, b in zip(start[some[new]].tolist(), end[some[new]].tolist(), strict=True)], kind[some[new]])
        back = np.empty(len(order), np.int64)
        back[order] = row
        row = back[code]
        words = np.searchsorted(start, np.cumsum(length))
        length_of = end - start
        off = self.size["bytes"][row] != length_of
        if len(row):
            spots = np.nonzero(~blank)[0]
            # Words of another length than their row's are compared with the row's first byte, and count as unlike anyway.
            unlike = data[spots] != self.store["bytes"][np.where(np.repeat(off, length_of), 0, spots + np.repeat(self.at["bytes"][row] - start, length_of))]
            if unlike.any():
                off |= np.add.reduceat(unlike, np.cumsum(length_of) - length_of) > 0
        whole = np.diff(np.concatenate([[0], np.cumsum(off)])[words], prepend=0) > 0
        size = self.size["ids"][row].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.store["ids"][np.repeat(self.at["ids"][row] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return flat, np.diff(np.concatenate([[0], ends])[words], prepend=0), whole

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and how many each text has."""
        if self.n > self.entries:
            self.clear()
        even, apart = [], []
        for i, t in enumerate(texts):
            (apart if t and ((self.special and self.special.search(t)) or _TOUCHING.search(t)) else even).append(i)
        flat, size, whole = self._even([(texts[i] or "").encode() for i in even])
        apart += [even[k] for k in np.nonzero(whole)[0].tolist()]
        n = np.zeros(len(texts), np.int64)
        n[even] = size
        if apart:
            parts, at, place = [], np.concatenate([[0], np.cumsum(size)]), dict(zip(even, range(len(even)), strict=True))
            said = {i: np.array(e.ids, np.uint32) for i, e in zip(apart, self.library.encode_batch_fast([texts[i] for i in apart], add_special_tokens=False), strict=True)}
            for i in range(len(texts)):
                parts.append(said[i] if i in said else flat[at[place[i]] : at[place[i] + 1]])
                n[i] = len(parts[-1])
            flat = np.concatenate(parts)
        return flat, n


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def shard_bytes(doc_ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, width: int) -> bytes:
    blocks = [pack_bits(flat[a : a + BLOCK], width) for a in range(0, len(flat), BLOCK)]
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    head = _HEAD.pack(_MAGIC, 1, width, BLOCK, len(sizes), len(flat), len(blocks))
    at = len(head) + 8 * (len(doc_ids) + len(begin) + len(blocks) + 1)
    offsets = at + np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<i8")
    return b"".join([head, doc_ids.astype("<i8").tobytes(), begin.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """A file's index, and its documents by position."""

    def __init__(self, path: str):
        fs, name = open_path(path)
        self.file = fs.open_input_file(name)
        magic, _, self.width, self.block, docs, self.n, blocks = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        index = np.frombuffer(self.file.read_at(8 * (2 * docs + blocks + 2), _HEAD.size), "<i8")
        self.doc_ids, self.begin, self.offsets = index[:docs], index[docs : 2 * docs + 1], index[2 * docs + 1 :]

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` up to ``last``, read from their blocks alone."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        data = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        out = [unpack_bits(data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], self.width, min(self.block, self.n - k * self.block)) for k in range(a, b + 1)]
        return np.concatenate(out)[first - a * self.block : last - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.begin[i]), int(self.begin[i + 1]))


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 2, id_col: str = "doc_id", text: str = "text", shard: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of all documents, each closed by ``end``, under ``path``; returns the manifest (shard, file, docs, ids).

    Shards hold ascending ranges of the integer id, nulls before all; rows that
    share an id stand by their ids' values. A null or empty text is the end id
    alone. A file that a lost task left stands in no manifest. Of no documents
    there are no files.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    from tokenizers import Tokenizer

    width = max((Tokenizer.from_file(vocabulary).get_vocab_size() - 1).bit_length(), end.bit_length())
    pairs = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    size = pairs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-size // shard))
    cuts = np.zeros(0, np.int64)
    if shards > 1:
        # The sketch of quantiles stays small however many shards there are; between two quantiles ids are cut evenly.
        steps = min(shards, QUANTILES)
        marks = pairs.where("i IS NOT NULL").approxQuantile("i", [k / steps for k in range(steps + 1)], 0.1 / steps)
        cuts = np.unique(np.interp(np.arange(1, shards) * (steps / shards), np.arange(len(marks)), marks).astype(np.int64)) if marks else cuts
    fs, place = open_path(path)
    fs.create_dir(place, recursive=True)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, squeeze = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = np.array(pa.compute.fill_null(batch.column(0), _NONE), np.int64)
            length = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), np.int64)
            piece = (np.cumsum(length) - length) // PIECE_BYTES
            for p in np.unique(piece):
                rows = np.nonzero(piece == p)[0]
                flat, n = known.encode(batch.column(1).slice(rows[0], len(rows)).to_pylist())
                flat = np.insert(flat, np.cumsum(n), end).astype("<u4" if width > 16 else "<u2")
                n = n + 1
                begin = np.concatenate([[0], np.cumsum(n)])
                to = np.searchsorted(cuts, ids[rows], side="right")
                for s in np.unique(to):
                    mine = np.nonzero(to == s)[0]
                    take = flat[np.repeat(begin[mine] - (np.cumsum(n[mine]) - n[mine]), n[mine]) + np.arange(int(n[mine].sum()))]
                    yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids[rows][mine].tobytes(), n[mine].tobytes(), squeeze.compress(take.tobytes())))], names=["shard", "docs", "sizes", "ids"])

    def stored(table: pa.Table) -> pa.Table:
        number, expand = table.column("shard")[0].as_py(), zstandard.ZstdDecompressor()
        doc, n = (np.concatenate([np.frombuffer(b, np.int64) for b in table.column(c).to_pylist()]) for c in ("docs", "sizes"))
        flat = np.concatenate([np.frombuffer(expand.decompress(b), "<u4" if width > 16 else "<u2") for b in table.column("ids").to_pylist()])
        begin = np.cumsum(n) - n
        order = np.argsort(doc, kind="stable")
        if (np.diff(doc[order]) == 0).any():
            order = np.array(sorted(range(len(doc)), key=lambda k: (doc[k], flat[begin[k] : begin[k] + n[k]].astype(">u4").tobytes())))
        flat = flat[np.repeat(begin[order] - (np.cumsum(n[order]) - n[order]), n[order]) + np.arange(len(flat))]
        name = f"shard-{number:08d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
        fs, place = open_path(path)
        with fs.open_output_stream(f"{place}/{name}") as f:
            f.write(shard_bytes(doc[order], n[order], flat, width))
        return pa.table({"shard": pa.array([number], pa.int32()), "file": [f"{path}/{name}"], "docs": [len(doc)], "ids": [len(flat)]})

    return written(pairs.mapInArrow(encoded, "shard int, docs binary, sizes binary, ids binary").groupBy("shard").applyInArrow(stored, "shard int, file string, docs long, ids long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of the files, ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before. A task reads one file.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select((F.row_number().over(Window.orderBy("shard")) - 1).alias("place"), "file", before.alias("before"))
    files = max(1, manifest.count())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard = Shard(name)
                step = max(1, len(shard.doc_ids) // max(1, -(-shard.n // (1 << 20))))
                for a in range(0, len(shard.doc_ids), step):
                    b = min(a + step, len(shard.doc_ids))
                    begin = shard.begin[a : b + 1]
                    flat = shard.ids(int(begin[0]), int(begin[-1])).astype("<u4").tobytes()
                    cut = (4 * (begin - begin[0])).tolist()
                    docs = pa.array(shard.doc_ids[a:b], mask=shard.doc_ids[a:b] == _NONE)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(first + begin[:-1]), pa.array(np.diff(begin)), pa.array([flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.repartitionById(files, F.col("place")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_ids(docs, new_path(spark, "token-ids"))
    return read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
