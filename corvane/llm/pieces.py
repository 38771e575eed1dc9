"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has a white-space marker after another character, and
none holds a line feed. So a marked text falls apart, before each run of
markers and around each line feed, into chunks that no merge crosses. Each task
keeps a table of the distinct chunks seen so far, has the library segment each
of them once, and joins the ids back by position with numpy. There is no
shuffle: the table is per task, and it is emptied when it is full, which costs
time and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import give_back, read

#: Entries of one task's table of chunks.
TABLE_ENTRIES = 200_000
_MARK = "▁"
#: Two white-space characters together, or one at an end, or a character that this module uses itself.
_UNEVEN = re.compile(r"[ \n][ \n]|^[ \n]|[ \n]\Z")
_RESERVED = re.compile("[\x00-\x02]")
_CHUNK = re.compile(r" *[^ \n]+|\n| +")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Ids of distinct chunks.

    Keys: ``w`` stands for one marker and w, ``\\x01w`` for w alone, ``\\n``
    for a line feed, ``\\x02`` and a chunk for one with several markers.
    """

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if "\n" in piece or _MARK in piece.lstrip(_MARK):
                raise ValueError(f"piece {piece!r} crosses a chunk's end; this model needs whole-text encoding")
        self.feed = self.library.encode("\n")
        self.entries = entries
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    @staticmethod
    def chunks(text: str) -> list[str] | None:
        """The keys of a text, or None if the text holds reserved characters."""
        if _RESERVED.search(text):
            return None
        text = text.replace(_MARK, " ")
        if not _UNEVEN.search(text):
            return text.replace("\n", " \n \x01").split(" ")
        out = []
        for x in _CHUNK.findall(" " + text):
            if x == "\n":
                out.append(x)
            elif x[0] != " ":
                out.append("\x01" + x)
            elif x[:2] == "  " or x == " ":
                out.append("\x02" + x)
            else:
                out.append(x[1:])
        return out

    def _segment(self, keys: list[str]) -> None:
        """Adds the keys, each segmented once by the library."""
        asked = [("\n" + k[1:] if k[0] == "\x01" else k[2:] if k[0] == "\x02" else k) for k in keys]
        for key, ids in zip(keys, self.library.encode(asked, num_threads=1), strict=True):
            if key == "\n":
                ids = self.feed[1:]
            elif key[0] == "\x01":
                ids = ids[len(self.feed) :]
            elif key == "\x02 ":
                ids = self.feed[:1]  # one marker alone
            n, row = len(ids), len(self.at)
            while self.used + n > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            if row == len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
            self.ids[self.used : self.used + n] = ids
            self.starts[row], self.sizes[row] = self.used, n
            self.used += n
            self.at[key] = row

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one more entry than texts)."""
        if len(self.at) > self.entries:
            self.clear()
        rows, counts, whole = [], np.zeros(len(texts), np.int64), {}
        for i, text in enumerate(texts):
            keys = self.chunks(text) if text else []
            if keys is None:
                whole[i] = np.array(self.library.encode(text), np.int32)
                continue
            new = {k for k in keys if k not in self.at}
            if new:
                self._segment(list(new))
            rows.append(np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys)))
            counts[i] = len(keys)
        row = np.concatenate(rows) if rows else np.empty(0, np.int64)
        size = self.sizes[row]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.starts[row] - (ends - size), size) + np.arange(total)]
        ids_before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if not whole:
            return flat, ids_before
        parts = [whole.get(i, flat[ids_before[i] : ids_before[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def encode_pieces(
    docs: DataFrame,
    path: str | None = None,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = "decoded",
    rows: int = 512,
) -> DataFrame:
    """``docs`` with the ids of each whole text, and the text that the library decodes from them.

    A null or empty text has no ids and decodes to the empty text. Other
    columns stay as they are; those named as ``ids`` or ``decoded`` are
    replaced. Repeated rows stay repeated.
    """
    path = path or model_path()
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = [x or "" for x in batch.column(names.index(text)).to_pylist()]
                flat, begins = table.encode(texts)
                columns = [batch.column(i) for i in range(len(names))]
                columns.append(pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat)))
                if decoded:
                    columns.append(pa.array([table.library.decode(flat[a:b].tolist()) if b > a else "" for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, ids, *([decoded] if decoded else [])])
        del table
        give_back()

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType(kept + added))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
