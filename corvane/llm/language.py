"""Language of a text: its family first, then one against one within the family.

Features are hashed byte trigrams of the whole text, other characters than
letters read as blanks, as square roots of their shares. Linear support vector
machines, one for each pair of families and one for each pair of languages of a
family, are fitted on the driver to a bounded sample: of each language the
``PER_LANGUAGE`` different labelled rows of smallest hash, at most a sixteenth of
them from any of 64 parts by hash. Every language is learnt: where there are more
than ``ROWS`` hold, each has fewer rows. Everything is predicted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fold, give_back, read

#: Rows of each language that are learnt from, at most; rows of all languages (one of each at least); hash buckets.
PER_LANGUAGE, ROWS, BUCKETS = 400, 25_600, 4096
UNKNOWN = "und"
#: Languages closely related to each other. A language not named here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "uralic": "et fi hu",
    "dravidian": "kn ml ta te",
    "celtic": "br cy ga gd",
    "austronesian": "id jv mg mi ms su tl",
    "sinitic": "zh yue wuu",
}
_FAMILY = {x: f for f, names in FAMILIES.items() for x in names.split()}
_READ = np.full(256, 32, np.uint8)
_READ[97:123] = np.arange(97, 123)
_READ[65:91] = np.arange(97, 123)
_READ[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (category L); digits, number signs and marks are none."""
    return text is not None and (text.isalpha() or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams; no trigrams, no features."""
    out = np.zeros(BUCKETS, np.float32)
    a = _READ[np.frombuffer(b" " + text.encode() + b" ", np.uint8)].astype(np.uint32)
    a = a[np.append((a[1:] != 32) | (a[:-1] != 32), True)]  # blanks in a row count once
    for at in range(0, len(a) - 2, 1 << 20):
        b = a[at : at + (1 << 20) + 2]
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        out += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    total = out.sum()
    return np.sqrt(out / total) if total else out


def machine(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights, the last one for a constant, of a linear machine with squared hinge loss; y is 1 or -1, both sides weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0.0, 1.0 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = weight * y * slack
        new = ahead + (np.append(pull @ x, pull.sum()) * 2 - decay * ahead) / 4.5
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w


class Languages:
    """The fitted machines: for each level a list of (one, other, weights)."""

    def __init__(self, x: np.ndarray, names: list[str]):
        found = sorted(set(names))
        self.family = {n: _FAMILY.get(n.lower().split("-")[0], n) for n in found}
        of = np.array([self.family[n] for n in names])
        label = np.array(names)
        self.families = sorted(set(self.family.values()))
        self.members = {f: [n for n in found if self.family[n] == f] for f in self.families}
        pairs = [(of == a, of == b) for a, b in combinations(self.families, 2)]
        self.first = [(i, j) for i, j in combinations(range(len(self.families)), 2)]
        self.second = {}
        for f, members in self.members.items():
            self.second[f] = (len(pairs), list(combinations(range(len(members)), 2)))
            pairs += [(label == members[i], label == members[j]) for i, j in self.second[f][1]]
        fitted = [machine(x[a | b], np.where(a[a | b], 1, -1).astype(np.float32)) for a, b in pairs]
        self.weights = np.stack(fitted, axis=1) if fitted else np.zeros((x.shape[1] + 1, 0), np.float32)

    @staticmethod
    def _vote(margins: np.ndarray, pairs: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The winner of the pairwise votes, margins breaking ties, and its least certain pair."""
        votes, least = np.zeros((len(margins), n)), np.ones((len(margins), n))
        for k, (i, j) in enumerate(pairs):
            m = margins[:, k]
            votes[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, j] += (m < 0) - 1e-3 * np.tanh(m)
            p = 1 / (1 + np.exp(-3 * np.clip(m, -30, 30)))
            least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
        at = votes.argmax(1)
        return at, least[np.arange(len(at)), at]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights[:-1] + self.weights[-1]
        family, score = self._vote(margins[:, : len(self.first)], self.first, len(self.families))
        names: list[str] = [""] * len(x)
        for f, members in enumerate(self.families):
            rows = np.nonzero(family == f)[0]
            begin, pairs = self.second[members]
            at, p = self._vote(margins[rows, begin : begin + len(pairs)], pairs, len(self.members[members]))
            score[rows] *= p
            for r, k in zip(rows, at, strict=True):
                names[r] = self.members[members][k]
        return names, score


def fit(docs: DataFrame, id_col: str, text: str, lang: str) -> Languages | None:
    """Machines fitted to a bounded sample of the rows that have a language; None if there are none."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    h = F.xxhash64(F.col(id_col), F.col(text))
    # Repeated rows count once. First within parts of a language, so that a language that most rows have is no single task's.
    parts = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    some = known.select(F.col(lang).alias("lang"), h.alias("h")).distinct().withColumn("n", F.row_number().over(parts)).where(F.col("n") <= PER_LANGUAGE // 16)
    order = Window.partitionBy("lang").orderBy("h")
    ranked = some.withColumn("n", F.row_number().over(order))

    def tops(per: int) -> list:
        return ranked.where(F.col("n") <= per).groupBy("lang").agg(F.max("h").alias("top")).collect()

    most = tops(PER_LANGUAGE)
    if not most:
        return None
    if len(most) * PER_LANGUAGE > ROWS:
        most = tops(max(1, ROWS // len(most)))
    # One row of two values for each language is broadcast.
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, r.top) for r in most], "lang string, top long"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(x.as_py()).astype(np.float16).tobytes() for x in batch.column(2)], pa.binary())], names=["h", "lang", "x"])

    sample = known.select(h.alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(chosen, "lang").where("h <= top").groupBy("h", "lang").agg(F.first("text").alias("text"))
    rows = sample.mapInArrow(run, "h long, lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.h, r.x))
    x, names = np.frombuffer(b"".join(r.x for r in rows), np.float16).reshape(-1, BUCKETS).astype(np.float32), [r.lang for r in rows]
    del rows
    model = Languages(x, names)
    del x
    give_back()
    return model


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with columns ``pred`` and ``score``, 0 to 1.

    Learns from the rows for which ``learn`` holds and whose language and text
    are not null; the language, and all other columns than the text, are no
    input of a prediction. A null text or one without a letter is ``und`` with
    score 0, as is every text if there is nothing to learn from. Rows keep
    their number and their other columns; columns of the two names are replaced.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs.where(learn), id_col, text, lang))
    kept = [f for f in docs.schema.fields if f.name not in (pred, score)]
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(names.index(text)).to_pylist()
                rows = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
                said, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if rows:
                    found, p = model.predict(np.stack([features(texts[i]) for i in rows]))
                    sure[rows] = p
                    for i, name in zip(rows, found, strict=True):
                        said[i] = name
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=[*names, pred, score])
        give_back()

    schema = T.StructType([*kept, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 4) == 2
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
