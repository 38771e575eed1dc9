"""Language-model scores by prediction by partial matching over bytes.

A text is read as its words, A-Z lower-cased, each followed by a blank and the
last by an end mark, which also stands before the text. The model is a trie of
byte contexts up to ``ORDER`` bytes with the counts of all training texts. The
next byte is predicted from the longest context seen in training; if it never
followed there, the model escapes to the context one byte shorter and excludes
the bytes it has just ruled out, down to all bytes alike. Escapes are estimated
by discounting: a byte counted n times among t keeps (n - d) / t, and each of q
distinct bytes gives d / t to the escape. Counts are made under update
exclusion: the longest contexts count every time a byte follows, shorter ones
count a byte once for each context one byte longer that it follows. Code length
adds up over the text.

Every context's bytes also followed its shorter suffix. So the bytes excluded
after an escape are those of the context just left, and what they weigh one
level below is a sum over a join of two levels of the trie. The trie is rows,
one for each context and byte, worked out level by level in SQL, never gathered.
A unit of documents asks only for the probabilities of its own distinct byte
sequences. Sequences are exchanged as they are, words by 63 bits of their XXH3
hash: among ten billion distinct words five pairs share one by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import fold, read, written
from corvane.llm.segments import U, Units, Words, find, message, pack, slices, table_of, unpack, unpack_sorted

#: Bytes of the longest context; at most 6, for a sequence and one bit to fit 64 bits.
ORDER = 5
#: What each distinct byte of a context gives to the escape.
DISCOUNT = 0.3
#: Bytes that can come next: all but six kinds of white space, a blank and the end mark.
SYMBOLS = 252
_ODD = 0x9E3779B97F4A7C15
_END = 0x0A


def _spread(keys: np.ndarray, order: int) -> np.ndarray:
    """A bijection of keys of order + 1 bytes whose leading bits are even."""
    return (keys * U(_ODD)) & U((1 << (8 * (order + 1))) - 1)


def _gathered(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words read as above, its key (context, then byte), and how many bytes each text has."""
    keep = ~words.blank
    keep[words.end] = True
    keep[words.text_end[words.count == 0] - 1] = True
    values = np.where(words.blank, np.uint8(0x20), words.bytes)
    some = words.before[1:][words.count > 0] - 1
    values[words.end[some]] = _END
    values[words.text_end[words.count == 0] - 1] = _END
    size = np.diff(np.concatenate([[0], np.cumsum(keep)[words.text_end - 1]]))
    key = values[keep].astype(U)
    base = key.copy()
    for j in range(1, order + 1):
        key[j:] |= base[:-j] << U(8 * j)
    begin = np.cumsum(size) - size
    pad = [sum(_END << (8 * (order - i)) for i in range(n)) for n in range(order + 1)]
    for j in range(order):  # the first bytes of a text see end marks before it
        at = (begin + j)[size > j]
        key[at] = (key[at] & U((1 << (8 * (j + 1))) - 1)) | U(pad[order - j])
    return key, size


def _distinct(values: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of fewer than 64 bits, and how many of each are counted."""
    v = np.sort((values << U(1)) | counted)
    key = v >> U(1)
    first = np.nonzero(np.diff(key, prepend=~key[:1]))[0]
    ones = np.concatenate([[0], np.cumsum((v & U(1)).astype(np.int64))])
    return key[first], np.diff(ones[np.append(first, len(v))])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and the sums of their numbers, of parts (values, numbers)."""
    v, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, (U, np.int64)[i]) for i in (0, 1))
    order = np.argsort(v, kind="stable")
    v = v[order]
    first = np.nonzero(np.diff(v, prepend=~v[:1]))[0]
    return v[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def _levels(grams: DataFrame, order: int) -> DataFrame:
    """key, bucket and the natural logarithm ``lp`` of each sequence's last byte's probability after the rest."""
    sums = [grams]
    for k in range(order, 0, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("key")
        sums.insert(0, sums[0].groupBy(low).agg(F.sum((F.col("n") > 0).cast("long")).alias("n")))
    n, t, q = F.col("n"), F.col("t"), F.col("q")
    below = None
    for k, level in enumerate(sums):
        context = Window.partitionBy(F.shiftrightunsigned(F.col("key"), 8))
        if below is None:
            row = level.withColumns({"t": F.sum("n").over(context), "q": F.sum((n > 0).cast("long")).over(context)})
            row = row.withColumn("x", -F.log(F.lit(float(SYMBOLS)) - q)).withColumn("flat", F.lit(-float(np.log(SYMBOLS))))
        else:
            row = level.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(below.select(F.col("key").alias("low"), *[F.col(c).alias(f"{c}0") for c in ("n", "t", "q", "x", "lp")]), "low")
            seen = F.when(n > 0, F.col("n0")).otherwise(0)
            row = row.withColumns({"t": F.sum("n").over(context), "q": F.sum((n > 0).cast("long")).over(context), "e": F.sum(seen).over(context)})
            left, others = F.col("t0") - F.col("e"), F.col("q0") - q
            x = F.when(F.col("n0") > 0, F.log(F.col("n0") - DISCOUNT) - F.log(left)).when(others > 0, F.log(DISCOUNT * others) - F.log(left) + F.col("x0")).otherwise(F.col("x0"))
            row = row.withColumn("x", x).withColumn("flat", F.col("lp0"))
        lp = F.when(t == 0, F.col("flat")).when(n > 0, F.log((n - DISCOUNT) / t)).otherwise(F.log(DISCOUNT * q / t) + F.col("x"))
        row = row.withColumn("lp", lp)
        below = written(row.select("key", "n", "t", "q", "x", "lp") if k < order else row.select("key", "bucket", "lp"), f"trie-{k}")
    return below


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """A row for each row of ``docs``: its id, ``train``, ``n_tokens`` (the end mark is one), ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``train`` says which rows the model learns from; all are scored. base_score
    is the add-half unigram score over words, score the model's; both are base-10
    logarithms. Null, empty and white-space texts are the end mark alone.
    Repeated rows count, and are scored, as often as they stand. With nothing to
    learn from all bytes are alike. Other columns are not read.
    """
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    width = 8 * (order + 1)
    units = Units(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train")), "text")
    bits = units.bits
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("unit", pa.int64()), ("v", pa.binary()), ("n", pa.binary())])
    reply = pa.schema([*schema, ("words", pa.int64()), ("tokens", pa.int64())])

    def sent(table: pa.Table) -> pa.Table:
        unit, words, grams = table.column("unit")[0].as_py(), [], []
        for batch in slices(table):
            learn = np.array(batch.column("train"), bool)
            w = Words(batch.column("text").to_pylist(), lower=True)
            code, low, _ = w.hashes()
            words.append((low >> U(1), np.bincount(code, np.repeat(learn, w.count), len(low)).astype(np.int64)))
            key, size = _gathered(w, order)
            grams.append(_distinct(_spread(key, order), np.repeat(learn, size).astype(U)))
            del w, key
            if sum(len(v) for v, _ in grams) > 4_000_000:
                grams = [_summed(grams)]
        out = [(0, *row) for row in message(unit, bits, *_summed(words), width=63)]
        out += [(1, *row) for row in message(unit, bits, *_summed(grams), width=width)]
        return table_of(out, schema)

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _summed([(unpack_sorted(v), unpack(n).astype(np.int64)) for v, n in zip(table.column("v").to_pylist(), table.column("n").to_pylist(), strict=True)])

    def counted(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        distinct, n = merged(table)
        out = [(0, bucket, unit, b, pack(n[np.searchsorted(distinct, unpack_sorted(b))]), 0, 0) for unit, b in zip(table.column("unit").to_pylist(), table.column("v").to_pylist(), strict=True)]
        return table_of([*out, (0, bucket, -1, b"", b"", int((n > 0).sum()), int(n.sum()))], reply)

    def learnt(table: pa.Table) -> pa.Table:
        distinct, n = merged(table)
        keys = (distinct * U(pow(_ODD, -1, 1 << 64))) & U((1 << width) - 1)
        return pa.table({"key": keys.astype(np.int64), "n": n, "bucket": pa.array(np.full(len(n), table.column("bucket")[0].as_py()), pa.int32())})

    def answered(table: pa.Table, trie: pa.Table) -> pa.Table:
        v, lp = _spread(trie.column("key").to_numpy().astype(U), order), trie.column("lp").to_numpy()
        by = np.argsort(v)
        v, lp = v[by], np.ascontiguousarray(lp[by]).view(U)
        return table_of([(1, b, unit, x, pack(lp[np.searchsorted(v, unpack_sorted(x))]), 0, 0) for b, unit, x in zip(*(table.column(c).to_pylist() for c in ("bucket", "unit", "v")), strict=True)], reply)

    names = "kind int, bucket int, unit long, v binary, n binary"
    replies = f"{names}, words long, tokens long"
    messages = written(units.grouped().applyInArrow(sent, names), "messages")
    counts = written(messages.where("kind = 0").groupBy("bucket").applyInArrow(counted, replies), "counts")
    grams = written(messages.where("kind = 1").groupBy("bucket").applyInArrow(learnt, "key long, n long, bucket int"), "grams")
    trie = _levels(grams, order)
    chances = messages.where("kind = 1").groupBy("bucket").cogroup(trie.groupBy("bucket")).applyInArrow(answered, replies)
    texts = docs.where(F.coalesce(train, F.lit(False))).count()
    seen = counts.where("unit = -1").agg(F.sum("words"), F.sum("tokens")).first()
    total, kinds = (seen[1] or 0) + texts, (seen[0] or 0) + (texts > 0)

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        got = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "v", "n")), strict=True))
        del answers
        # Buckets are leading bits, so their values in order of buckets ascend.
        words, grams = (np.concatenate([unpack_sorted(v) for k, _, v, _ in got if k == kind] or [np.zeros(0, U)]) for kind in (0, 1))
        known_n, lp = (np.concatenate([unpack(n) for k, _, _, n in got if k == kind] or [np.zeros(0, U)]) for kind in (0, 1))
        del got
        known_n, lp, grams = known_n.astype(np.float64), lp.view(np.float64), grams << U(64 - width)
        add = lambda x, size: np.diff(np.concatenate([[0.0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(size)])])
        floor = np.log10(total + 0.5 * (kinds + 1))
        out = []
        for batch in slices(table):
            w = Words(batch.column("text").to_pylist(), lower=True)
            code, low, _ = w.hashes()
            c = known_n[np.searchsorted(words, low >> U(1))][code] if len(low) else np.zeros(0)
            base = add(np.log10(c + 0.5) - floor, w.count) + (np.log10(texts + 0.5) - floor)
            known = add((c > 0).astype(np.float64), w.count).astype(np.int64) + (texts > 0)
            key, size = _gathered(w, order)
            model = add(lp[find(grams, _spread(key, order) << U(64 - width))], size) / np.log(10)
            n_tokens = (w.count + 1).astype(np.int64)
            out.append(pa.table({"doc_id": batch.column("doc_id"), "train": batch.column("train"), "n_tokens": n_tokens, "n_known": known, "train_tokens": pa.array(np.full(len(n_tokens), total), pa.int64()), "base_score": base, "score": model}))
            del w, key, c
        return pa.concat_tables(out)

    kind = units.schema["doc_id"].dataType.simpleString()
    answers = counts.where("unit >= 0").union(chances)
    return units.grouped().cogroup(units.answers(answers)).applyInArrow(scored, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold("doc_id", 5) == 1
    found = score(read(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
