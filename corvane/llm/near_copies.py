"""Near copies of documents: SimHash tables, then MinHash bands, verified by the exact similarity of shingle sets.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Texts of the same set are one class from then on, so
thousands of copies are one row. Candidates come in two steps. First the
multi-index tables of ``simhash``: classes whose fingerprints are at two bits or
fewer. At a similarity of 0.8 two fingerprints of 64 bits differ in ten bits, so
these tables alone miss most links; tables that found them would take some ten
thousand probes a document. So each text also has 200 minimal hashes in 40 bands
of five; a pair at 0.8 shares no band with a chance of 1e-7, and less above.
Components need no pair whose ends are connected already, so a band's classes
are first compared with one of them, then, in a further round, with another one,
and at last those of a band that are still in different components are compared
with each other: no link between components is left out. What can't be alike is
never paired: shingles that no other candidate has can't be shared, so the
others of a set bound the size of any set that it is alike to (``_bounds``).
Texts that differ from each other by words of their own, however many come from
one template, fall out by that bound. Of bands of more than SMALL classes the
rest is compared in blocks, by products of matrices, so that no row stands for a
pair. Every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import give_back, written
from corvane.llm.components import components
from corvane.llm.simhash import fold_bits, links, one_of_each

#: Bands, minimal hashes in a band, and rounds of comparing a band with one of its classes at most.
BANDS, DEEP, ROUNDS = 40, 5, 2
#: Classes of a band that are paired row by row at most; classes, and their shingles, in a block of a larger one.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 17
#: Ids that are broadcast at most.
BROADCAST_IDS = 500_000
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 32, (BANDS * DEEP, 1), np.uint32)
_TIMES = _rng.integers(0, 1 << 32, (BANDS * DEEP, 1), np.uint32) | np.uint32(1)
_MIX = _rng.integers(0, 1 << 63, (1, DEEP), np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def all_shingles(text: str | None, words: int = 5) -> np.ndarray:
    """64-bit hashes of the shingles of a text, repeats included; a text of fewer words is one shingle, one of none has none."""
    w = (text or "").encode().lower().split()
    some = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)] if w else []
    return np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(42)), np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    return np.unique(all_shingles(text, words))


def class_of(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles; 0 for none."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64)) if len(found) else 0


def bands(found: np.ndarray) -> np.ndarray:
    """The 64-bit keys of a set's bands."""
    folded = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * DEEP, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 2048):
        least = np.minimum(least, ((folded[None, at : at + 2048] ^ _XOR) * _TIMES).min(axis=1))
    key = ((least.reshape(BANDS, DEEP).astype(np.uint64) + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, cls, fp, bands) of each row: its class, the fingerprint of its shingles, and its bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [all_shingles(x.as_py(), words) for x in batch.column(1)]
            fp = [fold_bits(h) for h in every]
            sets = [np.unique(h) for h in every]
            keys = [bands(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "cls", "fp", "bands"])
        give_back()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, cls long, fp long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(cls, set) of each row: its hashes as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "set"])
        give_back()

    return docs.select("text").mapInArrow(run, "cls long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are alike by ``least`` or more."""
    both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("cls").alias("v"), F.col("set").alias("y")), "v").select("u", "v", "x", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(same >= least * (len(a) + len(b) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _close_prints(classes: DataFrame) -> DataFrame:
    """(u, v): each class beside the first of its fingerprint, and the first ones of fingerprints that the SimHash tables link."""
    first = classes.groupBy("fp").agg(F.min("cls").alias("first"))
    same = classes.join(first, "fp").where("cls <> first").select(F.col("first").alias("u"), F.col("cls").alias("v"))
    linked = links(first.select("fp"))
    a, b = first.select(F.col("fp").alias("u"), F.col("first").alias("x")), first.select(F.col("fp").alias("v"), F.col("first").alias("y"))
    return same.union(linked.join(a, "u").join(b, "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))


def _bounds(sets: DataFrame, least: float) -> DataFrame:
    """(cls, n, most, own) of each set: its size, the size of a set alike to it at most, and its share of shingles that no other set has.

    Of n shingles s are in other sets too, so two sets share s at most, and are
    alike by ``least`` only if s is ``least / (1 + least)`` of both sizes or more.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cls, np.int64)), pa.array(found)], names=["cls", "s"])

    single = sets.select("cls", "set").mapInArrow(run, "cls long, s long").groupBy("s").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).where("c = 1").groupBy("cls").agg(F.count("*").alias("u"))
    sized = sets.select("cls", (F.length("set") / 8).cast("long").alias("n")).join(single, "cls", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    most = F.floor((F.col("n") - F.col("u")) * ((1 + least) / least) - F.col("n") + 1e-6)
    return written(sized.select("cls", "n", most.alias("most"), (F.col("u") / F.greatest("n", F.lit(1))).alias("own")), "bounds")


def _may_link(a: str, b: str) -> Column:
    return (F.col(f"{a}n") <= F.col(f"{b}most")) & (F.col(f"{b}n") <= F.col(f"{a}most"))


def _links(members: DataFrame, near: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, root) of the classes that are connected over pairs of ``near`` (u, v) or of a band (key, cls) that are alike."""
    rooted = near.select(F.col("u").alias("node"), F.col("u").alias("root")).where("false")
    possible = members.join(_bounds(sets, least).where(F.col("most") >= F.col("n") * least - 1e-6), "cls")
    keys = possible.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = written(possible.join(keys, "key", "left_semi").select("key", "cls", "n", "most", "own"), "possible")
    mixed, tested = members.withColumn("root", F.col("cls")), near
    for n in range(ROUNDS):
        # First the class that has least of its own, which stands in the middle of its like; then any.
        first = F.col("own") if n == 0 else F.lit(0.0)
        lead = mixed.groupBy("key").agg(F.min(F.struct(first.alias("o"), F.xxhash64("cls", F.lit(n)).alias("h"), "cls", "root", "n", "most")).alias("lead"))
        star = mixed.join(lead, "key").where((F.col("root") != F.col("lead.root")) & _may_link("", "lead.")).select(F.least("cls", "lead.cls").alias("u"), F.greatest("cls", "lead.cls").alias("v"))
        # The pairs that the SimHash tables found are tested along with the first round's.
        star = written(star.union(near).distinct() if n == 0 else star.distinct().join(tested, ["u", "v"], "left_anti"), "star-pairs")
        new = written(_verified(star, sets, least), "star-links")
        tested = star if n == 0 else tested.union(star)
        if new.isEmpty():
            break
        rooted = _connected(rooted, new, n == 0)
        mixed = _mixed(members, rooted)
        if mixed.isEmpty():
            return rooted
    counted = mixed.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("all"))
    held = written(mixed.join(counted, "key"), "apart")
    a, b = (held.where(F.col("c") <= SMALL).select("key", *[F.col(c).alias(f"{x}{c}") for c in ("cls", "root", "n", "most")]) for x in ("p_", "q_"))
    apart = a.join(b, (a.key == b.key) & (F.col("p_cls") < F.col("q_cls")) & (F.col("p_root") != F.col("q_root")) & _may_link("p_", "q_"))
    pairs = apart.select(F.col("p_cls").alias("u"), F.col("q_cls").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
    new = written(_verified(pairs, sets, least).union(_in_blocks(held.where(F.col("c") > SMALL), sets, least)).distinct(), "links")
    return rooted if new.isEmpty() else _connected(rooted, new, rooted.isEmpty())


def _in_blocks(held: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): for each two components of a band in ``held`` (key, cls, root, n, most, c, all) that meet in two blocks, one of the links between them."""
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int")
    cut = held.join(sets, "cls").withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = cut.select("key", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "cls", "root", "n", "most", "set")
    dealt = dealt.select("key", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "cls", "root", "n", "most", "set")

    def compare(t: pa.Table) -> pa.Table:
        i, j, b, cls, root, n, most = (t.column(c).to_numpy() for c in ("i", "j", "b", "cls", "root", "n", "most"))
        x, y = np.nonzero(b == i[0])[0], np.nonzero(b == j[0])[0]
        may = (root[x][:, None] != root[y]) & (n[x][:, None] <= most[y]) & (n[y] <= most[x][:, None])
        x, y, may = x[may.any(1)], y[may.any(0)], may[may.any(1)][:, may.any(0)]
        none = np.empty(0, np.int64)
        if not may.size:
            return pa.table({"u": none, "v": none})
        raw = t.column("set").to_pylist()
        held = np.union1d(x, y)
        every = [np.frombuffer(raw[r], np.uint64) for r in held]
        row = np.repeat(np.arange(len(held)), [len(e) for e in every])
        _, at, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        row, at = row[times[at] > 1], at[times[at] > 1]
        order = np.argsort(at, kind="stable")
        row, at = row[order], np.unique(at[order], return_inverse=True)[1]
        px, py = np.searchsorted(held, x), np.searchsorted(held, y)
        same = np.zeros(may.shape, np.int64)
        for begin in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            lo, hi = np.searchsorted(at, [begin, begin + 4096])
            has = np.zeros((len(held), 4096), np.float32)
            has[row[lo:hi], at[lo:hi] - begin] = 1
            same += (has[px] @ has[py].T).astype(np.int64)
        p, q = np.nonzero(may & (same >= least * (n[x][:, None] + n[y] - same) - 1e-9))
        p, q = x[p], y[q]
        _, one = np.unique(np.stack([np.minimum(root[p], root[q]), np.maximum(root[p], root[q])]), axis=1, return_index=True)
        return pa.table({"u": np.minimum(cls[p[one]], cls[q[one]]), "v": np.maximum(cls[p[one]], cls[q[one]])})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "u long, v long")


def _connected(rooted: DataFrame, new: DataFrame, first: bool) -> DataFrame:
    """``rooted`` (node, root) with the links ``new`` (u, v): only roots are connected anew, not all that they stand for."""
    if first:
        return written(components(new), "roots")
    of = lambda c: rooted.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    lifted = new.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    moved = written(components(lifted), "moved")
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = rooted.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(kept.union(moved.join(rooted.select("node"), "node", "left_anti").select("node", "root")), "roots")


def _mixed(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """``members`` with their roots: the classes of bands that hold more than one component."""
    named = members.join(rooted, members.cls == rooted.node, "left").select(*members.columns, F.coalesce("root", "cls").alias("root"))
    keys = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return written(named.join(keys, "key", "left_semi"), "mixed")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, cls, root, component_id): one row for each row of ``docs``.

    component_id is the smallest id among the documents reachable over links,
    the row's own included; texts without words are copies of each other.
    ``cls`` tells texts of different shingle sets apart, ``root`` components. A null id never becomes
    a component_id; a component of such rows alone has none. ``least`` is 0.8 or
    more: below, the bands would miss pairs.
    """
    if least < 0.8:
        raise ValueError("bands are made for 0.8 and more")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = written(_sketches(texts, words), "sketches")
    # Texts of one set may repeat shingles unlike, so a class takes one of its fingerprints.
    classes = prints.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = written(classes, "copy-classes")
    rows = classes.select("cls", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = written(rows.join(shared, "key", "left_semi").select("key", "cls"), "band-members")
    near = written(_close_prints(classes.where("bands IS NOT NULL").select("cls", "fp")).distinct(), "close-prints")
    met = members.select("cls").union(near.select("u")).union(near.select("v")).distinct()
    asked = classes.join(met, "cls", "left_semi").where("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct()
    few = asked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    some = texts.join(F.broadcast(asked) if few else asked, "doc_id", "left_semi").select("text").union(texts.where("doc_id IS NULL").select("text"))
    sets = written(_sets(some, words).groupBy("cls").agg(F.first("set").alias("set")), "shingle-sets")
    rooted = _links(members, near, sets, least)
    named = classes.join(rooted, classes.cls == rooted.node, "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    linked = named.where("root <> cls").select("root").distinct()
    groups = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("reached"))
    named = named.join(groups, "root", "left").select("cls", "root", F.coalesce("reached", "least").alias("component_id"))
    return prints.select("doc_id", "cls").join(named, "cls").select("doc_id", "cls", "root", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: one of those whose id names it, of the smallest class.

    Rows are told apart by id and class, so of rows that share an id but not a
    text each is judged by its own text. A component of rows without an id keeps
    one of them. An empty table stays empty; all columns are kept as they are.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return one_of_each(docs, near_copies(texts, "doc_id", "text", words, least), id_col, text, "cls", lambda t: class_of(shingles(t, words)))
