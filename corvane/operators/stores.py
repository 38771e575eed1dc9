"""Vector stores as Parquet folders: rows (namespace, chunk_id, doc_id, text, embedding, metadata), each version a folder of its own.

A change writes the next version beside the last one and then its name, so a
reader sees the old rows or the new ones, and a job that dies leaves the old.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import vectors as vx
from corvane.operators import rows, search

SCHEMA = "namespace string, chunk_id string, doc_id string, text string, embedding array<double>, metadata map<string,string>"
#: Filter operators and how each compares a metadata value, as a number if the operand is one.
OPERATORS = {"$eq": "__eq__", "$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def matches(metadata: Column, filters: dict | None) -> Column:
    """Whether metadata meets every condition: {key: value} or {key: {operator: value}}; $in and $nin take lists. A missing key meets none but $ne and $nin."""
    out = F.lit(True)
    for key, wanted in (filters or {}).items():
        value = metadata[key]
        for name, operand in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            if name in ("$in", "$nin"):
                held = F.coalesce(value.isin([str(x) for x in operand]), F.lit(False))
                out = out & (held if name == "$in" else ~held)
            elif name in OPERATORS:
                number = isinstance(operand, (int, float)) and not isinstance(operand, bool)
                left, right = (value.try_cast("double"), F.lit(float(operand))) if number else (value, F.lit(str(operand)))
                out = out & F.coalesce(getattr(left, OPERATORS[name])(right), F.lit(name == "$ne"))
            else:
                raise ValueError(f"unknown filter operator {name}")
    return out


def normalised_metadata(metadata: Column) -> Column:
    """A map without null values; null is the empty map."""
    return F.map_filter(F.coalesce(metadata, F.expr("cast(map() as map<string,string>)")), lambda k, v: v.isNotNull())


def problems(chunks: DataFrame, dim: int | None = None) -> DataFrame:
    """``chunks`` with ``problem``, null for a row that a store takes: ids and text that are not blank, vectors of one length."""
    blank = lambda c: F.coalesce(tx.strip(F.col(c)) == "", F.lit(True))
    out = F.when(blank("chunk_id"), "chunk_id is required").when(blank("doc_id"), "doc_id is required").when(blank("text"), "text cannot be empty")
    if "embedding" in chunks.columns:
        out = out.when(F.col("embedding").isNull(), "embedding is missing")
        if dim is not None:
            out = out.when(F.size("embedding") != dim, F.concat(F.lit(f"expected {dim} dimensions, got "), F.size("embedding").cast("string")))
    return chunks.withColumn("problem", out)


@dataclass
class Store:
    """A store below ``path``. ``tenant`` is stamped on what is added and bounds all that is read; ``metric`` is cosine, l2 or ip."""

    spark: SparkSession
    path: str
    metric: str = "cosine"
    tenant: str | None = None

    def _versions(self) -> DataFrame:
        return self.spark.read.schema("version long, dim int").json(f"{self.path}/versions")

    def _last(self) -> tuple[int, int | None]:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions").getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")):
            return 0, None
        r = self._versions().orderBy(F.desc("version")).first()
        return (r.version, r.dim) if r else (0, None)

    def _replace(self, df: DataFrame, dim: int | None) -> None:
        version = self._last()[0] + 1
        df.select(*[F.col(c.split()[0]) for c in SCHEMA.split(", ")]).write.parquet(f"{self.path}/rows-{version:08d}")
        self.spark.createDataFrame([(version, dim)], "version long, dim int").coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def everything(self) -> DataFrame:
        version, _ = self._last()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rows-{version:08d}") if version else self.spark.createDataFrame([], SCHEMA)

    def rows(self, namespace: str | None = "") -> DataFrame:
        """The store's rows that this tenant may see; a null namespace means all of them."""
        found = self.everything()
        if namespace is not None:
            found = found.where(F.col("namespace") == namespace)
        return found.where(F.col("metadata")["tenant_id"] == self.tenant) if self.tenant else found

    def add(self, chunks: DataFrame, namespace: str = "") -> None:
        """Adds or replaces chunks by id. Raises if a row can't be taken, before anything is written."""
        _, dim = self._last()
        if dim is None:
            first = chunks.select(F.size("embedding").alias("n")).first()
            dim = first.n if first else None
        wrong = problems(chunks, dim).where("problem IS NOT NULL").first()
        if wrong:
            raise ValueError(f"chunk {wrong.chunk_id!r}: {wrong.problem}")
        metadata = normalised_metadata(F.col("metadata")) if "metadata" in chunks.columns else F.expr("cast(map() as map<string,string>)")
        if self.tenant:
            metadata = F.map_concat(F.map_filter(metadata, lambda k, v: k != "tenant_id"), F.create_map(F.lit("tenant_id"), F.lit(self.tenant)))
        new = chunks.select(F.lit(namespace).alias("namespace"), "chunk_id", "doc_id", "text", F.col("embedding").cast("array<double>").alias("embedding"), metadata.alias("metadata"))
        new = new.groupBy("namespace", "chunk_id").agg(F.max_by(F.struct("doc_id", "text", "embedding", "metadata"), F.struct("doc_id", "text")).alias("r")).select("namespace", "chunk_id", "r.*")
        kept = self.everything().join(new.select("namespace", "chunk_id"), ["namespace", "chunk_id"], "left_anti")
        self._replace(kept.unionByName(new), dim)

    def delete(self, chunk_ids: list[str] | None = None, doc_ids: list[str] | None = None, filters: dict | None = None, namespace: str | None = "") -> int:
        """Deletes what all given conditions hold for, within the tenant; returns how many rows went. Without a condition nothing goes."""
        if chunk_ids is None and doc_ids is None and filters is None:
            return 0
        gone = F.lit(True) if namespace is None else F.col("namespace") == namespace
        if chunk_ids is not None:
            gone = gone & F.col("chunk_id").isin(chunk_ids)
        if doc_ids is not None:
            gone = gone & F.col("doc_id").isin(doc_ids)
        gone = gone & matches(F.col("metadata"), {**(filters or {}), **({"tenant_id": self.tenant} if self.tenant else {})})
        held = self.everything()
        n = held.where(gone).count()
        if n:
            self._replace(held.where(~F.coalesce(gone, F.lit(False))), self._last()[1])
        return n

    def clear(self, namespace: str | None = None) -> None:
        """Empties a namespace, or the store; an empty store takes vectors of any length."""
        held = self.everything()
        self._replace(held.where("false") if namespace is None else held.where(F.col("namespace") != namespace), None if namespace is None else self._last()[1])

    def search(self, queries: DataFrame, k: int = 5, threshold: float | None = None, filters: dict | None = None, namespace: str | None = "") -> DataFrame:
        """query_id, rank, chunk_id, doc_id and score of the k best rows for each query (query_id, q); filters hold before the k are chosen."""
        held = self.rows(namespace).where(matches(F.col("metadata"), filters))
        scored = search.compared(held.select(F.col("chunk_id").alias("vec_id"), "embedding"), queries, self.metric, least=threshold, k=None if threshold is not None else k)
        best = search.top_k(scored, k).select("query_id", "rank", F.col("vec_id").alias("chunk_id"), "score")
        return best.join(held.select("chunk_id", "doc_id"), "chunk_id").select("query_id", "rank", "chunk_id", "doc_id", "score")

    def related(self, doc_id: str, k: int = 5, namespace: str | None = "") -> DataFrame:
        """The k chunks of other documents that are closest to any chunk of this one."""
        held = self.rows(namespace)
        asked = held.where(F.col("doc_id") == doc_id).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
        others = held.where(F.col("doc_id") != doc_id)
        scored = search.compared(others.select(F.col("chunk_id").alias("vec_id"), "embedding"), asked, self.metric, k=k)
        best = scored.groupBy("vec_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)
        return best.withColumnRenamed("vec_id", "chunk_id").join(others.select("chunk_id", "doc_id"), "chunk_id")

    def chunks_of(self, doc_id: str, namespace: str | None = "") -> DataFrame:
        return self.rows(namespace).where(F.col("doc_id") == doc_id)

    def documents(self, namespace: str | None = "") -> DataFrame:
        return self.rows(namespace).select("doc_id").distinct()

    def fetch(self, chunk_ids: DataFrame, namespace: str | None = "") -> DataFrame:
        return rows.fetch(self.rows(namespace), chunk_ids, "chunk_id")

    def __contains__(self, chunk_id: str) -> bool:
        return not self.rows(None).where(F.col("chunk_id") == chunk_id).isEmpty()

    def __len__(self) -> int:
        return self.rows(None).count()

    def stats(self) -> DataFrame:
        """namespace, chunks, documents and dim; the last row, of a null namespace, is the whole store."""
        return self.rows(None).groupingSets([["namespace"], []], "namespace").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.max(F.size("embedding")).alias("dim"))

    def save(self, path: str) -> None:
        """Copies the rows and the vectors' length to another place, where ``Store`` reads them."""
        Store(self.spark, path, self.metric)._replace(self.everything(), self._last()[1])


def unit(chunks: DataFrame) -> DataFrame:
    """``chunks`` with embeddings of length one, as inner products on unit vectors need; zero vectors stay."""
    return chunks.withColumn("embedding", vx.normalised(F.col("embedding")))
