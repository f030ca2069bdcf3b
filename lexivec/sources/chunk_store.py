"""A stored table of chunks that an ingest brings up to date by what has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec import schemas
from lexivec.operators.chunk import recursive_chunks
from lexivec.sources.folders import materialize, remove, scratch

#: Partitions of a new store: the unit that an ingest rewrites. It should grow with the corpus.
BUCKETS = 64


#: Ids that are few enough to be sent to all tasks.
FEW = 100_000


def _small(ids: DataFrame, n: int) -> DataFrame:
    """ids, to be broadcast if there are few."""
    return F.broadcast(ids) if n <= FEW else ids


class ChunkStore:
    """Two Parquet tables in a folder, both partitioned by a hash of doc_id: `chunks` (schemas.CHUNK) and `documents`
    (doc_id, digest, n_chunks). One writer at a time.

    An ingest writes chunks first and digests last, so that one which stops between leaves documents that still look changed;
    the next one does them again and ends in the same tables."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, chunker: Callable[[DataFrame], DataFrame] = recursive_chunks):
        self.spark, self.folder, self.buckets, self.chunker = spark, folder.rstrip("/"), buckets, chunker

    def _read(self, name: str, schema: str) -> DataFrame:
        full = f"{schema}, bucket int"
        try:
            return self.spark.read.schema(full).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], full)

    def chunks(self) -> DataFrame:
        """The chunks of all documents; a store without any is empty."""
        return self._read("chunks", schemas.CHUNK).drop("bucket")

    def documents(self) -> DataFrame:
        """(doc_id, digest, n_chunks) of all documents, those without a chunk too."""
        return self._read("documents", "doc_id string, digest string, n_chunks int").drop("bucket")

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def compare(self, docs: DataFrame, whole: bool = True) -> DataFrame:
        """(doc_id, digest, status, bucket) of docs (doc_id, text) against the store: new, changed, same, and, if docs are the whole
        corpus, gone. doc_ids are unique and not null; a null text is an empty one."""
        now = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
        held = self.documents().select("doc_id", F.col("digest").alias("old"))
        status = F.when(F.col("old").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("old") != F.col("digest"), "changed").otherwise("same")
        return now.join(held, "doc_id", "full_outer" if whole else "left").select("doc_id", "digest", status.alias("status"), self._bucket().alias("bucket"))

    def ingest(self, docs: DataFrame, limit: int | None = None, dry_run: bool = False) -> dict[str, int]:
        """Makes the store that of docs (doc_id, text) and counts documents by status; a dry run only counts.

        Only documents that are new or changed are chunked, and only the partitions of documents that are not the same are
        written. With a limit the first documents by id are ingested and no other is gone; 0 or None is all."""
        if limit:
            docs = docs.orderBy("doc_id").limit(limit)
        with scratch(self.spark):
            found = materialize(self.compare(docs, whole=not limit))
            counts = dict.fromkeys(("new", "changed", "same", "gone"), 0) | {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
            touched = found.where("status != 'same'").select("bucket").distinct()
            counts["partitions"] = touched.count()  # at most `buckets`
            if dry_run or not counts["partitions"]:
                return counts
            fresh = found.where("status in ('new', 'changed')").select("doc_id", "digest", "bucket")
            n_fresh, n_old = counts["new"] + counts["changed"], counts["changed"] + counts["gone"]
            texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
            if counts["same"]:  # else all texts are chunked, and none has to be looked up
                texts = texts.join(_small(fresh.select("doc_id"), n_fresh), "doc_id", "left_semi")
            columns = [c.name for c in self.spark.createDataFrame([], schemas.CHUNK).schema] + ["bucket"]
            made = materialize(self.chunker(texts).withColumn("bucket", self._bucket()).select(*columns))
            old = _small(found.where("status in ('changed', 'gone')").select("doc_id"), n_old)

            def kept(name: str, schema: str) -> DataFrame:
                """What stays in the partitions that are written; apart, as a table can't be read while it is overwritten."""
                return materialize(self._read(name, schema).join(F.broadcast(touched), "bucket", "left_semi").join(old, "doc_id", "left_anti"))

            rows = made.unionByName(kept("chunks", schemas.CHUNK).select(*columns))
            sizes = made.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
            noted = fresh.join(sizes, "doc_id", "left").select("doc_id", "digest", F.coalesce("n", F.lit(0)).alias("n_chunks"), "bucket")
            digests = noted.unionByName(kept("documents", "doc_id string, digest string, n_chunks int").select("doc_id", "digest", "n_chunks", "bucket"))
            for name, table in (("chunks", rows), ("documents", digests)):
                # A partition that is left without rows is not overwritten but removed.
                empty = [r["bucket"] for r in touched.join(table.select("bucket").distinct(), "bucket", "left_anti").collect()]
                table.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")
                for bucket in empty:
                    remove(self.spark, f"{self.folder}/{name}/bucket={bucket}")
        return counts
