"""The store of scored items and runs: keyed Parquet tables under one folder, with one writer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec import schemas
from lexivec.operators.evaluate import last_written


class Store:
    """Upserts append rows with a growing sequence number; readers see the last row of each key, compact() keeps only it.

    Appends are partitioned by git_sha, so a scan of one run reads its folder alone, and by batch, so that a batch of a stream
    that is written again takes the place of what it wrote before. A failed append leaves no rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        full = f"{schema}, seq bigint"
        try:
            return self.spark.read.schema(full).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], full)

    def _last(self, name: str, schema: str) -> int:
        return self._read(name, schema).agg(F.max("seq")).first()[0] or 0

    def _append(self, rows: DataFrame, name: str, schema: str, batch: str | None = None, seq: int | None = None) -> None:
        """Writes rows with the next sequence number, or as the named batch with its own."""
        seq = seq or self._last(name, schema) + 1
        kinds = self.spark.createDataFrame([], schema).schema
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds]
        out = rows.select(*cols).withColumns({"seq": F.lit(seq).cast("bigint"), "batch": F.lit(batch or uuid.uuid4().hex)}).write
        out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if batch else out.mode("append")
        out.partitionBy("git_sha", "batch").parquet(f"{self.folder}/{name}")

    def upsert_items(self, items: DataFrame) -> None:
        """Items replace those with their (git_sha, question); of equal keys in one call one is kept."""
        self._append(items.dropDuplicates(["git_sha", "question"]), "eval_items", schemas.SCORED_ITEM)

    def _entry(self, stream: str, number: int, kind: str) -> str:
        return f"{self.folder}/ledger/{stream}/{number}/{kind}"

    def _noted(self, path: str) -> int | None:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema("seq bigint").parquet(path).collect()
        except AnalysisException:
            return None
        return rows[0]["seq"] if rows else None

    def upsert_batch(self, stream: str, number: int, items: DataFrame) -> bool:
        """Upserts a batch of a stream once, however often it comes; whether it did anything.

        A ledger notes the batch's sequence number before its items are written and that they are, after. A batch that is
        noted as written is left out. One that stopped between is written again under the number that it had, in place of
        what it left. Items with an error are not upserted, so that a resumed run has them to do."""
        if self._noted(self._entry(stream, number, "written")) is not None:
            return False
        seq = self._noted(self._entry(stream, number, "begun"))
        if seq is None:
            # Batches of a stream come one by one; one that stopped may have left a number without items.
            seq = self._last("eval_items", schemas.SCORED_ITEM) + 1
            self._note(stream, number, "begun", seq)
        if "error" in items.columns:
            items = items.where("error is null")
        self._append(items.dropDuplicates(["git_sha", "question"]), "eval_items", schemas.SCORED_ITEM, f"{stream}-{number}", seq)
        self._note(stream, number, "written", seq)
        return True

    def _note(self, stream: str, number: int, kind: str, seq: int) -> None:
        self.spark.createDataFrame([(seq,)], "seq bigint").coalesce(1).write.mode("overwrite").parquet(self._entry(stream, number, kind))

    def upsert_stream(self, items: DataFrame, stream: str, checkpoint: str):
        """A started query that upserts a stream of scored items (schemas.SCORED_ITEM, and error if there is one) and stops
        after what there is. `stream` names it in the ledger: a query that replays batches, because its checkpoint was lost
        or its last commit was, changes nothing. Batches must hold the same items when they come again, as those of
        file sources do."""
        return items.writeStream.foreachBatch(lambda rows, number: self.upsert_batch(stream, number, rows) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def items(self, git_sha: str | None = None) -> DataFrame:
        rows = self._read("eval_items", schemas.SCORED_ITEM)
        rows = rows if git_sha is None else rows.where(F.col("git_sha") == git_sha)
        return last_written(rows, ["git_sha", "question"], "seq").drop("seq")

    def save_run(self, run: DataFrame, items: DataFrame) -> None:
        """Items take the run's id, also those reused from earlier runs; then the run itself."""
        run_id = run.first()["run_id"]
        self.upsert_items(items.withColumn("run_id", F.lit(run_id)))
        self._append(run, "eval_runs", schemas.RUN)

    def runs(self) -> DataFrame:
        return last_written(self._read("eval_runs", schemas.RUN), ["run_id"], "seq").drop("seq")

    def compact(self) -> str:
        """Writes the items without their history into a new folder and returns it; the caller swaps folders."""
        path = f"{self.folder}-{uuid.uuid4().hex[:8]}"
        self.items().withColumns({"seq": F.lit(1).cast("bigint"), "batch": F.lit("compacted")}).write.partitionBy("git_sha", "batch").parquet(f"{path}/eval_items")
        return path
