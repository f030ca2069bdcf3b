"""Readers and writers of corpora, manifests, JSON lines and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec import schemas
from lexivec.functions import text as T
from lexivec.sources.folders import materialize


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pos, number, title, cluster, base) of each entry of a manifest, one JSON document."""
    whole = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    return whole.select("source_base_url", F.posexplode("rfcs").alias("pos", "e")).select("pos", "e.number", "e.title", "e.cluster", F.col("source_base_url").alias("base"))


def manifest_positions(sources: DataFrame) -> DataFrame:
    """(source, source_pos) of a list of sources, by name; a manifest lists sources, not documents.

    Names are sorted in ranges, and a range is numbered from the count of those before it, so that no row or task has all."""
    sorted_ = materialize(sources.where("source is not null").select("source").distinct().sort("source").select("source", F.monotonically_increasing_id().alias("_id")))
    part, here = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_.join(before, part == F.col("_part")).select("source", (F.col("_before") + here).alias("source_pos"))


def read_source_docs(spark: SparkSession, manifest: DataFrame, folder: str, limit: int | None = None) -> DataFrame:
    """(pos, doc_id, title, source_uri, text) of the texts that the manifest lists, cleaned; a missing file is an error.

    limit 0 or None is all, a negative one leaves out as many at the end."""
    if limit:
        n = limit if limit > 0 else manifest.count() + limit
        manifest = manifest.where(F.col("pos") < n)
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(
        F.regexp_extract(F.col("_metadata.file_name"), r"rfc(\d+)\.txt$", 1).alias("name"), F.col("value").alias("text")
    )
    files = files.where("name != ''").withColumn("number", F.col("name").cast("int"))
    missing = [r["number"] for r in manifest.join(files, "number", "left_anti").select("number").orderBy("number").take(10)]
    if missing:
        raise FileNotFoundError(f"no text for {missing}")
    name = F.concat(F.lit("rfc"), F.col("number").cast("string"))
    return manifest.join(files, "number").select("pos", name.alias("doc_id"), "title", F.concat("base", name, F.lit(".txt")).alias("source_uri"), T.clean(F.col("text")).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), missing_ok: bool = False) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are skipped, malformed ones and nulls in required columns are errors."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path) from None
    for c in required:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    return rows


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def verified(files: DataFrame, number: str, content: str, min_bytes: int) -> DataFrame:
    """files with error: why a payload (binary) is not the text it should be, or null."""
    size = F.octet_length(content)
    head = F.decode(F.substring(content, 1, 4000), "UTF-8") if files.schema[content].dataType.simpleString() == "binary" else F.substring(content, 1, 4000)
    n = F.col(number).cast("string")
    named = F.contains(head, F.concat(F.lit("RFC "), n)) | F.contains(head, F.concat(F.lit("Request for Comments: "), n))
    return files.withColumn(
        "error",
        F.when(size < min_bytes, F.format_string("too small (%d bytes) - likely an error page", size)).when(~named, F.concat(F.lit("header does not name RFC "), n)),
    )


def provenance(files: DataFrame, key: str, content: str, min_bytes: int) -> DataFrame:
    """(key, bytes, sha256, status) of each file: skipped-exists if it is large enough, else failed."""
    size = F.octet_length(content).cast("bigint")
    return files.select(key, size.alias("bytes"), F.sha2(content, 256).alias("sha256"), F.when(size >= min_bytes, "skipped-exists").otherwise("failed").alias("status"))


def provenance_totals(rows: DataFrame) -> DataFrame:
    """One row: count, bytes, and how many were fetched, skipped and failed."""
    def n(status: str):
        return F.count_if(F.col("status") == status)

    return rows.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), n("fetched").alias("fetched"), n("skipped-exists").alias("skipped"), n("failed").alias("failed"))


def integrity(manifest: DataFrame, files: DataFrame, on: str, error: str = "error") -> DataFrame:
    """(on, problem): MISSING for entries without a file, BAD for those whose file has an error."""
    missing = manifest.select(on).join(files.select(on), on, "left_anti").select(on, F.lit("MISSING").alias("problem"))
    bad = manifest.select(on).join(files, on).where(F.col(error).isNotNull()).select(on, F.concat(F.lit("BAD: "), F.col(error)).alias("problem"))
    return missing.unionByName(bad)


def first_seen(rows: DataFrame, by: str, order: str) -> DataFrame:
    """One row for each key, the first by order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_rank = 1").drop("_rank")
