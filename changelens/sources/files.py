"""Reading and writing change records: strict JSON lines, several archives, CSV, Parquet, ordered exports, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_bad"


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Records, and the lines that are no record (bad JSON, no object, blank) with their file.

    Lines end at "\\n" only, since other Unicode line ends are legal inside strings. ``.gz`` files are read as they
    are but cannot be split; ``land`` them once.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("r", F.from_json("value", schema + f", {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    wrong = F.col(f"r.{BAD}").isNotNull() | F.col("r").isNull() | ~F.ltrim("value").startswith("{")
    good = parsed.where(~wrong).select("r.*", F.col("file").alias("source_file")).drop(BAD)
    return good, parsed.where(wrong).select("file", "value")


def require_clean(bad: DataFrame) -> None:
    """Raises with a few examples if there is any bad line."""
    some = bad.limit(3).collect()
    if some:
        raise ValueError("lines that are no record: " + "; ".join(f"{r['file']}: {(r['value'] or '')[:80]}" for r in some))


def read_repositories(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One folder per repository (owner__name); adds ``folder_matches``: whether the record's repository is its folder's."""
    good, _ = read_json_lines(spark, glob, schema)
    folder = F.replace(F.element_at(F.split("source_file", "/"), -2), F.lit("__"), F.lit("/"))
    return good.withColumn("folder_matches", F.coalesce(folder == F.col("repository.nameWithOwner"), F.lit(False)))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def land(df: DataFrame, path: str, partitions: int, keys: Sequence[str] = ()) -> None:
    """Evenly sized zstd Parquet, ready for split scans; ``keys`` become partition folders."""
    spread = df.repartition(partitions, *keys) if keys else df.repartition(partitions)
    writer = spread.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("compression", "gzip" if gzip else "none").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def export_ordered(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines in a total order over all part files; the commit protocol replaces the old export as a whole."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of whole files; for files under 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_fingerprint(spark: SparkSession, path: str, by_file: bool = True) -> DataFrame:
    """``file, lines, checksum``: independent of how large files are split; the same lines in any order give the same.

    Without ``by_file`` all files together give one row, the same however their lines are dealt over them.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.xxhash64("value").alias("h"))
    sums = lines.groupBy("file" if by_file else F.lit("all").alias("file")).agg(F.count(F.lit(1)).alias("lines"), F.bit_xor("h").alias("mixed"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("added"))
    return sums.select("file", "lines", F.concat_ws(":", "mixed", "added").alias("checksum"))


def unchanged(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> bool:
    return before.select(*columns).exceptAll(after.select(*columns)).isEmpty() and after.select(*columns).exceptAll(before.select(*columns)).isEmpty()


def latest_labels(spark: SparkSession, path: str, schema: str, key: str = "request_id") -> DataFrame:
    """Accepted records of append-only label files, the last written per key; bad lines are skipped."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    rows = raw.withColumn("r", F.from_json("value", schema)).where(F.col("r.status") == "ok").where(F.col(f"r.{key}").isNotNull())
    last = F.max_by("r", F.struct("r.labeled_at", "f", "b", "m"))
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(last.alias("r")).select("r.*")


def normalise_census(df: DataFrame) -> DataFrame:
    """Census documents in the shape of cross-repository ones: a plain file list and a truncation map."""
    cut = F.coalesce(F.col("files.pageInfo.hasNextPage"), F.lit(True)) | ~F.col("files.totalCount").eqNullSafe(F.size("files.nodes"))
    truncated = F.create_map(F.lit("files"), cut)
    return df.withColumn("collection", F.struct(truncated.alias("truncated"))).withColumn("files", F.col("files.nodes"))
