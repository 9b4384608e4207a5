"""Facts about written files that do not depend on how Spark splits them: checksums in order, breaks of order; pinned appends."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A prime below which all products fit twice, and the base of the polynomial.
PRIME, BASE = (1 << 61) - 1, 1_000_003


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, start, m``: lines, the split that holds them, and a number that rises within it."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"))


def joined_checksum(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(lines, checksum) of two runs of lines, one after the other."""
    return left[0] + right[0], (left[1] * pow(BASE, right[0], PRIME) + right[1]) % PRIME


def ordered_checksum(spark: SparkSession, path: str, by_file: bool = True) -> DataFrame:
    """``file, lines, checksum``: of the lines in their order, whatever the size of files and splits.

    Each split is one pass over its lines, in the order in which Spark reads them; splits are joined by their number of
    lines. Two exchanged lines, or one line moved, change the sum. Without ``by_file`` the files count as one text, in the
    order of their names. Files of any size; an empty folder gives no rows.
    """
    rows = lines_in_order(spark, path).select("file", "start", F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 15), 16, 10).cast("long").alias("h"))

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, total = None, 0, 0
        names = ["file", "start", "lines", "checksum"]
        for batch in batches:
            for file, start, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != own:
                    if own is not None:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, ([own[0]], [own[1]], [n], [total]), strict=True)))
                    own, n, total = (file, start), 0, 0
                n, total = n + 1, (total * BASE + h) % PRIME
        if own is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([own[0]], [own[1]], [n], [total]), strict=True)))

    def join(parts: pd.DataFrame) -> pd.DataFrame:  # one row a split
        parts = parts.sort_values(["file", "start"])
        found = (0, 0)
        for n, total in zip(parts["lines"].tolist(), parts["checksum"].tolist(), strict=True):
            found = joined_checksum(found, (n, total))
        return pd.DataFrame({"file": [parts["file"].iloc[0] if by_file else "all"], "lines": [found[0]], "checksum": [found[1]]})

    each = rows.mapInArrow(splits, "file string, start long, lines long, checksum long")
    return each.groupBy("file" if by_file else F.lit("all")).applyInPandas(join, "file string, lines long, checksum long")


def order_violations(spark: SparkSession, path: str, key: Callable[[Column], Column]) -> DataFrame:
    """One row, ``lines, violations``: neighbouring lines, across part files too, whose ``key`` falls.

    Inside a split neighbours are compared where they are; of each split only the first and last key go on, in the order
    of files and splits, so files are never brought together. A line without a key counts as a violation.
    """
    rows = lines_in_order(spark, path).select("file", "start", "m", key(F.col("value")).alias("k"))
    own = Window.partitionBy("file", "start").orderBy("m")
    inside = rows.withColumn("down", (F.lag("k").over(own) > F.col("k")) | F.col("k").isNull())
    ends = inside.groupBy("file", "start").agg(F.count(F.lit(1)).alias("lines"), F.count_if("down").alias("down"), F.min_by("k", "m").alias("first"), F.max_by("k", "m").alias("last"))
    seams = ends.withColumn("seam", F.coalesce(F.lag("last").over(Window.orderBy("file", "start")) > F.col("first"), F.lit(False)))  # one row a split
    return seams.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("down") + F.count_if("seam"), F.lit(0)).alias("violations"))


class ParametersDiffer(ValueError):
    """Rows were to be appended under other parameters than those of the data set."""


def pin(spark: SparkSession, path: str, parameters: dict[str, str]) -> None:
    """Makes ``parameters`` those of the data set at ``path``, or compares them with what it was begun with.

    The file is created only if it is absent, in one call of the file system, so of two writers that begin at once one
    wins and the other is compared with it.
    """
    text = json.dumps(parameters, sort_keys=True, ensure_ascii=True)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_parameters/{'pinned.json'}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(target, False)
        try:
            out.write(bytearray(text, "ascii"))
        finally:
            out.close()
        return
    except Exception as error:  # noqa: BLE001
        if not fs.exists(target):
            raise error
    have = spark.read.option("wholetext", True).text(target.toString()).first()
    if have is None or have["value"] != text:
        before = json.loads(have["value"]) if have else {}
        names = sorted(k for k in {*before, *parameters} if before.get(k) != parameters.get(k))
        raise ParametersDiffer(f"{path} was begun with other parameters: {', '.join(names)}")


def append_pinned(df: DataFrame, path: str, parameters: dict[str, str]) -> None:
    """Appends Parquet rows to a data set whose parameters are these; with others it fails before any row is written."""
    pin(df.sparkSession, path, parameters)
    df.write.mode("append").parquet(f"{path}/rows")


def pinned_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def changed_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = 4096) -> DataFrame:
    """``keys, column, left_value, right_value`` of all cells that differ between two formulations of one table (as text).

    Rows fall into buckets by their key, and each side's buckets get a checksum, combined before it is shuffled. Only rows of
    buckets whose checksums differ are joined, so where both agree no row moves. A row that one side lacks differs in every
    column. Keys are unique on each side and not null.
    """
    tag = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    typed = lambda df: df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns], tag.alias("_bucket"))
    a, b = typed(left), typed(right)
    row = F.xxhash64(*keys, *[F.struct(F.col(c).isNull(), c) for c in columns])
    sums = lambda df, side: df.groupBy("_bucket").agg(F.count(F.lit(1)).alias(f"n_{side}"), F.bit_xor(row).alias(f"x_{side}"), F.sum(F.shiftright(row, 24)).alias(f"s_{side}"))
    unlike = sums(a, "l").join(sums(b, "r"), "_bucket", "full")
    unlike = unlike.where(~(F.col("n_l").eqNullSafe(F.col("n_r")) & F.col("x_l").eqNullSafe(F.col("x_r")) & F.col("s_l").eqNullSafe(F.col("s_r")))).select("_bucket")
    only = lambda df: df.join(F.broadcast(unlike), "_bucket", "left_semi").drop("_bucket")  # noqa: E731  at most ``buckets`` rows
    x = only(a).select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    y = only(b).select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    lost = F.col("_l").isNull() | F.col("_r").isNull()
    cells = F.array_compact(F.array(*[F.when(lost | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value"))) for c in columns]))
    return x.join(y, list(keys), "full").select(*keys, F.explode(cells).alias("d")).select(*keys, "d.*")
