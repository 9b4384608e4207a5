"""Extendible hashing into shards of bounded size, with DataFrame functions only.

A row's hash is a string of bits, and a shard is a prefix of it. The directory is found on grouped sums, never on
rows: bytes per hash are pre-aggregated on the map side, then buckets of ``d0`` bits (about one per shard) are merged
upward while the parent still fits, and only oversized buckets are split on one more bit at a time. Rows that share
every bit (equal ids) cannot be told apart by the directory; they go to overflow pages, so the limit still holds
unless a single row exceeds it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

BITS = 32
#: Bits looked at in one shuffle below the starting level; the next ones follow while oversized buckets are left.
STEP = 8


def hash_bits(key: Column) -> Column:
    """32 hash bits as a long; from md5, so that another engine can compute the same."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def bit_prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def extendible_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_bytes, depth, shard``; ``shard`` is "depth:prefix:page".

    Null text has no bytes; a null id hashes as the empty string. Rows with one id share a shard while it fits, else
    they go to pages of the deepest bucket: rows over half the limit alone, the others together up to the limit. A
    row larger than the limit is alone. An empty table gives an empty result; other columns are not looked at.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
            hash_bits(F.col(id_col)).alias("bits"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("n_bytes").alias("s")).first()["s"] or 0
    start = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit_bytes)))))
    keys = materialize(
        rows.groupBy("bits").agg(F.sum("n_bytes").alias("key_bytes"), F.count(F.lit(1)).alias("key_rows")).withColumn("cell", bit_prefix(F.col("bits"), start)),
        "shard-keys",
    )
    cells = keys.groupBy("cell").agg(F.sum("key_bytes").alias("bytes")).withColumn("depth", F.when(F.col("bytes") <= limit_bytes, F.lit(start)))
    cells = materialize(cells, "shard-cells")
    for level in range(start - 1, -1, -1):  # a parent can only fit where its children do, so this soon stops
        parent = F.shiftright(F.col("cell"), start - level)
        fitting = cells.groupBy(parent.alias("parent")).agg(F.sum("bytes").alias("parent_bytes")).where(F.col("parent_bytes") <= limit_bytes)
        if fitting.isEmpty():
            break
        cells = materialize(
            cells.withColumn("parent", parent).join(fitting.select("parent", F.lit(level).alias("fits")), "parent", "left").select("cell", "bytes", F.least("depth", "fits").alias("depth")),
            "shard-cells",
        )
    # below the starting level: one shuffle by cell serves the sums of the next STEP levels
    directory = keys.join(cells.where("depth is not null").select("cell", "depth"), "cell").select("bits", "depth", "key_rows")
    sized = materialize(keys.join(cells.where("depth is null").select("cell"), "cell"), "shard-oversized")
    while start < BITS and not sized.isEmpty():
        levels = range(start + 1, min(BITS, start + STEP) + 1)
        for level in levels:
            sized = sized.withColumn(f"b{level}", F.sum("key_bytes").over(Window.partitionBy("cell", bit_prefix(F.col("bits"), level))))
        split = F.coalesce(*[F.when(F.col(f"b{level}") <= limit_bytes, F.lit(level)) for level in levels])
        start = levels[-1]
        sized = materialize(sized.select("bits", "key_bytes", "key_rows", bit_prefix(F.col("bits"), start).alias("cell"), split.alias("depth")), "shard-split")
        directory = directory.unionByName(sized.where("depth is not null").select("bits", "depth", "key_rows"))
        sized = sized.where("depth is null").drop("depth")
    directory = materialize(directory.unionByName(sized.select("bits", F.lit(BITS + 1).alias("depth"), "key_rows")), "shard-directory")

    placed = rows.join(directory, "bits")
    bucket = placed.where(F.col("depth") <= BITS).withColumn("page", F.lit("0"))
    groups = F.greatest(F.lit(1), F.floor(F.col("key_rows") / 10_000)).cast("long")
    over = placed.where(F.col("depth") > BITS).withColumn("group", F.pmod(F.col("row"), groups))
    small = Window.partitionBy("bits", "group", "alone").orderBy("n_bytes", "row")
    over = (
        over.withColumn("alone", F.col("n_bytes") * 2 > limit_bytes)
        .withColumn("filled", F.sum("n_bytes").over(small.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("page", F.when(F.col("alone"), F.concat(F.lit("row"), F.col("row"))).otherwise(F.concat_ws("-", "group", F.floor(F.greatest(F.lit(0), F.col("filled") - 1) * 2 / limit_bytes))))
        .withColumn("depth", F.lit(BITS))
    )
    columns = ["id", "n_bytes", "depth", "bits", "page"]
    found = bucket.select(*columns).unionByName(over.select(*columns))
    number = F.expr(f"shiftright(bits, {BITS} - depth)")
    return found.select(F.col("id").alias(id_col), "n_bytes", F.col("depth").cast("int").alias("depth"), F.concat_ws(":", "depth", number, "page").alias("shard"))


def oracle(limit_bytes: int) -> str:
    """DuckDB SQL for the query over ``documents`` with unique ids."""
    return f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS bits
  FROM documents),
levels AS (
  SELECT d, bits >> (32 - d)::INT AS p, sum(n_bytes) AS s FROM r, (SELECT unnest(range(0, 33)) AS d) GROUP BY d, p),
best AS (
  SELECT r.doc_id, any_value(r.n_bytes) AS n_bytes, any_value(r.bits) AS bits, min(d)::INT AS depth
  FROM r JOIN levels ON p = bits >> (32 - d)::INT WHERE s <= {limit_bytes} GROUP BY r.doc_id)
SELECT doc_id, n_bytes, depth, concat_ws(':', depth, bits >> (32 - depth), '0') AS shard FROM best
"""
