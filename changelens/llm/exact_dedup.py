"""Exact deduplication by a heavy-hitter split, with DataFrame functions only.

A Misra-Gries style frequent-items summary of fixed size (``approx_top_k``) proposes the digests that many rows
share. Their groups are counted exactly and their winners, at most ``top`` rows, are broadcast:
rows with such a digest are settled on the map side and never shuffled. All other digests go through an ordinary
hash shuffle, where no group can be larger than the summary's error bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: The characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 1024, tracked: int = 8192) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with most code points stays, then the one with the smallest id. Null text equals empty
    text. A null id loses against any id. Rows repeated in full have one id, so they are kept or dropped together
    and count one by one in ``group_size``. An empty table gives an empty result; other columns are not looked at.

    ``top`` bounds the broadcast winners, ``tracked`` the summary; both are independent of the input's size.
    """
    digests = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
            F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
        ),
        "digests",
    )
    # one's complement reverses the order of ids without overflow
    best = F.max(F.struct("points", F.bitwise_not("id").alias("rev")))
    frequent = digests.select(F.xxhash64("digest").alias("key")).agg(F.expr(f"approx_top_k(key, {top}, {tracked})").alias("found"))
    candidates = frequent.select(F.explode("found").alias("f")).select(F.col("f.item").alias("key"))
    heavy = (
        digests.withColumn("key", F.xxhash64("digest"))
        .join(F.broadcast(candidates), "key", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .select("digest", "group_size", F.bitwise_not("best.rev").alias("keep_id"))
    )
    winners = materialize(heavy, "winners")
    settled = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("keep_id", F.bitwise_not(best.over(group)["rev"]))
    )
    columns = ["digest", "id", "points", "group_size", "keep_id"]
    return settled.select(*columns).unionByName(rest.select(*columns)).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: DuckDB SQL for the query over ``documents``.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
