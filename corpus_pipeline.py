"""A training corpus in five stages: quality, repeated lines, near copies, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next one's
documents. Decisions are applied where the text is, or to the few rows that a bitmap of ids lets through, so whole
texts are shuffled only where they change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import line_dedup, mixing, ngram_join, packing, quality, textkit
from changelens.llm.scratch import fresh, materialize, probably_in, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score as high quality is at least a half; all columns as they are."""
    labels = table(spark, sf_dir, "labels")
    known = labels.where("quality in (0, 1)")
    rows = known.count()
    share = min(1.0, quality.SAMPLE_ROWS / max(1, rows))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    seen = quality.document_statistics(probably_in(docs, known.select("doc_id"), "doc_id"))
    model = quality.fit(materialize(seen, "labelled"), known, F.lit(True))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textkit.chunks(batch.column(at)):
                good = model.predict(quality.statistics(data, offsets)) >= 0.5
                yield batch.slice(first, last - first).filter(pa.array(good))

    return docs.mapInArrow(textkit.tidy(keep), docs.schema)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that has nothing left repeats others in full and goes."""
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked texts the one with the smallest id; of rows equal in id and text, one.

    Rows that repeat an id with different texts count as documents of their own. Rows without an id all stay.
    """
    again, row, own_id, touched = fresh(docs.columns, "_again", "_row", "_doc", "_touched")
    named = docs.where(F.col("doc_id").isNotNull())
    repeated = materialize(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    marked = named.withColumn(again, F.lit(False)) if repeated.isEmpty() else probably_in(named, repeated, "doc_id", flag=again)
    marked = marked.withColumn(row, F.when(F.col(again), F.xxhash64("doc_id", F.col("text").isNull(), "text")).otherwise(F.col("doc_id").cast("long")))
    groups = ngram_join.similar_groups(marked.select(row, "text"), row).where(F.col("component_id") != F.col(row)).select(F.col(row).alias("row"), "component_id").distinct()
    groups = materialize(groups, "components")
    members = groups.unionByName(groups.select(F.col("component_id").alias("row"), "component_id").distinct())
    own = materialize(marked.where(again).select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias(own_id)).distinct(), "own-rows")
    place = F.struct(F.coalesce(own_id, "row").alias("doc"), "row")
    members = members.join(own, "row", "left").select("row", "component_id", place.alias("place"))
    best = members.groupBy("component_id").agg(F.min("place").alias("best"))
    worse = materialize(members.join(best, "component_id").where("place <> best").select(F.col("row").alias(row)), "worse")
    flagged = probably_in(marked, worse.unionByName(own.select(F.col("row").alias(row))), row, flag=touched)
    untouched = flagged.where(~F.col(touched)).select(*docs.columns)
    some = flagged.where(touched).select(*docs.columns, row).join(worse, row, "left_anti").dropDuplicates([row]).select(*docs.columns)
    return untouched.unionByName(some).unionByName(docs.where(F.col("doc_id").isNull()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents."""
    decided = mixing.decide(docs)
    return decided.where(F.col(decided.columns[-1])["sampled"]).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("ngram_join", near_copy_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL cannot express trained trees, groups of similar lines and tokens; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
