"""Fixed and adaptive time windows over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(spark: SparkSession, start: str, end: str, hours: int) -> DataFrame:
    """``start_at, end_at`` of half-open windows that cover [start, end); the last one is clipped."""
    first, last = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    starts = F.explode(F.sequence(first, last, F.expr(f"interval {hours} hours"))).alias("start_at")
    grid = spark.range(1).select(starts).where(F.col("start_at") < last)
    return grid.select("start_at", F.least(F.col("start_at") + F.expr(f"interval {hours} hours"), last).alias("end_at"))


def tumbling_counts(events: DataFrame, when: str, start: str, end: str, hours: int) -> DataFrame:
    """``start_at, n`` for every window, empty ones too; assignment is a division, not a join on a range."""
    first = F.unix_micros(F.to_timestamp(F.lit(start)))
    width = F.lit(hours * 3_600_000_000)
    at = F.unix_micros(F.col(when).cast("timestamp"))
    inside = events.where((F.col(when).cast("timestamp") >= F.to_timestamp(F.lit(start))) & (F.col(when).cast("timestamp") < F.to_timestamp(F.lit(end))))
    counts = inside.select(F.timestamp_micros(first + F.floor((at - first) / width).cast("long") * width).alias("start_at")).groupBy("start_at").agg(F.count(F.lit(1)).alias("n"))
    return tumbling(events.sparkSession, start, end, hours).join(counts, "start_at", "left").select("start_at", "end_at", F.coalesce("n", F.lit(0)).alias("n"))


def adaptive(events: DataFrame, when: str, start_s: int, end_s: int, threshold: int, least_s: int) -> DataFrame:
    """Leaves ``start_s, end_s, n, truncated`` of the span in epoch seconds: a window with more than ``threshold`` events
    that is longer than ``least_s`` is cut at its integer midpoint, again and again; dense leaves are ``truncated``.

    Where windows may be cut is known beforehand, so each second names all windows that hold it, one per level, and a
    single grouped sum counts them all. Counts and lengths only grow upwards, hence a window exists if its parent is
    to be split; no level waits for another.
    """
    levels, longest = 0, end_s - start_s
    while longest > least_s:
        longest, levels = longest - longest // 2, levels + 1
    second = F.floor(F.unix_micros(F.col(when).cast("timestamp")) / 1_000_000).cast("long")
    seconds = events.select(second.alias("s")).where(F.col("s").between(start_s, end_s - 1)).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    window = F.struct(F.lit(start_s).cast("long").alias("lo"), F.lit(end_s).cast("long").alias("hi"))

    def half(acc, _):
        mine = F.element_at(acc, -1)
        middle = mine["lo"] + F.floor((mine["hi"] - mine["lo"]) / 2).cast("long")
        low = F.col("s") < middle
        return F.concat(acc, F.array(F.struct(F.when(low, mine["lo"]).otherwise(middle).alias("lo"), F.when(low, middle).otherwise(mine["hi"]).alias("hi"))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(window), half) if levels else F.array(window)
    counts = seconds.select("c", F.explode(path).alias("w")).groupBy("w.lo", "w.hi").agg(F.sum("c").alias("n"))
    wide = F.col("hi") - F.col("lo") > least_s
    split = counts.where((F.col("n") > threshold) & wide)
    middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("long")
    halves = split.select(F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))).alias("w")).select("w.*")
    whole = events.sparkSession.createDataFrame([(start_s, end_s)], "lo long, hi long")
    found = whole.unionByName(halves).join(counts, ["lo", "hi"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.where(~((F.col("n") > threshold) & wide)).select(F.col("lo").alias("start_s"), F.col("hi").alias("end_s"), "n", (F.col("n") > threshold).alias("truncated"))
