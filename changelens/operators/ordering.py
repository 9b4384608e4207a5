"""Ranks and exact quantiles over whole tables, without a task that sees a whole group.

Both cut the order into ranges that many tasks hold, count the rows of each range, and add up the counts of the ranges
before; only these counts, a bounded number, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Ranges of values per column; the share of a group's distinct values that one task sees is about one in so many.
RANGES = 128


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "ix") -> DataFrame:
    """Adds the row's place (from 0) in ``order``, which must not leave ties, as ``name``.

    Rows are dealt out by ranges of the order and sorted there; a place is the rows of the ranges before, and the row's own number in its range.
    """
    tagged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    tagged = written(tagged, "numbered").withColumn("_range", F.shiftrightunsigned("_at", 33))
    sizes = tagged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return tagged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_range", "_before")


def quantiles(df: DataFrame, sets: Sequence[Sequence[str]], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Exact interpolated quantiles of several columns under several key sets.

    ``wanted`` maps a column to the names of its quantiles and their levels. Gives the keys of all sets (null outside a
    row's set), ``_set`` (the number of the set) and one column per name; null where a group has no value.

    Values are counted per group first, so equal values cost one row. Cut points from an approximate summary of the
    values (RANGES per column, whatever its error) deal the counts into ranges. Range totals show in which range a
    quantile's two neighbours lie, and only these ranges are put in order.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in wanted]))
    rows = df.select(*keys, each.alias("x")).where("x.v is not null").select(*keys, "x.c", "x.v")
    in_set = F.array(*[F.struct(F.lit(i).alias("_set"), *[(F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys]) for i, s in enumerate(sets)])
    counts = rows.groupBy(*keys, "c", "v").agg(F.count(F.lit(1)).alias("n"))  # combined before anything is repeated per set
    group = ["_set", *keys, "c"]
    counts = counts.select(F.explode(in_set).alias("s"), "c", "v", "n").select("s.*", "c", "v", "n").groupBy(*group, "v").agg(F.sum("n").alias("n"))
    counts = written(counts, "value-counts")
    place = F.lit(0)
    for c in wanted:
        cuts = sorted({float(p) for p in counts.where(F.col("c") == c).approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)})
        below = F.aggregate(F.array(*[F.lit(x) for x in cuts]).cast("array<double>"), F.lit(0), lambda acc, x: acc + (F.col("v") > x).cast("int"))
        place = F.when(F.col("c") == c, below).otherwise(place)
    counts = counts.withColumn("range", place)
    own = Window.partitionBy(*group)
    ranges = counts.groupBy(*group, "range").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumn("before", F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("all", F.sum("n").over(own))
    levels = F.create_map(*[x for c, of in wanted.items() for x in (F.lit(c), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in of.items()]))])
    asked = ranges.select(*group, "range", "before", "n", F.explode(levels[F.col("c")]).alias("l"), "all").withColumn("at", (F.col("all") - 1) * F.col("l.q"))
    ends = F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))
    asked = asked.select(*group, "range", "before", "n", "l.name", "at", ends.alias("end")).where("end >= before and end < before + n")
    asked = asked.drop("n")
    place_keys = [*group, "range"]
    same = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in place_keys])
    inside = counts.alias("x").join(asked.select(*place_keys).distinct().alias("y"), same, "left_semi")
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*place_keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    met = asked.alias("x").join(inside.alias("y"), same).where("x.end - x.before < y.upto and x.end - x.before >= y.upto - y.n")
    met = met.select(*[F.col(f"x.{k}") for k in group], "x.name", "x.at", "x.end", "y.v")
    low, high = F.floor("at"), F.ceil("at")
    value = lambda end: F.max(F.when(F.col("end") == end, F.col("v")))
    both = met.groupBy(*group, "name", "at").agg(value(low).alias("lo"), value(high).alias("hi"))
    mixed = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((high - F.col("at")) * F.col("lo") + (F.col("at") - low) * F.col("hi"))
    names = [n for of in wanted.values() for n in of]
    return both.withColumn("value", mixed).groupBy("_set", *keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
