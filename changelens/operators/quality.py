"""Checks that report rows ``check, violations`` instead of stopping, and table comparison with tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows for which each rule is false or unknown, in one pass."""
    sums = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("violations")) for k in rules])).alias("r")).select("r.*")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows repeat a key that another row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit("unique_" + "_".join(keys)).alias("check"), "violations")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    lost = child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"orphan_{key}").alias("check"), "violations")


def additive(df: DataFrame, keys: Sequence[str], part: str, value: str, all_label: str) -> DataFrame:
    """Groups whose parts do not sum to the row labelled ``all_label``."""
    whole = F.sum(F.when(F.col(part) == all_label, F.col(value)))
    parts = F.sum(F.when(F.col(part) != all_label, F.col(value)))
    return df.groupBy(*keys).agg(whole.alias("whole"), parts.alias("parts")).where(~F.col("whole").eqNullSafe(F.col("parts")))


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field, left_value, right_value`` of all fields that differ, nulls being equal to each other."""
    joined = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields]).join(right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields]), key)
    text = lambda c: F.col(c).cast("string")
    rows = F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.struct(F.lit(f).alias("field"), text(f"l_{f}").alias("left_value"), text(f"r_{f}").alias("right_value"))) for f in fields]))
    return joined.select(key, F.explode(rows).alias("m")).select(key, "m.*")


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], rtol: float = 1e-9, atol: float = 1e-10) -> DataFrame:
    """Rows that one side lacks or whose numbers differ by more than atol + rtol * |right|: ``keys, column, l, r``."""
    a = left.select(*keys, *[F.col(v).cast("double").alias(f"l_{v}") for v in values], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(v).cast("double").alias(f"r_{v}") for v in values], F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full")

    def differs(v: str) -> Column:
        x, y = F.col(f"l_{v}"), F.col(f"r_{v}")
        return ~F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), x.isNull() & y.isNull()) | F.col("_l").isNull() | F.col("_r").isNull()

    rows = F.array_compact(F.array(*[F.when(differs(v), F.struct(F.lit(v).alias("column"), F.col(f"l_{v}").alias("l"), F.col(f"r_{v}").alias("r"))) for v in values]))
    return both.select(*keys, F.explode(rows).alias("d")).select(*keys, "d.*")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows only one side has, repeated rows counted."""
    only = left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_left")).crossJoin(right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_right")))
    return only


def pinned(existing: DataFrame, wanted: dict[str, str]) -> dict[str, tuple]:
    """Parameters (name, value) of a data set that differ from the wanted ones; empty if work may be appended."""
    have = {r["name"]: r["value"] for r in existing.where(F.col("name").isin(*wanted)).collect()}
    return {k: (have[k], v) for k, v in wanted.items() if k in have and have[k] != v}


def exclusion_ledger(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that no rule excludes, and every excluded row with ``reason``: the first rule, in order, that holds."""
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())
