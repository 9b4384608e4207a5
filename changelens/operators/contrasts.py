"""Matched-strata contrasts, fixed-weight standardisation, gap decomposition, and the inference on their results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import share
from ..sources.scratch import written
from . import ordering

#: Fixed value: the two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def matched_strata(df: DataFrame, keys: Sequence[str], arm: Column, value: str, kind: str = "log_median", least: int = 1) -> DataFrame:
    """Strata that hold both arms, with ``n_a, n_b, delta, weight``.

    ``arm`` is true for a, false for b, null for rows outside. ``log_median`` is the difference of log1p medians,
    ``rate`` the difference of a flag's rates in percentage points. ``least`` rows are needed in each arm.
    """
    rows = df.withColumn("_a", arm).where("_a is not null")
    of = lambda x: F.when(F.col("_a") == x, F.col(value))
    n = {x: F.count_if(F.col("_a") == x) for x in (True, False)}
    counts = [n[True].alias("n_a"), n[False].alias("n_b")]
    if kind == "log_median":
        rows = written(rows.select(*keys, "_a", value), "arms")
        medians = ordering.quantiles(rows, [[*keys, "_a"]], {value: {"_median": 0.5}})
        one = lambda x: F.max(F.when(F.col("_a") == x, F.log1p("_median")))
        deltas = medians.groupBy(*keys).agg((one(True) - one(False)).alias("delta"))
        same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
        strata = rows.groupBy(*keys).agg(*counts).alias("l").join(deltas.alias("r"), same, "left").select("l.*", "r.delta")
    else:
        delta = 100.0 * (F.count_if(of(True)) / n[True] - F.count_if(of(False)) / n[False])
        strata = rows.groupBy(*keys).agg(*counts, F.when(F.least(n[True], n[False]) > 0, delta).alias("delta"))
    return strata.where(F.least("n_a", "n_b") >= max(1, least)).withColumn("weight", F.col("n_a") + F.col("n_b"))


def within_repositories(strata: DataFrame, repository: str = "repository_id") -> DataFrame:
    """The weighted mean of the strata's deltas in each repository; repositories then weigh the same."""
    return within_repositories_by(strata, [repository])


def within_repositories_by(strata: DataFrame, keys: Sequence[str]) -> DataFrame:
    return strata.groupBy(*keys).agg((F.sum(F.col("delta") * F.col("weight")) / F.sum("weight")).alias("delta"), F.sum("weight").alias("rows"), F.count(F.lit(1)).alias("strata"))


def contrast(strata: DataFrame, repository: str = "repository_id", statistic: str = "median", eps: float = 1e-12) -> DataFrame:
    """One row: repositories, strata, rows, the estimate over repositories, and how many lie on either side of 0."""
    repos = within_repositories(strata, repository)
    centre = F.percentile("delta", F.lit(0.5)) if statistic == "median" else F.avg("delta")
    return repos.agg(
        F.count(F.lit(1)).alias("repositories"),
        F.sum("strata").alias("strata"),
        F.sum("rows").alias("rows"),
        centre.alias("estimate"),
        F.count_if(F.col("delta") > eps).alias("positive"),
        F.count_if(F.col("delta") < -eps).alias("negative"),
        F.count_if(F.abs("delta") <= eps).alias("tied"),
    )


def rate_contrasts(df: DataFrame, keys: Sequence[str], arm: Column, flags: Sequence[str], repository: str = "repository_id", eps: float = 1e-12) -> DataFrame:
    """``category`` and the columns of ``contrast`` (mean of rate differences) for each flag, all from one grouping.

    A null flag counts as not set. Sums per stratum are turned to rows only after the grouping.
    """
    rows = df.withColumn("_a", arm).where("_a is not null")
    n = {x: F.count_if(F.col("_a") == x) for x in (True, False)}
    deltas = [(100.0 * (F.count_if(F.col("_a") & F.col(f)) / n[True] - F.count_if(~F.col("_a") & F.col(f)) / n[False])) for f in flags]
    each = F.array(*[F.struct(F.lit(f).alias("category"), d.alias("delta")) for f, d in zip(flags, deltas, strict=True)])
    strata = rows.groupBy(*keys).agg((n[True] + n[False]).alias("weight"), F.when(F.least(n[True], n[False]) > 0, each).alias("each")).where("each is not null")
    repos = within_repositories_by(strata.select(*keys, "weight", F.inline("each")), ["category", repository])
    return repos.groupBy("category").agg(
        F.count(F.lit(1)).alias("repositories"),
        F.avg("delta").alias("estimate"),
        F.count_if(F.col("delta") > eps).alias("positive"),
        F.count_if(F.col("delta") < -eps).alias("negative"),
        F.count_if(F.abs("delta") <= eps).alias("tied"),
    )


def rate_families(df: DataFrame, keys: Sequence[str], arm: Column, flags: Sequence[str], levels: Sequence[int], repository: str = "repository_id", eps: float = 1e-10) -> DataFrame:
    """``category, least, repositories, strata, rows, estimate, positive, negative, tied`` for each flag and each least
    number of rows that a stratum needs in both arms; all from one grouping. A null flag counts as not set."""
    rows = df.withColumn("_a", arm).where("_a is not null")
    n = {x: F.count_if(F.col("_a") == x) for x in (True, False)}
    deltas = [100.0 * (F.count_if(F.col("_a") & F.col(f)) / F.nullif(n[True], F.lit(0)) - F.count_if(~F.col("_a") & F.col(f)) / F.nullif(n[False], F.lit(0))) for f in flags]
    each = F.array(*[F.struct(F.lit(f).alias("category"), d.alias("delta")) for f, d in zip(flags, deltas, strict=True)])
    strata = rows.groupBy(*keys).agg((n[True] + n[False]).alias("weight"), F.least(n[True], n[False]).alias("both"), each.alias("each")).where(F.col("both") >= max(1, min(levels)))
    supported = strata.withColumn("least", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("both"))))
    repos = within_repositories_by(supported.select(*keys, "weight", "least", F.inline("each")), ["category", "least", repository])
    return repos.groupBy("category", "least").agg(
        F.count(F.lit(1)).alias("repositories"),
        F.sum("strata").alias("strata"),
        F.sum("rows").alias("rows"),
        F.avg("delta").alias("estimate"),
        F.count_if(F.col("delta") > eps).alias("positive"),
        F.count_if(F.col("delta") < -eps).alias("negative"),
        F.count_if(F.abs("delta") <= eps).alias("tied"),
    )


def common_support(df: DataFrame, keys: Sequence[str], arm: Column) -> DataFrame:
    """The rows of strata that hold both arms."""
    rows = df.withColumn("_a", arm).where("_a is not null")
    both = rows.groupBy(*keys).agg(F.countDistinct("_a").alias("_arms")).where("_arms = 2").select(*keys)
    return rows.join(both, list(keys), "left_semi").drop("_a")


def log10_sign_test(positive: Column, negative: Column) -> Column:
    """log10 of the exact two-sided binomial p-value, by log-sum-exp over the smaller tail; 0 without any nonzero."""
    n, k = (positive + negative).cast("int"), F.least(positive, negative).cast("int")
    start = F.struct((n * F.lit(-math.log(2))).cast("double").alias("term"), (n * F.lit(-math.log(2))).cast("double").alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["total"])
    return F.when(n > 0, F.least(F.lit(0.0), (tail + math.log(2)) / math.log(10))).otherwise(F.lit(0.0))


def sign_test(df: DataFrame) -> DataFrame:
    """Adds ``positive_pct, p_sign, log10_p_sign`` to rows with positive, negative and tied."""
    every = F.col("positive") + F.col("negative") + F.col("tied")
    log = log10_sign_test(F.col("positive"), F.col("negative"))
    return df.withColumn("positive_pct", share(F.col("positive"), every)).withColumn("log10_p_sign", log).withColumn("p_sign", F.pow(F.lit(10.0), "log10_p_sign"))


def holm(df: DataFrame, p: str = "p_sign", family: Sequence[str] = (), log10: str | None = None) -> DataFrame:
    """Step-down adjusted p-values within each family (a few rows); with ``log10`` those of a log column as well."""
    keys = list(family)

    def adjusted(column: str, log: bool) -> Column:
        order = Window.partitionBy(*keys).orderBy(column)
        left = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1
        one = F.least(F.lit(0.0), F.col(column) + F.log10(left)) if log else F.least(F.lit(1.0), F.col(column) * left)
        return one

    out = df.withColumn("_h", adjusted(p, False)).withColumn("p_holm", F.max("_h").over(Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, 0))).drop("_h")
    if log10:
        out = out.withColumn("_h", adjusted(log10, True)).withColumn("log10_p_holm", F.max("_h").over(Window.partitionBy(*keys).orderBy(log10).rowsBetween(Window.unboundedPreceding, 0))).drop("_h")
    return out


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper score bounds within [0, 1]; both 0 for n = 0."""
    p = hits / F.nullif(n, F.lit(0))
    scale = 1 + F.lit(z * z) / F.nullif(n, F.lit(0))
    centre = (p + F.lit(z * z) / (2 * F.nullif(n, F.lit(0)))) / scale
    margin = F.lit(z) * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + F.lit(z * z) / (4 * F.nullif(n, F.lit(0)) * F.nullif(n, F.lit(0)))) / scale
    some = lambda x: F.when(n > 0, x).otherwise(F.lit(0.0))
    return some(F.greatest(F.lit(0.0), centre - margin)), some(F.least(F.lit(1.0), centre + margin))


def draws(spark, reps: int, n: int, seed: str) -> DataFrame:
    """``rep, draw, ix``: for each replicate n indices below n, from md5 text, the same in any engine."""
    grid = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    text = F.concat_ws(":", F.lit(seed), "rep", "draw").cast("binary")
    return grid.select("rep", "draw", (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % n).alias("ix"))


#: Most rows of a bootstrap that are broadcast (16 bytes each).
MOST_BROADCAST = 1 << 20


def bootstrap(
    df: DataFrame, value: str, order: Sequence[str], reps: int = 5000, statistic: str = "mean", seed: str = "boot", weight: str | None = None, least: int = 1
) -> DataFrame:
    """``n, low, high``: the percentile interval of a statistic over resampled rows; null bounds under ``least`` rows.

    ``df`` holds one row per repository or cluster. Its rows are numbered in ``order`` and meet the replicate grid by
    number. Up to MOST_BROADCAST rows they go to where the grid is made, so that a replicate's sums are combined there
    and only these are shuffled; more rows meet the grid by shuffle. With ``weight`` the statistic is sum(value) / sum(weight).
    """
    numbered = ordering.numbered(df, list(order)).select("ix", F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1.0)).alias("_w"))
    n = numbered.count()
    if n < max(1, least):
        return df.sparkSession.createDataFrame([(n, None, None)], "n long, low double, high double")
    grid = draws(df.sparkSession, reps, n, seed)
    each = grid.join(F.broadcast(numbered) if n <= MOST_BROADCAST else numbered, "ix").groupBy("rep")
    if statistic == "median" and not weight:
        # a replicate's draws, counted per value
        found = each.agg(F.percentile("_v", F.lit(0.5)).alias("s"))
    else:
        found = each.agg((F.sum("_v") / F.sum("_w") if weight else F.avg("_v")).alias("s"))
    return found.agg(F.lit(n).cast("long").alias("n"), F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"))


def standardised(df: DataFrame, dims: Sequence[str], period: str, periods: tuple[str, str], flags: Sequence[str]) -> DataFrame:
    """Rates in two periods under the same weights: cells seen in both, weighed by their rows in both together.

    One row per flag: ``category, q1_pct, q2_pct, delta_pp, cells, q1_n, q2_n``.
    """
    p, (one, two) = F.col(period), periods
    n1, n2 = F.count_if(p == one), F.count_if(p == two)
    rates = [(F.count_if((p == q) & F.col(f)) / F.nullif(n, F.lit(0))).alias(f"{name}_{f}") for f in flags for name, q, n in (("r1", one, n1), ("r2", two, n2))]
    cells = df.where(p.isin(one, two)).groupBy(*dims).agg(n1.alias("n1"), n2.alias("n2"), *rates).where("n1 > 0 and n2 > 0")
    w = F.col("n1") + F.col("n2")
    mean = lambda c: 100.0 * F.sum(F.col(c) * w) / F.sum(w)
    sums = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n1").alias("q1_n"), F.sum("n2").alias("q2_n"), *[mean(f"{r}_{f}").alias(f"{r}_{f}") for f in flags for r in ("r1", "r2")])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("category"), F.col(f"r1_{f}").alias("q1_pct"), F.col(f"r2_{f}").alias("q2_pct")) for f in flags]))
    return sums.select(rows.alias("r"), "cells", "q1_n", "q2_n").select("r.*", (F.col("r.q2_pct") - F.col("r.q1_pct")).alias("delta_pp"), "cells", "q1_n", "q2_n")


def decomposed(df: DataFrame, group: Column, groups: tuple, stratum: str, flag: str) -> DataFrame:
    """The gap of a rate between two groups, split at midpoints into composition and within-stratum parts (points).

    Strata that one group lacks have no rate there; with any such stratum the row says ``supported = false``.
    """
    a, b = groups
    g = df.withColumn("_g", group).where(F.col("_g").isin(a, b))
    cells = g.groupBy(stratum).agg(*[x for k, v in (("a", a), ("b", b)) for x in (F.count_if(F.col("_g") == v).alias(f"n_{k}"), F.count_if((F.col("_g") == v) & F.col(flag)).alias(f"h_{k}"))])
    whole = cells.agg(F.sum("n_a").alias("all_a"), F.sum("n_b").alias("all_b"))  # one row
    c = cells.crossJoin(F.broadcast(whole))
    pa, pb, ra, rb = F.col("n_a") / F.col("all_a"), F.col("n_b") / F.col("all_b"), F.col("h_a") / F.nullif("n_a", F.lit(0)), F.col("h_b") / F.nullif("n_b", F.lit(0))
    return c.agg(
        F.bool_and((F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("supported"),
        (100.0 * (F.sum("h_b") / F.max("all_b") - F.sum("h_a") / F.max("all_a"))).alias("gap_pp"),
        (100.0 * F.sum((pb - pa) * (rb + ra) / 2)).alias("composition_pp"),
        (100.0 * F.sum((rb - ra) * (pb + pa) / 2)).alias("within_pp"),
    )


def decomposed_pairs(df: DataFrame, group: str, stratum: str, flag: str) -> DataFrame:
    """``decomposed`` for every unordered pair of groups that share all strata, from one table of cells."""
    cells = df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("h"))
    sums = cells.groupBy(group).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("strata"))
    side = cells.join(sums, group).select(F.col(group).alias("g"), F.col(stratum).alias("s"), (F.col("n") / F.col("all")).alias("p"), (F.col("h") / F.col("n")).alias("r"), "strata")
    a, b = side.select(*[F.col(c).alias(f"{c}_a") for c in side.columns]), side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
    pairs = a.join(b, (F.col("s_a") == F.col("s_b")) & (F.col("g_a") < F.col("g_b")))
    found = pairs.groupBy("g_a", "g_b").agg(
        F.count(F.lit(1)).alias("shared"),
        F.max("strata_a").alias("sa"),
        F.max("strata_b").alias("sb"),
        (100.0 * F.sum(F.col("p_b") * F.col("r_b") - F.col("p_a") * F.col("r_a"))).alias("gap_pp"),
        (100.0 * F.sum((F.col("p_b") - F.col("p_a")) * (F.col("r_b") + F.col("r_a")) / 2)).alias("composition_pp"),
        (100.0 * F.sum((F.col("r_b") - F.col("r_a")) * (F.col("p_b") + F.col("p_a")) / 2)).alias("within_pp"),
    )
    return found.where("shared = sa and shared = sb").select(F.col("g_a").alias("group_a"), F.col("g_b").alias("group_b"), "gap_pp", "composition_pp", "within_pp")


def ecdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or below each distinct value; counts per value first, so ties and hot values cost one row each."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    every = Window.partitionBy(*keys)
    return counts.withColumn("ecdf", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(every)).select(*keys, value, "n", "ecdf")


def tails(df: DataFrame, lines: str, flag: str, id_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Line shares as they are, without the largest 1 % of rows (ties by id), and with lines cut at the 99th percentile.

    The rank of the largest rows is found among those at or above an exact lower quantile only, so no window sees the
    whole table; one row per ``mode`` and key.
    """
    keys = list(keys)
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile(lines, F.array(F.lit(0.99), F.lit(0.985))).alias("_q"))
    rows = df.crossJoin(F.broadcast(sums)) if not keys else df.join(sums, keys)
    rows = rows.withColumn("_drop", F.ceil(F.col("_n") * 0.01))
    top = rows.where(F.col(lines) >= F.least(F.col("_q")[0], F.col("_q")[1])).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(lines).desc(), id_col))).where("_r <= _drop")
    out = []
    for mode, part, value in (("raw", rows, F.col(lines)), ("drop_top_1pct", rows.join(top.select(id_col), id_col, "left_anti"), F.col(lines)), ("winsorize_99pct", rows, F.least(F.col(lines).cast("double"), F.col("_q")[0]))):
        hit = F.col(flag)
        got = part.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("prs"), F.count_if(hit).alias("signal_prs"), share(F.count_if(hit), F.count(F.lit(1))).alias("pr_share_pct"),
            F.sum(value).cast("double").alias("total_lines"), F.coalesce(F.sum(F.when(hit, value)), F.lit(0)).cast("double").alias("signal_lines"),
        )
        out.append(got.withColumn("line_share_pct", share(F.col("signal_lines"), F.col("total_lines"))).withColumn("mode", F.lit(mode)))
    return out[0].unionByName(out[1]).unionByName(out[2])


def tail_contributions(df: DataFrame, lines: str, flag: str, id_col: str, by: str) -> DataFrame:
    """``mode, by, prs, signal_prs, total_lines, signal_lines, line_share_pct``: what each group gives to the whole table's
    lines as they are, without the largest 1 % of all rows (ties by id), and with lines cut at the whole table's 99th percentile.

    Places of rows and the percentile come from ranges (see ``ordering``); modes are sums of one grouping.
    """
    placed, one = top_rows(df.select(id_col, by, lines, flag), lines, id_col)
    cap = ordering.quantiles(placed, [[]], {lines: {"_cap": 0.99}}).select("_cap")  # one row
    rows = placed.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(cap)).withColumn("_x", F.col(lines).cast("double"))
    modes = F.array_compact(
        F.array(
            F.struct(F.lit("raw").alias("mode"), F.col("_x").alias("v")),
            F.when(F.col("_place") >= F.col("top_n"), F.struct(F.lit("drop_top_1pct").alias("mode"), F.col("_x").alias("v"))),
            F.struct(F.lit("winsorize_99pct").alias("mode"), F.least("_x", "_cap").alias("v")),
        )
    )
    hit = F.col(flag)
    each = rows.select(by, flag, F.explode(modes).alias("m")).groupBy("m.mode", by)
    sums = each.agg(F.count(F.lit(1)).alias("prs"), F.count_if(hit).alias("signal_prs"), F.sum("m.v").alias("total_lines"), F.coalesce(F.sum(F.when(hit, F.col("m.v"))), F.lit(0.0)).alias("signal_lines"))
    return sums.withColumn("line_share_pct", share(F.col("signal_lines"), F.col("total_lines")))


def top_rows(df: DataFrame, lines: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_place`` (from 0, largest ``lines`` first, ties by id), and one row ``top_n``: how many the largest 1 % are."""
    placed = ordering.numbered(df, [F.desc(lines), id_col], "_place")
    return placed, placed.agg(F.ceil(F.count(F.lit(1)) * 0.01).alias("top_n"))
