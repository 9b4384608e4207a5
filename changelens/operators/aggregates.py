"""Lists of aggregate columns for change records, and the groupings they are used with."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import share
from ..sources.scratch import written
from . import ordering


def n_of(condition: Column) -> Column:
    return F.count_if(condition)


def total(value: Column, where: Column | None = None) -> Column:
    """A sum that is 0, not null, over nothing."""
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0))


#: The quantiles of a summary.
LEVELS = {"q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9}


def levels(values: Sequence[str], of: dict[str, float] = LEVELS) -> dict[str, dict[str, float]]:
    """What ``ordering.quantiles`` is asked for the values of a summary."""
    return {v: {f"{v}_{name}": q for name, q in of.items()} for v in values}


def summary(values: Sequence[str] = (), flags: Sequence[str] = (), repository: str | None = None, ranked: bool = True) -> list[Column]:
    """For values: eligible rows, exact quartiles and p90, mean, deviation, sum. For flags: true, eligible, percentage.

    Eligible rows are those where the column is known; ``n`` counts all. Without ``ranked`` no quantiles: ``by_sets`` can
    add them for groups of any size.
    """
    out = [F.count(F.lit(1)).alias("n")]
    if repository:
        out.append(F.countDistinct(repository).alias("repositories"))
    for v in values:
        x = F.col(v)
        out.append(F.count(x).alias(f"{v}_n"))
        out += [F.percentile(x, F.lit(q)).alias(f"{v}_{name}") for name, q in LEVELS.items() if ranked]
        out += [F.avg(x).alias(f"{v}_mean"), F.stddev_samp(x).alias(f"{v}_std"), total(x).alias(f"{v}_sum")]
    for f in flags:
        x = F.col(f)
        out += [n_of(x).alias(f"{f}_n"), F.count(x).alias(f"{f}_eligible"), (100.0 * F.avg(x.cast("double"))).alias(f"{f}_pct")]
    return out


def by_sets(
    df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column], all_label: str = "all", quantiles: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """One pass over ``df`` for several key sets; a key outside a row's set reads ``all_label``.

    Keys are cast to strings; rows whose own key is null stay apart as null. ``quantiles`` (column to names and levels)
    are exact and found by ranges of values, so the grand total needs no task that holds all of them.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    typed = df.select(*[c for c in df.columns if c not in keys], *[F.col(k).cast("string").alias(k) for k in keys])
    if quantiles:  # read more than once
        typed = written(typed, "summarised")
    grouped = typed.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    marks = [F.grouping(k).alias(f"_out_{k}") for k in keys]
    found = grouped.agg(*marks, *aggregates)
    if quantiles:
        number = F.lit(None).cast("int")
        for i, s in enumerate(sets):
            here = reduce(lambda a, b: a & b, [F.col(f"_out_{k}") == int(k not in s) for k in keys], F.lit(True))
            number = F.when(here, i).otherwise(number)
        ranked = ordering.quantiles(typed, sets, quantiles)
        names = [n for of in quantiles.values() for n in of]
        ranked = ranked.select(F.col("_set").alias("_ranked"), *[F.col(k).alias(f"_ranked_{k}") for k in keys], *names)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_ranked_{k}")) for k in keys], F.col("_set") == F.col("_ranked"))
        found = found.withColumn("_set", number).join(ranked, same, "left").drop("_set", "_ranked", *[f"_ranked_{k}" for k in keys])
    named = [F.when(F.col(f"_out_{k}") == 1, all_label).otherwise(F.col(k)).alias(k) for k in keys]
    return found.select(*named, *[c for c in found.columns if c not in keys and not c.startswith("_out_")])


def contribution(flag: str = "agent_detected", eligible: str = "source_lines_eligible") -> list[Column]:
    """Counts and shares of flagged changes; the source share as a point only if every change's source lines are known,
    and always as bounds that give the unknown lines to either side."""
    a, known = F.col(flag), F.col(eligible)
    n, agents = F.count(F.lit(1)), n_of(a)
    add, rem, churn = F.col("additions"), F.col("deletions"), F.col("changed_lines")
    source, source_a = total(F.col("source_churn"), known), total(F.col("source_churn"), known & a)
    unknown_a, unknown_o = total(churn, ~known & a), total(churn, ~known & ~a)
    complete = n_of(~known) == 0
    return [
        n.alias("pr_count"),
        agents.alias("agent_pr_count"),
        share(agents, n).alias("agent_pr_pct"),
        total(add).alias("all_additions"),
        total(add, a).alias("agent_additions"),
        share(total(add, a), total(add)).alias("agent_additions_pct"),
        total(rem).alias("all_deletions"),
        total(rem, a).alias("agent_deletions"),
        total(churn).alias("all_text_churn"),
        total(churn, a).alias("agent_text_churn"),
        share(total(churn, a), total(churn)).alias("agent_text_churn_pct"),
        n_of(known).alias("source_eligible_prs"),
        share(n_of(known), n).alias("source_coverage_pct"),
        complete.alias("source_coverage_complete"),
        source.alias("known_source_churn"),
        source_a.alias("known_agent_source_churn"),
        F.when(complete, share(source_a, source)).alias("agent_source_churn_pct"),
        share(source_a, source + unknown_o).alias("source_share_lower_bound_pct"),
        share(source_a + unknown_a, source + unknown_a).alias("source_share_upper_bound_pct"),
        unknown_a.alias("source_unknown_agent_text_churn"),
        unknown_o.alias("source_unknown_other_text_churn"),
    ]


def complexity(values: Sequence[str] = ("changed_files", "changed_lines", "source_churn")) -> list[Column]:
    out = [F.count(F.lit(1)).alias("pr_count"), n_of(F.col("cross_file")).alias("cross_file_prs"), share(n_of(F.col("cross_file")), F.count(F.lit(1))).alias("cross_file_pct")]
    for v in values:
        x = F.col(v)
        out += [F.count(x).alias(f"{v}_eligible_n"), F.percentile(x, F.lit(0.5)).alias(f"{v}_median"), F.percentile(x, F.lit(0.9)).alias(f"{v}_p90"), F.avg(x).alias(f"{v}_mean")]
    return out


def shares(flag: str = "agent_detected", lines: str = "changed_lines") -> list[Column]:
    n, a, all_, own = F.count(F.lit(1)), n_of(F.col(flag)), total(F.col(lines)), total(F.col(lines), F.col(flag))
    return [n.alias("n"), a.alias("agent_n"), share(a, n).alias("pr_pct"), all_.alias("lines"), own.alias("agent_lines"), share(own, all_).alias("lines_pct")]


def leave_one_out(df: DataFrame, group: str, flag: str, lines: str) -> DataFrame:
    """Shares of the whole without each group, from one pass: the total minus the group's own sums."""
    f = F.col(flag)
    sums = {"n": F.count(F.lit(1)), "a": n_of(f), "l": total(F.col(lines)), "la": total(F.col(lines), f)}
    each = df.groupBy(group).agg(*[c.alias(k) for k, c in sums.items()])
    whole = each.agg(*[F.sum(k).alias(f"all_{k}") for k in sums])  # one row
    rest = {k: F.col(f"all_{k}") - F.col(k) for k in sums}
    return each.crossJoin(F.broadcast(whole)).select(
        F.col(group).alias("left_out"), rest["n"].alias("n"), rest["a"].alias("agent_n"), share(rest["a"], rest["n"]).alias("pr_pct"), share(rest["la"], rest["l"]).alias("lines_pct")
    )


def mean_of_shares(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Mean and median over groups of each group's percentage, next to the pooled one."""
    each = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), n_of(F.col(flag)).alias("a")).withColumn("pct", share(F.col("a"), F.col("n")))
    return each.agg(F.count(F.lit(1)).alias("groups"), F.avg("pct").alias("mean_pct"), F.percentile("pct", F.lit(0.5)).alias("median_pct"), share(F.sum("a"), F.sum("n")).alias("pooled_pct"))


def overlapping(df: DataFrame, items: str, keys: Sequence[str]) -> DataFrame:
    """Rows per element of an array column; a row counts once for each of its elements, against all rows of the group."""
    every = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_n"))
    hit = df.select(*keys, F.explode(F.array_distinct(items)).alias("item")).groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(every, list(keys)).select(*keys, "item", "n", "group_n", share(F.col("n"), F.col("group_n")).alias("pct"))


def dense(df: DataFrame, axes: dict[str, DataFrame], keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Every combination of the axes (small tables of distinct values), counts filled with 0, all else left null."""
    frame = None
    for axis in axes.values():
        frame = axis if frame is None else frame.crossJoin(axis)
    return frame.join(df, list(keys), "left").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) if c in fill else F.col(c) for c in df.columns if c not in keys])


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, name: str = "share_pct") -> DataFrame:
    """Each row's percentage of the sum over the rows with the same keys."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    return df.join(sums, list(keys)).withColumn(name, share(F.col(value), F.col("_sum"))).drop("_sum")


def unpivot(df: DataFrame, ids: Sequence[str], flags: Sequence[str], name: str = "category", value: str = "flag") -> DataFrame:
    return df.unpivot(list(ids), list(flags), name, value)


def pair_cochange(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """For every unordered pair of flags the rows with both, of all and of those with the first; one pass."""
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[n_of(F.col(a)).alias(f"one_{a}") for a in flags], *[n_of(F.col(a) & F.col(b)).alias(f"both_{a}_{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"both_{a}_{b}").alias("n"), F.col(f"one_{a}").alias("n_a"), F.col("n").alias("all")) for a, b in pairs]))
    return sums.select(rows.alias("r")).select("r.a", "r.b", "r.n", share(F.col("r.n"), F.col("r.all")).alias("pct"), share(F.col("r.n"), F.col("r.n_a")).alias("pct_given_a"))


def exclusive_pairs(hits: DataFrame, values: Sequence[str], id_col: str = "id", category: str = "module", path: str = "path") -> DataFrame:
    """For pairs of categories: ids with both, and ids where each has a path that the other lacks."""
    sets = hits.groupBy(id_col).pivot(category, list(values)).agg(F.collect_set(path))
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    rest = lambda a, b: F.size(F.array_except(f"`{a}`", f"`{b}`")) > 0
    some = lambda a: F.size(F.col(f"`{a}`")) > 0
    out = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (some(a) & some(b)).alias("both"), (rest(a, b) & rest(b, a)).alias("exclusive")) for a, b in pairs]
    return sets.select(F.explode(F.array(*out)).alias("r")).groupBy("r.a", "r.b").agg(n_of(F.col("r.both")).alias("both_n"), n_of(F.col("r.exclusive")).alias("exclusive_n"))


def attributed(df: DataFrame, many: str, values: Sequence[str] = (), flags: Sequence[str] = (), by: str = "agent") -> DataFrame:
    """The summary by group over all rows and over those with a single signal, tagged by ``scope``."""
    each = [scope.groupBy(by).agg(*summary(values, flags)).withColumn("scope", F.lit(name)) for name, scope in (("all", df), ("single_signal", df.where(~F.col(many))))]
    return each[0].unionByName(each[1])


def scopes(df: DataFrame, masks: dict[str, Column], aggregates: Sequence[Column]) -> DataFrame:
    """The same aggregates under several overlapping masks, in one pass: rows are tagged with the scopes they are in."""
    tags = F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()]))
    return df.withColumn("scope", F.explode(tags)).groupBy("scope").agg(*aggregates)


def missing_bounds(hits: Column, known: Column, all_rows: Column) -> list[Column]:
    """Lowest and highest possible percentage of hits when rows without an answer may be either."""
    return [share(hits, all_rows).alias("lower_pct"), share(hits + all_rows - known, all_rows).alias("upper_pct")]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``counter, value, n``: how often each value of several columns occurs, in one pass; values as text, null as null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.counter", "p.value").agg(F.count(F.lit(1)).alias("n"))
