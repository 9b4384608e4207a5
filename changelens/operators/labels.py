"""Supplied annotations and review labels: joins, coverage, rollups to documents, category tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import share
from .contrasts import wilson

SEVERITY_ORDER = ("unknown", "low", "medium", "high")


def annotate(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """A left join that fails at run time if a key of either side repeats."""
    def once(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        if not n.isEmpty():
            raise ValueError(f"{name} repeats values of {key}")
        return rows

    return once(df, "left").join(once(labels, "right"), key, "left")


def membership_stats(df: DataFrame, items: str, keys: Sequence[str], values: Sequence[str], flag: str) -> DataFrame:
    """Per group and element of an array: rows, their percentage of the group, and a flag's percentage among them."""
    every = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("labelled"))
    hits = df.select(*keys, flag, F.explode(F.array_distinct(items)).alias("item")).where(F.col("item").isin(*values))
    own = hits.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("n"), share(F.count_if(F.col(flag)), F.count(F.lit(1))).alias("flag_pct"))
    return own.join(every, list(keys)).select(*keys, "item", "n", "labelled", share(F.col("n"), F.col("labelled")).alias("pct"), "flag_pct")


def coverage(selected: DataFrame, got: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    """Selected, retrieved and missing rows by group."""
    flagged = selected.join(got.select(key).distinct().withColumn("_got", F.lit(True)), key, "left")
    hit = F.count_if(F.coalesce(F.col("_got"), F.lit(False)))
    n = F.count(F.lit(1))
    return flagged.groupBy(*groups).agg(n.alias("selected"), hit.alias("retrieved"), (n - hit).alias("missing"), share(hit, n).alias("retrieved_pct"))


def rollup(documents: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Review labels (key, is_code_issue, categories, severity, confidence) per document, also for those without any."""
    code = F.col("is_code_issue")
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    sums = reviews.groupBy(key).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(code).alias("code_issues"),
        F.max(F.when(code, rank)).alias("worst"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )
    counts = reviews.where(code).select(key, F.explode("categories").alias("c")).groupBy(key, "c").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("category_counts"))
    out = documents.select(key).join(sums, key, "left").join(maps, key, "left")
    n = F.coalesce("texts", F.lit(0))
    counted = F.coalesce("category_counts", F.create_map().cast("map<string,bigint>"))
    return out.select(
        key,
        F.when(n > 0, "model_classified").otherwise("no_human_review_text").alias("status"),
        n.alias("texts"),
        F.coalesce("code_issues", F.lit(0)).alias("code_issues"),
        (n - F.coalesce("code_issues", F.lit(0))).alias("non_code"),
        F.array_sort(F.map_keys(counted)).alias("categories"),
        counted.alias("category_counts"),
        F.coalesce(F.try_element_at(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("worst").cast("int")), F.lit("none")).alias("max_severity"),
        F.coalesce("mean_confidence", F.lit(1.0)).alias("mean_confidence"),
    )


def category_table(rolled: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Documents per category among reviewed ones and among those with an issue, with Wilson bounds."""
    base = rolled.where("texts > 0")
    sums = base.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("code_issues") > 0).alias("issues"), *[F.count_if(F.array_contains("categories", c)).alias(c) for c in categories])
    rows = sums.select("reviewed", "issues", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in categories])).alias("r")).select("reviewed", "issues", "r.*")
    low, high = wilson(F.col("n"), F.col("reviewed"))
    return rows.select("category", "n", "reviewed", share(F.col("n"), F.col("reviewed")).alias("pct"), low.alias("low"), high.alias("high"), share(F.col("n"), F.col("issues")).alias("pct_of_issues"))


def agent_table(rolled: DataFrame, agent: str) -> DataFrame:
    reviewed, issue, n = F.count_if(F.col("texts") > 0), F.count_if(F.col("code_issues") > 0), F.count(F.lit(1))
    sums = rolled.groupBy(agent).agg(n.alias("n"), reviewed.alias("reviewed"), issue.alias("issues"))
    low, high = wilson(F.col("reviewed"), F.col("n"))
    ilow, ihigh = wilson(F.col("issues"), F.col("reviewed"))
    return sums.select(agent, "n", "reviewed", "issues", low.alias("coverage_low"), high.alias("coverage_high"), ilow.alias("issue_low"), ihigh.alias("issue_high"))


def label_stats(human: str, text: str) -> dict[str, Column]:
    """The statistics of a group of labelled changes, by column name."""
    n = F.count(F.lit(1))
    flags = {"human": human, "text": text, "cross": "cross_file", "merged": "merged"}
    out = {"n": n}
    for name, flag in flags.items():
        out |= {f"{name}_n": F.count_if(flag), f"{name}_pct": share(F.count_if(flag), n)}
    out["files_median"] = F.percentile("changed_files", F.lit(0.5))
    return out | {f"lines_{k}": F.percentile("changed_lines", F.lit(p)) for k, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))}


def grouped_label_stats(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], stats: dict[str, Column]) -> DataFrame:
    """``stats`` over each set of keys in one pass; keys outside a set are "" and ``grouped`` tells which (as GROUPING_ID)."""
    sums = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(F.grouping_id(*keys).cast("int").alias("grouped"), *[c.alias(k) for k, c in stats.items()])
    return sums.select(*[F.coalesce(c, F.lit("")).alias(c) for c in keys], "grouped", *stats)
