"""Deterministic samples: day-stratified orders, caps per repository, hash-ordered audits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(*fields: Column) -> Column:
    """SHA-256 of the fields joined by NUL, as hex; hex order is digest order."""
    return F.sha2(F.concat_ws("\u0000", *fields), 256)


def day_stratified(df: DataFrame, agent: str, day: str, id_col: str, seed: str) -> DataFrame:
    """Adds ``turn``: the row's place within its agent's day, in hash order. Order by (turn, day) interleaves the days."""
    key = hash_key(F.lit(seed), F.col(agent), F.col(day), F.col(id_col).cast("string"))
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(agent, day).orderBy(key, id_col)))


def capped_sample(df: DataFrame, agent: str, day: str, id_col: str, repository: str, seed: str, per_agent: int, per_repository: int) -> DataFrame:
    """Walks each agent's interleaved order, takes at most ``per_repository`` of a repository and ``per_agent`` in all;
    adds ``rank``. The cap per repository comes first, so the last window sees few rows of each."""
    turns = day_stratified(df, agent, day, id_col, seed)
    walk = ["turn", day, id_col]
    capped = turns.withColumn("_r", F.row_number().over(Window.partitionBy(agent, repository).orderBy(*walk))).where(F.col("_r") <= per_repository).drop("_r")
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy(agent).orderBy(*walk))).where(F.col("rank") <= per_agent).drop("turn")


def _walked(turns: DataFrame, agent: str, day: str, repository: str, per_agent: int, per_repository: int) -> DataFrame:
    """At most ``per_repository`` rows of each (day, repository), and of these the first 2 * ``per_agent`` of each day.

    A day gives at most ``per_agent`` rows and skips no more: at most per_agent / per_repository repositories are full.
    """
    near = turns.withColumn("_r", F.row_number().over(Window.partitionBy(agent, day, repository).orderBy("turn"))).where(F.col("_r") <= per_repository)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(agent, day).orderBy("turn"))).where(F.col("_r") <= 2 * per_agent)


def round_robin_sample(df: DataFrame, agent: str, day: str, id_col: str, repository: str, seed: str, per_agent: int, per_repository: int) -> DataFrame:
    """Like ``capped_sample``, but a day whose next row is over its repository's cap offers its following row in the
    same turn, so every day gives a row in every turn while it can. Returns ``agent, id, rank``.

    The walk depends on all earlier choices of the agent, so it runs per agent on what can matter.
    """
    near = _walked(day_stratified(df, agent, day, id_col, seed), agent, day, repository, per_agent, per_repository)
    slim = near.select(F.col(agent).alias("agent"), F.col(day).cast("string").alias("day"), F.col(id_col).alias("id"), F.col(repository).alias("repository"), "turn")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        days = [d.sort_values("turn")[["id", "repository"]].to_numpy().tolist() for _, d in sorted(rows.groupby("day"))]
        at, taken, chosen = [0] * len(days), {}, []
        moved = True
        while moved and len(chosen) < per_agent:
            moved = False
            for k, queue in enumerate(days):
                while at[k] < len(queue) and taken.get(queue[at[k]][1], 0) >= per_repository:
                    at[k] += 1
                if at[k] < len(queue) and len(chosen) < per_agent:
                    row_id, repo = queue[at[k]]
                    at[k] += 1
                    taken[repo] = taken.get(repo, 0) + 1
                    chosen.append(row_id)
                    moved = True
        return pd.DataFrame({"agent": rows["agent"].iloc[0], "id": chosen, "rank": range(1, len(chosen) + 1)})

    kind = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.groupBy("agent").applyInPandas(walk, f"agent {kind['agent']}, id {kind['id']}, rank int")


def audit_sample(df: DataFrame, id_col: str, salt: str, size: int) -> DataFrame:
    """The ``size`` rows with the smallest hash of salt and id: a bounded top-k, no full sort."""
    return df.withColumn("audit_key", hash_key(F.lit(salt), F.col(id_col).cast("string"))).orderBy("audit_key", id_col).limit(size)


def sample_per_group(df: DataFrame, group: str, item: str, salt: str, size: int) -> DataFrame:
    """At most ``size`` distinct items of each group in hash order, with ``place``."""
    key = hash_key(F.lit(salt), F.col(group).cast("string"), F.col(item).cast("string"))
    distinct = df.select(group, item).distinct()
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key, item))).where(F.col("place") <= size)


def work_queue(df: DataFrame, status: str, open_states: Sequence[str], attempts: str, most: int, order: Sequence[str], limit: int) -> DataFrame:
    return df.where(F.col(status).isin(*open_states) & (F.col(attempts) < most)).orderBy(*order).limit(limit)
