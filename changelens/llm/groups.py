"""Connected groups of rows that a verified relation links, found through keys that linked rows must share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import join_facts, materialize, probably_in


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id of its component) of every id in ``edges`` (a, b).

    Alternates two steps on edge tables: every node hands its larger neighbours its smallest one, then its smaller
    neighbours and itself. Each is a combinable minimum and a join, so a node with very many edges is just a skewed
    join side. Stops when the edges are stars and do not change.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = materialize(small, "edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def shared_keys(keys: DataFrame, possible: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``key, id, size, at, rank`` of the keys with several members of which one leads. Most keys have one member and are dropped
    by a broadcast bitmap of the others before rows are moved.

    ``possible`` (size, place, least size of the key's members) is False for rows that are compatible with no row of their key:
    they stand so late in their order that not even its smallest member could link there. No such row goes on.
    """
    lead = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("leads").alias("led"), F.min("size").alias("lo")).where("members > 1 and led").select("key", "lo")
    lead = materialize(lead, "lead")
    rows = probably_in(keys, lead.select("key"), "key").join(lead, "key").where(possible(F.col("size"), F.col("at"), F.col("lo")))
    return materialize(rows.select("key", "id", "size", "at", "rank"), "keys")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("p.id", "m.id").alias("a"), F.greatest("p.id", "m.id").alias("b")).distinct()


def _member(name: str) -> Column:
    return F.struct("id", "size", "at", "component").alias(name)


def add_links(groups: DataFrame | None, found: DataFrame) -> DataFrame:
    """The groups after the links ``found`` (a, b) are added."""
    edges = found if groups is None else groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found)
    return materialize(connected_components(edges), "groups")


def open_keys(keys: DataFrame, groups: DataFrame | None) -> DataFrame | None:
    """``key, id, size, at, rank, component`` of the keys whose members are not in one group; None where there is none."""
    if groups is None:
        rest = keys.withColumn("component", F.col("id"))
    else:
        rest = keys.join(groups, "id", "left").select("key", "id", "size", "at", "rank", F.coalesce("component", "id").alias("component"))
    several = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("copies")).where("lo <> hi").select("key", "copies")
    several = materialize(several, "open-keys")
    return None if several.isEmpty() else materialize(join_facts(rest, several, "key"), "open")


def link_groups(
    keys: DataFrame, verify: Callable[[DataFrame], DataFrame], compatible: Callable[[Column, Column], Column], ratio: float, groups: DataFrame | None = None
) -> DataFrame | None:
    """``id, component`` of all ids in verified links, given shared ``keys`` (key, id, size, at, rank); None without any key.

    Any two linked rows share a key where the two are ``compatible`` by what they bring there (size, and a place ``at``
    in their order); compatible sizes are within a factor of ``ratio`` below 1. First every key compares its member
    of the lowest rank (then id) with its others, which is linear in the key's length. Keys whose members already are in one group are done.
    What is open then is compared in full, but only across groups and, by cells of size, between sizes that can be
    compatible: within a group no pair is needed. So no link between groups is lost, and groups of copies never unfold
    into pairs. ``groups`` are those known before.
    """
    rest = open_keys(keys, groups)
    if rest is None:
        return groups
    pivots = materialize(rest.groupBy("key").agg(F.min(F.struct("rank", "id", "size", "at", "component")).alias("p"), F.count(F.lit(1)).alias("copies")), "pivots")
    met = join_facts(rest, pivots, "key").select("p", _member("m")).where("p.component <> m.component").where(compatible(F.col("p"), F.col("m")))
    groups = add_links(groups, verify(materialize(_pairs(met), "pairs")))
    rest = open_keys(keys, groups)
    if rest is None:
        return groups
    rest = rest.withColumn("cell", F.floor(F.log("size") / (-math.log(ratio) * 1.001)))
    small = rest.select("key", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"), _member("p"))
    met = small.join(rest.select("key", "cell", _member("m")), ["key", "cell"]).where("p.component <> m.component")
    met = met.where("p.size < m.size or p.size = m.size and p.id < m.id").where(compatible(F.col("p"), F.col("m")))
    return add_links(groups, verify(materialize(_pairs(met), "pairs")))
