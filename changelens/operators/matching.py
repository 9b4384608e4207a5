"""Nearest controls without replacement, as deferred acceptance over candidates from widening cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Candidates that an anchor fetches at once; the reach of its cells doubles up to 2 ** WIDEST (years, log sizes), from 1 or, where
#: controls are many, from as little as 2 ** NARROWEST.
BATCH, WIDEST, NARROWEST = 32, 9, -10
#: Scores are rounded to 6 places, so one at the very edge of the reach is not sure to be complete.
EDGE = 1e-5


def _score() -> Column:
    days = F.abs(F.floor(F.datediff("pc", "ac"))) / 365.25
    topical = 1 - F.size(F.array_intersect("at", "pt")) / F.greatest(F.lit(1), F.size(F.array_union("at", "pt")))
    return F.round(days + F.abs(F.log1p("ps") - F.log1p("asz")) + 2 * topical, 6)


def _start(pool: DataFrame, batch: int) -> int:
    """The level at which a cell and those around it hold a few times ``batch`` controls of the largest language; 0 at most."""
    most = pool.groupBy("language").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return max(NARROWEST, min(0, round(math.log2(12 * batch / most) / 2)))


def _offered(anchors: DataFrame, pool: DataFrame, level: int, batch: int) -> DataFrame:
    """``anchors`` with ``offers``, up to ``batch`` controls in order after ``seen``, and ``p``, the place of the first to ask;
    null and 0 where none is left among the controls whose score is below the level's reach.

    Age and size alone are at most the score, so whatever scores below the reach lies in the anchor's cell or one next to it.
    Anchors that differ in rank and name only are twins: they have one list, in which a later twin ends after every
    earlier one. So the list is made once, in blocks of ``batch``, and the i-th twin asks from its i-th place on.
    """
    reach = 2.0**level
    cell = lambda day, size: (F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / 365.25 / reach), F.floor(F.log1p(size) / reach))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    alike = ["language", "ac", "asz", "at", "seen"]
    order = Window.partitionBy(*alike).orderBy("rank", "anchor")
    marked = anchors.withColumns({"twin": F.row_number().over(order) - 1, "lead": F.first(F.struct("rank", "anchor")).over(order)})
    a = marked.groupBy("lead", *alike).agg(F.max("twin").alias("last")).withColumns(dict(zip(("x", "y"), cell("ac", "asz"), strict=True)))
    a = a.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    p = pool.withColumns(dict(zip(("x", "y"), cell("pc", "ps"), strict=True)))
    met = a.join(p, ["language", "x", "y"]).withColumn("offer", F.struct(_score().alias("score"), "control"))
    met = met.where((F.col("offer.score") <= reach - EDGE) if level < WIDEST else F.lit(True)).where(F.col("seen").isNull() | (F.col("offer") > F.col("seen")))
    first = met.select("lead", "last", "offer").withColumn("k", F.row_number().over(Window.partitionBy("lead").orderBy("offer")) - 1).where(F.col("k") < F.col("last") + batch)
    blocks = first.groupBy("lead", F.floor(F.col("k") / batch).alias("block")).agg(F.array_sort(F.collect_list("offer")).alias("offers"))
    found = marked.withColumn("block", F.floor(F.col("twin") / batch)).join(blocks, ["lead", "block"], "left")
    some = F.size("offers") > F.col("twin") % batch
    return found.select(*anchors.columns, F.when(some, F.col("offers")).alias("offers"), F.when(some, F.col("twin") % batch).otherwise(0).cast("int").alias("p"))


def _settle(rows: DataFrame) -> DataFrame:
    """Anchors of one batch ask among themselves until each has a control that no better one of the batch wants, or no offer left.

    Who asks first makes no difference to a deferred acceptance, so every batch, whatever its rows, can go ahead on its own.
    """

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [(r is not None, r, a is not None, a) for r, a in zip(batch["rank"].to_pylist(), batch["anchor"].to_pylist(), strict=True)]
            lists = [[o["control"] for o in offers] for offers in batch["offers"].to_pylist()]
            places, langs, holder = batch["p"].to_pylist(), batch["language"].to_pylist(), {}
            for i in range(batch.num_rows):
                while places[i] < len(lists[i]):
                    control = (langs[i], lists[i][places[i]])
                    other = holder.get(control)
                    if other is not None and names[other] <= names[i]:
                        places[i] += 1
                        continue
                    holder[control] = i
                    if other is None:
                        break
                    i = other
                    places[i] += 1
            yield batch.set_column(batch.schema.get_field_index("p"), "p", pa.array(places, pa.int32()))

    return rows.mapInArrow(settled, rows.schema)


def match_controls(anchors: DataFrame, pool: DataFrame, language: str = "language", batch: int = BATCH) -> DataFrame:
    """For each anchor in order of ``rank`` the nearest unused control of its language: ``rank, anchor, control, score``.

    Both tables have name, language, created, size, topics (and anchors rank). The score adds the age difference in
    years, the difference of log1p sizes and twice one minus the topics' Jaccard similarity, rounded to 6; ties go to
    the smaller name. Null topics are none; rows without language, created or size take no part, and an anchor for
    which no control is left has no row. Anchors of one rank go by name.

    The walk in order of rank is the one stable matching in which every control prefers the smaller rank. So all anchors
    ask at once for their next control, a control keeps the smallest rank that ever asked, and those refused ask on,
    until nobody is refused; batches of neighbours settle among themselves first. An anchor that has used up its candidates fetches the next ones, from cells twice as wide where
    there are none; the first cells are the narrower the more controls there are, so what an anchor meets does not grow
    with the pool. No task holds a language; a round moves only anchors with their few candidates.
    """
    full = lambda df: df.where(F.col(language).isNotNull() & F.col("created").isNotNull() & F.col("size").isNotNull())
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    a = full(anchors).select(F.col("name").alias("anchor"), F.col(language).alias("language"), "rank", F.col("created").alias("ac"), F.col("size").alias("asz"), topics.alias("at"))
    p = full(pool).select(F.col("name").alias("control"), F.col(language).alias("language"), F.col("created").alias("pc"), F.col("size").alias("ps"), topics.alias("pt"))
    p = written(p, "pool")
    offer = f"struct<score:double,control:{p.schema['control'].dataType.simpleString()}>"
    none = F.array().cast(f"array<{offer}>")
    state = written(a.withColumns({"level": F.lit(_start(p, batch)), "seen": F.lit(None).cast(offer), "offers": none, "p": F.lit(0)}), "anchors")
    asks = F.get("offers", F.col("p"))
    while True:
        # anchors without a candidate fetch more, or look further where their last list ended before its block did
        ended = (F.col("p") >= F.size("offers")) & F.size("offers").between(1, batch - 1)
        state = state.withColumn("level", F.col("level") + ended.cast("int"))
        empty = state.where(F.col("p") >= F.size("offers"))
        levels = sorted(r["level"] for r in empty.where(F.col("level") <= WIDEST).select("level").distinct().collect())
        if levels:
            rest = state.where((F.col("p") < F.size("offers")) | (F.col("level") > WIDEST))
            for level in levels:
                mine = empty.where(F.col("level") == level).drop("offers", "p")
                got = _offered(mine, p, level, batch)
                more = got.select(*[c for c in state.columns if c not in ("level", "seen", "offers", "p")], (F.col("level") + F.col("offers").isNull().cast("int")).alias("level"), F.coalesce(F.element_at("offers", -1), "seen").alias("seen"), F.coalesce("offers", none).alias("offers"), "p")
                rest = rest.unionByName(more)
            state = written(rest, "anchors")
            continue
        # those of one language and year go ahead among themselves, then all meet
        near = state.repartition("language", F.year("ac")).sortWithinPartitions("language", "ac", "asz", "rank")
        asked = _settle(near).withColumn("to", asks["control"])
        # those that have no control to ask stand alone
        wanted = Window.partitionBy("language", F.col("to").isNull(), F.coalesce(F.col("to").cast("string"), F.col("anchor").cast("string")))
        least = F.min(F.struct("rank", "anchor")).over(wanted)
        refused = F.col("to").isNotNull() & (least != F.struct("rank", "anchor"))
        without = F.col("to").isNull() & (F.col("level") <= WIDEST)
        state = written(asked.withColumn("lost", refused).withColumn("refused", F.col("lost") | without).withColumn("p", F.col("p") + F.col("lost").cast("int")).drop("to", "lost"), "anchors")
        again = not state.where("refused").isEmpty()
        if not again:
            return state.where(F.col("p") < F.size("offers")).select("rank", "anchor", asks["control"].alias("control"), asks["score"].alias("score"))
        state = state.drop("refused")
