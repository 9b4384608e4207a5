"""Events around a change: first events, intervals, external discussion, workflow tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import is_human, share


def discussion_events(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, place, kind, key, login, actor, state, body, created_at, submitted_at`` of reviews, comments and inline
    comments, in that order; an event without id and url gets a key of its own."""

    def tagged(events: Column, kind: str, review: bool) -> Column:
        return F.transform(
            F.coalesce(events, F.array()),
            lambda e: F.struct(
                F.lit(kind).alias("kind"), F.coalesce(e["id"], e["url"]).alias("key"), e["author"]["login"].alias("login"), e["author"]["__typename"].alias("actor"),
                (e["state"] if review else F.lit(None).cast("string")).alias("state"), e["body"].alias("body"), e["createdAt"].alias("created_at"),
                (e["submittedAt"] if review else F.lit(None).cast("string")).alias("submitted_at"),
            ),
        )

    inline = F.flatten(F.transform(F.coalesce(F.col("reviewThreads"), F.array()), lambda t: t["comments"]))
    every = F.concat(tagged(F.col("reviews"), "review", True), tagged(F.col("comments"), "comment", False), tagged(inline, "inline", False))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(every).alias("place", "e")).select("id", "place", "e.*")
    return rows.withColumn("key", F.coalesce("key", F.concat_ws(":", "kind", F.lit("missing"), "place")))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))).where("_n = 1").drop("_n")


def discussion_features(docs: DataFrame, days: int = 30) -> DataFrame:
    """Per document with ``id, author_login, created_at, merged_at``: counts of external texts and reviews.

    External are people other than the author. Events are deduplicated first. The text count over the first days uses
    the creation time, before-or-after-merge counts a review's submission time; an event at the merge is after it.
    """
    events = keep_first(discussion_events(docs), ["id", "key"], ["place"])
    base = docs.select("id", F.lower(F.col("author.login")).alias("_author"), F.to_timestamp("createdAt").alias("_created"), F.to_timestamp("mergedAt").alias("_merged"))
    e = events.join(base, "id").where(is_human(F.col("login"), F.col("actor")) & ~F.lower(F.col("login")).eqNullSafe(F.col("_author")))
    text = F.coalesce(F.trim("body") != "", F.lit(False))
    first = F.to_timestamp(F.coalesce("created_at", "submitted_at"))
    when = F.to_timestamp(F.when(F.col("kind") == "review", F.coalesce("submitted_at", "created_at")).otherwise(F.col("created_at")))
    within = lambda t: F.coalesce((t >= F.col("_created")) & (t < F.col("_created") + F.expr(f"interval {days} days")), F.lit(False))
    pre = F.coalesce((when >= F.col("_created")) & (when < F.col("_merged")), F.lit(False))
    post = F.coalesce(when >= F.col("_merged"), F.lit(False))
    review = (F.col("kind") == "review") & when.isNotNull() & ~F.coalesce(F.col("state") == "PENDING", F.lit(False))
    approved = review & pre & F.coalesce(F.col("state") == "APPROVED", F.lit(False))
    counts = {
        "ext_text_30d": text & within(first), "ext_text_premerge_all": text & pre, "ext_text_premerge_30d": text & pre & within(when),
        "ext_text_postmerge_30d": text & post & within(when), "ext_review_all": review, "ext_review_premerge": review & pre,
        "ext_approval_premerge": approved, "ext_approval_empty_premerge": approved & ~text,
    }
    found = e.groupBy("id").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    out = docs.select("id").join(found, "id", "left").select("id", *[F.coalesce(k, F.lit(0)).alias(k) for k in counts])
    return out.withColumn("premerge_external_evidence", (F.col("ext_text_premerge_all") > 0) | (F.col("ext_review_premerge") > 0))


def first_after(starts: DataFrame, ends: DataFrame, key: str, start: str, end: str, id_col: str) -> DataFrame:
    """``id_col`` of each start with the first end of the same key strictly later, or null.

    One union and one running minimum from the back per key, instead of a join of all pairs.
    """
    a = starts.select(F.col(key), F.col(start).alias("_t"), F.lit(1).alias("_start"), F.col(id_col))
    b = ends.select(F.col(key), F.col(end).alias("_t"), F.lit(0).alias("_start"), F.lit(None).cast(starts.schema[id_col].dataType).alias(id_col))
    both = a.unionByName(b)
    later = Window.partitionBy(key).orderBy(F.col("_t").desc(), F.col("_start").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = F.min(F.when((F.col("_start") == 0), F.col("_t"))).over(later)
    return both.withColumn("first_end", found).where("_start = 1").select(id_col, key, F.col("_t").alias(start), "first_end")


def events_within(starts: DataFrame, events: DataFrame, key: str, start: str, when: str, id_col: str, seconds: int) -> DataFrame:
    """``id_col, n``: events of the same key in [start, start + seconds); starts without any have 0.

    The time line is cut into cells of the interval's length, so an event meets starts of its own and the previous cell
    only: an equi-join on (key, cell) with a residual range.
    """
    cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    a = starts.select(F.col(key), F.col(id_col), F.col(start).alias("_s"), F.explode(F.array(cell(start), cell(start) + 1)).alias("_cell"))
    b = events.select(F.col(key), F.col(when).alias("_t"), cell(when).alias("_cell"))
    met = a.join(b, [key, "_cell"]).where((F.col("_t") >= F.col("_s")) & (F.col("_t") < F.col("_s") + F.expr(f"interval {seconds} seconds")))
    counts = met.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return starts.select(id_col).join(counts, id_col, "left").select(id_col, F.coalesce("n", F.lit(0)).alias("n"))


def workflow() -> list[Column]:
    """Measures of merged changes; the self-merge rate is over those whose two actors are known, the rest over all."""
    n = F.count(F.lit(1))
    known = F.col("author_known") & F.col("merger_known")
    pct = lambda c: share(F.count_if(c), n)
    return [
        n.alias("n"), F.countDistinct("repository_id").alias("repos"), F.count_if(known).alias("known_author_merger"),
        F.count_if(known & F.col("same_author_merger")).alias("same_author_merger_n"), share(F.count_if(known & F.col("same_author_merger")), F.count_if(known)).alias("same_author_merger_pct"),
        F.percentile("merge_minutes", F.lit(0.5)).alias("median_merge_minutes"), pct(F.col("merge_minutes") <= 5).alias("fast_5m_pct"), pct(F.col("merge_minutes") <= 60).alias("fast_1h_pct"),
        pct(F.col("texts_before") > 0).alias("text_before_pct"), pct((F.col("texts_after") > 0) & (F.col("texts_before") == 0)).alias("postmerge_only_pct"),
    ]
