"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Token weights of the cells are raked to the target share of
every source, language and topic in turn until all three agree; a cell's ratio of wanted to present tokens, scaled to
the budget and at most 1, is the chance of each of its documents. Documents are drawn by a hash of their id.
Topics are learned from the texts (see topics) where no column gives them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import topics
from .scratch import fresh, materialize

MARGINS = ("source", "lang", "topic")
#: Cells that are raked on the driver and broadcast; more are raked as a table, to the same weights.
MOST_CELLS = 200_000
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
NONE = "(none)"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tempered(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Shares proportional to a power of the tokens: 1 leaves the mixture, 0 makes it even."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Cell weights (summing to 1) with the target margins; codes: a column per margin."""
    weight = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for j, target in enumerate(targets):
            have = np.bincount(codes[:, j], weight, len(target)).astype(float)
            factor = np.divide(target, have, out=np.ones_like(have), where=have > 0)
            worst = max(worst, float(np.abs(factor[have > 0] - 1).max(initial=0.0)))
            weight = weight * factor[codes[:, j]]
        if worst < tolerance:
            break
    return weight / max(weight.sum(), 1e-300)


def chances(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Each cell's chance min(1, s * weight / tokens), with s such that ``budget`` tokens are expected."""
    ratio = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    if tokens[ratio > 0].sum() <= budget:
        return (ratio > 0).astype(float)
    low, high = 0.0, budget / max(weight.sum(), 1e-300) + 1.0
    while (np.minimum(1, high * ratio) * tokens).sum() < budget:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * tokens).sum() < budget else (low, mid)
    return np.minimum(1, high * ratio)


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]], powers: dict[str, float], rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``cells`` (a column per margin, and ``tokens``) with ``weight``: ``rake`` by grouped sums and joins, for any number of cells.

    Each round is written before the next, so a lost executor costs one round; the driver sees one number a round.
    """
    spark, wanted = cells.sparkSession, {}
    for margin in MARGINS:
        sums = cells.groupBy(margin).agg(F.sum("tokens").alias("have"))
        if targets.get(margin):
            given = spark.createDataFrame([(str(k), float(v)) for k, v in targets[margin].items()], f"{margin} string, target double")
            sums = sums.join(given, margin, "left").select(margin, F.coalesce("target", F.lit(0.0)).alias("target"))
        else:
            sums = sums.select(margin, F.when(F.col("have") > 0, F.pow("have", F.lit(powers[margin]))).otherwise(0.0).alias("target"))
        total = sums.agg(F.sum("target")).first()[0] or 1e-300
        wanted[margin] = materialize(sums.withColumn("target", F.col("target") / total), "mix-target")
    total = cells.agg(F.sum("tokens")).first()[0] or 1e-300
    now = cells.withColumn("weight", F.col("tokens") / total)
    for _ in range(rounds):
        now = now.withColumn("worst", F.lit(0.0))
        for margin in MARGINS:
            have = now.groupBy(margin).agg(F.sum("weight").alias("have")).join(wanted[margin], margin)
            factor = have.select(margin, F.when(F.col("have") > 0, F.col("target") / F.col("have")).alias("factor"))
            off = F.greatest("worst", F.coalesce(F.abs(F.col("factor") - 1), F.lit(0.0)))
            now = now.join(factor, margin).select(*MARGINS, "tokens", (F.col("weight") * F.coalesce("factor", F.lit(1.0))).alias("weight"), off.alias("worst"))
        now = materialize(now, "mix-round")
        if (now.agg(F.max("worst")).first()[0] or 0.0) < tolerance:
            break
    total = now.agg(F.sum("weight")).first()[0] or 1e-300
    return now.select(*MARGINS, "tokens", (F.col("weight") / total).alias("weight"))


def chances_table(cells: DataFrame, keep_share: float) -> DataFrame:
    """``cells`` with ``chance``: as ``chances``, the scale by passes that each try 64 values between two bounds."""
    rows = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    reach, budget = rows.agg(F.sum(F.when(F.col("ratio") > 0, F.col("tokens")).otherwise(0.0)), F.sum("tokens") * keep_share).first()
    if (reach or 0.0) <= (budget or 0.0):
        return rows.withColumn("chance", F.when(F.col("ratio") > 0, 1.0).otherwise(0.0)).drop("ratio")
    spent = lambda scales: rows.agg(*[F.sum(F.least(F.lit(1.0), F.col("ratio") * s) * F.col("tokens")) for s in scales]).first()
    low, high = 0.0, budget + 1.0
    while spent([high])[0] < budget:
        low, high = high, high * 64
    while high - low > 1e-14 * high:
        scales = [float(x) for x in np.linspace(low, high, 65)[1:]]
        place = next((i for i, x in enumerate(spent(scales)) if x >= budget), 63)
        narrowed = (scales[place - 1] if place else low, scales[place])
        if narrowed == (low, high):
            break
        low, high = narrowed
    return rows.withColumn("chance", F.least(F.lit(1.0), F.col("ratio") * high)).drop("ratio")


def draw(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the id and the seed, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def _plan(sums: DataFrame, targets: dict[str, dict[str, float]], powers: dict[str, float], keep_share: float) -> DataFrame:
    """cell, weight, chance of a bounded number of cells, raked here."""
    cells = sums.orderBy(*MARGINS).collect()
    tokens = np.array([r["tokens"] for r in cells], float)
    codes, wanted = np.zeros((len(cells), len(MARGINS)), np.int64), []
    for j, margin in enumerate(MARGINS):
        values = sorted({r[margin] for r in cells})
        number = {v: i for i, v in enumerate(values)}
        codes[:, j] = [number[r[margin]] for r in cells]
        have = dict(zip(values, np.bincount(codes[:, j], tokens, len(values)).tolist(), strict=True)) if cells else {}
        share = targets.get(margin) or tempered(have, powers[margin])
        target = np.array([share.get(v, 0.0) for v in values])
        wanted.append(target / max(target.sum(), 1e-300))
    weight = rake(tokens, codes, wanted)
    chance = chances(tokens, weight, keep_share * tokens.sum())
    return sums.sparkSession.createDataFrame(
        [(tuple(r[m] for m in MARGINS), float(w), float(c)) for r, w, c in zip(cells, weight, chance, strict=True)],
        "cell struct<source:string,lang:string,topic:string>, weight double, chance double",
    )


def decide(
    docs: DataFrame,
    keep_share: float = 0.5,
    targets: dict[str, dict[str, float]] | None = None,
    powers: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    seed: str = "mix",
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """``docs`` plus a last column (a struct of ``source, lang, topic, n_tokens, weight, chance, sampled``) whose name none of
    ``docs`` has; no row moves.

    See ``mix``. Texts are read once for the cells' sums and once to decide, and without ``topic`` once more
    to learn topics from all of them.
    """
    mark = fresh(docs.columns, "_mix")[0]
    return _drawn(docs.withColumn(mark, _cell(docs, text_col, topic)), docs.columns, mark, keep_share, targets, powers, id_col, seed, most_cells)


def _cell(docs: DataFrame, text_col: str, topic: Column | None) -> Column:
    """A struct of ``source, lang, topic, n_tokens``."""
    text = F.col(text_col)
    n_tokens = token_count(text)
    if topic is None:
        learned = topics.topic_and_words(topics.fit(docs, text_col), text, F.col("lang"))
        topic, n_tokens = learned["topic"], learned["n_words"]
    return F.struct(
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(topic.cast("string"), F.lit(NONE)).alias("topic"),
        n_tokens.alias("n_tokens"),
    )


def _drawn(
    rows: DataFrame, columns: list[str], mark: str, keep_share: float, targets: dict[str, dict[str, float]] | None, powers: dict[str, float] | None, id_col: str, seed: str, most_cells: int
) -> DataFrame:
    """``columns`` of ``rows`` and, under the name of their cell ``mark``, what ``decide`` adds."""
    own, weight_of, chance_of = fresh([*columns, mark], "_cell", "_weight", "_chance")
    keys = [F.col(mark)[m].alias(m) for m in MARGINS]
    powers = POWERS | (powers or {})
    sums = materialize(rows.groupBy(*keys).agg(F.sum(F.col(mark)["n_tokens"]).cast("double").alias("tokens")), "mix-cells")
    if sums.count() > most_cells:
        plan = chances_table(rake_table(sums, targets or {}, powers), keep_share)
        plan = materialize(plan.select(F.struct(*MARGINS).alias(own), F.col("weight").alias(weight_of), F.col("chance").alias(chance_of)), "mix-plan")
    else:
        plan = F.broadcast(_plan(sums, targets or {}, powers, keep_share).toDF(own, weight_of, chance_of))  # at most most_cells rows
    joined = rows.withColumn(own, F.struct(*keys)).join(plan, own)
    tokens_of = F.col(mark)["n_tokens"]
    sampled = (tokens_of == 0) | (draw(F.col(id_col), seed) < F.col(chance_of))
    decided = F.struct(*keys, tokens_of.alias("n_tokens"), F.col(weight_of).alias("weight"), F.col(chance_of).alias("chance"), sampled.alias("sampled"))
    return joined.select(*columns, decided.alias(mark))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_share: float = 0.5,
    targets: dict[str, dict[str, float]] | None = None,
    powers: dict[str, float] | None = None,
    topic: Column | None = None,
    seed: str = "mix",
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """One row per input row: ``id_col, source, lang, topic, n_tokens, weight, chance, sampled``.

    ``targets`` gives shares by margin ("source", "lang", "topic") and value; where missing they are the present
    shares raised to ``powers`` (0.5 for sources, 0.7 for languages, 0.5 for topics). Values without a target get none
    of the budget, which is ``keep_share`` of all tokens. Null source or language is a value of its own. Documents
    without tokens cost nothing and are always kept. Repeated rows are drawn alike. An empty table gives an empty
    result; columns of ``docs`` other than id, text, source and lang are not looked at.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "source", "lang")
    # texts are looked at once; their cells are written, and rows are drawn from these
    cells = materialize(own.select("id", _cell(own, "text", topic).alias("cell")), "mix-rows")
    return _drawn(cells, ["id"], "cell", keep_share, targets, powers, "id", seed, most_cells).select(F.col("id").alias(id_col), "cell.*")
