"""Queries: matched contrasts, inference, standardisation, decomposition, tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.records import bins
from ..operators import contrasts as c
from .fixtures import CHANGES_SQL, PERIODS, changes
from .registry import query

W = f"WITH {CHANGES_SQL}"
KEYS = ["repository_id", "agent", "quarter"]


def feature_arm():
    return F.when(F.col("task_type") == "feature", True).when(F.col("task_type") == "bug_fix", False)


def period_arm():
    return F.when(F.col("quarter") == PERIODS[1], True).when(F.col("quarter") == PERIODS[0], False)


IN_PERIODS = f"('{PERIODS[0]}', '{PERIODS[1]}')"


def strata_sql(keys: str, arm: str, delta: str, source: str = "changes", least: int = 1) -> str:
    """CTEs arms, strata and repos; ``arm`` gives 1, 0 or null, ``delta`` uses quantities with suffixes 1 and 0."""
    return f"""arms AS (SELECT *, {arm} AS arm FROM {source}),
one AS (SELECT {keys}, count(*) AS n1, median(changed_lines) AS m1, avg(merged::INT) AS r1, avg(touches_test::INT) AS t1 FROM arms WHERE arm = 1 GROUP BY {keys}),
two AS (SELECT {keys}, count(*) AS n0, median(changed_lines) AS m0, avg(merged::INT) AS r0, avg(touches_test::INT) AS t0 FROM arms WHERE arm = 0 GROUP BY {keys}),
strata AS (SELECT *, {delta} AS delta, n1 + n0 AS weight FROM one JOIN two USING ({keys}) WHERE least(n1, n0) >= {least}),
repos AS (SELECT repository_id, sum(delta * weight) / sum(weight) AS delta, sum(weight)::BIGINT AS n, count(*) AS k FROM strata GROUP BY repository_id)"""


def summary_sql(statistic: str) -> str:
    return f"""SELECT count(*) AS repositories, sum(k)::BIGINT AS strata, sum(n)::BIGINT AS "rows", {statistic}(delta) AS estimate, count(*) FILTER (delta > 1e-12) AS positive,
count(*) FILTER (delta < -1e-12) AS negative, count(*) FILTER (abs(delta) <= 1e-12) AS tied FROM repos"""


LOG, ARM = "ln(1 + m1) - ln(1 + m0)", "CASE task_type WHEN 'feature' THEN 1 WHEN 'bug_fix' THEN 0 END"
KEY_SQL = 'repository_id, agent, "quarter"'
BASE = strata_sql(KEY_SQL, ARM, LOG)


@query(f"{W}, {BASE} SELECT repository_id, delta, n AS \"rows\", k AS strata FROM repos", ["delta"])
def matched_strata(spark, sf_dir):
    """M1 by repository: the weighted contrast of feature and repair sizes within repository, agent and quarter."""
    return c.within_repositories(c.matched_strata(changes(spark, sf_dir), KEYS, feature_arm(), "changed_lines"))


@query(f"{W}, {BASE} {summary_sql('median')}", ["estimate"])
def matched_contrast(spark, sf_dir):
    """M1 in one row."""
    return c.contrast(c.matched_strata(changes(spark, sf_dir), KEYS, feature_arm(), "changed_lines"))


@query(f"{W}, {strata_sql('repository_id', ARM, LOG)} {summary_sql('median')}", ["estimate"])
def matched_by_repository_only(spark, sf_dir):
    """M1 with repositories as the only strata."""
    return c.contrast(c.matched_strata(changes(spark, sf_dir), ["repository_id"], feature_arm(), "changed_lines"))


@query(f"{W}, {strata_sql(KEY_SQL, ARM, LOG, least=2)} {summary_sql('median')}", ["estimate"])
def matched_contrast_two_each(spark, sf_dir):
    """At least two changes in each arm."""
    return c.contrast(c.matched_strata(changes(spark, sf_dir), KEYS, feature_arm(), "changed_lines", least=2))


@query(f"{W}, whole AS (SELECT * FROM changes WHERE files_complete), {strata_sql(KEY_SQL, ARM, LOG, 'whole')} {summary_sql('median')}", ["estimate"])
def matched_contrast_complete(spark, sf_dir):
    """M2, F1: complete file lists only."""
    return c.contrast(c.matched_strata(changes(spark, sf_dir).where("files_complete"), KEYS, feature_arm(), "changed_lines"))


TEXT_KEYS, RATE = 'agent, repository_id, task_type, "quarter"', "100.0 * (r1 - r0)"
TEXT_ARM = "has_text::INT"


@query(
    f"""{W}, {strata_sql(TEXT_KEYS, TEXT_ARM, RATE)}, ar AS (SELECT agent, repository_id, sum(delta * weight) / sum(weight) AS d, sum(weight) AS n, count(*) AS k FROM strata GROUP BY ALL),
raw AS (SELECT agent, 100.0 * (avg(merged::INT) FILTER (has_text) - avg(merged::INT) FILTER (NOT has_text)) AS raw_pp FROM changes GROUP BY agent)
SELECT agent, count(*) AS repositories, sum(k)::BIGINT AS strata, sum(n)::BIGINT AS "rows", avg(d) AS difference_pp, any_value(raw_pp) AS raw_pp FROM ar JOIN raw USING (agent) GROUP BY agent""",
    ["difference_pp", "raw_pp"],
)
def discussion_contrast(spark, sf_dir):
    """M3: merged rate with and without discussion per agent, matched and raw."""
    df = changes(spark, sf_dir)
    strata = c.matched_strata(df, ["agent", "repository_id", "task_type", "quarter"], F.col("has_text"), "merged", "rate")
    repos = strata.groupBy("agent", "repository_id").agg((F.sum(F.col("delta") * F.col("weight")) / F.sum("weight")).alias("d"), F.sum("weight").alias("n"), F.count(F.lit(1)).alias("k"))
    rate = lambda x: F.avg(F.when(F.col("has_text") == x, F.col("merged").cast("double")))
    raw = df.groupBy("agent").agg((100.0 * (rate(True) - rate(False))).alias("raw_pp"))
    return repos.groupBy("agent").agg(F.count(F.lit(1)).alias("repositories"), F.sum("k").alias("strata"), F.sum("n").alias("rows"), F.avg("d").alias("difference_pp")).join(raw, "agent")


@query(f"{W}, done AS (SELECT * FROM changes WHERE state <> 'OPEN'), {strata_sql(TEXT_KEYS, TEXT_ARM, RATE, 'done')} {summary_sql('avg')}", ["estimate"])
def discussion_contrast_resolved(spark, sf_dir):
    """M4: resolved changes only."""
    df = changes(spark, sf_dir).where("state <> 'OPEN'")
    return c.contrast(c.matched_strata(df, ["agent", "repository_id", "task_type", "quarter"], F.col("has_text"), "merged", "rate"), statistic="mean")


@query(f"{W}, src AS (SELECT * FROM changes WHERE touches_source), {strata_sql(KEY_SQL, ARM, '100.0 * (t1 - t0)', 'src', 2)} {summary_sql('avg')}", ["estimate"])
def test_cochange_contrast(spark, sf_dir):
    """M5: how often tests change along, features against repairs, two of each at least."""
    df = changes(spark, sf_dir).where("touches_source")
    return c.contrast(c.matched_strata(df, KEYS, feature_arm(), "touches_test", "rate", 2), statistic="mean")


PERIOD_ARM = f"CASE \"quarter\" WHEN '{PERIODS[1]}' THEN 1 WHEN '{PERIODS[0]}' THEN 0 END"


@query(f"{W}, fix AS (SELECT * FROM changes WHERE task_type = 'bug_fix'), {strata_sql('repository_id, agent', PERIOD_ARM, LOG, 'fix')} {summary_sql('median')}", ["estimate"])
def paired_period_contrast(spark, sf_dir):
    """M6: repair sizes in two quarters within repository and agent."""
    df = changes(spark, sf_dir).where("task_type = 'bug_fix'")
    return c.contrast(c.matched_strata(df, ["repository_id", "agent"], period_arm(), "changed_lines"))


FLAGS = ["merged", "touches_test", "touches_source", "cross_file", "files_complete"]
TAIL_SQL = """least(1.0, 2.0 * list_sum(list_transform(range(0, least(positive, negative)::BIGINT + 1),
 lambda k: exp(lgamma(positive + negative + 1) - lgamma(k + 1) - lgamma(positive + negative - k + 1) - (positive + negative) * ln(2)))))"""


def period_rates_sql(flag: str) -> str:
    return f"""SELECT '{flag}' AS category, count(*) AS repositories, avg(d) AS mean_pp, count(*) FILTER (d > 1e-10) AS positive, count(*) FILTER (d < -1e-10) AS negative, count(*) FILTER (abs(d) <= 1e-10) AS tied FROM (
 SELECT repository_id, sum(d * w) / sum(w) AS d FROM (SELECT repository_id, agent, 100.0 * (avg({flag}::INT) FILTER ("quarter" = '{PERIODS[1]}') - avg({flag}::INT) FILTER ("quarter" = '{PERIODS[0]}')) AS d, count(*) AS w
 FROM changes WHERE "quarter" IN {IN_PERIODS} GROUP BY ALL HAVING count(DISTINCT "quarter") = 2) GROUP BY repository_id)"""


@query(
    f"""{W}, each AS ({' UNION ALL '.join(period_rates_sql(f) for f in FLAGS)}), p AS (SELECT *, CASE WHEN positive + negative = 0 THEN 1.0 ELSE {TAIL_SQL} END AS p_sign FROM each)
SELECT category, repositories, mean_pp, positive, negative, tied, p_sign, max(least(1.0, p_sign * k)) OVER (ORDER BY p_sign, category ROWS UNBOUNDED PRECEDING) AS p_holm
FROM (SELECT *, 6 - row_number() OVER (ORDER BY p_sign, category) AS k FROM p)""",
    ["mean_pp", "p_sign", "p_holm"],
)
def paired_rates_family(spark, sf_dir):
    """Five rates between two quarters, each with an exact sign test, adjusted as one family."""
    family = c.rate_contrasts(changes(spark, sf_dir), ["repository_id", "agent"], period_arm(), FLAGS, eps=1e-10)
    tested = c.holm(c.sign_test(family))
    return tested.select("category", "repositories", F.col("estimate").alias("mean_pp"), "positive", "negative", "tied", "p_sign", "p_holm")


@query(
    f"""{W}, {BASE}, g AS (SELECT count(*) FILTER (delta > 1e-12) AS positive, count(*) FILTER (delta < -1e-12) AS negative FROM repos)
SELECT positive, negative, {TAIL_SQL} AS p_sign, log10({TAIL_SQL}) AS log10_p_sign FROM g""",
    ["p_sign", "log10_p_sign"],
)
def sign_test_of_contrast(spark, sf_dir):
    """M10 on M1."""
    return c.sign_test(matched_contrast(spark, sf_dir)).select("positive", "negative", "p_sign", "log10_p_sign")


BAND_SQL = "CASE WHEN changed_lines <= 50 THEN 'a' WHEN changed_lines <= 200 THEN 'b' ELSE 'c' END"


@query(
    f"""{W}, banded AS (SELECT *, {BAND_SQL} AS band FROM changes), both_arms AS (SELECT {KEY_SQL}, band FROM banded WHERE task_type IN ('feature', 'bug_fix') GROUP BY ALL HAVING count(DISTINCT task_type) = 2),
kept AS (SELECT banded.* FROM banded JOIN both_arms USING ({KEY_SQL}, band) WHERE task_type IN ('feature', 'bug_fix')), {strata_sql(KEY_SQL, ARM, '100.0 * (t1 - t0)', 'kept')} {summary_sql('avg')}""",
    ["estimate"],
)
def common_support_contrast(spark, sf_dir):
    """The contrast on changes whose stratum and size band hold both arms."""
    df = changes(spark, sf_dir).withColumn("band", bins(F.col("changed_lines"), [-1, 50, 200, float("inf")], ["a", "b", "c"]))
    kept = c.common_support(df, [*KEYS, "band"], feature_arm())
    return c.contrast(c.matched_strata(kept, KEYS, feature_arm(), "touches_test", "rate"), statistic="mean")


Z = c.Z95
WILSON_SQL = f"""(h / n + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) AS centre, {Z} * sqrt(h / n * (1 - h / n) / n + {Z * Z} / (4.0 * n * n)) / (1 + {Z * Z} / n) AS margin"""


@query(f"{W}, g AS (SELECT repository_id, count(*)::DOUBLE AS n, count(*) FILTER (merged)::DOUBLE AS h FROM changes GROUP BY 1) SELECT repository_id, greatest(0, centre - margin) AS low, least(1, centre + margin) AS high FROM (SELECT *, {WILSON_SQL} FROM g)", ["low", "high"])
def wilson_by_repository(spark, sf_dir):
    """M9: score intervals of merged rates."""
    g = changes(spark, sf_dir).groupBy("repository_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("merged").cast("double").alias("h"))
    low, high = c.wilson(F.col("h"), F.col("n"))
    return g.select("repository_id", low.alias("low"), high.alias("high"))


#: Replicates of medians and means, and of ratios; fewest clusters of a ratio's interval.
REPS, RATIO_REPS, LEAST_CLUSTERS = 5000, 2000, 20


def grid_sql(source: str, seed: str, statistic: str, reps: int = REPS, least: int = 1) -> str:
    return f"""numbered AS (SELECT row_number() OVER (ORDER BY repository_id) - 1 AS ix, v, w FROM {source}), size AS (SELECT count(*) AS n FROM numbered),
grid AS (SELECT rep, draw, ('0x' || substr(md5('{seed}:' || rep || ':' || draw), 1, 15))::BIGINT % n AS ix FROM size, (SELECT unnest(range({reps})) AS rep), (SELECT unnest(range((SELECT n FROM size))) AS draw)),
reps AS (SELECT rep, {statistic} AS s FROM grid JOIN numbered USING (ix) GROUP BY rep)
SELECT (SELECT n FROM size) AS n, CASE WHEN (SELECT n FROM size) >= {least} THEN quantile_cont(s, 0.025) END AS low, CASE WHEN (SELECT n FROM size) >= {least} THEN quantile_cont(s, 0.975) END AS high FROM reps"""


@query(f"{W}, {BASE}, d AS (SELECT repository_id, delta AS v, 1.0 AS w FROM repos), {grid_sql('d', 'boot', 'median(v)')}", ["low", "high"])
def bootstrap_median(spark, sf_dir):
    """The interval of the median over repositories."""
    repos = c.within_repositories(c.matched_strata(changes(spark, sf_dir), KEYS, feature_arm(), "changed_lines"))
    return c.bootstrap(repos, "delta", ["repository_id"], REPS, "median")


@query(f"{W}, d AS (SELECT repository_id, count(*) FILTER (merged)::DOUBLE AS v, count(*)::DOUBLE AS w FROM changes GROUP BY 1), {grid_sql('d', 'cluster', 'sum(v) / sum(w)', RATIO_REPS, LEAST_CLUSTERS)}", ["low", "high"])
def bootstrap_ratio(spark, sf_dir):
    """The interval of a pooled rate when repositories are drawn."""
    g = changes(spark, sf_dir).groupBy("repository_id").agg(F.count_if("merged").cast("double").alias("v"), F.count(F.lit(1)).cast("double").alias("w"))
    return c.bootstrap(g, "v", ["repository_id"], RATIO_REPS, seed="cluster", weight="w", least=LEAST_CLUSTERS)


@query(f"{W}, d AS (SELECT repository_id, count(*) FILTER (merged)::DOUBLE AS v, count(*)::DOUBLE AS w FROM changes WHERE repository_id < 12 GROUP BY 1), {grid_sql('d', 'cluster', 'sum(v) / sum(w)', RATIO_REPS, LEAST_CLUSTERS)}", ["low", "high"])
def bootstrap_ratio_of_few(spark, sf_dir):
    """Of a scope with fewer than 20 repositories no interval is given."""
    few = changes(spark, sf_dir).where("repository_id < 12").groupBy("repository_id").agg(F.count_if("merged").cast("double").alias("v"), F.count(F.lit(1)).cast("double").alias("w"))
    return c.bootstrap(few, "v", ["repository_id"], RATIO_REPS, seed="cluster", weight="w", least=LEAST_CLUSTERS)


def standard_sql(flag: str) -> str:
    q1, q2 = PERIODS
    return f"""SELECT '{flag}' AS category, 100.0 * sum(r1 * w) / sum(w) AS q1_pct, 100.0 * sum(r2 * w) / sum(w) AS q2_pct, 100.0 * sum(r2 * w) / sum(w) - 100.0 * sum(r1 * w) / sum(w) AS delta_pp, count(*) AS cells, sum(n1)::BIGINT AS q1_n, sum(n2)::BIGINT AS q2_n FROM (
 SELECT agent, task_type, avg({flag}::INT) FILTER ("quarter" = '{q1}') AS r1, avg({flag}::INT) FILTER ("quarter" = '{q2}') AS r2, count(*) FILTER ("quarter" = '{q1}') AS n1, count(*) FILTER ("quarter" = '{q2}') AS n2, count(*) AS w
 FROM changes WHERE "quarter" IN {IN_PERIODS} GROUP BY ALL HAVING count(DISTINCT "quarter") = 2)"""


@query(f"{W} {' UNION ALL '.join(standard_sql(f) for f in FLAGS)}", ["q1_pct", "q2_pct", "delta_pp"])
def standardised_rates(spark, sf_dir):
    """Rates of two quarters under fixed agent and task weights."""
    return c.standardised(changes(spark, sf_dir), ["agent", "task_type"], "quarter", PERIODS, FLAGS)


@query(
    f"""{W}, n AS (SELECT agent, count(*) FILTER ("quarter" = '{PERIODS[0]}') AS na, count(*) FILTER ("quarter" = '{PERIODS[1]}') AS nb, avg(merged::INT) FILTER ("quarter" = '{PERIODS[0]}') AS ra, avg(merged::INT) FILTER ("quarter" = '{PERIODS[1]}') AS rb
 FROM changes WHERE "quarter" IN {IN_PERIODS} GROUP BY agent), p AS (SELECT *, na / sum(na) OVER () AS pa, nb / sum(nb) OVER () AS pb FROM n)
SELECT bool_and(na > 0 AND nb > 0) AS supported, 100 * (sum(pb * rb) - sum(pa * ra)) AS gap_pp, 100 * sum((pb - pa) * (ra + rb) / 2) AS composition_pp, 100 * sum((rb - ra) * (pa + pb) / 2) AS within_pp FROM p""",
    ["gap_pp", "composition_pp", "within_pp"],
)
def decomposed_gap(spark, sf_dir):
    """The change of the merged rate, by agent mix and within agents."""
    return c.decomposed(changes(spark, sf_dir), F.col("quarter"), PERIODS, "agent", "merged")


@query(
    f"""{W}, k AS (SELECT agent, same_author_merger AS s, count(*) AS n, avg(merged::INT) AS r FROM changes WHERE author_known AND merger_known GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY agent) AS p FROM k)
SELECT a.agent AS group_a, b.agent AS group_b, 100 * sum(b.p * b.r - a.p * a.r) AS gap_pp, 100 * sum((b.p - a.p) * (a.r + b.r) / 2) AS composition_pp, 100 * sum((b.r - a.r) * (a.p + b.p) / 2) AS within_pp
FROM p a JOIN p b ON a.s = b.s AND a.agent < b.agent GROUP BY ALL HAVING count(*) = 2""",
    ["gap_pp", "composition_pp", "within_pp"],
)
def decomposed_agent_pairs(spark, sf_dir):
    """The same for every pair of agents, by who merges."""
    return c.decomposed_pairs(changes(spark, sf_dir).where("author_known and merger_known"), "agent", "same_author_merger", "merged")


@query(f"{W} SELECT agent, changed_lines, count(*) AS n, sum(count(*)) OVER (PARTITION BY agent ORDER BY changed_lines) / sum(count(*)) OVER (PARTITION BY agent) AS ecdf FROM changes GROUP BY agent, changed_lines", ["ecdf"])
def ecdf_of_lines(spark, sf_dir):
    """M15."""
    return c.ecdf(changes(spark, sf_dir), "changed_lines", ["agent"])


def tail_sql(mode: str, value: str, where: str) -> str:
    return f"""SELECT agent, '{mode}' AS mode, count(*) AS prs, count(*) FILTER (agent_detected) AS signal_prs, 100.0 * count(*) FILTER (agent_detected) / count(*) AS pr_share_pct, sum({value})::DOUBLE AS total_lines,
coalesce(sum({value}) FILTER (agent_detected), 0)::DOUBLE AS signal_lines, 100.0 * coalesce(sum({value}) FILTER (agent_detected), 0) / sum({value}) AS line_share_pct FROM ranked WHERE {where} GROUP BY agent"""


@query(
    f"""{W}, ranked AS (SELECT changes.*, row_number() OVER (PARTITION BY agent ORDER BY changed_lines DESC, id) AS r, count(*) OVER (PARTITION BY agent) AS n, cap FROM changes JOIN (SELECT agent, quantile_cont(changed_lines, 0.99) AS cap FROM changes GROUP BY agent) USING (agent))
{tail_sql('raw', 'changed_lines', 'true')} UNION ALL {tail_sql('drop_top_1pct', 'changed_lines', 'r > ceil(n * 0.01)')} UNION ALL {tail_sql('winsorize_99pct', 'least(changed_lines, cap)', 'true')}""",
    ["pr_share_pct", "total_lines", "signal_lines", "line_share_pct"],
)
def tail_sensitivity(spark, sf_dir):
    """Line shares raw, without the top 1 % and with lines cut at the 99th percentile."""
    return c.tails(changes(spark, sf_dir), "changed_lines", "agent_detected", "id", ["agent"])
