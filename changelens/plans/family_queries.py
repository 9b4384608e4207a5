"""Queries: families of module contrasts, fixed-weight profiles, coverage tables, shares by month, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as r
from ..operators import aggregates as a
from ..operators import contrasts as c
from ..operators import ordering
from .contrast_queries import IN_PERIODS, TAIL_SQL, period_arm
from .fixtures import CHANGES_SQL, FUNCTIONAL, PERIODS, changes, files, t
from .record_queries import MODULES_SQL, SHARES_SQL, module_matrix_of, pct
from .registry import query

W = f"WITH {CHANGES_SQL}"
_NAMES = [n for m in FUNCTIONAL for n in (m, f"{m}_strict")]


def _marked_sql() -> str:
    """Changes with their modules; a change without listed files has none."""
    after_files = CHANGES_SQL[CHANGES_SQL.index("sums AS (") :]
    return f"{MODULES_SQL}, {after_files}, marked AS (SELECT changes.*, {', '.join(f'coalesce(pm.{n}, false) AS {n}' for n in _NAMES)} FROM changes LEFT JOIN pm USING (id))"


MARKED_SQL = _marked_sql()


def marked(spark, sf_dir):
    """Changes with a flag per module, and per module from directory names only."""
    flags = module_matrix_of(spark, sf_dir, False, True)
    joined = changes(spark, sf_dir).join(flags, "id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(False)) for n in _NAMES})


LEVELS = (1, 2, 3)


def _family_sql(module: str, least: int) -> str:
    return f"""SELECT '{module}' AS category, {least} AS least, count(*) AS repositories, sum(k)::BIGINT AS strata, sum(n)::BIGINT AS "rows", avg(d) AS mean_pp, count(*) FILTER (d > 1e-10) AS positive, count(*) FILTER (d < -1e-10) AS negative, count(*) FILTER (abs(d) <= 1e-10) AS tied FROM (
 SELECT repository_id, sum(d * w) / sum(w) AS d, sum(w) AS n, count(*) AS k FROM (SELECT repository_id, agent, 100.0 * (avg({module}::INT) FILTER ("quarter" = '{PERIODS[1]}') - avg({module}::INT) FILTER ("quarter" = '{PERIODS[0]}')) AS d, count(*) AS w
 FROM marked WHERE "quarter" IN {IN_PERIODS} GROUP BY ALL HAVING least(count(*) FILTER ("quarter" = '{PERIODS[0]}'), count(*) FILTER ("quarter" = '{PERIODS[1]}')) >= {least}) GROUP BY repository_id)"""


@query(
    f"""{MARKED_SQL}, each AS ({' UNION ALL '.join(_family_sql(m, k) for m in FUNCTIONAL for k in LEVELS)}), p AS (SELECT *, CASE WHEN positive + negative = 0 THEN 1.0 ELSE {TAIL_SQL} END AS p_sign FROM each WHERE repositories > 0)
SELECT category, least, repositories, strata, "rows", mean_pp, positive, negative, tied, p_sign, max(least(1.0, p_sign * k)) OVER (PARTITION BY least ORDER BY p_sign, category ROWS UNBOUNDED PRECEDING) AS p_holm
FROM (SELECT *, count(*) OVER (PARTITION BY least) + 1 - row_number() OVER (PARTITION BY least ORDER BY p_sign, category) AS k FROM p)""",
    ["mean_pp", "p_sign", "p_holm"],
)
def module_temporal_families(spark, sf_dir):
    """Five modules between two quarters at three levels of support; each level is one Holm family."""
    family = c.rate_families(marked(spark, sf_dir), ["repository_id", "agent"], period_arm(), FUNCTIONAL, LEVELS)
    tested = c.holm(c.sign_test(family), family=["least"])
    return tested.select("category", "least", "repositories", "strata", "rows", F.col("estimate").alias("mean_pp"), "positive", "negative", "tied", "p_sign", "p_holm")


def _fixed_sql(flag: str, dims: str, source: str) -> str:
    q1, q2 = PERIODS
    return f"""SELECT '{flag}' AS category, 100.0 * sum(r1 * w) / sum(w) AS q1_pct, 100.0 * sum(r2 * w) / sum(w) AS q2_pct, 100.0 * sum(r2 * w) / sum(w) - 100.0 * sum(r1 * w) / sum(w) AS delta_pp, count(*) AS cells, sum(n1)::BIGINT AS q1_n, sum(n2)::BIGINT AS q2_n FROM (
 SELECT {dims}, avg({flag}::INT) FILTER ("quarter" = '{q1}') AS r1, avg({flag}::INT) FILTER ("quarter" = '{q2}') AS r2, count(*) FILTER ("quarter" = '{q1}') AS n1, count(*) FILTER ("quarter" = '{q2}') AS n2, count(*) AS w
 FROM {source} WHERE "quarter" IN {IN_PERIODS} GROUP BY {dims} HAVING count(DISTINCT "quarter") = 2)"""


_RATES = ["q1_pct", "q2_pct", "delta_pp"]
_STRICT = [f"{m}_strict" for m in FUNCTIONAL]
_PROFILES = {"agent": ["agent"], "agent_task": ["agent", "task_type"]}


@query(MARKED_SQL + " " + " UNION ALL ".join(f"SELECT '{mode}' AS mode, * FROM ({_fixed_sql(m, ', '.join(d), 'marked')})" for mode, d in _PROFILES.items() for m in _STRICT), _RATES)
def strict_profiles(spark, sf_dir):
    """Modules from directory names only, under fixed agent and agent-and-task weights."""
    df = marked(spark, sf_dir)
    found = [c.standardised(df, d, "quarter", PERIODS, _STRICT).select(F.lit(mode).alias("mode"), "*") for mode, d in _PROFILES.items()]
    return found[0].unionByName(found[1])


@query(f"{W}, fix AS (SELECT * FROM changes WHERE task_type = 'bug_fix') " + " UNION ALL ".join(f"SELECT '{n}' AS weighting, * FROM ({_fixed_sql(f, n, s)})" for n, s in (("agent", "changes"), ("repository_id", "fix")) for f in ("has_text", "merged")), _RATES)
def fixed_weight_rates(spark, sf_dir):
    """All changes under fixed agent weights, repairs under fixed repository weights."""
    df = changes(spark, sf_dir)
    each = (("agent", df), ("repository_id", df.where("task_type = 'bug_fix'")))
    found = [c.standardised(x, [n], "quarter", PERIODS, ["has_text", "merged"]).select(F.lit(n).alias("weighting"), "*") for n, x in each]
    return found[0].unionByName(found[1])


_DIMENSIONS = ["agent", "quarter", "task_type"]


@query(MARKED_SQL + " " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, \"{d}\" AS \"group\", '{m}' AS category, count(*) AS n, count(*) FILTER ({m}) AS prs, {pct(f'count(*) FILTER ({m})')} AS pct FROM marked GROUP BY \"{d}\"" for d in _DIMENSIONS for m in FUNCTIONAL), ["pct"])
def module_coverage(spark, sf_dir):
    """Modules by agent, quarter and task type, in one pass."""
    sums = a.by_sets(marked(spark, sf_dir), [[d] for d in _DIMENSIONS], [F.count(F.lit(1)).alias("n"), *[F.count_if(m).alias(m) for m in FUNCTIONAL]], "*")
    dimension = F.when(F.col("agent") != "*", "agent").when(F.col("quarter") != "*", "quarter").otherwise("task_type")
    rows = sums.select(dimension.alias("dimension"), F.coalesce(*[F.nullif(F.col(d), F.lit("*")) for d in _DIMENSIONS]).alias("group"), "n", *FUNCTIONAL)
    long = rows.unpivot(["dimension", "group", "n"], FUNCTIONAL, "category", "prs")
    return long.select("dimension", "group", "category", "n", "prs", r.share(F.col("prs"), F.col("n")).alias("pct"))


@query(MARKED_SQL + " " + " UNION ALL ".join(f"SELECT '{m}' AS category, count(*) AS n, count(*) FILTER ({m}) AS prs, {pct(f'count(*) FILTER ({m})')} AS pct FROM marked WHERE touches_source" for m in FUNCTIONAL), ["pct"])
def module_given_source(spark, sf_dir):
    """Modules among changes that touch source files."""
    sums = marked(spark, sf_dir).where("touches_source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(m).alias(m) for m in FUNCTIONAL])
    return sums.unpivot(["n"], FUNCTIONAL, "category", "prs").select("category", "n", "prs", r.share(F.col("prs"), F.col("n")).alias("pct"))


_AGENTS = ["codex", "copilot", "claude_code", "jules", "devin"]


@query(MARKED_SQL + " " + " UNION ALL ".join(f"SELECT '{m}' AS category, " + ", ".join(f"100.0 * avg({m}::INT) FILTER (agent = '{g}') AS {g}" for g in _AGENTS) + " FROM marked" for m in FUNCTIONAL), _AGENTS)
def module_agent_matrix(spark, sf_dir):
    """Percentage of each agent's changes that touch each module, modules by agents."""
    long = marked(spark, sf_dir).select("agent", *FUNCTIONAL).unpivot(["agent"], FUNCTIONAL, "category", "flag")
    return long.groupBy("category").pivot("agent", _AGENTS).agg(100.0 * F.avg(F.col("flag").cast("double")))


@query(f"{W} SELECT CASE WHEN grouping(repository_id) = 1 THEN 'ALL_SELECTED' ELSE repository_id::VARCHAR END AS repository_id, \"month\", {SHARES_SQL} FROM changes GROUP BY GROUPING SETS ((\"month\"), (repository_id, \"month\"))", ["pr_pct", "lines_pct"])
def monthly_shares(spark, sf_dir):
    """Shares by month, pooled and of each repository."""
    return a.by_sets(changes(spark, sf_dir), [["month"], ["repository_id", "month"]], a.shares(), "ALL_SELECTED")


_STARS = {"0": (-1, 0), "1-10": (0, 10), "11-100": (10, 100), "101-1000": (100, 1000), "1001-10000": (1000, 10000), ">10000": (10000, float("inf"))}
_STAR_SQL = ", ".join(f"('{k}', {lo}, {'1e300' if hi == float('inf') else hi})" for k, (lo, hi) in _STARS.items())


@query(f"{W} SELECT b.label AS star_bucket, count(id) AS prs, count(DISTINCT repository_id) AS repositories, 100.0 * count(id) / (SELECT count(*) FROM changes) AS pr_pct FROM (VALUES {_STAR_SQL}) b(label, lo, hi) LEFT JOIN changes ON stars > lo AND stars <= hi GROUP BY 1", ["pr_pct"])
def star_distribution(spark, sf_dir):
    """Right-closed bins; bins without changes stay, with zeros."""
    edges = [-1, *[hi for _, hi in _STARS.values()]]
    df = changes(spark, sf_dir).withColumn("star_bucket", r.bins(F.col("stars"), edges, list(_STARS)))
    counts = df.groupBy("star_bucket").agg(F.count(F.lit(1)).alias("prs"), F.countDistinct("repository_id").alias("repositories"))
    whole = counts.agg(F.sum("prs").alias("all"))  # one row
    kept = a.dense(counts, {"star_bucket": spark.createDataFrame([(k,) for k in _STARS], "star_bucket string")}, ["star_bucket"], ["prs", "repositories"])
    return kept.crossJoin(F.broadcast(whole)).select("star_bucket", "prs", "repositories", r.share(F.col("prs"), F.col("all")).alias("pr_pct"))


@query(
    f"""{W}, ranked AS (SELECT *, row_number() OVER (ORDER BY changed_lines DESC, id) AS k, count(*) OVER () AS m FROM changes)
SELECT ceil(max(m) * 0.01)::BIGINT AS top_n, 100.0 * sum(changed_lines) FILTER (k <= ceil(m * 0.01)) / sum(changed_lines) AS top_line_pct, 100.0 * avg((stars <= 10)::INT) AS low_star_pct,
 median(changed_lines) FILTER (files_complete) AS complete_lines_median, median(changed_lines) FILTER (NOT files_complete) AS incomplete_lines_median,
 median(changed_files) FILTER (files_complete) AS complete_files_median, median(changed_files) FILTER (NOT files_complete) AS incomplete_files_median FROM ranked""",
    ["top_line_pct", "low_star_pct", "complete_lines_median", "incomplete_lines_median", "complete_files_median", "incomplete_files_median"],
)
def top_records(spark, sf_dir):
    """What the largest 1 % of changes holds, changes of little-known repositories, medians by completeness of the list."""
    df = changes(spark, sf_dir).select("id", "changed_lines", "changed_files", "stars", "files_complete")
    ranked = ordering.numbered(df, [F.desc("changed_lines"), "id"], "k")
    whole = ranked.agg(F.count(F.lit(1)).alias("m"))  # one row
    top = ranked.crossJoin(F.broadcast(whole)).withColumn("top_n", F.ceil(F.col("m") * 0.01))
    sums = top.agg(
        F.max("top_n").alias("top_n"),
        r.share(F.sum(F.when(F.col("k") < F.col("top_n"), F.col("changed_lines"))), F.sum("changed_lines")).alias("top_line_pct"),
        (100.0 * F.avg((F.col("stars") <= 10).cast("double"))).alias("low_star_pct"),
    )
    medians = ordering.quantiles(ranked, [["files_complete"]], {"changed_lines": {"lines": 0.5}, "changed_files": {"files": 0.5}})
    of = lambda done, name: F.max(F.when(F.col("files_complete") == done, F.col(name)))
    wide = medians.agg(*[of(done, n).alias(f"{label}_{n}_median") for n in ("lines", "files") for done, label in ((True, "complete"), (False, "incomplete"))])
    return sums.crossJoin(F.broadcast(wide))  # one row each


@query("SELECT doc_id % 10 AS k, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(fix(?:es|ed|ing)?|bug(?:fix)?|regression|hotfix)($|[^\\p{L}\\p{N}_])')) AS titles, count(*) FILTER (regexp_replace(lower(source), '[^a-z0-9]', '', 'g') IN ('bug', 'bugfix', 'bugfixes', 'typebug', 'kindbug', 'typebugfix', 'hotfix', 'typehotfix')) AS labelled FROM documents GROUP BY 1")
def corpus_repairs(spark, sf_dir):
    """The wider repair pattern and bug labels of the cross-repository corpus."""
    df = t(spark, sf_dir, "documents")
    title, label = r.repair_title(F.col("text"), r.CORPUS_REPAIR_TITLE), r.bug_label(F.array(F.coalesce("source", F.lit(""))), r.CORPUS_BUG_LABELS)
    return df.groupBy((F.col("doc_id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(title).alias("titles"), F.count_if(label).alias("labelled"))


_RANKED_SQL = "ranked AS (SELECT *, row_number() OVER (ORDER BY changed_lines DESC, id) AS k, count(*) OVER () AS m, quantile_cont(changed_lines, 0.99) OVER () AS cap FROM changes)"


def _contribution_sql(mode: str, value: str, where: str) -> str:
    return f"""SELECT '{mode}' AS mode, repository_id, count(*) AS prs, count(*) FILTER (agent_detected) AS signal_prs, sum({value})::DOUBLE AS total_lines, coalesce(sum({value}) FILTER (agent_detected), 0)::DOUBLE AS signal_lines,
 {pct(f'coalesce(sum({value}) FILTER (agent_detected), 0)', f'sum({value})')} AS line_share_pct FROM ranked WHERE {where} GROUP BY repository_id"""


@query(f"{W}, {_RANKED_SQL} {_contribution_sql('raw', 'changed_lines', 'true')} UNION ALL {_contribution_sql('drop_top_1pct', 'changed_lines', 'k > ceil(m * 0.01)')} UNION ALL {_contribution_sql('winsorize_99pct', 'least(changed_lines, cap)', 'true')}", ["total_lines", "signal_lines", "line_share_pct"])
def tail_projects(spark, sf_dir):
    """Each project's part of the lines in the three treatments of the largest changes."""
    return c.tail_contributions(changes(spark, sf_dir), "changed_lines", "agent_detected", "id", "repository_id")


@query(f"{W}, {_RANKED_SQL} SELECT id, repository_id, changed_lines, agent_detected, k AS place FROM ranked WHERE k <= ceil(m * 0.01)")
def top_record_audit(spark, sf_dir):
    """The largest 1 % of changes, one by one."""
    placed, top = c.top_rows(changes(spark, sf_dir).select("id", "repository_id", "changed_lines", "agent_detected"), "changed_lines", "id")
    return placed.crossJoin(F.broadcast(top)).where("_place < top_n").select("id", "repository_id", "changed_lines", "agent_detected", (F.col("_place") + 1).alias("place"))


_POPULATIONS = {"all_annotated": "true", "feature": "task_type = 'feature'", "bug_fix": "task_type = 'bug_fix'"}


@query(f"{W} " + " UNION ALL ".join(f"SELECT '{n}' AS population, \"quarter\", count(*) AS prs, median(changed_files) AS files_median, median(changed_lines) AS lines_median, count(*) FILTER (has_text) AS discussion_prs, 100.0 * avg(has_text::INT) AS discussion_pct, 100.0 * avg(cross_file::INT) AS cross_file_pct FROM changes WHERE \"quarter\" IN {IN_PERIODS} AND {e} GROUP BY 2" for n, e in _POPULATIONS.items()), ["files_median", "lines_median", "discussion_pct", "cross_file_pct"])
def quarterly_evidence(spark, sf_dir):
    """Sizes and discussion of all changes, features and repairs in two quarters."""
    df = changes(spark, sf_dir).where(F.col("quarter").isin(*PERIODS))
    tags = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in _POPULATIONS.items()]))
    half = lambda v: F.percentile(v, F.lit(0.5)).alias(f"{v[8:]}_median")
    rate = lambda v: 100.0 * F.avg(F.col(v).cast("double"))
    return df.withColumn("population", F.explode(tags)).groupBy("population", "quarter").agg(
        F.count(F.lit(1)).alias("prs"), half("changed_files"), half("changed_lines"), F.count_if("has_text").alias("discussion_prs"), rate("has_text").alias("discussion_pct"), rate("cross_file").alias("cross_file_pct")
    )


_ROLES = ["test_path", "configuration_path", "documentation_path"]


@query(f"{W}, roles AS (SELECT id, bool_or(kind = 'source_candidate') AS source, {', '.join(f'bool_or(kind = {chr(39)}{k}{chr(39)}) AS {k}' for k in _ROLES)} FROM files GROUP BY id) " + " UNION ALL ".join(f"SELECT '{k}' AS role, count(*) FILTER (source AND {k}) AS with_source, count(*) FILTER ({k}) AS prs, count(*) FILTER (task_type = 'testing' AND {k}) AS testing_with, count(*) FILTER (task_type = 'testing' AND NOT {k}) AS testing_without FROM roles JOIN changes USING (id)" for k in _ROLES))
def role_cochange(spark, sf_dir):
    """Roles that change together with source files, and how far changes tagged as testing touch them."""
    flags = [F.bool_or(F.col("kind") == k).alias(k) for k in ["source_candidate", *_ROLES]]
    df = files(spark, sf_dir).groupBy("id").agg(*flags).join(changes(spark, sf_dir).select("id", "task_type"), "id")
    tag = F.col("task_type") == "testing"
    rows = [F.struct(F.lit(k).alias("role"), F.count_if(F.col("source_candidate") & F.col(k)).alias("with_source"), F.count_if(k).alias("prs"), F.count_if(tag & F.col(k)).alias("testing_with"), F.count_if(tag & ~F.col(k)).alias("testing_without")) for k in _ROLES]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


_COUNTED = ["agent", "task_type", "state", "quarter", "multi_signal", "files_complete"]


@query(f"{W} " + " UNION ALL ".join(f"SELECT '{x}' AS counter, \"{x}\"::VARCHAR AS value, count(*) AS n FROM changes GROUP BY 2" for x in _COUNTED))
def corpus_counters(spark, sf_dir):
    """Six frequency counters of the corpus, in one pass."""
    return a.value_counts(changes(spark, sf_dir), _COUNTED)


@query(f"{W} SELECT agent, count(*) AS selected, count(DISTINCT repository_id) AS repositories, count(DISTINCT created_at::DATE) AS days, count(*) FILTER (files_complete) AS complete, count(*) FILTER (state = 'OPEN') AS open, count(*) FILTER (state = 'MERGED') AS merged FROM changes GROUP BY 1")
def selection_ledger(spark, sf_dir):
    """Repositories, days and states of what was selected for each agent."""
    state = lambda x: F.count_if(F.col("state") == x)
    return changes(spark, sf_dir).groupBy("agent").agg(
        F.count(F.lit(1)).alias("selected"), F.countDistinct("repository_id").alias("repositories"), F.countDistinct(F.to_date("created_at")).alias("days"),
        F.count_if("files_complete").alias("complete"), state("OPEN").alias("open"), state("MERGED").alias("merged"),
    )
