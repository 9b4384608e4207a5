"""Queries: paths, modules, grouped summaries, shares, workflow, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.records import bins, in_window, share
from ..operators import aggregates as a
from ..operators import ordering
from ..operators import quality as q
from .fixtures import _PART, CHANGES_SQL, FILES_SQL, FUNCTIONAL, changes, files, t
from .registry import query

W, WF = f"WITH {CHANGES_SQL}", f"WITH {FILES_SQL}"
PCT = "CASE WHEN ({1}) <> 0 THEN 100.0 * ({0}) / ({1}) END"


def pct(part: str, whole: str = "count(*)") -> str:
    return PCT.format(part, whole)


@query(f"{WF} SELECT kind, count(DISTINCT id) AS prs, count(*) AS files, sum(additions + deletions)::BIGINT AS lines FROM files GROUP BY kind")
def file_kinds(spark, sf_dir):
    """Changes, files and lines by kind of path."""
    df = files(spark, sf_dir)
    return df.groupBy("kind").agg(F.countDistinct("id").alias("prs"), F.count(F.lit(1)).alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("lines"))


STAGE_SQL = {
    "code_path": "kind = 'source_candidate'",
    "test_path": "kind = 'test_path'",
    "ci_path": f"contains(low, '.github/workflows') OR {_PART(['.circleci'])} OR regexp_matches(low, '(^|/)(jenkinsfile|\\.gitlab-ci\\.yml|\\.travis\\.yml)$')",
    "deployment_path": f"{_PART(paths.DEPLOY_PARTS)} OR regexp_matches(low, '(^|/)(dockerfile|docker-compose|compose\\.y)[^/]*$') OR regexp_matches(low, '[^./][^/]*\\.tf$')",
    "documentation_path": "kind = 'documentation_path'",
}


@query(f"{WF}, f AS (SELECT id, {', '.join(f'bool_or({e}) AS {k}' for k, e in STAGE_SQL.items())} FROM files GROUP BY id) " + " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) AS eligible, count(*) FILTER ({k}) AS touching, {pct(f'count(*) FILTER ({k})')} AS pct FROM f" for k in STAGE_SQL), ["pct"])
def stage_footprints(spark, sf_dir):
    """Changes touching each stage."""
    df = files(spark, sf_dir, lambda p, kind: paths.stage_flags(F.col("path"), kind, p))
    per = df.groupBy("id").agg(*[F.bool_or(k).alias(k) for k in STAGE_SQL])
    long = a.unpivot(per, ["id"], list(STAGE_SQL), "stage")
    return long.groupBy("stage").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("flag").alias("touching"), share(F.count_if("flag"), F.count(F.lit(1))).alias("pct"))


TEST_SQL = "regexp_matches(low, '(^|[/._-])(tests?|specs?)([._-][^/]*)?/') OR regexp_matches(low, '(tests?|specs?)\\.(cs|java|kt|swift)$')"
STEM_SQL = "regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[-.]', '_', 'g')"


#: Fixed values, written out once more so that the SQL does not follow a slip in the library's own lists.
DIRECTORY_SQL = {
    "interface": "frontend|front-end|ui|gui|screens|widgets|styles|css|renderer|webapp",
    "service_api": "api|apis|backend|back-end|server|servers|service|services|controllers|controller|routers",
    "storage": "db|database|databases|storage|migrations|prisma|sequelize|typeorm|alembic",
    "security": "auth|authentication|authorization|security|crypto|cryptography|oauth|oauth2|permissions",
    "automation": "ci|cicd|deployment|deployments|docker|terraform|k8s|kubernetes|helm",
}
TOKEN_SQL = {
    "interface": "['ui', 'gui', 'renderer']",
    "service_api": "['api', 'server', 'controller', 'router']",
    "storage": "['db', 'database']",
    "security": "['auth', 'authentication', 'authorization', 'security', 'crypto', 'cryptography', 'oauth', 'oauth2']",
}
BUILD_SQL = "makefile|gnumakefile|cmakelists[.]txt|jenkinsfile|[.]gitlab-ci[.]yml|[.]travis[.]yml|azure-pipelines[.]yml|build[.]gradle|build[.]gradle[.]kts|pom[.]xml"


def module_sql(module: str, strict: bool = False) -> str:
    dirs = f"regexp_matches(low, '(^|/)({DIRECTORY_SQL[module]})/')"
    if module == "automation":
        more = "(contains(low, '.github/') AND contains(low, 'workflows/'))"
        loose = f" OR regexp_matches(low, '(^|/)({BUILD_SQL})$') OR regexp_matches(low, '(^|/)(dockerfile|docker-compose|compose\\.y)[^/]*$') OR low LIKE '%.tf'"
        return f"kind IN ('source_candidate', 'configuration_path', 'other_or_unknown') AND NOT ({TEST_SQL}) AND ({dirs} OR {more}{'' if strict else loose})"
    loose = f"list_has_any(string_split({STEM_SQL}, '_'), {TOKEN_SQL[module]})"
    if module != "interface":
        loose = f"({loose} AND NOT regexp_matches(low, '\\.(html|css|scss|sass|less)$'))"
    if module == "interface":
        loose += " OR regexp_matches(low, '\\.(jsx|tsx|vue|svelte|html|css|scss|sass|less)$')"
    if module == "storage":
        loose += " OR low LIKE '%.sql'"
    return f"kind = 'source_candidate' AND NOT ({TEST_SQL}) AND ({dirs}{'' if strict else f' OR {loose}'})"


MODULES_SQL = f"{WF}, m AS (SELECT *, {', '.join(f'({module_sql(m)}) AS {m}, ({module_sql(m, True)}) AS {m}_strict' for m in FUNCTIONAL)} FROM files), pm AS (SELECT id, {', '.join(f'bool_or({m}) AS {m}, bool_or({m}_strict) AS {m}_strict' for m in FUNCTIONAL)} FROM m GROUP BY id)"


def module_rows(spark, sf_dir, strict: bool = False):
    df = files(spark, sf_dir, lambda p, kind: {"e": paths.module_evidence(F.col("path"), kind, strict, p)})
    return df.select("id", "path", F.explode("e").alias("e")).select("id", "path", "e.*")


def module_matrix_of(spark, sf_dir, *strict: bool):
    """``id`` and a flag per module, with ``_strict`` at the end of its name where directories only count; one scan, one shuffle."""
    versions = strict or (False,)
    names = {only: {m: f"{m}_strict" if only else m for m in FUNCTIONAL} for only in versions}

    def rules(p: paths.Parsed, kind):
        return {names[only][m]: c for only in versions for m, c in paths.module_flags(F.col("path"), kind, only, p).items() if m in names[only]}

    df = files(spark, sf_dir, rules)
    return df.groupBy("id").agg(*[F.bool_or(n).alias(n) for only in versions for n in names[only].values()])


@query(MODULES_SQL + " " + " UNION ALL ".join(f"SELECT '{m}' AS category, count(*) AS n, count(*) FILTER ({m}) AS prs, {pct(f'count(*) FILTER ({m})')} AS pct FROM pm" for m in FUNCTIONAL), ["pct"])
def module_summary(spark, sf_dir):
    """Changes with evidence of each module."""
    long = a.unpivot(module_matrix_of(spark, sf_dir), ["id"], FUNCTIONAL)
    return long.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("prs"), share(F.count_if("flag"), F.count(F.lit(1))).alias("pct"))


@query(MODULES_SQL + " " + " UNION ALL ".join(f"SELECT '{m}' AS category, count(*) FILTER ({m}) AS broad_n, count(*) FILTER ({m}_strict) AS directory_only_n FROM pm" for m in FUNCTIONAL))
def module_strict_sensitivity(spark, sf_dir):
    """The same from directory names only."""
    counts = module_matrix_of(spark, sf_dir, False, True).agg(*[F.count_if(x).alias(x) for m in FUNCTIONAL for x in (m, f"{m}_strict")])
    rows = F.array(*[F.struct(F.lit(m).alias("category"), F.col(m).alias("broad_n"), F.col(f"{m}_strict").alias("directory_only_n")) for m in FUNCTIONAL])
    return counts.select(F.inline(rows))


PAIRS = [(x, y) for i, x in enumerate(FUNCTIONAL) for y in FUNCTIONAL[i + 1 :]]


@query(MODULES_SQL + " " + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, count(*) FILTER ({x} AND {y}) AS n, {pct(f'count(*) FILTER ({x} AND {y})')} AS pct, {pct(f'count(*) FILTER ({x} AND {y})', f'count(*) FILTER ({x})')} AS pct_given_a FROM pm" for x, y in PAIRS), ["pct", "pct_given_a"])
def module_pairs(spark, sf_dir):
    """Changes with both of two modules."""
    return a.pair_cochange(module_matrix_of(spark, sf_dir), FUNCTIONAL)


EXCLUSIVE_SQL = MODULES_SQL + ", l AS (" + " UNION ALL ".join(f"SELECT id, '{m}' AS module, list(DISTINCT path) AS p FROM m WHERE {m} GROUP BY id" for m in FUNCTIONAL) + ")"


@query(EXCLUSIVE_SQL + """ SELECT x.module AS a, y.module AS b, count(*) AS both_n, count(*) FILTER (len(list_filter(x.p, lambda v: NOT list_contains(y.p, v))) > 0 AND len(list_filter(y.p, lambda v: NOT list_contains(x.p, v))) > 0) AS exclusive_n
FROM l x JOIN l y USING (id) WHERE list_position(""" + str(FUNCTIONAL) + ", x.module) < list_position(" + str(FUNCTIONAL) + ", y.module) GROUP BY ALL")
def module_exclusive_pairs(spark, sf_dir):
    """Both modules present, and each with a path of its own."""
    found = a.exclusive_pairs(module_rows(spark, sf_dir), FUNCTIONAL)
    return found.where("both_n > 0")


@query(f"{WF}, d AS (SELECT unnest(list_distinct(string_split(low, '/')[:-2])) AS directory FROM files WHERE kind = 'source_candidate') SELECT directory, count(*) AS n FROM d GROUP BY directory")
def directory_inventory(spark, sf_dir):
    """How many changed source files lie under each directory name."""
    df = files(spark, sf_dir, lambda p, kind: {"directories": F.array_distinct(p.dirs)}).where("kind = 'source_candidate'")
    return df.select(F.explode("directories").alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WF} SELECT regexp_extract(low, '[^/]*$') AS name, count(*) AS n FROM files WHERE kind = 'source_candidate' GROUP BY 1 ORDER BY n DESC, name LIMIT 1500")
def file_name_inventory(spark, sf_dir):
    """The 1,500 most frequent names of changed source files; a top-k report."""
    df = files(spark, sf_dir, lambda p, kind: {"name": p.name}).where("kind = 'source_candidate'")
    return df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(1500)


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n, count(*) FILTER (contains(url, '?')) AS with_query FROM pages GROUP BY 1")
def url_hosts(spark, sf_dir):
    """Path parts of page addresses."""
    df = t(spark, sf_dir, "pages")
    return df.groupBy(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("url", F.lit("?"))).alias("with_query"))


VALUES, FLAGS = ["changed_lines", "changed_files"], ["cross_file", "merged", "files_complete"]


def summary_sql(values: list[str], flags: list[str]) -> str:
    out = ["count(*) AS n", "count(DISTINCT repository_id) AS repositories"]
    for v in values:
        out += [f"count({v}) AS {v}_n", *[f"quantile_cont({v}, {x}) AS {v}_{k}" for k, x in (("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("p90", 0.9))], f"avg({v}) AS {v}_mean", f"stddev_samp({v}) AS {v}_std", f"coalesce(sum({v}), 0)::BIGINT AS {v}_sum"]
    for f in flags:
        out += [f"count(*) FILTER ({f}) AS {f}_n", f"count({f}) AS {f}_eligible", f"100.0 * avg({f}::INT) AS {f}_pct"]
    return ", ".join(out)


@query(
    f"{W} SELECT CASE WHEN grouping(agent) = 1 THEN 'all' ELSE agent END AS agent, CASE WHEN grouping(\"quarter\") = 1 THEN 'all' ELSE \"quarter\" END AS \"quarter\", {summary_sql(VALUES, FLAGS)} FROM changes GROUP BY GROUPING SETS ((), (agent), (\"quarter\"), (agent, \"quarter\"))",
    [f"{v}_{k}" for v in VALUES for k in ("q25", "median", "q75", "p90", "mean", "std")] + [f"{f}_pct" for f in FLAGS],
)
def scope_summaries(spark, sf_dir):
    """A1, A2: all, by agent, by quarter, by both; quantiles by ranges of values."""
    df = changes(spark, sf_dir).select("agent", "quarter", F.col("repository_id").alias("repo"), *VALUES, *FLAGS)
    return a.by_sets(df, [[], ["agent"], ["quarter"], ["agent", "quarter"]], a.summary(VALUES, FLAGS, "repo", ranked=False), quantiles=a.levels(VALUES))


@query(f"{W} SELECT CASE WHEN stars <= 10 THEN '0-10' WHEN stars <= 100 THEN '11-100' WHEN stars <= 500 THEN '101-500' WHEN stars <= 1000 THEN '501-1000' ELSE '>1000' END AS star_bucket, count(*) AS n, count(DISTINCT repository_id) AS repositories, median(changed_lines) AS lines FROM changes GROUP BY 1", ["lines"])
def star_buckets(spark, sf_dir):
    """Right-closed bins."""
    df = changes(spark, sf_dir).withColumn("star_bucket", bins(F.col("stars"), [-1, 10, 100, 500, 1000, float("inf")], ["0-10", "11-100", "101-500", "501-1000", ">1000"]))
    return df.groupBy("star_bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repository_id").alias("repositories"), F.percentile("changed_lines", F.lit(0.5)).alias("lines"))


S = lambda v, f="true": f"coalesce(sum({v}) FILTER ({f}), 0)::BIGINT"
KNOWN_SQL = "source_lines_eligible"
SRC, SRC_A, UN_A, UN_O = S("source_churn", KNOWN_SQL), S("source_churn", f"{KNOWN_SQL} AND agent_detected"), S("changed_lines", f"NOT {KNOWN_SQL} AND agent_detected"), S("changed_lines", f"NOT {KNOWN_SQL} AND NOT agent_detected")
CONTRIBUTION_SQL = f"""count(*) AS pr_count, count(*) FILTER (agent_detected) AS agent_pr_count, {pct('count(*) FILTER (agent_detected)')} AS agent_pr_pct,
{S('additions')} AS all_additions, {S('additions', 'agent_detected')} AS agent_additions, {pct(S('additions', 'agent_detected'), S('additions'))} AS agent_additions_pct,
{S('deletions')} AS all_deletions, {S('deletions', 'agent_detected')} AS agent_deletions, {S('changed_lines')} AS all_text_churn, {S('changed_lines', 'agent_detected')} AS agent_text_churn,
{pct(S('changed_lines', 'agent_detected'), S('changed_lines'))} AS agent_text_churn_pct, count(*) FILTER ({KNOWN_SQL}) AS source_eligible_prs, {pct(f'count(*) FILTER ({KNOWN_SQL})')} AS source_coverage_pct,
bool_and({KNOWN_SQL}) AS source_coverage_complete, {SRC} AS known_source_churn, {SRC_A} AS known_agent_source_churn, CASE WHEN bool_and({KNOWN_SQL}) THEN {pct(SRC_A, SRC)} END AS agent_source_churn_pct,
{pct(SRC_A, f'{SRC} + {UN_O}')} AS source_share_lower_bound_pct, {pct(f'{SRC_A} + {UN_A}', f'{SRC} + {UN_A}')} AS source_share_upper_bound_pct, {UN_A} AS source_unknown_agent_text_churn, {UN_O} AS source_unknown_other_text_churn"""
CONTRIBUTION_PCT = ["agent_pr_pct", "agent_additions_pct", "agent_text_churn_pct", "source_coverage_pct", "agent_source_churn_pct", "source_share_lower_bound_pct", "source_share_upper_bound_pct"]


@query(f"{W} SELECT coalesce(CASE WHEN grouping(repository_id) = 1 THEN 'ALL' END, repository_id::VARCHAR) AS repository_id, coalesce(CASE WHEN grouping(\"quarter\") = 1 THEN 'ALL' END, \"quarter\") AS \"quarter\", {CONTRIBUTION_SQL} FROM changes GROUP BY CUBE (repository_id, \"quarter\")", CONTRIBUTION_PCT)
def contribution_cube(spark, sf_dir):
    """Contributions with source bounds over repository and quarter and their totals."""
    return a.by_sets(changes(spark, sf_dir), [["repository_id", "quarter"], ["repository_id"], ["quarter"], []], a.contribution(), "ALL")


COMPLEX = ["changed_files", "changed_lines", "source_churn"]


@query(f"{W} SELECT agent_detected, count(*) AS pr_count, count(*) FILTER (cross_file) AS cross_file_prs, {pct('count(*) FILTER (cross_file)')} AS cross_file_pct, " + ", ".join(f"count({v}) AS {v}_eligible_n, median({v}) AS {v}_median, quantile_cont({v}, 0.9) AS {v}_p90, avg({v}) AS {v}_mean" for v in COMPLEX) + " FROM changes GROUP BY 1", ["cross_file_pct", *[f"{v}_{k}" for v in COMPLEX for k in ("median", "p90", "mean")]])
def complexity_by_signal(spark, sf_dir):
    """A7."""
    return changes(spark, sf_dir).groupBy("agent_detected").agg(*a.complexity(COMPLEX))


@query(f"{W}, g AS (SELECT \"quarter\", count(*) AS group_n FROM changes GROUP BY 1), e AS (SELECT \"quarter\", agent AS item FROM changes UNION ALL SELECT \"quarter\", 'extra' FROM changes WHERE multi_signal) SELECT \"quarter\", item, count(*) AS n, any_value(group_n) AS group_n, 100.0 * count(*) / any_value(group_n) AS pct FROM e JOIN g USING (\"quarter\") GROUP BY 1, 2", ["pct"])
def overlapping_agents(spark, sf_dir):
    """A change counts for each of its agents."""
    df = changes(spark, sf_dir).withColumn("agents", F.array_compact(F.array("agent", F.when(F.col("multi_signal"), "extra"))))
    return a.overlapping(df, "agents", ["quarter"])


@query(f"{W} SELECT repository_id, count(*) FILTER (state = 'MERGED') AS merged, count(*) FILTER (state = 'OPEN') AS open, count(*) FILTER (state = 'CLOSED') AS closed, {pct('count(*) FILTER (merged)')} AS merged_pct FROM changes WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1998-01-01' GROUP BY 1", ["merged_pct"])
def status_at_capture(spark, sf_dir):
    """States of the changes created in a half-open window."""
    created = F.col("created_at").cast("timestamp")
    df = changes(spark, sf_dir).where(in_window(created, F.lit("1996-01-01").cast("timestamp"), F.lit("1998-01-01").cast("timestamp")))
    state = lambda s: F.count_if(F.col("state") == s)
    return df.groupBy("repository_id").agg(state("MERGED").alias("merged"), state("OPEN").alias("open"), state("CLOSED").alias("closed"), share(F.count_if("merged"), F.count(F.lit(1))).alias("merged_pct"))


SHARES_SQL = f"count(*) AS n, count(*) FILTER (agent_detected) AS agent_n, {pct('count(*) FILTER (agent_detected)')} AS pr_pct, {S('changed_lines')} AS lines, {S('changed_lines', 'agent_detected')} AS agent_lines, {pct(S('changed_lines', 'agent_detected'), S('changed_lines'))} AS lines_pct"


@query(f"{W} SELECT \"quarter\", {SHARES_SQL}, {pct('count(*) FILTER (task_type = ' + chr(39) + 'bug_fix' + chr(39) + ')')} AS repair_pct FROM changes GROUP BY 1", ["pr_pct", "lines_pct", "repair_pct"])
def quarterly_shares(spark, sf_dir):
    """A11, A12, A23."""
    return changes(spark, sf_dir).groupBy("quarter").agg(*a.shares(), share(F.count_if(F.col("task_type") == "bug_fix"), F.count(F.lit(1))).alias("repair_pct"))


@query(f"{W}, r AS (SELECT repository_id, count(*) AS n, count(*) FILTER (agent_detected) AS k, {pct('count(*) FILTER (agent_detected)')} AS p FROM changes GROUP BY 1) SELECT count(*) AS groups, avg(p) AS mean_pct, median(p) AS median_pct, 100.0 * sum(k) / sum(n) AS pooled_pct FROM r", ["mean_pct", "median_pct", "pooled_pct"])
def equal_project_means(spark, sf_dir):
    """Mean of ratios next to ratio of sums."""
    return a.mean_of_shares(changes(spark, sf_dir), "repository_id", "agent_detected")


SCOPES = {"all": "true", "without_dominant": "repository_id NOT IN (0, 1)", "early": "created_at < TIMESTAMP '1998-01-01'", "codex_or_copilot": "agent IN ('codex', 'copilot')"}


@query(f"{W} " + " UNION ALL ".join(f"SELECT '{k}' AS scope, {SHARES_SQL} FROM changes WHERE {e}" for k, e in SCOPES.items()), ["pr_pct", "lines_pct"])
def composition_scopes(spark, sf_dir):
    """Shares under overlapping scopes, in one pass."""
    masks = {k: F.expr(e.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")) for k, e in SCOPES.items()}
    return a.scopes(changes(spark, sf_dir), masks, a.shares())


@query(f"{W}, r AS (SELECT DISTINCT repository_id AS left_out FROM changes) SELECT left_out, count(*) AS n, count(*) FILTER (agent_detected) AS agent_n, {pct('count(*) FILTER (agent_detected)')} AS pr_pct, {pct(S('changed_lines', 'agent_detected'), S('changed_lines'))} AS lines_pct FROM r JOIN changes ON repository_id <> left_out GROUP BY 1", ["pr_pct", "lines_pct"])
def leave_one_repository_out(spark, sf_dir):
    """Total minus group."""
    return a.leave_one_out(changes(spark, sf_dir), "repository_id", "agent_detected", "changed_lines")


@query(f"{W}, m AS (SELECT DISTINCT \"month\" FROM changes), r AS (SELECT DISTINCT repository_id FROM changes), c AS (SELECT \"month\", repository_id, count(*) AS n, count(*) FILTER (agent_detected) AS agent_n, {pct('count(*) FILTER (agent_detected)')} AS pr_pct FROM changes GROUP BY 1, 2) SELECT \"month\", repository_id, coalesce(n, 0) AS n, coalesce(agent_n, 0) AS agent_n, pr_pct FROM m CROSS JOIN r LEFT JOIN c USING (\"month\", repository_id)", ["pr_pct"])
def dense_months(spark, sf_dir):
    """Every month and repository, zero rows kept, shares null there."""
    df = changes(spark, sf_dir)
    counts = df.groupBy("month", "repository_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("agent_detected").alias("agent_n"), share(F.count_if("agent_detected"), F.count(F.lit(1))).alias("pr_pct"))
    axes = {"month": df.select("month").distinct(), "repository_id": df.select("repository_id").distinct()}
    return a.dense(counts, axes, ["month", "repository_id"], ["n", "agent_n"])


@query(f"{W}, c AS (SELECT \"month\", repository_id, sum(changed_lines)::BIGINT AS lines FROM changes GROUP BY 1, 2) SELECT *, {pct('lines', 'sum(lines) OVER (PARTITION BY ' + chr(34) + 'month' + chr(34) + ')')} AS share_pct FROM c", ["share_pct"])
def share_of_month(spark, sf_dir):
    """Each repository's share of its month."""
    c = changes(spark, sf_dir).groupBy("month", "repository_id").agg(F.sum("changed_lines").alias("lines"))
    return a.share_of_total(c, ["month"], "lines")


@query(f"{W} SELECT repository_id, count(*) AS n, count(DISTINCT \"quarter\") AS quarters, arg_max(agent, id) AS last_agent, min(stars) AS min_stars, max(stars) AS max_stars FROM changes GROUP BY 1")
def period_support(spark, sf_dir):
    """A20."""
    return changes(spark, sf_dir).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("quarter").alias("quarters"), F.max_by("agent", "id").alias("last_agent"), F.min("stars").alias("min_stars"), F.max("stars").alias("max_stars"))


@query(f"{W} SELECT 'all' AS scope, agent, count(*) AS n, count(*) FILTER (merged) AS merged_n, count(merged) AS merged_eligible, 100.0 * avg(merged::INT) AS merged_pct FROM changes GROUP BY agent UNION ALL SELECT 'single_signal', agent, count(*), count(*) FILTER (merged), count(merged), 100.0 * avg(merged::INT) FROM changes WHERE NOT multi_signal GROUP BY agent", ["merged_pct"])
def attribution_sensitivity(spark, sf_dir):
    """A22."""
    return a.attributed(changes(spark, sf_dir), "multi_signal", flags=["merged"])


@query(f"{W} SELECT task_type, count(*) FILTER (state = 'MERGED') AS merged, count(*) FILTER (state = 'OPEN') AS open, count(*) FILTER (state = 'CLOSED') AS closed FROM changes GROUP BY 1")
def task_by_state(spark, sf_dir):
    """A crosstab with fixed columns."""
    wide = changes(spark, sf_dir).groupBy("task_type").pivot("state", ["MERGED", "OPEN", "CLOSED"]).agg(F.count(F.lit(1)))
    return wide.select("task_type", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("MERGED", "OPEN", "CLOSED")])


WORKFLOW_SQL = f"""count(*) AS n, count(DISTINCT repository_id) AS repos, count(*) FILTER (author_known AND merger_known) AS known_author_merger, count(*) FILTER (author_known AND merger_known AND same_author_merger) AS same_author_merger_n,
{pct('count(*) FILTER (author_known AND merger_known AND same_author_merger)', 'count(*) FILTER (author_known AND merger_known)')} AS same_author_merger_pct, median(merge_minutes) AS median_merge_minutes,
{pct('count(*) FILTER (merge_minutes <= 5)')} AS fast_5m_pct, {pct('count(*) FILTER (merge_minutes <= 60)')} AS fast_1h_pct, {pct('count(*) FILTER (texts_before > 0)')} AS text_before_pct, {pct('count(*) FILTER (texts_after > 0 AND texts_before = 0)')} AS postmerge_only_pct"""
WORKFLOW_PCT = ["same_author_merger_pct", "median_merge_minutes", "fast_5m_pct", "fast_1h_pct", "text_before_pct", "postmerge_only_pct"]


@query(f"{W} SELECT CASE WHEN grouping(agent) = 1 THEN 'all' ELSE agent END AS agent, {WORKFLOW_SQL} FROM changes WHERE merged GROUP BY GROUPING SETS ((), (agent))", WORKFLOW_PCT)
def merge_workflows(spark, sf_dir):
    """Two denominators, known actors and all."""
    from ..operators.events import workflow

    return a.by_sets(changes(spark, sf_dir).where("merged"), [[], ["agent"]], workflow())


@query(f"{W} SELECT agent, CASE WHEN stars <= 10 THEN 'low' WHEN stars <= 1000 THEN 'mid' ELSE 'high' END AS tier, count(*) AS n, {pct('count(*) FILTER (texts_before > 0)')} AS pre_pct FROM changes WHERE merged GROUP BY 1, 2", ["pre_pct"])
def workflow_by_tier(spark, sf_dir):
    """A30."""
    df = changes(spark, sf_dir).where("merged").withColumn("tier", bins(F.col("stars"), [-1, 10, 1000, float("inf")], ["low", "mid", "high"]))
    return df.groupBy("agent", "tier").agg(F.count(F.lit(1)).alias("n"), share(F.count_if(F.col("texts_before") > 0), F.count(F.lit(1))).alias("pre_pct"))


@query(f"{W} SELECT task_type, count(*) AS n, count(*) FILTER (touches_test) AS test_cochange_n, {pct('count(*) FILTER (touches_test)')} AS test_cochange_pct, median(changed_lines) AS lines_median FROM changes WHERE touches_source AND files_complete GROUP BY 1", ["test_cochange_pct", "lines_median"])
def task_test_cochange(spark, sf_dir):
    """A31, A37."""
    df = changes(spark, sf_dir).where("touches_source and files_complete")
    return df.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("touches_test").alias("test_cochange_n"), share(F.count_if("touches_test"), F.count(F.lit(1))).alias("test_cochange_pct"), F.percentile("changed_lines", F.lit(0.5)).alias("lines_median"))


@query(f"{W}, r AS (SELECT repository_id, count(*) AS n FROM changes GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, repository_id) AS k, count(*) OVER () AS m FROM r) SELECT 100.0 * sum(n) FILTER (k <= ceil(m * 0.1)) / sum(n) AS top_pct, max(n) AS largest FROM o", ["top_pct"])
def concentration(spark, sf_dir):
    """What the top tenth of repositories holds."""
    r = ordering.numbered(changes(spark, sf_dir).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), "repository_id"], "k")
    o = r.crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("m"))))  # one row
    return o.agg(share(F.sum(F.when(F.col("k") < F.ceil(F.col("m") * 0.1), F.col("n"))), F.sum("n")).alias("top_pct"), F.max("n").alias("largest"))


@query(f"{W} SELECT task_type, count(*) AS n, {pct('count(*) FILTER (merged AND files_complete)')} AS lower_pct, {pct('count(*) FILTER (merged AND files_complete) + count(*) - count(*) FILTER (files_complete)')} AS upper_pct FROM changes GROUP BY 1", ["lower_pct", "upper_pct"])
def missing_bounds(spark, sf_dir):
    """Bounds when incomplete changes could be either."""
    hit, known = F.count_if(F.col("merged") & F.col("files_complete")), F.count_if("files_complete")
    return changes(spark, sf_dir).groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), *a.missing_bounds(hit, known, F.count(F.lit(1))))


@query(f"{W}, f AS (SELECT id, count(DISTINCT regexp_replace(low, '/[^/]*$', '')) AS folders FROM files GROUP BY id) SELECT id, CASE WHEN files_complete THEN source_files END AS source_files, CASE WHEN files_complete THEN source_churn END AS source_lines, CASE WHEN files_complete THEN folders END AS listed_directories, files_complete FROM changes JOIN f USING (id)")
def gated_measures(spark, sf_dir):
    """Nested file lists; measures are unknown unless the list is complete."""
    from ..functions import records as r

    own = files(spark, sf_dir, lambda p, kind: {"folder": paths.parent_directory(F.lower("path"))})
    listed = own.groupBy("id").agg(F.collect_list(F.struct(F.lower("path").alias("path"), "additions", "deletions", "kind", "folder")).alias("listed"))
    complete = r.files_complete(F.col("listed"), F.col("id") % 40 == 0, F.size("listed"))
    found = listed.withColumn("files_complete", complete)
    measures = r.source_measures(F.col("listed"), F.col("files_complete"), lambda f: f["kind"], lambda f: f["folder"])
    return found.select("id", measures["source_files"].alias("source_files"), measures["source_lines"].alias("source_lines"), measures["listed_directories"].alias("listed_directories"), "files_complete")


@query(f"{W} SELECT 'lines_not_negative' AS \"check\", count(*) FILTER (NOT changed_lines >= 0) AS violations FROM changes UNION ALL SELECT 'state_known', count(*) FILTER (state NOT IN ('MERGED', 'OPEN')) FROM changes UNION ALL SELECT 'paths_at_most_files', count(*) FILTER (paths > changed_files) FROM changes UNION ALL SELECT 'unique_id', count(*) - count(DISTINCT id) FROM changes UNION ALL SELECT 'orphan_id', (SELECT count(*) FROM files ANTI JOIN changes USING (id))")
def row_checks(spark, sf_dir):
    """One pass of rules, uniqueness, foreign keys."""
    df = changes(spark, sf_dir)
    rules = {"lines_not_negative": F.col("changed_lines") >= 0, "state_known": F.col("state").isin("MERGED", "OPEN"), "paths_at_most_files": F.col("paths") <= F.col("changed_files")}
    return q.row_checks(df, rules).unionByName(q.unique(df, ["id"])).unionByName(q.orphans(files(spark, sf_dir), df, "id", "id"))


@query(f"{W}, e AS (SELECT repository_id, \"quarter\", count(*) AS n FROM changes GROUP BY ALL), w AS (SELECT repository_id, sum(n)::BIGINT + CASE WHEN repository_id = 7 THEN 1 ELSE 0 END AS whole, sum(n)::BIGINT AS parts FROM e GROUP BY 1) SELECT repository_id::VARCHAR AS repository_id, whole, parts FROM w WHERE whole <> parts")
def additivity(spark, sf_dir):
    """Q2: quarters against a total that is wrong for one repository."""
    cube = a.by_sets(changes(spark, sf_dir), [["repository_id", "quarter"], ["repository_id"]], [F.count(F.lit(1)).alias("n")], "ALL")
    wrong = cube.withColumn("n", F.col("n") + F.when((F.col("repository_id") == "7") & (F.col("quarter") == "ALL"), 1).otherwise(0))
    return q.additive(wrong, ["repository_id"], "quarter", "n", "ALL")


@query(f"{W}, l AS (SELECT repository_id, sum(changed_lines)::DOUBLE AS v FROM changes GROUP BY 1), r AS (SELECT repository_id, CASE WHEN repository_id % 10 = 3 THEN v * (1 + 1e-6) ELSE v * (1 + 1e-12) END AS v FROM l WHERE repository_id <> 5) SELECT repository_id, 'v' AS \"column\", l.v AS l, r.v AS r FROM l FULL JOIN r USING (repository_id) WHERE l.v IS NULL OR r.v IS NULL OR abs(l.v - r.v) > 1e-10 + 1e-9 * abs(r.v)", ["l", "r"])
def table_difference(spark, sf_dir):
    """Q5, Q6: a comparison with tolerance."""
    left = changes(spark, sf_dir).groupBy("repository_id").agg(F.sum("changed_lines").cast("double").alias("v"))
    right = left.where("repository_id <> 5").withColumn("v", F.col("v") * F.when(F.col("repository_id") % 10 == 3, F.lit(1 + 1e-6)).otherwise(F.lit(1 + 1e-12)))
    return q.table_diff(left, right, ["repository_id"], ["v"])


@query(f"{W} SELECT count(*) FILTER (merged AND merge_minutes IS NULL) AS merged_without_time, count(*) FILTER (merge_minutes < 1) AS under_a_minute, count(*) FILTER (merged AND NOT merger_known) AS merged_without_merger, count(*) FILTER (NOT files_complete) AS files_incomplete, count(*) FILTER (additions = deletions) AS balanced FROM changes")
def field_audit(spark, sf_dir):
    """Q4."""
    rules = {"merged_without_time": "merged AND merge_minutes IS NULL", "under_a_minute": "merge_minutes < 1", "merged_without_merger": "merged AND NOT merger_known", "files_incomplete": "NOT files_complete", "balanced": "additions = deletions"}
    return changes(spark, sf_dir).agg(*[F.count_if(F.expr(e)).alias(k) for k, e in rules.items()])


@query(f"{W} SELECT repository_id, count(*) AS n, count(*) FILTER (files_complete) AS complete, {pct('count(*) FILTER (files_complete)')} AS coverage_pct, count(*) + repository_id % 3 AS expected, repository_id % 3 = 0 AS enumerated FROM changes GROUP BY 1", ["coverage_pct"])
def acquisition_status(spark, sf_dir):
    """What was fetched against what was expected."""
    got = changes(spark, sf_dir).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("files_complete").alias("complete"), share(F.count_if("files_complete"), F.count(F.lit(1))).alias("coverage_pct"))
    expected = changes(spark, sf_dir).groupBy("repository_id").agg((F.count(F.lit(1)) + F.max(F.col("repository_id") % 3)).alias("expected"))
    return got.join(expected, "repository_id").withColumn("enumerated", F.col("n") == F.col("expected"))
