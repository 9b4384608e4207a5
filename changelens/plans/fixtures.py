"""Change records, their files and annotations, bound to the driver's tables; the same expressions serve Spark and the oracle.

An order is a change, its line items are the changed files (the path comes from part and supplier), customers modulo 60
are repositories, priorities are task types. Several lines can name one path, which is what an incomplete list looks like.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.records import quarter


def _case(of: str, values: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


FOLDERS = ["src/api", "tests/unit", "docs", ".github/workflows", "frontend/ui", "db/migrations", "auth", "vendor/lib", "deploy/k8s", "services/server", "lib", "pkg/my.tests/core"]
NAMES = ["UserAuth", "apiServer", "index", "test_util", "README", "Dockerfile", "db_model", "Controller", "OrderTests", "main", "oauth2_client"]
SUFFIXES = [".py", ".ts", ".tsx", ".sql", ".md", ".yml", ".min.js", ".html", ".lock", ".cs", ""]
PATH = f"({_case('l_partkey % 12', FOLDERS)}) || '/' || ({_case('l_suppkey % 11', NAMES)}) || ({_case('(l_partkey + l_suppkey) % 11', SUFFIXES)})"
TASK = "CASE o_orderpriority WHEN '1-URGENT' THEN 'feature' WHEN '2-HIGH' THEN 'bug_fix' WHEN '3-MEDIUM' THEN 'docs' WHEN '4-NOT SPECIFIED' THEN 'testing' ELSE 'other' END"
STATE = "CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END"
AGENT = _case("o_orderkey % 5", ["codex", "copilot", "claude_code", "jules", "devin"])
#: Derived attributes of a change: name -> expression over its id and repository.
ATTRIBUTES = {
    "agent_detected": "id % 3 = 0",
    "multi_signal": "id % 17 = 0",
    "has_text": "id % 7 < 3",
    "author_known": "id % 11 <> 0",
    "merger_known": "id % 13 <> 0",
    "same_author_merger": "id % 4 = 0",
    "merge_minutes": "(id * 37 % 5000) / 4.0",
    "texts_before": "id % 5",
    "texts_after": "id % 3",
    "stars": "repository_id * 37 % 2000",
}
PERIODS = ("2001Q1", "2001Q2")
FUNCTIONAL = list(paths.MODULES)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, rules: Callable[[paths.Parsed, Column], dict[str, Column]] | None = None) -> DataFrame:
    """``path, id, additions, deletions, kind`` of every changed file, and what ``rules`` say of its path."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    rows = lines.selectExpr("l_orderkey AS id", f"{PATH} AS path", "cast(floor(l_quantity) AS bigint) AS additions", "cast(floor(l_tax * 100) AS bigint) AS deletions")
    return paths.classified(rows, rules)


#: Changed files that one task puts together to changes, about.
FILES_A_TASK = 1 << 19


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per change: keys, period, file measures and attributes.

    The files of a change are brought together before anything is grouped, in as many parts as their number asks for: a part
    holds about FILES_A_TASK of them, whatever the size of the table.
    """
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(t(spark, sf_dir, "lineitem").count() / FILES_A_TASK))
    sums = files(spark, sf_dir).repartition(parts, "id").groupBy("id").agg(
        F.count(F.lit(1)).alias("changed_files"), F.countDistinct("path").alias("paths"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.count_if(F.col("kind") == "source_candidate").alias("source_files"), F.sum(F.when(F.col("kind") == "source_candidate", F.col("additions") + F.col("deletions")).otherwise(0)).alias("source_churn"),
        F.count_if(F.col("kind") == "test_path").alias("test_files"),
    )
    orders = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 60 AS repository_id", f"{AGENT} AS agent", f"{TASK} AS task_type", f"{STATE} AS state", "o_orderdate AS created_at")
    joined = orders.join(sums, "id", "left").withColumn("quarter", quarter(F.col("created_at"))).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    counts = ["changed_files", "paths", "additions", "deletions", "source_files", "source_churn", "test_files"]
    out = joined.select(*[c for c in joined.columns if c not in counts], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])
    out = out.withColumn("changed_lines", F.col("additions") + F.col("deletions"))
    return out.selectExpr(
        "*", "state = 'MERGED' AS merged", "changed_files >= 2 AS cross_file", "paths = changed_files AND id % 40 <> 0 AS files_complete", "source_files > 0 AS touches_source", "test_files > 0 AS touches_test",
        *[f"{e} AS {k}" for k, e in ATTRIBUTES.items()],
    ).withColumn("source_lines_eligible", F.col("files_complete"))


_WORDS = lambda words: "|".join(w.replace(".", r"\.") for w in words)
_PART = lambda words: f"regexp_matches(low, '(^|/)({_WORDS(words)})(/|$)')"
_SUFFIX = lambda words: f"regexp_matches(low, '[^./][^/]*({_WORDS(words)})$')"
#: The oracle's own formulation of the path classes, over low = lower(path).
KIND_SQL = f"""CASE WHEN regexp_matches(low, '(^|/)({_WORDS(paths.LOCKFILES)})$') OR low LIKE '%.lock' THEN 'lockfile'
 WHEN {_PART(paths.GENERATED_PARTS)} OR regexp_matches(low, '(\\.min\\.(js|css)|\\.g\\.cs|\\.pb\\.(go|cc|h))$') THEN 'generated_or_vendor_path'
 WHEN {_PART(paths.TEST_PARTS)} OR regexp_matches(low, '(^|/)test_[^/]*$|_test\\.[^/]*$|\\.(test|spec)\\.[^/]*$|test\\.java$') THEN 'test_path'
 WHEN {_SUFFIX(paths.DOCUMENT_SUFFIXES)} OR {_PART(paths.DOCUMENT_PARTS)} OR regexp_matches(low, '(^|/)(readme|license|changelog)[^/]*$') THEN 'documentation_path'
 WHEN {_SUFFIX(paths.SOURCE_SUFFIXES)} THEN 'source_candidate'
 WHEN {_SUFFIX(paths.CONFIG_SUFFIXES)} OR {_PART(['.github'])} OR regexp_matches(low, '(^|/)(dockerfile|makefile)$') THEN 'configuration_path'
 ELSE 'other_or_unknown' END"""
FILES_SQL = f"""raw_files AS (SELECT l_orderkey AS id, {PATH} AS path, floor(l_quantity)::BIGINT AS additions, floor(l_tax * 100)::BIGINT AS deletions FROM lineitem),
files AS (SELECT id, path, additions, deletions, low, {KIND_SQL} AS kind FROM (SELECT *, lower(path) AS low FROM raw_files))"""
CHANGES_SQL = f"""{FILES_SQL},
sums AS (SELECT id, count(*) AS changed_files, count(DISTINCT path) AS paths, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions,
 count(*) FILTER (kind = 'source_candidate') AS source_files, coalesce(sum(additions + deletions) FILTER (kind = 'source_candidate'), 0)::BIGINT AS source_churn, count(*) FILTER (kind = 'test_path') AS test_files FROM files GROUP BY id),
base AS (SELECT o_orderkey AS id, o_custkey % 60 AS repository_id, {AGENT} AS agent, {TASK} AS task_type, {STATE} AS state, o_orderdate AS created_at,
 year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS "quarter", strftime(o_orderdate, '%Y-%m') AS "month" FROM orders),
joined AS (SELECT base.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'changed_files paths additions deletions source_files source_churn test_files'.split())} FROM base LEFT JOIN sums USING (id)),
changes AS (SELECT *, additions + deletions AS changed_lines, state = 'MERGED' AS merged, changed_files >= 2 AS cross_file, paths = changed_files AND id % 40 <> 0 AS files_complete,
 source_files > 0 AS touches_source, test_files > 0 AS touches_test, {', '.join(f'{e} AS {k}' for k, e in ATTRIBUTES.items())}, paths = changed_files AND id % 40 <> 0 AS source_lines_eligible FROM joined)"""
