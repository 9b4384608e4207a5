"""Queries: nested discussion, requests, actors, signals, label statistics, suppression, ledgers, round trips of files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as r
from ..functions import text as x
from ..operators import events as e
from ..operators import labels as lb
from ..operators import quality as q
from ..sources import files as src
from .fixtures import AGENT, CHANGES_SQL, changes, t
from .registry import query

W = f"WITH {CHANGES_SQL}"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a temporary one only where everything runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='changelens-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- nested discussion

LOGIN = "CASE WHEN l_suppkey % 9 = 0 THEN '' WHEN l_suppkey % 8 = 0 THEN 'helper[bot]' ELSE 'user' || cast(l_suppkey % 7 AS string) END"
EVENT = f"""l_orderkey AS id, l_linenumber AS n, concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(l_extendedprice AS string)) AS event, {LOGIN} AS login,
 CASE WHEN l_suppkey % 5 = 0 THEN 'Bot' ELSE 'User' END AS actor, CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE 'part ' || cast(l_partkey AS string) END AS body,
 CASE l_partkey % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'PENDING' ELSE 'COMMENTED' END AS state, l_shipdate AS moment"""
EVENT_SQL = EVENT.replace("AS string", "AS VARCHAR")


def _discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with nested reviews, comments and threads made of their line items."""
    rows = t(spark, sf_dir, "lineitem").selectExpr(*[p.strip() for p in _split(EVENT)])
    one = F.struct(
        F.col("event").alias("id"), F.lit(None).cast("string").alias("url"), F.struct(F.col("login"), F.col("actor").alias("__typename")).alias("author"),
        "body", "state", F.col("moment").cast("string").alias("createdAt"), F.col("moment").cast("string").alias("submittedAt"),
    )
    part = lambda k: F.sort_array(F.collect_list(F.when(F.col("n") % 3 == k, one)))
    nested = rows.groupBy("id").agg(part(0).alias("reviews"), part(1).alias("comments"), part(2).alias("inline"))
    threads = F.transform("inline", lambda c: F.struct(F.array(c).alias("comments")))
    docs = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "named_struct('login', 'USER' || cast(o_custkey % 7 AS string)) AS author", "cast(o_orderdate AS string) AS createdAt", "cast(o_orderdate + interval 20 days AS string) AS mergedAt")
    return docs.join(nested, "id", "left").select("id", "author", "createdAt", "mergedAt", "reviews", "comments", threads.alias("reviewThreads"))


def _split(expressions: str) -> list[str]:
    """Select expressions cut at commas outside brackets."""
    parts, depth = [""], 0
    for c in expressions:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


DISCUSSION_SQL = f"""ev AS (SELECT {EVENT_SQL} FROM lineitem),
ext AS (SELECT ev.*, o_orderdate AS created, o_orderdate + INTERVAL 20 DAY AS merged, CASE n % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'comment' ELSE 'inline' END AS source, trim(body) <> '' AS has_text
 FROM ev JOIN orders ON id = o_orderkey WHERE login <> '' AND actor <> 'Bot' AND NOT ends_with(login, '[bot]') AND login <> 'user' || (o_custkey % 7)::VARCHAR)"""


@query(f"WITH {DISCUSSION_SQL} SELECT source, count(*) AS texts, count(DISTINCT id) AS documents, sum(length(body))::BIGINT AS characters FROM ext WHERE has_text GROUP BY 1")
def human_review_texts(spark, sf_dir):
    """Texts of people other than the author, out of nested reviews, comments and threads."""
    docs = _discussions(spark, sf_dir)
    found = docs.select("id", F.explode(r.human_texts(F.col("reviews"), F.col("comments"), F.col("reviewThreads"), F.col("author.login"))).alias("e"))
    return found.groupBy("e.source").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("id").alias("documents"), F.sum(F.length("e.body")).cast("long").alias("characters"))


@query(f"""WITH {DISCUSSION_SQL}, f AS (SELECT id, has_text, source, state, moment >= created AND moment < created + INTERVAL 30 DAY AS within, moment >= created AND moment < merged AS pre, moment >= merged AS post FROM ext),
s AS (SELECT id, count(*) FILTER (has_text AND within) AS ext_text_30d, count(*) FILTER (has_text AND pre) AS ext_text_premerge_all, count(*) FILTER (has_text AND pre AND within) AS ext_text_premerge_30d,
 count(*) FILTER (has_text AND post AND within) AS ext_text_postmerge_30d, count(*) FILTER (source = 'review' AND state <> 'PENDING') AS ext_review_all, count(*) FILTER (source = 'review' AND state <> 'PENDING' AND pre) AS ext_review_premerge,
 count(*) FILTER (source = 'review' AND state = 'APPROVED' AND pre) AS ext_approval_premerge, count(*) FILTER (source = 'review' AND state = 'APPROVED' AND pre AND NOT has_text) AS ext_approval_empty_premerge FROM f GROUP BY id)
SELECT o_orderkey AS id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'ext_text_30d ext_text_premerge_all ext_text_premerge_30d ext_text_postmerge_30d ext_review_all ext_review_premerge ext_approval_premerge ext_approval_empty_premerge'.split())},
 coalesce(ext_text_premerge_all > 0 OR ext_review_premerge > 0, false) AS premerge_external_evidence FROM orders LEFT JOIN s ON id = o_orderkey""")
def merge_discussion_features(spark, sf_dir):
    """External texts and reviews before and after the merge."""
    return e.discussion_features(_discussions(spark, sf_dir))


@query("SELECT author_known, merger_known, same_author_merger, count(*) AS n FROM (SELECT a <> '' AS author_known, coalesce(m <> '', false) AS merger_known, coalesce(a <> '' AND m <> '' AND lower(a) = m, false) AS same_author_merger FROM (SELECT CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'User' || (o_custkey % 5)::VARCHAR END AS a, CASE WHEN o_custkey % 13 <> 0 THEN 'user' || (o_orderkey % 5)::VARCHAR END AS m FROM orders)) GROUP BY ALL")
def actor_accounts(spark, sf_dir):
    """Known accounts, and whether author and merger are one."""
    names = t(spark, sf_dir, "orders").selectExpr("CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'User' || cast(o_custkey % 5 AS string) END AS a", "CASE WHEN o_custkey % 13 <> 0 THEN 'user' || cast(o_orderkey % 5 AS string) END AS m")
    flags = r.actor_flags(F.col("a"), F.col("m"))
    return names.select(*[c.alias(k) for k, c in flags.items()]).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


LINE_AGENT = AGENT.replace("o_orderkey", "l_suppkey")


@query(f"WITH s AS (SELECT l_orderkey AS id, list_sort(list_distinct(list({LINE_AGENT}))) AS signals FROM lineitem GROUP BY 1) SELECT array_to_string(signals, '|') AS signals, CASE WHEN id % 4 = 0 THEN 'manifest' WHEN len(signals) = 1 THEN signals[1] ELSE 'multiple_or_unknown' END AS assigned, count(*) AS n FROM s GROUP BY ALL")
def assigned_agents(spark, sf_dir):
    """Agents of all search matches, and the one a change is assigned to."""
    rows = t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", f"named_struct('agent', {LINE_AGENT}) AS m").groupBy("id").agg(F.collect_list("m").alias("matches"))
    found = rows.withColumn("s", r.search_agents(F.col("matches")))
    assigned = r.assigned_agent(F.when(F.col("id") % 4 == 0, "manifest"), F.col("s"))
    return found.groupBy(F.array_join("s", "|").alias("signals"), assigned.alias("assigned")).agg(F.count(F.lit(1)).alias("n"))


SQUEEZED = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT conv_id, turn, conv_id::VARCHAR || ':' || turn::VARCHAR AS request_id, left({SQUEEZED.format('text')}, 6000) AS body, turn % 2 = 0 AS has_thread, left({SQUEEZED.format("role || '  hunk'")}, 2000) AS hunk FROM conversations)
SELECT conv_id, turn, request_id, length(body) AS body_length, CASE WHEN has_thread THEN hunk ELSE '' END AS hunk,
 sha256(CASE WHEN has_thread THEN json_object('body', body, 'hunk', hunk, 'line', turn, 'path', 'src/' || turn::VARCHAR || '.py', 'request_id', request_id) ELSE json_object('body', body, 'hunk', '', 'request_id', request_id) END::VARCHAR) AS input_hash FROM c""")
def built_requests(spark, sf_dir):
    """P25: requests with their thread's context and a hash of all that is asked."""
    df = t(spark, sf_dir, "conversations")
    texts = df.selectExpr("conv_id", "turn", "struct(conv_id, turn) AS text_id", "text AS body")
    threads = df.where("turn % 2 = 0").selectExpr("struct(conv_id, turn) AS text_id", "'src/' || cast(turn AS string) || '.py' AS path", "turn AS line", "role || '  hunk' AS hunk")
    found = x.review_requests(texts, threads, ("conv_id", "turn"))
    return found.select("conv_id", "turn", "request_id", F.length("evidence.body").cast("long").alias("body_length"), F.col("evidence.hunk").alias("hunk"), "input_hash")


CONTRACT = {"severity": ["high", "low"], "categories": ["security", "edge_case"]}
_CONTEXT_SQL = f"""CASE WHEN turn % 2 = 0 THEN json_object('diff_hunk', left({SQUEEZED.format("role || '  hunk'")}, 2500), 'is_outdated', turn % 4 = 0, 'is_resolved', turn % 6 = 0, 'line', turn::BIGINT, 'original_line', turn::BIGINT + 1, 'path', 'src/' || turn::VARCHAR || '.py', 'review_state', NULL)
 WHEN turn % 3 = 0 THEN json_object('diff_hunk', NULL, 'is_outdated', NULL, 'is_resolved', NULL, 'line', NULL, 'original_line', NULL, 'path', NULL, 'review_state', upper(role)) END"""


@query(f"""WITH c AS (SELECT conv_id, turn, role, left({SQUEEZED.format('text')}, 6000) AS body, coalesce(role, 'unknown') AS source FROM conversations),
n AS (SELECT *, CASE WHEN turn % 5 <> 0 THEN 'r' || turn::VARCHAR ELSE substr(sha256(coalesce(role, '') || chr(0) || body || chr(0) || turn::VARCHAR), 1, 20) END AS review_id, CASE WHEN turn % 5 <> 0 THEN {_CONTEXT_SQL} END AS context FROM c),
e AS (SELECT conv_id, n.source, review_id, n.body, context, json_object('change', json_object('agent_signal', CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lang END, 'body_context', left({SQUEEZED.format('text')}, 1000), 'number', doc_id::BIGINT, 'repository', coalesce(d.source, ''), 'title', left({SQUEEZED.format("lang || '  ' || d.source")}, 500), 'url', NULL),
 'review', json_object('author', NULL, 'body', n.body, 'context', context, 'created_at', NULL, 'id', review_id, 'source', n.source, 'url', '/' || turn::VARCHAR))::VARCHAR AS evidence FROM n JOIN (SELECT doc_id, text, lang, source FROM documents) d ON doc_id = conv_id)
SELECT conv_id AS change_id, review_id, conv_id::VARCHAR || ':' || source || ':' || review_id AS request_id, length(body)::BIGINT AS body_length, json_extract_string(context, '$.path') AS path,
 sha256('{{"evidence":' || evidence || ',"prompt_version":"v2","schema":{{"categories":["security","edge_case"],"severity":["high","low"]}}}}') AS input_hash FROM e""")
def classification_requests(spark, sf_dir):
    """P25: requests from evidence on change, review and its thread; the hash covers prompt version and contract."""
    df = t(spark, sf_dir, "conversations").withColumn("review_id", F.expr("CASE WHEN turn % 5 <> 0 THEN concat('r', turn) END"))
    reviews = df.selectExpr("conv_id AS change_id", "turn AS place", "review_id", "role AS source", "concat('/', turn) AS url", "CAST(NULL AS STRING) AS author", "CAST(NULL AS STRING) AS created_at", "text AS body")
    changes = t(spark, sf_dir, "documents").selectExpr("doc_id AS change_id", "CAST(NULL AS STRING) AS url", "source AS repository", "doc_id AS number", "lang || '  ' || source AS title", "text AS body", "CASE WHEN doc_id % 3 <> 0 THEN lang END AS agent")
    states = df.where("turn % 3 = 0").selectExpr("conv_id AS change_id", "review_id AS text_id", "upper(role) AS review_state")
    threads = df.where("turn % 2 = 0").selectExpr("conv_id AS change_id", "review_id AS text_id", "concat('src/', turn, '.py') AS path", "turn AS line", "turn + 1 AS original_line", "turn % 4 = 0 AS is_outdated", "turn % 6 = 0 AS is_resolved", "role || '  hunk' AS diff_hunk")
    found = x.classification_requests(reviews, changes, x.evidence_contexts(states, threads), "v2", CONTRACT)
    return found.select("change_id", "review_id", "request_id", F.length("evidence.review.body").cast("long").alias("body_length"), F.col("evidence.review.context.path").alias("path"), "input_hash")


# ---- label statistics

LABEL_SETS = (("agent",), ("quarter",), ("task_type",), ("task_type", "agent"), ("task_type", "quarter"), ("agent", "quarter"), ("task_type", "agent", "quarter"))
PHASES = ("design", "implementation", "testing")
HAS_PHASE = {"design": "id % 2 = 0", "implementation": "id % 3 <> 0", "testing": "id % 5 = 0"}
_Q = lambda c: f'"{c}"'
STATS_SQL = """count(*) AS n, count(*) FILTER (agent_detected) AS human_n, 100.0 * count(*) FILTER (agent_detected) / count(*) AS human_pct, count(*) FILTER (has_text) AS text_n, 100.0 * count(*) FILTER (has_text) / count(*) AS text_pct,
 quantile_cont(changed_files, 0.5) AS files_median, quantile_cont(changed_lines, 0.5) AS lines_median, quantile_cont(changed_lines, 0.25) AS lines_q25, quantile_cont(changed_lines, 0.75) AS lines_q75,
 count(*) FILTER (cross_file) AS cross_n, 100.0 * count(*) FILTER (cross_file) / count(*) AS cross_pct, count(*) FILTER (merged) AS merged_n, 100.0 * count(*) FILTER (merged) / count(*) AS merged_pct"""
STATS_ROUNDED = ("human_pct", "text_pct", "files_median", "lines_median", "lines_q25", "lines_q75", "cross_pct", "merged_pct")


@query(f"{W} SELECT coalesce(agent, '') AS agent, coalesce(\"quarter\", '') AS \"quarter\", coalesce(task_type, '') AS task_type, grouping(agent, \"quarter\", task_type)::INT AS grouped, {STATS_SQL} FROM changes GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(map(_Q, s)) + ')' for s in LABEL_SETS)})", STATS_ROUNDED)
def label_statistics(spark, sf_dir):
    """A3: the same statistics over seven sets of keys, in one pass."""
    stats = lb.label_stats("agent_detected", "has_text")
    return lb.grouped_label_stats(changes(spark, sf_dir), ("agent", "quarter", "task_type"), LABEL_SETS, stats)


@query(f"{W}, p AS (SELECT *, unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{p}{chr(39)} END' for p, c in HAS_PHASE.items())}], lambda z: z IS NOT NULL)) AS item FROM changes), s AS (SELECT \"quarter\", count(*) AS labelled FROM changes GROUP BY 1) SELECT p.\"quarter\", item, count(*) AS n, any_value(labelled) AS labelled, 100.0 * count(*) / any_value(labelled) AS pct, 100.0 * count(*) FILTER (has_text) / count(*) AS flag_pct FROM p JOIN s ON p.\"quarter\" = s.\"quarter\" GROUP BY 1, 2", ["pct", "flag_pct"])
def phases_by_quarter(spark, sf_dir):
    """A4: members of a set-valued label by quarter."""
    of = F.array_compact(F.array(*[F.when(F.expr(c), p) for p, c in HAS_PHASE.items()]))
    return lb.membership_stats(changes(spark, sf_dir).withColumn("phases", of), "phases", ["quarter"], PHASES, "has_text")


def _coverage(key: str):
    def run(spark, sf_dir):
        df = changes(spark, sf_dir).select("id", "agent", "quarter")
        return lb.coverage(df, df.where("id % 9 <> 0"), "id", key.split(","))

    run.__doc__ = f"A24: selected and retrieved changes by {key}."
    run.__name__ = "retrieval_by_" + key.replace(",", "_")
    keys = ", ".join(map(_Q, key.split(",")))
    return query(f"{W} SELECT {keys}, count(*) AS selected, count(*) FILTER (id % 9 <> 0) AS retrieved, count(*) FILTER (id % 9 = 0) AS missing, 100.0 * count(*) FILTER (id % 9 <> 0) / count(*) AS retrieved_pct FROM changes GROUP BY ALL", ["retrieved_pct"])(run)


for _key in ("quarter", "agent,quarter"):
    _coverage(_key)


# ---- small numbers, exclusions


@query(f"{W} SELECT agent, \"month\", count(*) AS n, CASE WHEN count(*) >= 20 THEN quantile_cont(changed_lines, 0.5) END AS lines_median, CASE WHEN count(*) >= 20 THEN 100.0 * count(*) FILTER (merged) / count(*) END AS merged_pct FROM changes GROUP BY 1, 2", ["lines_median", "merged_pct"])
def suppressed_small_groups(spark, sf_dir):
    """figures of groups under 20 rows are not shown."""
    n = F.count(F.lit(1))
    sums = changes(spark, sf_dir).groupBy("agent", "month").agg(n.alias("n"), F.percentile("changed_lines", F.lit(0.5)).alias("m"), r.share(F.count_if("merged"), n).alias("p"))
    return sums.select("agent", "month", "n", r.suppressed(F.col("m"), F.col("n")).alias("lines_median"), r.suppressed(F.col("p"), F.col("n")).alias("merged_pct"))


@query(f"{W} SELECT repository_id, CASE WHEN changed_files = 0 THEN 'no_files' WHEN NOT files_complete THEN 'incomplete_file_list' ELSE 'too_many_files' END AS reason, count(*) AS n, min(id) AS first_id FROM changes WHERE changed_files = 0 OR NOT files_complete OR changed_files > 6 GROUP BY 1, 2")
def exclusions(spark, sf_dir):
    """every excluded change with the first rule that excludes it."""
    rules = {"no_files": F.col("changed_files") == 0, "incomplete_file_list": ~F.col("files_complete"), "too_many_files": F.col("changed_files") > 6}
    _, ledger = q.exclusion_ledger(changes(spark, sf_dir), rules)
    return ledger.groupBy("repository_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


# ---- files

ORDER_COLUMNS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"
ORDER_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(ORDER_SQL)
def jsonl_roundtrip(spark, sf_dir):
    """An ordered export of JSON lines, read back strictly."""
    path = _folder(spark, "jsonl")
    src.export_ordered(_orders(spark, sf_dir), path, ["o_orderkey"])
    good, bad = src.read_json_lines(spark, path, ORDER_COLUMNS)
    src.require_clean(bad)
    return good.drop("source_file")


@query(ORDER_SQL)
def csv_roundtrip(spark, sf_dir):
    """Compressed CSV with a header and all values quoted."""
    path = _folder(spark, "csv")
    src.write_csv(_orders(spark, sf_dir), path, quote_all=True, gzip=True)
    return src.read_csv(spark, path, ORDER_COLUMNS)


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def parquet_roundtrip(spark, sf_dir):
    """Partitioned Parquet of even size."""
    path = _folder(spark, "parquet")
    src.land(_orders(spark, sf_dir), path, 4, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderstatus AS folder_status, o_custkey % 10 <> 0 AS folder_matches, count(*) AS n FROM orders GROUP BY ALL")
def repository_folders(spark, sf_dir):
    """S3: one folder per repository, and records that name another one than their folder."""
    path = _folder(spark, "folders")
    name = F.when(F.col("o_custkey") % 10 == 0, "other/one").otherwise(F.concat(F.lit("own/"), "o_orderstatus"))
    rows = _orders(spark, sf_dir).select(F.struct(name.alias("nameWithOwner")).alias("repository"), F.concat(F.lit("own__"), "o_orderstatus").alias("folder"))
    for status in ("F", "O", "P"):  # the three values of the column
        rows.where(F.col("folder") == f"own__{status}").drop("folder").write.json(f"{path}/own__{status}")
    found = src.read_repositories(spark, f"{path}/*/*.json", "repository struct<nameWithOwner:string>")
    status = F.substring_index(F.element_at(F.split("source_file", "/"), -2), "__", -1)
    return found.groupBy(status.alias("folder_status"), "folder_matches").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (count(*))::BIGINT AS lines, true AS same_in_other_files FROM orders")
def content_fingerprints(spark, sf_dir):
    """Sums of lines in any order do not depend on how these are dealt over files; export_checksums has the ordered ones."""
    one, other = _folder(spark, "one"), _folder(spark, "other")
    _orders(spark, sf_dir).write.json(one)
    _orders(spark, sf_dir).repartition(7, "o_custkey").write.json(other)
    a, b = (src.content_fingerprint(spark, p, by_file=False).select("lines", "checksum") for p in (one, other))
    return a.join(b.withColumnRenamed("checksum", "again"), "lines").select("lines", (F.col("checksum") == F.col("again")).alias("same_in_other_files"))


@query("SELECT conv_id AS request_id, max(turn) AS turn FROM conversations WHERE turn % 3 <> 2 GROUP BY 1")
def latest_label_records(spark, sf_dir):
    """Append-only label files; failed attempts and bad lines are skipped, the latest record of a key stays."""
    path = _folder(spark, "labels")
    rows = t(spark, sf_dir, "conversations").selectExpr("conv_id AS request_id", "turn", "CASE WHEN turn % 3 = 2 THEN 'failed' ELSE 'ok' END AS status", "lpad(cast(turn AS string), 6, '0') AS labeled_at")
    rows.write.json(path)
    spark.createDataFrame([("no json",), ("{}",)], "value string").coalesce(1).write.mode("append").text(path)
    return src.latest_labels(spark, path, "request_id long, turn long, status string, labeled_at string").select("request_id", "turn")
