"""Queries: joins and sets, events, samples, windows, labels, text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import records as r
from ..functions import text as x
from ..operators import events as e
from ..operators import labels as lb
from ..operators import matching
from ..operators import quality as q
from ..operators import sampling as s
from ..operators import windows as w
from .fixtures import CHANGES_SQL, FILES_SQL, changes, files, t
from .registry import query

W, WF = f"WITH {CHANGES_SQL}", f"WITH {FILES_SQL}"

# ---- joins and sets


@query("SELECT source, lang, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def annotated_documents(spark, sf_dir):
    """A validated one-to-one annotation join, summarised with unlabelled rows kept."""
    df = lb.annotate(t(spark, sf_dir, "documents").select("doc_id", "source", "lang"), t(spark, sf_dir, "labels"), "doc_id")
    flag = lambda c, n: F.count_if(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n)
    return df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), flag("quality", "good"), flag("toxic", "toxic"))


@query("SELECT quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def label_groups_with_nulls(spark, sf_dir):
    """Null keys are groups of their own."""
    df = t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return df.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(f"{W}, b AS (SELECT id, CASE WHEN id % 50 = 0 THEN state || 'X' ELSE state END AS state, CASE WHEN id % 70 = 0 THEN NULL ELSE agent END AS agent FROM changes) SELECT c.id, 'state' AS field, c.state AS left_value, b.state AS right_value FROM changes c JOIN b USING (id) WHERE c.state IS DISTINCT FROM b.state UNION ALL SELECT c.id, 'agent', c.agent, b.agent FROM changes c JOIN b USING (id) WHERE c.agent IS DISTINCT FROM b.agent")
def field_mismatches(spark, sf_dir):
    """Field by field differences of two sources."""
    df = changes(spark, sf_dir).select("id", "state", "agent")
    other = df.withColumn("state", F.when(F.col("id") % 50 == 0, F.concat("state", F.lit("X"))).otherwise(F.col("state"))).withColumn("agent", F.when(F.col("id") % 70 != 0, F.col("agent")))
    return q.field_mismatches(df, other, "id", ["state", "agent"])


@query("SELECT lang, source, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) GROUP BY ALL")
def unlabelled(spark, sf_dir):
    """J3."""
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"{W} SELECT kind, count(*) AS files FROM files SEMI JOIN (SELECT id FROM changes WHERE merged) m USING (id) GROUP BY 1")
def files_of_merged(spark, sf_dir):
    """J4."""
    return files(spark, sf_dir).join(changes(spark, sf_dir).where("merged").select("id"), "id", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


@query(f"{W} SELECT agent, count(*) AS overlap, count(*) FILTER (a.changed_lines <> b.changed_lines + b.id % 2) AS scope_changed FROM (SELECT * FROM changes WHERE id % 2 = 0 OR id % 3 = 0) a JOIN (SELECT id, changed_lines FROM changes WHERE id % 5 <> 0) b USING (id) GROUP BY 1".replace("b.id % 2", "id % 2"))
def cohort_overlap(spark, sf_dir):
    """Two cohorts that overlap, and how often the scope differs between them."""
    df = changes(spark, sf_dir)
    b = df.where("id % 5 <> 0").select("id", (F.col("changed_lines") + F.col("id") % 2).alias("other_lines"))
    return df.where("id % 2 = 0 or id % 3 = 0").join(b, "id").groupBy("agent").agg(F.count(F.lit(1)).alias("overlap"), F.count_if(F.col("changed_lines") != F.col("other_lines")).alias("scope_changed"))


@query("SELECT conv_id, turn, 'pending' AS status FROM conversations c ANTI JOIN (SELECT conv_id, turn, md5(text) AS h FROM conversations WHERE turn % 2 = 0) d ON c.conv_id = d.conv_id AND c.turn = d.turn AND md5(c.text) = d.h")
def pending_requests(spark, sf_dir):
    """Requests without a completed label for the same input."""
    df = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("h"))
    return df.join(df.where("turn % 2 = 0"), ["conv_id", "turn", "h"], "left_anti").select("conv_id", "turn", F.lit("pending").alias("status"))


@query(f"{W} SELECT 'merged' AS origin, repository_id, count(*) AS n FROM changes WHERE merged GROUP BY 2 UNION ALL SELECT 'open', repository_id, count(*) FROM changes WHERE state = 'OPEN' GROUP BY 2")
def union_with_origin(spark, sf_dir):
    """U1."""
    df = changes(spark, sf_dir)
    one = lambda name, part: part.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("origin"), "repository_id", "n")
    return one("merged", df.where("merged")).unionByName(one("open", df.where("state = 'OPEN'")))


@query(f"{W} SELECT repository_id FROM changes WHERE \"quarter\" = '2001Q1' INTERSECT SELECT repository_id FROM changes WHERE \"quarter\" = '2001Q2'")
def repositories_in_both(spark, sf_dir):
    """U2."""
    df = changes(spark, sf_dir)
    return df.where("quarter = '2001Q1'").select("repository_id").intersect(df.where("quarter = '2001Q2'").select("repository_id"))


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)) AS only_right")
def multiset_difference(spark, sf_dir):
    """U3."""
    return q.same_rows(t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query("SELECT n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", ["balance"])
def owners_by_nation(spark, sf_dir):
    """A lookup in a dimension; its size decides whether Spark broadcasts it."""
    df = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# ---- events


@query("SELECT s.event_id, s.user_id, s.ts, min(p.ts) AS first_end FROM events s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts > s.ts WHERE s.event_type = 'signup' GROUP BY ALL")
def first_purchase(spark, sf_dir):
    """The first end after each start."""
    df = t(spark, sf_dir, "events")
    return e.first_after(df.where("event_type = 'signup'"), df.where("event_type = 'purchase'"), "user_id", "ts", "ts", "event_id")


@query("SELECT s.event_id, count(p.event_id) AS n FROM events s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type IN ('click', 'view', 'error') AND p.ts >= s.ts AND p.ts < s.ts + INTERVAL 7 DAY WHERE s.event_type = 'signup' GROUP BY 1")
def discussion_within_week(spark, sf_dir):
    """Events in a half-open interval after each start."""
    df = t(spark, sf_dir, "events")
    return e.events_within(df.where("event_type = 'signup'"), df.where("event_type in ('click', 'view', 'error')"), "user_id", "ts", "ts", "event_id", 7 * 86_400)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1", ["value"])
def first_of_kind(spark, sf_dir):
    """W8."""
    return e.keep_first(t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id, value FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1", ["value"])
def latest_completed(spark, sf_dir):
    """The last accepted record wins."""
    return e.keep_latest(t(spark, sf_dir, "events").where("event_type <> 'error'"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total, max((props->>'k')::BIGINT) AS most FROM events GROUP BY 1")
def usage_totals(spark, sf_dir):
    """Totals from JSON, with a fixed schema."""
    df = t(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


# ---- samples

DAY = "strftime(o_orderdate, '%Y-%m-%d')"
CANDIDATES_SQL = f"cand AS (SELECT o_orderkey AS id, o_custkey % 60 AS repository, o_orderpriority AS agent, {DAY} AS \"day\", sha256('s1' || chr(0) || o_orderpriority || chr(0) || {DAY} || chr(0) || o_orderkey::VARCHAR) AS h FROM orders), turns AS (SELECT *, row_number() OVER (PARTITION BY agent, \"day\" ORDER BY h, id) AS turn FROM cand)"


def candidates(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 60).alias("repository"), F.col("o_orderpriority").alias("agent"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(f"WITH {CANDIDATES_SQL.replace('chr(0)', 'chr(0)')} SELECT id, agent, \"day\", turn FROM turns")
def day_stratified_order(spark, sf_dir):
    """Hash order within each day; turns interleave the days."""
    return s.day_stratified(candidates(spark, sf_dir), "agent", "day", "id", "s1").select("id", "agent", "day", "turn")


@query(f"WITH {CANDIDATES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY agent, repository ORDER BY turn, \"day\", id) AS k FROM turns), g AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY turn, \"day\", id) AS rank FROM c WHERE k <= 3) SELECT id, agent, repository, rank FROM g WHERE rank <= 100")
def capped_sample(spark, sf_dir):
    """At most 3 of a repository and 100 of an agent."""
    return s.capped_sample(candidates(spark, sf_dir), "agent", "day", "id", "repository", "s1", 100, 3).select("id", "agent", "repository", "rank")


@query()
def round_robin_sample(spark, sf_dir):
    """A sequential walk per agent; tested against brute force."""
    return s.round_robin_sample(candidates(spark, sf_dir), "agent", "day", "id", "repository", "s1", 100, 3)


@query("SELECT doc_id, source, sha256('audit' || chr(0) || doc_id::VARCHAR) AS audit_key FROM documents ORDER BY 3, 1 LIMIT 50")
def audit_sample(spark, sf_dir):
    """The 50 smallest hashes; a sampling operator."""
    return s.audit_sample(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "audit", 50)


@query(f"{WF}, d AS (SELECT DISTINCT kind, path FROM files), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sha256('p' || chr(0) || kind || chr(0) || path), path) AS place FROM d) SELECT kind, path, place FROM k WHERE place <= 24")
def paths_per_kind(spark, sf_dir):
    """24 distinct paths of each kind in hash order."""
    return s.sample_per_group(files(spark, sf_dir), "kind", "path", "p", 24)


@query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_orderkey % 4 < 3 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", ["o_totalprice"])
def work_queue(spark, sf_dir):
    """A bounded queue of open work."""
    df = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus", (F.col("o_orderkey") % 4).alias("attempts"), (-F.col("o_totalprice")).alias("priority"))
    return s.work_queue(df, "o_orderstatus", ["P", "O"], "attempts", 3, ["priority", "id"], 25).select("id", "o_totalprice")


def _projects(spark, sf_dir):
    df = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    topics = F.array_compact(F.array(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "three"), F.when(F.col("c_custkey") % 5 == 0, "five")))
    return df.select(F.col("c_name").alias("name"), F.col("n_name").alias("language"), F.expr("date_add(DATE'2015-01-01', cast(c_custkey % 3000 as int))").alias("created"), F.abs("c_acctbal").alias("size"), topics.alias("topics"), (F.col("c_custkey")).alias("rank"), "c_custkey")


PROJECTS_SQL = """SELECT c_name AS name, n_name AS language, DATE '2015-01-01' + (c_custkey % 3000)::INT AS created, abs(c_acctbal) AS size, c_custkey AS rank,
 list_filter([c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'three' END, CASE WHEN c_custkey % 5 = 0 THEN 'five' END], lambda x: x IS NOT NULL) AS topics FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(f"""WITH RECURSIVE p AS ({PROJECTS_SQL}), a AS (SELECT *, row_number() OVER (ORDER BY rank, name) AS k FROM p WHERE rank % 50 = 0),
pairs AS (SELECT a.k, a.rank, a.name AS anchor, b.name AS control, round(abs(date_diff('day', a.created, b.created)) / 365.25 + abs(ln(1 + b.size) - ln(1 + a.size))
 + 2 * (1 - len(list_intersect(a.topics, b.topics)) / greatest(1, len(list_distinct(list_concat(a.topics, b.topics))))), 6) AS score FROM a JOIN p b USING (language) WHERE b.rank % 50 <> 0),
walk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::STRUCT(score DOUBLE, control VARCHAR) AS best
 UNION ALL SELECT w.k + 1, CASE WHEN w.best IS NULL THEN w.used ELSE list_append(w.used, w.best.control) END,
 (SELECT min({{'score': q.score, 'control': q.control}}) FROM pairs q WHERE q.k = w.k + 1 AND NOT list_contains(w.used, q.control) AND (w.best IS NULL OR q.control <> w.best.control)) FROM walk w WHERE w.k < (SELECT count(*) FROM a))
SELECT a.rank, a.name AS anchor, w.best.control AS control, w.best.score AS score FROM walk w JOIN a USING (k) WHERE w.best IS NOT NULL""", ["score"])
def matched_controls(spark, sf_dir):
    """Nearest controls without replacement."""
    p = _projects(spark, sf_dir)
    return matching.match_controls(p.where("c_custkey % 50 = 0"), p.where("c_custkey % 50 <> 0"))


# ---- windows


@query("SELECT generate_series AS start_at, least(generate_series + INTERVAL 6 HOUR, TIMESTAMP '2024-01-31 10:00:00') AS end_at, count(event_id) AS n FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 09:59:59', INTERVAL 6 HOUR) LEFT JOIN events ON ts >= generate_series AND ts < least(generate_series + INTERVAL 6 HOUR, TIMESTAMP '2024-01-31 10:00:00') GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """Six-hour windows, the last one clipped."""
    found = w.tumbling_counts(t(spark, sf_dir, "events"), "ts", "2024-01-01 00:00:00", "2024-01-31 10:00:00", 6)
    return found.select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), F.col("end_at").cast("timestamp_ntz").alias("end_at"), "n")


SPAN = (1704067200, 1706745600)


@query(f"""WITH RECURSIVE e AS (SELECT floor(epoch(ts))::BIGINT AS s, count(*) AS c FROM events GROUP BY 1),
win AS (SELECT {SPAN[0]}::BIGINT AS lo, {SPAN[1]}::BIGINT AS hi, (SELECT coalesce(sum(c), 0)::BIGINT FROM e WHERE s >= {SPAN[0]} AND s < {SPAN[1]}) AS n
UNION ALL SELECT CASE h WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE h WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END,
 (SELECT coalesce(sum(c), 0)::BIGINT FROM e WHERE s >= CASE h WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END AND s < CASE h WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END) FROM win, (VALUES (0), (1)) v(h) WHERE n > 50 AND hi - lo > 3600)
SELECT lo AS start_s, hi AS end_s, n, n > 50 AS truncated FROM win WHERE NOT (n > 50 AND hi - lo > 3600)""")
def adaptive_windows(spark, sf_dir):
    """Dense windows split at their midpoint until they are sparse or short."""
    return w.adaptive(t(spark, sf_dir, "events"), "ts", *SPAN, 50, 3600)


# ---- labels

REVIEWS_SQL = """reviews AS (SELECT conv_id, turn, (conv_id + turn) % 3 <> 0 AS is_code_issue, CASE WHEN (conv_id + turn) % 3 = 0 THEN ['non_code_issue'] WHEN turn % 2 = 0 THEN ['security', 'edge_case'] ELSE ['documentation'] END AS categories,
 (['unknown', 'low', 'medium', 'high'])[((conv_id * 7 + turn) % 4 + 1)::INT] AS severity, ((conv_id + turn) % 100) / 100.0 AS confidence FROM conversations WHERE role = 'user' AND conv_id % 4 <> 0),
rolled AS (SELECT c.conv_id, count(r.turn) AS texts, count(r.turn) FILTER (is_code_issue) AS code_issues, coalesce(round(avg(confidence), 4), 1.0) AS mean_confidence,
 coalesce((['unknown', 'low', 'medium', 'high'])[max(list_position(['unknown', 'low', 'medium', 'high'], severity)) FILTER (is_code_issue)], 'none') AS max_severity,
 count(*) FILTER (is_code_issue AND list_contains(categories, 'security')) AS sec, count(*) FILTER (is_code_issue AND list_contains(categories, 'documentation')) AS docu
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN reviews r USING (conv_id) GROUP BY 1)"""


def _reviews(spark, sf_dir):
    df = t(spark, sf_dir, "conversations").where("role = 'user' and conv_id % 4 <> 0")
    code = (F.col("conv_id") + F.col("turn")) % 3 != 0
    words = lambda *v: F.array(*[F.lit(a) for a in v])
    return df.select(
        "conv_id", code.alias("is_code_issue"),
        F.when(~code, words("non_code_issue")).when(F.col("turn") % 2 == 0, words("security", "edge_case")).otherwise(words("documentation")).alias("categories"),
        F.element_at(words(*lb.SEVERITY_ORDER), ((F.col("conv_id") * 7 + F.col("turn")) % 4 + 1).cast("int")).alias("severity"), (((F.col("conv_id") + F.col("turn")) % 100) / 100.0).alias("confidence"),
    )


def _rolled(spark, sf_dir):
    return lb.rollup(t(spark, sf_dir, "conversations").select("conv_id").distinct(), _reviews(spark, sf_dir), "conv_id")


@query(f"WITH {REVIEWS_SQL} SELECT conv_id, CASE WHEN texts > 0 THEN 'model_classified' ELSE 'no_human_review_text' END AS status, texts, code_issues, texts - code_issues AS non_code, max_severity, mean_confidence, sec > 0 AS security FROM rolled", ["mean_confidence"])
def review_rollup(spark, sf_dir):
    """Review labels per conversation, with those that have none."""
    return _rolled(spark, sf_dir).select("conv_id", "status", "texts", "code_issues", "non_code", "max_severity", "mean_confidence", F.array_contains("categories", "security").alias("security"))


@query(f"""WITH {REVIEWS_SQL}, g AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (code_issues > 0) AS i, count(*) FILTER (sec > 0) AS s, count(*) FILTER (docu > 0) AS d FROM rolled WHERE texts > 0),
c AS (SELECT 'security' AS category, s::DOUBLE AS h, n, i FROM g UNION ALL SELECT 'documentation', d, n, i FROM g)
SELECT category, h::BIGINT AS n, c.n::BIGINT AS reviewed, 100.0 * h / c.n AS pct, greatest(0, (h / c.n + 3.841458820694124 / (2 * c.n) - 1.959963984540054 * sqrt(h / c.n * (1 - h / c.n) / c.n + 3.841458820694124 / (4 * c.n * c.n))) / (1 + 3.841458820694124 / c.n)) AS low,
least(1, (h / c.n + 3.841458820694124 / (2 * c.n) + 1.959963984540054 * sqrt(h / c.n * (1 - h / c.n) / c.n + 3.841458820694124 / (4 * c.n * c.n))) / (1 + 3.841458820694124 / c.n)) AS high, 100.0 * h / i AS pct_of_issues FROM c""", ["pct", "low", "high", "pct_of_issues"])
def category_table(spark, sf_dir):
    """A42, M9."""
    return lb.category_table(_rolled(spark, sf_dir), ["security", "documentation"])


@query("SELECT source, count(*) AS selected, count(l.doc_id) AS retrieved, count(*) - count(l.doc_id) AS missing, 100.0 * count(l.doc_id) / count(*) AS retrieved_pct FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1", ["retrieved_pct"])
def label_coverage(spark, sf_dir):
    """A24."""
    return lb.coverage(t(spark, sf_dir, "documents").select("doc_id", "source"), t(spark, sf_dir, "labels"), "doc_id", ["source"])


@query(f"{W}, p AS (SELECT agent, merged, unnest(list_distinct(['coding', CASE WHEN touches_test THEN 'testing' ELSE 'coding' END, CASE WHEN source_files = 0 THEN 'planning' ELSE 'coding' END])) AS item FROM changes), g AS (SELECT agent, count(*) AS labelled FROM changes GROUP BY 1) SELECT agent, item, count(*) AS n, any_value(labelled) AS labelled, 100.0 * count(*) / any_value(labelled) AS pct, 100.0 * avg(merged::INT) AS flag_pct FROM p JOIN g USING (agent) GROUP BY 1, 2", ["pct", "flag_pct"])
def phase_membership(spark, sf_dir):
    """Changes per phase label, against all labelled ones."""
    phases = F.array(F.lit("coding"), F.when(F.col("touches_test"), "testing").otherwise("coding"), F.when(F.col("source_files") == 0, "planning").otherwise("coding"))
    return lb.membership_stats(changes(spark, sf_dir).withColumn("phases", phases), "phases", ["agent"], ["coding", "testing", "planning"], "merged")


# ---- text and row rules


@query(r"""WITH d AS (SELECT doc_id, text, regexp_replace(text, 'token = "[0-9a-f]{40}"', '[REDACTED]', 'g') AS clean FROM documents) SELECT doc_id, (length(text) - length(clean)) // 40 AS found, md5(clean) AS clean_md5 FROM d""")
def redacted_tokens(spark, sf_dir):
    """Every string of a nested document redacted; counts of what was found."""
    pattern = 'token = "[0-9a-f]{40}"'
    df = t(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("text").alias("body"), F.array("text").alias("parts")).alias("doc"))
    clean = x.redact(df, pattern)
    found = x.occurrences(F.col("doc.body"), df.schema["doc"].dataType["body"].dataType, pattern)
    counted = df.select("doc_id", found.cast("long").alias("found"))
    return clean.select("doc_id", F.md5(F.col("doc.parts")[0].cast("binary")).alias("clean_md5")).join(counted, "doc_id")


@query(f"{W} SELECT id, list_filter([CASE WHEN state <> 'MERGED' THEN 'not_merged' END, CASE WHEN id % 3 <> 0 THEN 'not_approved' END, CASE WHEN NOT has_text THEN 'no_non_author_human_review_text' END, CASE WHEN id % 9 = 0 THEN 'active_unresolved_review_thread' END, CASE WHEN id % 23 = 0 THEN 'missing_base_or_head_oid' END], lambda z: z IS NOT NULL)::VARCHAR AS reasons FROM changes")
def gate_reasons(spark, sf_dir):
    """Why a change is no review candidate."""
    df = changes(spark, sf_dir)
    merged_at = F.when(F.col("merged"), F.col("created_at"))
    reasons = r.review_gate(F.col("state"), merged_at, F.when(F.col("id") % 3 == 0, "APPROVED"), F.col("has_text").cast("int"), (F.col("id") % 9 == 0).cast("int"), F.when(F.col("id") % 23 != 0, "b"), F.lit("h"))
    return df.select("id", F.concat(F.lit("["), F.array_join(reasons, ", "), F.lit("]")).alias("reasons"))


@query("SELECT role, count(*) AS n, count(*) FILTER (role = 'user' AND trim(text) <> '') AS human_texts, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def human_texts(spark, sf_dir):
    """People, bots and unknown actors."""
    df = t(spark, sf_dir, "conversations")
    login = F.when(F.col("role") == "user", "person").when(F.col("role") == "assistant", "helper[bot]")
    human = r.is_human(login, F.when(F.col("role") == "assistant", "Bot").otherwise("User")) & (F.trim("text") != "")
    return df.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(human).alias("human_texts"), F.countDistinct("conv_id").alias("conversations"))


@query(r"SELECT p_partkey, regexp_matches(p_name, '\b(bolt|widget)\b') AS repair, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'mid' ELSE 'large' END AS band, lower(p_type) IN ('small', 'economy') AS bug FROM part")
def keyword_flags(spark, sf_dir):
    """Title and label flags, right-closed bands."""
    df = t(spark, sf_dir, "part")
    return df.select("p_partkey", r.repair_title(F.col("p_name"), r"(?U)\b(bolt|widget)\b").alias("repair"), r.bins(F.col("p_size"), [-1, 10, 30, float("inf")], ["small", "mid", "large"]).alias("band"), r.bug_label(F.array("p_type"), ("small", "economy")).alias("bug"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'non_programming_primary_language' WHEN c_mktsegment = 'MACHINERY' THEN 'resource_or_study_repository' WHEN c_custkey % 5 = 0 THEN 'resource_collection_description' ELSE '' END AS reason FROM customer")
def repository_gate(spark, sf_dir):
    """P24."""
    df = t(spark, sf_dir, "customer")
    reason = r.repository_exclusion(F.when(F.col("c_custkey") % 9 != 0, "Python"), F.array(F.when(F.col("c_mktsegment") == "MACHINERY", "awesome").otherwise("tool")), F.when(F.col("c_custkey") % 5 == 0, "A curated list of things").otherwise("software"))
    return df.select("c_custkey", reason.alias("reason"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude_code' WHEN 2 THEN 'claude_code|jules' WHEN 3 THEN '' ELSE 'copilot|devin' END AS agents, o_orderkey % 5 = 2 AS changed_by_markdown FROM orders")
def agent_signals(spark, sf_dir):
    """Agents from branch, body and author, and what the second signature adds."""
    k = F.col("o_orderkey") % 5
    df = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "codex/x").when(k == 4, "Copilot/y").alias("branch"), F.when(k == 1, "done\n\nCo-Authored-By: Claude <x>").when(k == 2, "Generated with [Claude Code](https://a.b/c)").alias("body"), F.when(k == 2, "google-labs-jules[bot]").when(k == 4, "devin-ai-integration").alias("author"))
    one, two = (r.agent_evidence(F.col("branch"), F.col("body"), F.col("author"), m) for m in (False, True))
    return df.select("id", r.agent_names(two).alias("agents"), (r.agent_names(one) != r.agent_names(two)).alias("changed_by_markdown"))


@query("SELECT conv_id, turn, left(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 6000) AS cleaned, length(text) > 6000 AS long FROM conversations")
def cleaned_requests_in_full(spark, sf_dir):
    """P25: as cleaned_requests, with the operator's own limit."""
    df = t(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", x.clean(F.col("text")).alias("cleaned"), (F.length("text") > 6000).alias("long"))


@query("""WITH k AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 6 AS k FROM conversations) SELECT conv_id, turn, k = 0 OR k = 1 AS accepted, CASE k WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'is_code_issue,no_categories,severity,confidence,quote_not_in_body,rationale' WHEN 3 THEN 'categories' WHEN 4 THEN 'quote_not_in_body' ELSE 'severity,confidence' END AS errors FROM k""")
def validated_labels(spark, sf_dir):
    """Model outputs parsed, normalised and accepted or given reasons."""
    df = t(spark, sf_dir, "conversations").withColumn("k", (F.col("conv_id") * 3 + F.col("turn")) % 6)
    quote = F.substring(F.trim(F.regexp_replace(F.regexp_replace("text", r'[\\"]', ""), r"\s+", " ")), 1, 12)
    body = F.concat(F.regexp_replace("text", r'[\\"]', ""), F.lit(" end"))

    def answer(issue: str, categories: str, severity: str, confidence: str, said) -> F.Column:
        return F.concat(F.lit(f'{{"is_code_issue": {issue}, "categories": {categories}, "severity": "{severity}", "confidence": {confidence}, "evidence_quote": "'), said, F.lit('", "rationale": "because"}'))

    fine = answer("true", '["performance", "security", "security"]', "high", "0.9", quote)
    content = (
        F.when(F.col("k") == 0, fine)
        .when(F.col("k") == 1, F.concat(F.lit("```json\n"), answer("false", '["non_code_issue"]', "low", "0.5", quote), F.lit("\n```")))
        .when(F.col("k") == 2, F.lit("no json"))
        .when(F.col("k") == 3, answer("true", '["unheard"]', "low", "0.5", quote))
        .when(F.col("k") == 4, answer("true", '["security"]', "low", "0.5", F.lit("@@nowhere@@")))
        .otherwise(answer("true", '["security"]', "fatal", "1.5", quote))
    )
    _, errors = x.validate_label(x.parse_label(content), body)
    return df.select("conv_id", "turn", (F.size(errors) == 0).alias("accepted"), F.array_join(errors, ",").alias("errors"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS truncated, sum(greatest(0, floor(value)::BIGINT - 20))::BIGINT AS gap FROM events GROUP BY 1")
def window_ledger(spark, sf_dir):
    """Ledger counts with gaps clipped at 0."""
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("truncated"), F.sum(F.greatest(F.lit(0), F.floor("value") - 20)).alias("gap"))


@query(f"{W} SELECT agent, min(merge_minutes) AS fastest, count(*) FILTER (created_at >= TIMESTAMP '2001-01-01') AS recent, max(date_diff('day', created_at, TIMESTAMP '2002-01-01')) AS oldest_days FROM changes GROUP BY 1", ["fastest"])
def ages(spark, sf_dir):
    """Ages in days at a capture time."""
    age = r.age_days(F.col("created_at"), F.lit("2002-01-01").cast("timestamp"))
    return changes(spark, sf_dir).groupBy("agent").agg(F.min("merge_minutes").alias("fastest"), F.count_if(F.col("created_at") >= F.lit("2001-01-01").cast("timestamp_ntz")).alias("recent"), F.max(F.floor(age)).alias("oldest_days"))


@query(f"{W} SELECT agent, repository_id, count(*) AS n, rank() OVER (PARTITION BY agent ORDER BY count(*) DESC) AS place FROM changes GROUP BY 1, 2")
def repository_ranks(spark, sf_dir):
    """Ranks within agents over summary rows."""
    g = changes(spark, sf_dir).groupBy("agent", "repository_id").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.rank().over(Window.partitionBy("agent").orderBy(F.desc("n"))))
