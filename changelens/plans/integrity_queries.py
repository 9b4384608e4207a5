"""Queries: ordered exports and their checksums, pinned appends, repeated labelling, independent recomputation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import records as r
from ..sources import files as src
from ..sources import integrity as g
from ..sources.scratch import shared_dir
from ..streaming import incremental
from .fixtures import CHANGES_SQL, PATH, changes, files, t
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Text lines of documents, with line ends that are none for JSON lines inside.
_LINE = "lpad(cast(doc_id AS {0}), 12, '0') || ' ' || coalesce(source, '') || {1} || coalesce(lang, '') || {2} || coalesce(cast(n_chars AS {0}), '')"
LINE, LINE_SQL = _LINE.format("string", "'\\u2028'", "'\\u0085'"), _LINE.format("VARCHAR", "chr(8232)", "chr(133)")
#: In the perturbed export the rows of two neighbouring documents change places.
SWAPPED = "CASE doc_id WHEN (SELECT min(doc_id) FROM documents) THEN (SELECT min(doc_id) FROM documents WHERE doc_id > (SELECT min(doc_id) FROM documents)) WHEN (SELECT min(doc_id) FROM documents WHERE doc_id > (SELECT min(doc_id) FROM documents)) THEN (SELECT min(doc_id) FROM documents) ELSE doc_id END"


def _exports(spark, sf_dir):
    """Two exports of the same lines over several part files: in order, and with the first two lines exchanged."""
    docs = t(spark, sf_dir, "documents")
    first = [r["doc_id"] for r in docs.select("doc_id").distinct().orderBy("doc_id").limit(2).collect()]
    place = F.when(F.col("doc_id") == first[0], first[-1]).when(F.col("doc_id") == first[-1], first[0]).otherwise(F.col("doc_id")) if first else F.col("doc_id")
    out = {}
    for name, order, parts in (("ordered", F.col("doc_id"), 5), ("swapped", place, 3)):
        out[name] = _folder(spark, name)
        lines = docs.select(order.alias("place"), F.expr(LINE).alias("value"))
        lines.repartitionByRange(parts, "place", "value").sortWithinPartitions("place", "value").select("value").write.text(out[name])
    return out


@query("SELECT 'ordered' AS export, count(*) AS lines, 0::BIGINT AS violations FROM documents UNION ALL SELECT 'swapped', count(*), 1 FROM documents")
def export_order(spark, sf_dir):
    """Order inside and across part files, of strings with other line ends; an export with two lines exchanged has one break."""
    found = None
    for name, path in _exports(spark, sf_dir).items():
        one = g.order_violations(spark, path, lambda v: F.left(v, F.lit(12))).select(F.lit(name).alias("export"), "lines", "violations")
        found = one if found is None else found.unionByName(one)
    return found


_SUM_SQL = lambda order: f"""list_reduce(list_prepend(0::HUGEINT, list(('0x' || substr(md5({LINE_SQL}), 1, 15))::HUGEINT ORDER BY {order})), lambda a, h: (a * {g.BASE} + h) % {g.PRIME})::BIGINT"""


@query(f"SELECT 'ordered' AS export, count(*) AS lines, {_SUM_SQL('doc_id, ' + LINE_SQL)} AS checksum FROM documents UNION ALL SELECT 'swapped', count(*), {_SUM_SQL('p, ' + LINE_SQL)} FROM (SELECT *, {SWAPPED} AS p FROM documents)")
def export_checksums(spark, sf_dir):
    """Checksums of whole exports in the order of their lines, for any number of files and splits."""
    found = None
    for name, path in _exports(spark, sf_dir).items():
        one = g.ordered_checksum(spark, path, by_file=False).select(F.lit(name).alias("export"), "lines", "checksum")
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT status, count(*) AS rows FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'same' END AS status FROM orders) WHERE status IS NOT NULL GROUP BY 1 UNION ALL SELECT 'refused', 0")
def pinned_append(spark, sf_dir):
    """Q7: appends under the parameters of the first one; one under others is refused before a row is written."""
    path, orders = _folder(spark, "pinned"), t(spark, sf_dir, "orders").select("o_orderkey")
    refused = 0
    for status, rest, parameters in (("first", 0, {"model": "m1", "limit": "6000"}), ("refused", 2, {"model": "m2", "limit": "6000"}), ("same", 1, {"limit": "6000", "model": "m1"})):
        try:
            g.append_pinned(orders.where(F.col("o_orderkey") % 3 == rest).withColumn("status", F.lit(status)), path, parameters)
        except g.ParametersDiffer:
            refused += 1
    rows = g.pinned_rows(spark, path)
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
    none = rows.agg(F.count_if(F.col("status") == "refused").alias("rows")).where(F.lit(refused == 1)).select(F.lit("refused").alias("status"), "rows")
    return counts.where("status <> 'refused'").unionByName(none)


@query("SELECT DISTINCT conv_id % 40 AS request_id, md5(role || turn::VARCHAR) AS input_hash FROM conversations WHERE conv_id % 40 NOT IN (SELECT conv_id % 40 FROM conversations WHERE conv_id % 7 = 0)")
def resumed_labels(spark, sf_dir):
    """Requests that come again in later batches are labelled once; keyed state instead of reading what is done."""
    rows = t(spark, sf_dir, "conversations").select((F.col("conv_id") % 40).alias("request_id"), F.md5(F.concat("role", F.col("turn").cast("string")).cast("binary")).alias("input_hash"), "conv_id")
    done = rows.where("conv_id % 7 = 0").select("request_id").distinct().join(rows.select("request_id", "input_hash").distinct(), "request_id")
    source, known, out, checkpoint = (_folder(spark, n) for n in ("requests", "done", "labels", "state"))
    rows.select("request_id", "input_hash").repartition(3).write.parquet(source)
    done.select("request_id", "input_hash").coalesce(1).write.parquet(known)
    schema = "request_id long, input_hash string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.append_first_seen(stream, out, checkpoint, spark.readStream.schema(schema).parquet(known)).awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


@query("SELECT r_regionkey AS region, r_name AS name, count(n_nationkey) AS nations, coalesce(sum(n_nationkey), 0)::BIGINT AS keys FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def document_read(spark, sf_dir):
    """One JSON document over many lines, with nested lists."""
    path = _folder(spark, "document")
    nations = t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("nations"))
    regions = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name")).join(nations, "region", "left")
    whole = F.to_json(F.sort_array(F.collect_list(F.struct("region", "name", F.coalesce("nations", F.array().cast("array<int>")).alias("nations")))))
    lines = regions.agg(F.regexp_replace(whole, r"([,\[{])", "$1\n  ").alias("value"))  # as a person would lay it out
    lines.write.text(path)
    found = src.read_document(spark, path, "region int, name string, nations array<int>")
    return found.select("region", "name", F.size("nations").cast("long").alias("nations"), F.aggregate("nations", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("keys"))


@query(f"WITH {CHANGES_SQL} SELECT repository_id, count(*) AS n, count(*) FILTER (id % 9 <> 0) AS reconciled FROM changes WHERE changed_files > 0 GROUP BY 1")
def reconciled_files(spark, sf_dir):
    """Whether the listed files add up to the declared additions and deletions, which are wrong for some changes."""
    listed = files(spark, sf_dir).groupBy("id").agg(F.collect_list(F.struct("path", "additions", "deletions")).alias("listed"))
    df = changes(spark, sf_dir).select("id", "repository_id", "additions", (F.col("deletions") + (F.col("id") % 9 == 0).cast("int")).alias("deletions")).join(listed, "id")
    return df.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(r.files_reconcile(F.col("listed"), F.col("additions"), F.col("deletions"))).alias("reconciled"))


_OUT = r"low rlike '(^|/)(package-lock[.]json|yarn[.]lock)$|[.]lock$|(^|/)(node_modules|vendor|dist|build|generated|__generated__)/|[.]min[.](js|css)$'"
_TEST = r"low rlike '(^|/)(test|tests|__tests__|spec|specs|testing)/|(^|/)test_[^/]*$|_test[.][^/]*$'"
_DOC = r"low rlike '[.](md|rst|adoc)$|(^|/)(doc|docs|documentation)/|(^|/)(readme|license|changelog)[^/]*$'"
#: The second formulation: exclusive predicates over the paths that the fixture can make.
_SECOND = {"is_test": f"not ({_OUT}) and {_TEST}", "is_source": f"not ({_OUT}) and not ({_TEST}) and not ({_DOC}) and low rlike '[.](py|ts|tsx|sql|html|cs)$'"}


@query(f"WITH {CHANGES_SQL} SELECT id, 'touches_test' AS \"column\", CASE WHEN touches_test THEN 'true' ELSE 'false' END AS left_value, CASE WHEN touches_test THEN 'false' ELSE 'true' END AS right_value FROM changes WHERE id % 4999 = 0 UNION ALL SELECT id, 'source_churn', source_churn::VARCHAR, (source_churn + 1)::VARCHAR FROM changes WHERE id % 4999 = 1")
def recomputed_cells(spark, sf_dir):
    """Q5, Q6: measures of changes against a second formulation on its own parse, in which a few cells are wrong."""
    left = changes(spark, sf_dir).select("id", "touches_test", "source_churn")
    lines = t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", f"{PATH} AS path", "cast(floor(l_quantity) AS bigint) + cast(floor(l_tax * 100) AS bigint) AS churn").withColumn("low", F.lower("path"))
    lines = lines.withColumns({k: F.expr(e) for k, e in _SECOND.items()})
    sums = lines.groupBy("id").agg(F.count_if("is_test").alias("tests"), F.sum(F.when(F.col("is_source"), F.col("churn")).otherwise(0)).alias("churn"))
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    right = orders.join(sums, "id", "left").select(
        "id",
        (F.coalesce(F.col("tests") > 0, F.lit(False)) != (F.col("id") % 4999 == 0)).alias("touches_test"),
        (F.coalesce("churn", F.lit(0)) + (F.col("id") % 4999 == 1).cast("int")).alias("source_churn"),
    )
    return g.changed_cells(left, right, ["id"], ["touches_test", "source_churn"])
