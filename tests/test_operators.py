"""Operators against golden numbers, brute force and invariants."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from changelens.operators import contrasts as c
from changelens.operators import events, labels, quality, sampling, windows
from changelens.plans import misc_queries
from changelens.sources import files
from changelens.streaming import incremental


def test_sign_test_holm_and_wilson(spark):
    # published p-values of exact binomial tests
    rows = [("a", 8, 2, 0), ("b", 5, 5, 1), ("c", 0, 0, 3), ("d", 30, 10, 0)]
    got = {r["k"]: r for r in c.holm(c.sign_test(spark.createDataFrame(rows, "k string, positive int, negative int, tied int")), log10="log10_p_sign").collect()}
    assert got["a"]["p_sign"] == pytest.approx(0.109375, abs=1e-12) and got["b"]["p_sign"] == 1 and got["c"]["p_sign"] == 1
    assert got["d"]["p_sign"] == pytest.approx(0.002221, abs=1e-6)
    assert got["d"]["p_holm"] == pytest.approx(4 * got["d"]["p_sign"]) and got["a"]["p_holm"] == pytest.approx(3 * 0.109375) and got["b"]["p_holm"] == 1
    far = c.sign_test(spark.createDataFrame([(3000, 300, 0)], "positive int, negative int, tied int")).first()
    assert far["log10_p_sign"] < -500
    low, high = spark.range(1).select(*c.wilson(F.lit(8.0), F.lit(10.0))).first()
    assert low == pytest.approx(0.49016, abs=1e-5) and high == pytest.approx(0.94331, abs=1e-5)
    assert tuple(spark.range(1).select(*c.wilson(F.lit(0.0), F.lit(0.0))).first()) == (0, 0)


def test_decomposition_adds_up(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ab"), draw.choice("xyz"), draw.random() < 0.4) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, s string, f boolean")
    got = c.decomposed(df, F.col("g"), ("a", "b"), "s", "f").first()
    assert got["supported"] and got["gap_pp"] == pytest.approx(got["composition_pp"] + got["within_pp"])
    pair = c.decomposed_pairs(df, "g", "s", "f").first()
    assert pair["gap_pp"] == pytest.approx(got["gap_pp"])


def test_tails_drop_exactly_the_top(spark):
    rows = [(i, 5 if i < 150 else i, i % 2 == 0) for i in range(200)]
    got = {r["mode"]: r for r in c.tails(spark.createDataFrame(rows, "id int, lines int, f boolean"), "lines", "f", "id").collect()}
    assert got["drop_top_1pct"]["prs"] == 198 and got["raw"]["total_lines"] - got["drop_top_1pct"]["total_lines"] == 199 + 198


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_round_robin_equals_the_walk(spark, seed):
    draw = random.Random(seed)
    rows = [(i, f"d{draw.randrange(5)}", draw.randrange(4), draw.choice("ab")) for i in range(150)]
    want = []
    for agent in "ab":
        days = {}
        for i, d, repo, a in rows:
            if a == agent:
                days.setdefault(d, []).append((hashlib.sha256(f"s\0{a}\0{d}\0{i}".encode()).hexdigest(), i, repo))
        queues, taken, chosen = [sorted(days[d]) for d in sorted(days)], {}, []
        while len(chosen) < 20:
            progress = False
            for q in queues:
                while q:
                    _, i, repo = q.pop(0)
                    if taken.get(repo, 0) < 4:
                        taken[repo] = taken.get(repo, 0) + 1
                        chosen.append(i)
                        progress = True
                        break
                if len(chosen) >= 20:
                    break
            if not progress:
                break
        want += [(agent, i, k + 1) for k, i in enumerate(chosen)]
    df = spark.createDataFrame(rows, "id int, day string, repo int, agent string")
    got = sampling.round_robin_sample(df, "agent", "day", "id", "repo", "s", 20, 4).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    walk = sampling.capped_sample(df, "agent", "day", "id", "repo", "s", 20, 4).groupBy("agent", "repo").count().agg(F.max("count")).first()[0]
    assert walk <= 4


def test_round_robin_walks_few_rows_of_a_day(spark):
    draw = random.Random(4)
    rows = [(i, f"d{i % 3}", min(draw.randrange(300), draw.randrange(300)) // 2, "a") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, day string, repo int, agent string")
    turns = sampling.day_stratified(df, "agent", "day", "id", "s")
    walked = sampling._walked(turns, "agent", "day", "repo", 14, 2).groupBy("day").count().collect()
    assert [r["count"] for r in walked] == [28] * 3
    few, many = (sorted(r["rank"] * 1000 + r["id"] for r in sampling.round_robin_sample(df, "agent", "day", "id", "repo", "s", n, 2).collect()) for n in (14, 450))
    assert len(few) == 14 and many[:14] == few


def test_matched_controls_are_greedy(spark, sf_dir):
    p = misc_queries._projects(spark, sf_dir).toPandas()
    got = misc_queries.matched_controls(spark, sf_dir).toPandas().sort_values("rank")
    import math

    used = set()
    for a in p[p.c_custkey % 50 == 0].sort_values("rank").itertuples():
        near = []
        for b in p[(p.c_custkey % 50 != 0) & (p.language == a.language)].itertuples():
            if b.name not in used:
                common, every = len(set(a.topics) & set(b.topics)), len(set(a.topics) | set(b.topics))
                near.append((round(abs((b.created - a.created).days) / 365.25 + abs(math.log1p(b.size) - math.log1p(a.size)) + 2 * (1 - common / max(1, every)), 6), b.name))
        mine = got[got.anchor == a.name]
        if near:
            used.add(min(near)[1])
            assert mine.control.iloc[0] == min(near)[1]


def test_windows_partition_the_span(spark):
    rows = [(f"2024-01-01 00:{m:02d}:{s:02d}",) for m in range(3) for s in range(60)] + [("2024-01-01 20:00:00",)]
    df = spark.createDataFrame(rows, "t string").select(F.to_timestamp("t").alias("t"))
    leaves = sorted(map(tuple, windows.adaptive(df, "t", 1704067200, 1704067200 + 86_400, 20, 60).collect()))
    assert leaves[0][0] == 1704067200 and leaves[-1][1] == 1704067200 + 86_400 and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
    assert sum(x[2] for x in leaves) == len(rows) and any(x[3] for x in leaves) and all(x[2] <= 20 or x[1] - x[0] <= 60 for x in leaves)
    tumbling = windows.tumbling_counts(df, "t", "2024-01-01 00:00:00", "2024-01-01 05:00:00", 2).orderBy("start_at").collect()
    assert [x["n"] for x in tumbling] == [180, 0, 0] and str(tumbling[-1]["end_at"]) == "2024-01-01 05:00:00"


EVENT = "struct<id:string,url:string,body:string,createdAt:string,author:struct<__typename:string,login:string>>"
DOCUMENT = f"id string, createdAt string, mergedAt string, author struct<login:string>, comments array<{EVENT}>, reviewThreads array<struct<comments:array<{EVENT}>>>, reviews array<struct<id:string,url:string,state:string,body:string,createdAt:string,submittedAt:string,author:struct<__typename:string,login:string>>>"


def test_discussion_features(spark):
    who = lambda n, k="User": {"__typename": k, "login": n}
    event = lambda i, body, at, w: {"id": i, "url": None, "body": body, "createdAt": at, "author": w}
    review = lambda i, state, body, at, sub, w: {"id": i, "url": None, "state": state, "body": body, "createdAt": at, "submittedAt": sub, "author": w}
    doc = (
        "p", "2025-01-01T00:00:00Z", "2025-01-03T00:00:00Z", {"login": "Me"},
        [event("c1", "hi", "2025-01-02T00:00:00Z", who("you")), event("c1", "hi", "2025-01-02T00:00:00Z", who("you")), event("c2", "own", "2025-01-02T00:00:00Z", who("me")), event("c3", "bot", "2025-01-02T00:00:00Z", who("x[bot]")), event("c4", "at merge", "2025-01-03T00:00:00Z", who("you")), event(None, "late", "2025-03-01T00:00:00Z", who("you"))],
        [{"comments": [event("i1", " ", "2025-01-02T00:00:00Z", who("you"))]}],
        [review("r1", "APPROVED", "", "2025-01-01T10:00:00Z", "2025-01-02T00:00:00Z", who("you")), review("r2", "PENDING", "x", "2025-01-02T00:00:00Z", None, who("you"))],
    )
    got = events.discussion_features(spark.createDataFrame([doc, ("q", "2025-01-01T00:00:00Z", None, None, None, None, None)], DOCUMENT)).orderBy("id").collect()
    assert got[0].asDict() == {"id": "p", "ext_text_30d": 3, "ext_text_premerge_all": 2, "ext_text_premerge_30d": 2, "ext_text_postmerge_30d": 1, "ext_review_all": 1, "ext_review_premerge": 1, "ext_approval_premerge": 1, "ext_approval_empty_premerge": 1, "premerge_external_evidence": True}
    assert got[1]["ext_text_30d"] == 0 and got[1]["premerge_external_evidence"] is False


def test_annotations_must_be_one_to_one(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    with pytest.raises(ValueError, match="right repeats"):
        labels.annotate(df, spark.createDataFrame([(1, "a"), (1, "b")], "id int, l string"), "id")
    assert labels.annotate(df, spark.createDataFrame([(1, "a")], "id int, l string"), "id").count() == 2


def test_json_lines_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"id": 1, "t": "a b"}\n\nnot json\n[1]\n{"id": 2}\n')
    good, bad = files.read_json_lines(spark, str(tmp_path / "in"), "id int, t string")
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and bad.count() == 3
    with pytest.raises(ValueError):
        files.require_clean(bad)
    out = str(tmp_path / "out")
    files.export_ordered(good.select("id"), out, ["id"])
    assert [r["id"] for r in spark.read.schema("id int").json(out).collect()] == [1, 2]
    before = files.manifest(spark, str(tmp_path / "in"))
    assert before.first()["bytes"] > 0 and files.unchanged(before, files.manifest(spark, str(tmp_path / "in")), ["file", "sha256"])
    assert files.content_fingerprint(spark, str(tmp_path / "in")).first()["lines"] == 5
    files.write_csv(good.select("id"), str(tmp_path / "csv"), quote_all=True, gzip=True)
    assert files.read_csv(spark, str(tmp_path / "csv"), "id int").count() == 2
    files.land(good.select("id"), str(tmp_path / "pq"), 2)
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_latest_label_wins(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"status":"ok","request_id":"a","labeled_at":"1","v":1}\nbad\n{"status":"error","request_id":"a","labeled_at":"3","v":9}\n{"status":"ok","request_id":"a","labeled_at":"2","v":2}\n')
    got = files.latest_labels(spark, str(tmp_path), "status string, request_id string, labeled_at string, v int").collect()
    assert [r["v"] for r in got] == [2]


def test_pending_stream_is_incremental(spark, tmp_path):
    schema = "request_id string, input_hash string"
    spark.createDataFrame([("a", "1")], schema).write.parquet(str(tmp_path / "done"))
    source = tmp_path / "in"
    spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], schema).coalesce(1).write.json(str(source))
    stream = incremental.request_stream(spark, str(source), schema)
    incremental.append_pending(stream, str(tmp_path / "done"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "out")).select("request_id", "input_hash").collect()) == [("a", "2"), ("b", "1")]


def test_quality_reports(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (3, 2.0)], "k int, v double")
    assert sorted(r["k"] for r in quality.table_diff(a, b, ["k"], ["v"]).collect()) == [2, 3]
    assert quality.unique(a.union(a), ["k"]).first()["violations"] == 2
    assert quality.pinned(spark.createDataFrame([("seed", "1")], "name string, value string"), {"seed": "2", "x": "1"}) == {"seed": ("1", "2")}
