"""Ranks, exact quantiles and matching: against plain Python, with ties, nulls and many conflicts."""

import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.operators import matching, ordering


def test_numbered_equals_sorting(spark):
    draw = random.Random(1)
    rows = [(draw.choice([1, 1, 2, None, 7]), i) for i in range(500)]
    found = ordering.numbered(spark.createDataFrame(rows, "v int, id int").repartition(7), [F.desc_nulls_last("v"), "id"])
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["v"], r["id"]) for r in sorted(found.collect(), key=lambda r: r["ix"])] == want
    assert sorted(r["ix"] for r in found.collect()) == list(range(500))
    assert ordering.numbered(found.limit(0).drop("ix"), ["v"]).collect() == []


def test_no_task_of_ranks_sees_all_rows(spark):
    found = ordering.numbered(spark.range(1000).withColumnRenamed("id", "v"), ["v"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the only window is over the counts of partitions
    assert plan.count("Window") == 1 and plan.split("Window")[1].startswith(" [sum(_n")


@pytest.mark.parametrize("ranges", [128, 3])
def test_quantiles_equal_numpy(spark, monkeypatch, ranges):
    monkeypatch.setattr(ordering, "RANGES", ranges)
    draw = random.Random(ranges)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, 2]), draw.choice([None, 0, 0, 5, draw.randrange(1000), draw.random() * 10]), draw.randrange(10**15, 10**15 + 50)) for _ in range(700)]
    rows += [("only nulls", 3, None, 1)]
    df = spark.createDataFrame([(g, k, None if x is None else float(x), y) for g, k, x, y in rows], "g string, k int, x double, y long")
    wanted = {"x": {"x0": 0.0, "x25": 0.25, "x50": 0.5, "x99": 0.99, "x1": 1.0}, "y": {"y90": 0.9}}
    sets = [[], ["g"], ["g", "k"]]
    found = {(r["_set"], r["g"], r["k"]): r for r in ordering.quantiles(df, sets, wanted).collect()}
    groups = {(0, None, None)} | {(1, g, None) for g, *_ in rows} | {(2, g, k) for g, k, *_ in rows}
    assert set(found) == groups
    for (i, g, k), r in found.items():
        own = [x for x in rows if (i < 1 or x[0] == g) and (i < 2 or x[1] == k)]
        for column, at in (("x", 2), ("y", 3)):
            values = [x[at] for x in own if x[at] is not None]
            for name, q in wanted[column].items():
                assert (r[name] is None) == (not values)
                if values:
                    assert r[name] == pytest.approx(float(np.quantile(np.array(values, float), q)), rel=1e-12, abs=1e-12)


def greedy(anchors, pool):
    used, out = set(), {}
    for name, language, rank, created, size, topics in sorted(anchors, key=lambda a: (a[2], a[0])):
        near = []
        for other, other_language, _, day, other_size, other_topics in pool:
            if other in used or None in (language, other_language, created, day, size, other_size) or language != other_language:
                continue
            a, b = set(topics or ()), set(other_topics or ())
            score = abs((day - created).days) / 365.25 + abs(math.log1p(other_size) - math.log1p(size)) + 2 * (1 - len(a & b) / max(1, len(a | b)))
            near.append((round(score, 6), other))
        if near:
            used.add(min(near)[1])
            out[name] = min(near)[::-1]
    return out


@pytest.mark.parametrize(("seed", "batch"), [(1, 32), (2, 2), (3, 1)])
def test_controls_equal_the_walk(spark, seed, batch):
    draw = random.Random(seed)

    def project(i, kind):
        crowd = draw.random() < 0.5
        day = datetime.date(2015, 1, 1) + datetime.timedelta(days=0 if crowd else draw.randrange(9000))
        row = [f"{kind}{i}", draw.choice(["x", "x", "y", None]), draw.randrange(8), day, 10.0 if crowd else float(draw.choice([0, 10, 10**6, 10**12])), draw.choice([None, [], ["t"], ["t", "u"]])]
        if draw.random() < 0.05:
            row[draw.choice([3, 4])] = None
        return tuple(row)

    anchors, pool = [project(i, "a") for i in range(14)], [project(i, "c") for i in range(18)]
    schema = "name string, language string, rank int, created date, size double, topics array<string>"
    found = matching.match_controls(spark.createDataFrame(anchors, schema), spark.createDataFrame(pool, schema), batch=batch).collect()
    assert {r["anchor"]: (r["control"], r["score"]) for r in found} == greedy(anchors, pool)
    assert matching.match_controls(spark.createDataFrame([], schema), spark.createDataFrame(pool, schema)).collect() == []


def test_files_meet_by_change_in_parts_of_bounded_size(spark, sf_dir, monkeypatch):
    from changelens.plans import fixtures

    monkeypatch.setattr(fixtures, "FILES_A_TASK", 500)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    plan = fixtures.changes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt == [max(4, -(-lines // 500))] and dealt[0] > 4
    assert not re.search(r"hashpartitioning\(path#|hashpartitioning\(id#\d+L?, path#", plan), plan


def test_anchors_alike_do_not_take_a_round_each(spark, monkeypatch):
    day = datetime.date(2020, 1, 1)
    anchors = [(f"a{i:03d}", "go", i, day, 10.0 + i % 2, ["x"]) for i in range(60)]
    pool = [(f"c{i:03d}", "go", 0, day + datetime.timedelta(days=i // 40), 10.0, ["x"]) for i in range(100)]
    schema, steps, write = "name string, language string, rank int, created date, size double, topics array<string>", [], matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: steps.append(name) or write(df, name))
    found = matching.match_controls(spark.createDataFrame(anchors, schema), spark.createDataFrame(pool, schema), batch=8).collect()
    assert {r["anchor"]: (r["control"], r["score"]) for r in found} == greedy(anchors, pool) and len(found) == 60
    assert len(steps) < 20
