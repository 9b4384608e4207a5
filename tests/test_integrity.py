"""Ordered checksums, breaks of order, pinned appends, keyed labelling and cell comparison on small files."""

import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from changelens.sources import integrity as g
from changelens.streaming import incremental


def by_hand(lines):
    return functools.reduce(lambda a, x: (a * g.BASE + int(hashlib.md5(x.encode()).hexdigest()[:15], 16)) % g.PRIME, lines, 0)


def write(folder, *files):
    folder.mkdir()
    for i, lines in enumerate(files):
        (folder / f"part-{i:05}.txt").write_bytes("".join(x + "\n" for x in lines).encode())
    return str(folder)


LINES = [f"{i:04} wörd {'x' * (i % 37)}\u0085end" for i in range(300)]


@pytest.mark.parametrize("size", ["1g", "4000", "700"])
def test_checksums_do_not_depend_on_splits(spark, tmp_path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        one, many = write(tmp_path / "one", LINES), write(tmp_path / "many", LINES[:120], [], LINES[120:])
        swapped = [*LINES]
        swapped[10], swapped[11] = swapped[11], swapped[10]
        other = write(tmp_path / "other", swapped)
        of = lambda p: tuple(g.ordered_checksum(spark, p, by_file=False).first()[1:])
        assert of(one) == of(many) == (300, by_hand(LINES)) and of(other) == (300, by_hand(swapped)) != of(one)
        key = lambda v: F.left(v, F.lit(4))
        assert [tuple(g.order_violations(spark, p, key).first()) for p in (one, many, other)] == [(300, 0), (300, 0), (300, 1)]
        each = {r["file"][-9:]: (r["lines"], r["checksum"]) for r in g.ordered_checksum(spark, many).collect()}
        assert each == {"00000.txt": (120, by_hand(LINES[:120])), "00002.txt": (180, by_hand(LINES[120:]))}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_order_breaks_between_files(spark, tmp_path):
    key = lambda v: F.left(v, F.lit(4))
    assert tuple(g.order_violations(spark, write(tmp_path / "a", LINES[100:], LINES[:100]), key).first()) == (300, 1)
    assert tuple(g.order_violations(spark, write(tmp_path / "b", LINES[5:6], LINES[5:6], LINES[4:5]), key).first()) == (3, 1)


def test_joined_checksums():
    draw = random.Random(2)
    for _ in range(50):
        i, j = sorted(draw.choices(range(301), k=2))
        parts = [(len(x), by_hand(x)) for x in (LINES[:i], LINES[i:j], LINES[j:])]
        assert g.joined_checksum(g.joined_checksum(parts[0], parts[1]), parts[2]) == g.joined_checksum(parts[0], g.joined_checksum(parts[1], parts[2])) == (300, by_hand(LINES))


def test_other_parameters_write_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "data"), spark.range(5)
    g.append_pinned(rows, path, {"model": "a", "n": "1"})
    g.append_pinned(rows, path, {"n": "1", "model": "a"})
    for wrong in ({"model": "b", "n": "1"}, {"model": "a"}, {"model": "a", "n": "1", "more": "x"}):
        with pytest.raises(g.ParametersDiffer):
            g.append_pinned(rows, path, wrong)
    assert g.pinned_rows(spark, path).count() == 10


def test_repeats_and_replays_are_labelled_once(spark, tmp_path):
    schema = "request_id string, input_hash string"

    def put(name, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        stream, done = (spark.readStream.schema(schema).parquet(str(tmp_path / n)) for n in ("in", "done"))
        incremental.append_first_seen(stream, str(tmp_path / "out"), str(tmp_path / "cp"), done).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out/batch=*").collect())

    put("done", ("a", "1"))
    put("in", ("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"))
    assert run() == [("a", "2"), ("b", "1")]
    put("in", ("b", "1"), ("a", "1"), ("c", "1"), ("a", "2"))
    assert run() == [("a", "2"), ("b", "1"), ("c", "1")]
    put("done", ("d", "1"))
    put("in", ("d", "1"), ("b", "2"))
    assert run() == [("a", "2"), ("b", "1"), ("b", "2"), ("c", "1")] == run()
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the last batch had failed after its rows were written
    for crc in (tmp_path / "cp" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    assert run() == [("a", "2"), ("b", "1"), ("b", "2"), ("c", "1")]


def test_changed_cells_are_found(spark):
    rows = [(i, i % 7, None if i % 11 == 0 else f"v{i}") for i in range(2000)]
    other = [(i, a + (i == 77), "w" if i == 88 else b) for i, a, b in rows if i != 99] + [(5000, 1, None)]
    schema = "id long, a int, b string"
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    found = {tuple(r) for r in g.changed_cells(left, right, ["id"], ["a", "b"]).collect()}
    assert found == {(77, "a", "0", "1"), (88, "b", None, "w"), (99, "a", "1", None), (99, "b", None, None), (5000, "a", None, "1"), (5000, "b", None, None)}
    assert g.changed_cells(left, left, ["id"], ["a", "b"]).collect() == []


def test_census_documents_become_plain_lists(spark):
    from changelens.sources import files

    schema = "id string, files struct<totalCount:long,pageInfo:struct<hasNextPage:boolean>,nodes:array<struct<path:string>>>"
    rows = [("a", (1, (False,), [("x",)])), ("b", (2, (False,), [("x",)])), ("c", (1, (True,), [("x",)])), ("d", (1, None, [("x",)]))]
    found = files.normalise_census(spark.createDataFrame(rows, schema)).select("id", "files", "collection.truncated").collect()
    assert {r["id"]: r["truncated"]["files"] for r in found} == {"a": False, "b": True, "c": True, "d": True}
    assert all([f["path"] for f in r["files"]] == ["x"] for r in found)
