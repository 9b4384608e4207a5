"""Keys of the n-gram join: rows that no member of their key can link with are dropped before keys are compared."""

from pyspark.sql import functions as F

from changelens.llm import groups


def test_key_rows_without_a_possible_partner_go_no_further(spark):
    rows = [("late", 1, 100, 40, True), ("late", 2, 100, 40, True), ("early", 1, 100, 2, True), ("early", 2, 100, 3, True), ("small", 3, 100, 24, True), ("small", 4, 76, 0, True), ("alone", 5, 9, 0, True), ("unled", 6, 9, 0, False), ("unled", 7, 9, 0, False)]
    df = spark.createDataFrame(rows, "key string, id long, size int, at int, leads boolean").withColumn("rank", F.lit(0))
    possible = lambda size, at, least: (size - at) * 7 >= (size + F.greatest(least, F.ceil(size * 3 / 4))) * 3
    found = groups.shared_keys(df, possible).select("key", "id").collect()
    assert sorted(map(tuple, found)) == [("early", 1), ("early", 2), ("small", 3), ("small", 4)]
