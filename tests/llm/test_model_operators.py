"""Neighbours, packing, language, mixing, quality: recall, exact round trips, held-out accuracy, awkward rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from changelens.llm import ann, langid, mixing, packing, quality, queries

SF = "/root/testdata/sf0.01"


def brute(rows, q_id, q, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q_id][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_nearest_reaches_its_recall(spark):
    found = queries.op3_nearest(spark, SF).collect()
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    of = {}
    for r in found:
        of.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q_id, q in rows:
        if q_id % 100 == 0:
            want = brute(rows, q_id, q)
            got = sorted(of[q_id], key=lambda r: r["rank"])
            assert [r["rank"] for r in got] == list(range(1, 11))
            true = dict(brute(rows, q_id, q, len(rows)))
            assert all(abs(true[r["vec_id"]] - r["score"]) < 1e-9 for r in got)
            hits += len({v for v, _ in want} & {r["vec_id"] for r in got})
            total += len(want)
    assert hits / total >= 0.9


def test_nearest_with_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5000)] + [(5000 + i, [float(i), 1.0]) for i in range(50)]
    rows += [(6000, None), (6001, [0.0, 0.0]), (6002, [float("nan"), 1.0]), (6003, [None, 1.0]), (6004, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, leaf int")
    found = ann.nearest(df, df.where("vec_id in (0, 4999, 6000, 6001, 6002, 5049)"), sample_rows=600).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == {0, 4999, 5049}
    assert by[0] == [(i, 0.0) for i in range(1, 11)] and by[4999] == [(i, 0.0) for i in range(10)]
    few = df.where("vec_id in (5000, 5001, 5002)")
    assert len(ann.nearest(few, few.where("vec_id = 5001")).collect()) == 2
    assert ann.nearest(df.limit(0), df).collect() == []


def test_nearest_in_small_blocks_of_rows_and_queries(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(900, 6)) + draw.integers(0, 4, size=(900, 1)) * 3
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(x, 2))]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, block int, side int, blocks string")
    queries_ = df.where("vec_id % 3 = 0")
    want = sorted(map(tuple, ann.nearest(df, queries_, sample_rows=300).collect()))
    got = sorted(map(tuple, ann.nearest(df, queries_, sample_rows=300, block_rows=40, block_queries=7).collect()))
    assert got == want and len(got) == 3000
    found = {(q, v) for q, _, v, _ in got}
    true = {(i, v) for i, q in rows if i % 3 == 0 for v, _ in brute([(n, np.array(r)) for n, r in rows], i, np.array(q))}
    assert len(found & true) >= 0.9 * len(true)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "it's we've 'll\n\n x  y", "a" * 3000, "naïve 日本 😀 <|endoftext|>", "hello<|endoftext|>world<|endof", "text|>", "<|endoftext|> <|endoftext|>"] + [f"line {i} of words " * (i % 700) for i in range(0, 2000, 13)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "doc_id long, text string, length int")
    packed = packing.pack(df, with_ids=True)
    rows = packed.collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 2048
    for i, t in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: (r["piece"], r["sequence_id"]))
        own = own[::2] if i == 3 else own
        ids = [x for r in own for x in r["ids"]]
        assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        assert all(r["length"] == 2048 for r in own[1:])
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048
    assert len(used) <= 1.02 * sum(used.values()) / 2048 + 1
    assert {len(r["ids"]) for r in packing.sequences(packed).collect()} == set(used.values())
    assert packing.pack(df.limit(0)).collect() == []


def test_patterns_use_up_all_lengths():
    draw = np.random.default_rng(4)
    for _ in range(20):
        counts = {int(x): int(n) for x, n in zip(draw.integers(1, 2049, 40), draw.integers(1, 50, 40), strict=True)}
        used = {}
        for lengths, times in packing.pack_lengths(counts):
            assert sum(lengths) <= 2048 and times > 0
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts


def test_languages_on_held_out_rows(spark):
    found = queries.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert right[0] > 0.97 and right[1] > 150
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_of_awkward_rows(spark):
    known = [(i, "the of and that with from this thing" if i % 2 else "der die das und nicht ein mit auch", "en" if i % 2 else "de") for i in range(40)]
    odd = [(100, None, None), (101, "", "en"), (102, "123 !?", "de"), (103, "é", None), (104, "und " * 50_000, None)]
    df = spark.createDataFrame([(*r, 1) for r in known + odd], "doc_id long, text string, lang string, score int")
    model = langid.fit(df, F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[104]["lang_pred"] == "de" and got[103]["lang_pred"] in ("en", "de")
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df.limit(0), F.lit(True))).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).collect() == []


def test_raking_meets_the_margins(spark):
    draw = np.random.default_rng(0)
    codes = np.array([(a, b, c) for a in range(5) for b in range(3) for c in range(2)])
    targets = [draw.dirichlet(np.ones(n)) for n in (5, 3, 2)]
    weight = mixing.rake(draw.random(len(codes)) + 0.1, codes, targets)
    for j, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, j], weight), t, atol=1e-6)
    tokens = draw.random(len(codes)) * 100
    chance = mixing.chances(tokens, weight, 0.4 * tokens.sum())
    assert chance.max() <= 1 and abs((chance * tokens).sum() - 0.4 * tokens.sum()) < 1e-6 * tokens.sum()


def test_mixture_moves_to_its_targets(spark):
    rows = [(i, "word " * 20, ["en", "de", None][i % 3], "hot" if i % 4 else f"s{i % 40}", 1.0) for i in range(4000)] + [(9001, None, None, None, 1.0), (9002, "", "en", "hot", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight double")
    found = mixing.mix(df, keep_share=0.3, targets={"lang": {"en": 0.2, "de": 0.6, mixing.NONE: 0.2}}, powers={"source": 1.0}).toPandas()
    assert len(found) == len(rows) and found[found.doc_id.isin([9001, 9002])].sampled.all()
    kept = found[found.sampled]
    assert abs(kept.n_tokens.sum() / found.n_tokens.sum() - 0.3) < 0.04
    assert abs(kept[kept.lang == "de"].n_tokens.sum() / kept.n_tokens.sum() - 0.6) < 0.05
    assert mixing.mix(df.limit(0)).collect() == []


def test_many_cells_are_raked_to_the_same_chances(spark):
    rows = [(i, "word " * (i % 7), ["en", "de", None][i % 3], f"s{i % 11}" if i % 4 else "hot") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for options in ({"keep_share": 0.3, "targets": {"lang": {"en": 0.3, "de": 0.7}}}, {"keep_share": 1.0}):
        here, there = ({r["doc_id"]: r for r in mixing.mix(df, most_cells=n, **options).collect()} for n in (10**6, 0))
        assert here.keys() == there.keys()
        for i, r in here.items():
            assert abs(r["weight"] - there[i]["weight"]) < 1e-7 and abs(r["chance"] - there[i]["chance"]) < 1e-6, (r, there[i])
    assert mixing.mix(df.limit(0), most_cells=-1).collect() == []


def test_mixture_keeps_columns_and_takes_null_topics(spark):
    rows = [(i, "word " * (i % 9), "en", "s", None if i % 3 else "t", "own", 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, t string, _mix string, _weight double")
    decided = mixing.decide(df, topic=F.col("t"))
    assert decided.columns[:-1] == df.columns
    found = decided.select("*", f"{decided.columns[-1]}.*").collect()
    assert len(found) == 60 and {(r["_mix"], r["_weight"]) for r in found} == {("own", 2.0)} and {r["topic"] for r in found} == {"t", mixing.NONE}


def test_quality_on_held_out_rows(spark):
    found = queries.op7_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")), F.count("quality")).first()
    assert right[0] > 0.95 and right[1] > 80


def test_quality_of_awkward_rows(spark):
    texts = [None, "", "\n" * 1000, "word " * 100_000, "a"] + ["some plain words in a row."] * 20 + ["!!! ### $$$"] * 20
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, x int")
    labels = spark.createDataFrame([(i, 1 if i < 25 else 0) for i in range(5, 45)] + [(7, None), (8, 5), (None, 1), (9, 1)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found.values())
    assert found[0]["score"] == found[1]["score"] and found[10]["predicted"] == 1 and found[30]["predicted"] == 0
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), labels).collect() == []
