"""N-gram join, line dedup and the pipeline: against brute force, on awkward rows and large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changelens.llm import line_dedup, ngram_join
from changelens.llm.groups import connected_components


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(sets):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_texts(draw):
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    texts = [None, "", " \t", "one", "ONE", "one two", "one two three four", "One two three Four five", "one two three four five six"]
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([6, 8, 12, 40, 120, 300]))] + (passage if draw.random() < 0.6 else [])
        texts.append(" ".join(base))
        for _ in range(draw.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy) if draw.random() < 0.8 else "\n".join(copy).upper())
    texts += [" ".join(["the"] * n) for n in (3, 5, 9, 50)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    texts = near_texts(random.Random(seed))
    df = spark.createDataFrame([(1000 - i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component int")
    found = {r["doc_id"]: r for r in ngram_join.similar_groups(df).collect()}
    sets = {1000 - i: shingles(t) for i, t in enumerate(texts)}
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in found.items()} == components(sets)


def test_join_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q " * 40_000)], "doc_id long, text string")
    rows = ngram_join.similar_groups(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (None, 2, None)]
    assert ngram_join.similar_groups(df.limit(0)).collect() == []


def test_join_of_repeated_ids(spark):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "one two three four five six seven"
    df = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (7, c), (7, None), (8, c), (9, "alone here with five words more")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df).collect())
    assert rows == [(1, 4, 1), (2, 4, 1), (5, 4, 1), (5, 4, 1), (7, 0, 7), (7, 3, 7), (8, 3, 7), (9, 2, 9)]
    apart = spark.createDataFrame([(1, a), (5, a), (5, b), (6, b + " y"), (6, c), (8, c)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.similar_groups(apart).collect()} == {(i, 1) for i in (1, 5, 6, 8)}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.6, 0.74, 0.8])
def test_join_of_two_texts(spark, share):
    own = [f"w{i}" for i in range(200)]
    texts = [" ".join(own), " ".join(own[: int(200 * share)] + [f"x{i}" for i in range(200 - int(200 * share))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(df).collect()} == components(dict(enumerate(map(shingles, texts))))


def test_join_of_many_overlapping_texts(spark):
    draw = random.Random(11)
    own = [[f"w{draw.randrange(5000)}" for _ in range(draw.choice([9, 30, 200, 600]))] for _ in range(6)]
    texts = []
    for base in own:
        for _ in range(12):
            keep = int(len(base) * draw.uniform(0.3, 1.0))
            texts.append(" ".join(base[:keep] + [f"v{draw.randrange(5000)}" for _ in range(len(base) - keep)]))
        texts += [" ".join(base)] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(df).collect()} == components(dict(enumerate(map(shingles, texts))))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 200)] + [(900, 900)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[500 + i] == 500 for i in range(200)) and 900 not in found


LINE = "The quick brown fox jumps over the lazy dog near the river bank today {}"


def line_groups(texts):
    """By brute force over all pairs: of every document (index) the numbers of its lines that go."""
    places = [(i, k, " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in x).split(" "))) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    places = [(i, k, " ".join(x.split())) for i, k, x in places if x.split()]
    parent = list(range(len(places)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j, (_, _, y) in enumerate(places):
        for i, (_, _, x) in enumerate(places[:j]):
            if x == y or min(len(x), len(y)) >= 20 and near(x, y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    gone = {i: [] for i in range(len(texts))}
    for j, (i, k, _) in enumerate(places):
        if root(j) != j:
            gone[i].append(k)
    return gone


def test_lines_against_brute_force(spark):
    texts = [None, "", "\n\n", LINE.format("x"), "own start\n" + LINE.format("x") + "\nshort", LINE.format("x").upper(), "short\nshort", LINE.format("y").replace("quick", "quack"), "A line that nobody else has in any document at all."]
    texts += [f"Unrelated sentence {c * 9} about {c * 7} and {c * 5} only" for c in "abcdefgh"] + [LINE.format("abcdefg"[i % 7]) for i in range(100)]
    texts += [f"Row {i} of the table costs {i * 7}.50 and not more than that" for i in range(30)] + ["A line  that nobody else has in any\tdocument at all.\n \n\nend\r\nend"]
    df = spark.createDataFrame([(i, t, 1, "own", 7) for i, t in enumerate(texts)] + [(None, LINE.format(1), 1, "own", 7)], "doc_id long, text string, lines int, _hit string, _slot int")
    result = line_dedup.dedup_lines(df)
    assert result.columns == [*df.columns, "n_lines", "n_removed"]
    found = {r["doc_id"]: r for r in result.collect()}
    assert len(found) == len(texts) + 1 and found[None]["text"] == LINE.format(1) and found[0]["text"] is None
    for i, lines in line_groups(texts).items():
        if texts[i] is not None:
            own = texts[i].split("\n")
            assert found[i]["text"] == "\n".join(x for k, x in enumerate(own) if k not in lines), i
            assert (found[i]["n_lines"], found[i]["n_removed"], found[i]["_hit"], found[i]["_slot"]) == (len(own), len(lines), "own", 7)
    assert found[4]["text"] == "own start\nshort" and found[6]["text"] == "" and found[7]["n_removed"] == 1
    assert sum(found[i]["n_removed"] for i in range(117, 147)) == 0  # lines that differ in numbers stay
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_edit_distance_equals_the_table():
    draw = random.Random(6)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
        return row[-1]

    for _ in range(2000):
        x, y = ("".join(draw.choice("abé") for _ in range(draw.randint(0, 12))) for _ in range(2))
        assert [line_dedup.edits_within(x, y, k) for k in range(14)] == [distance(x, y) <= k for k in range(14)]


def edited(draw, line, edits):
    for _ in range(edits):
        at, c = draw.randrange(len(line)), draw.choice("abcé xyz")
        line = draw.choice((line[:at] + c + line[at:], line[:at] + line[at + 1 :], line[:at] + c + line[at + 1 :]))
    return " ".join(line.split())


def near(x, y):
    digits = ["".join(c for c in t if c in "0123456789") for t in (x, y)]
    return digits[0] == digits[1] and line_dedup.edits_within(x, y, max(len(x), len(y)) // 10)


def blocks_of(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    b, starts, ends, rows = line_dedup.normalised_lines(data, offsets)
    line, key, _ = line_dedup.block_keys(b, starts, ends)
    found = [set() for _ in texts]
    for i, k in zip(line.tolist(), key.tolist(), strict=True):
        found[rows[i]].add(k)
    return found


@pytest.mark.parametrize(("words", "share", "least"), [(n, 0, 0.96) for n in (5, 8, 12, 20, 40, 80)] + [(n, 5, 0.96) for n in (8, 12, 20, 40, 80)] + [(n, 8, 0.8) for n in (8, 12, 20, 40, 80)])
def test_similar_lines_share_a_block(words, share, least):
    """One edit (share 0), or that percentage of all code points scattered over the line."""
    draw = random.Random(words)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    xs = [" ".join(draw.choice(vocabulary) for _ in range(words)) for _ in range(300)]
    ys = [edited(draw, x, max(1, len(x) * share // 100)) for x in xs]
    blocks = blocks_of(xs + ys)
    pairs = [i for i, (x, y) in enumerate(zip(xs, ys, strict=True)) if x != y and near(x, y)]
    assert len(pairs) > 250
    assert sum(bool(blocks[i] & blocks[300 + i]) for i in pairs) >= least * len(pairs)


def test_halves_of_lines_that_differ_in_one_word_share_a_block():
    draw = random.Random(4)
    for n in range(2, 60):
        own = [f"w{draw.choice('abcdefgh')}{''.join(draw.choice('ijklmnop') for _ in range(4))}" for _ in range(n)]
        at = draw.randrange(n)
        for other in (own[:at] + own[at + 1 :], own[:at] + ["new"] + own[at + 1 :], own[:at] + ["new"] + own[at:]):
            if n > 2 or len(other) > 1:
                x, y = blocks_of([" ".join(own), " ".join(other)])
                assert x & y, (own, other)


def test_lines_without_blanks_share_a_block():
    draw = random.Random(5)
    xs = ["".join(chr(0x4E00 + draw.randrange(2000)) for _ in range(60)) for _ in range(100)] + ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)) for _ in range(100)]
    ys = [x[:k] + "z" + x[k + 1 :] for x in xs for k in [draw.randrange(len(x))]]
    blocks = blocks_of(xs + ys)
    assert sum(bool(blocks[i] & blocks[200 + i]) for i in range(200)) >= 190


def test_pair_filter_loses_nothing():
    draw = random.Random(9)
    xs = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(20, 300))) for _ in range(400)]
    ys = [edited(draw, x, draw.randint(0, len(x) // 6)) for x in xs]
    most = np.array([max(len(x), len(y)) // 10 for x, y in zip(xs, ys, strict=True)])
    maybe = line_dedup.may_be_similar(xs, ys, most)
    assert all(p for x, y, k, p in zip(xs, ys, most, maybe, strict=True) if line_dedup.edits_within(x, y, int(k)))
    assert not line_dedup.may_be_similar(xs[:-1], xs[1:], most[:-1]).all()


def test_edited_lines_against_brute_force(spark):
    draw = random.Random(10)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    lines = []
    for n in (4, 5, 6, 8, 10, 12, 16, 20, 35, 50) * 6:
        own = [draw.choice(words) for _ in range(n)]
        line, other = " ".join(own), list(own)
        other[draw.randrange(n)] = draw.choice(words)
        lines += [line, " ".join(other), edited(draw, line, 2), edited(draw, line, max(1, len(line) * 7 // 100))]
    lines = list(dict.fromkeys(lines))
    lost = {i for i, gone in line_groups(lines).items() if gone}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r["doc_id"] for r in line_dedup.dedup_lines(df).collect() if r["n_removed"]}
    assert len(lost) > 100 and found <= lost
    assert len(found) >= 0.95 * len(lost)


def test_one_letter_edits_are_found(spark):
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    lines = [" ".join(draw.choice(words) for _ in range(14)) for _ in range(300)]
    copies = [x[:k] + ("q" if x[k] != "q" else "z") + x[k + 1 :] for x in lines for k in [draw.randrange(len(x))]]
    df = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    assert line_dedup.dedup_lines(df).agg(F.sum("n_removed")).first()[0] >= 295


def test_lines_of_a_very_long_text_and_repeated_ids(spark):
    long = "\n".join(f"{'abcdefghij'[i % 10] * (20 + i % 13)} {'klmnopqrst'[i // 10 % 10] * 30}" for i in range(20_000)) + "\n" + "word " * 40_000
    df = spark.createDataFrame([(1, long), (1, "only once here\nand this"), (2, "word " * 40_000)], "doc_id long, text string")
    found = line_dedup.dedup_lines(df).collect()
    kept = max(len(r["text"]) for r in found)
    assert {r["text"] for r in found if r["doc_id"] == 2} == {""} and kept < len(long) // 2 and len(found) == 3


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in corpus_pipeline.table(spark, sf_dir, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality":
            assert sum(labels.get(i) == 1 for i in before) - sum(labels.get(i) == 1 for i in after) <= 1
            assert sum(labels.get(i) == 0 for i in after) <= 1
        if name == "ngram_join":
            group = components({i: shingles(r["text"]) for i, r in before.items()})
            assert set(after) == {i for i in before if group[i] == i}
        if name == "mixing":
            assert 0.2 < len(after) / len(before) < 0.9
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(before)


def test_pipeline_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("doc_id")).first()[0] == 0


def test_near_copy_stage_keeps_unlinked_texts_and_rows_without_id(spark):
    copied, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, copied), (5, copied + " end"), (5, other), (5, other), (7, "x y"), (7, None), (7, ""), (8, third), (8, third + " end"), (9, other + " end"), (3, third)]
    rows += [(None, copied), (None, copied), (None, "own")] + [(100 + i, f"only {i}") for i in range(50)]
    docs = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, n_chars long")
    found = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert found.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in found.collect()]
    want = [(1, copied), (5, other), (7, "x y"), (7, None), (7, ""), (3, third), *rows[11:]]
    assert sorted(got, key=str) == sorted(want, key=str)
