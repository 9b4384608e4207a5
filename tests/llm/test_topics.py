"""Learned topics: planted subjects are told apart inside languages; assignments equal plain loops; awkward rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from changelens.llm import mixing, textkit, topics


def planted(draw, n=240):
    """(id, text, lang, subject): common words of the language and a few words of the subject."""
    rows = []
    for i in range(n):
        lang, subject = draw.choice(["en", "de"]), draw.choice(["sea", "law", "food"])
        words = [f"{lang}{draw.randrange(40)}" for _ in range(60)] + [f"{lang}_{subject}{draw.randrange(25)}" for _ in range(40)]
        draw.shuffle(words)
        rows.append((i, " ".join(words).title() if i % 3 else "\n".join(words), lang, subject))
    return rows


def bucket(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(textkit.range_hashes(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(32)) % topics.BUCKETS


def plain_topic(model, text, lang):
    counts = Counter(bucket(w) for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split())
    if not counts:
        return topics.NO_WORDS
    weights = {b: round(topics.STEP * math.log(1 + n)) for b, n in counts.items()}
    size = math.sqrt(sum(w * w * int(model.squares[b]) for b, w in weights.items()) / topics.GRID)
    offsets = model.offsets.get(lang, model.offsets[None])
    scores = [sum(w * int(model.dots[b, k]) for b, w in weights.items()) / topics.GRID / size - o for k, o in enumerate(offsets)]
    return f"topic_{scores.index(max(scores))}"


def test_planted_subjects_are_found_within_languages(spark):
    rows = planted(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, subject string")
    model = topics.fit(df, topics=3)
    found = df.select("doc_id", topics.topic(model, F.col("text"), F.col("lang")).alias("topic")).collect()
    topic_of = {r["doc_id"]: r["topic"] for r in found}
    assert topic_of == {i: plain_topic(model, text, lang) for i, text, lang, _ in rows}
    groups = defaultdict(Counter)
    for i, _, lang, subject in rows:
        groups[lang, topic_of[i]][subject] += 1
    assert sum(max(c.values()) for c in groups.values()) >= 0.9 * len(rows)
    assert all(len({t for g, t in groups if g == lang}) == 3 for lang in ("en", "de"))


def test_topics_do_not_depend_on_partitions_or_order(spark):
    rows = [*planted(random.Random(4), 60), (900, "word " * 60_000, "en", ""), (901, "word " * 60_000, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, subject string")
    one, two = (topics.fit(d, sample_rows=50) for d in (df.coalesce(1), df.orderBy(F.desc("doc_id")).repartition(7)))
    assert np.array_equal(one.dots, two.dots) and np.array_equal(one.squares, two.squares)
    a, b = ({r[0]: r[1] for r in d.select("doc_id", topics.topic(one, F.col("text"), F.col("lang"))).collect()} for d in (df.coalesce(1), df.repartition(9)))
    assert a == b == {i: plain_topic(one, text, lang) for i, text, lang, _ in rows}


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, topic string"
    rows = [(1, None, None, None, "own"), (2, "", "en", "a", "own"), (3, " \t\n", "en", "a", None), (4, "one two", None, None, "own"), (4, "one two", None, None, "own"), (None, "three", "de", "b", "own")]
    df = spark.createDataFrame(rows, schema)
    found = mixing.mix(df).collect()
    assert len(found) == 6 and {r["topic"] for r in found if r["doc_id"] in (1, 2, 3)} == {topics.NO_WORDS}
    assert all(r["topic"].startswith("topic_") for r in found if r["doc_id"] not in (1, 2, 3))
    assert mixing.mix(df.limit(0)).collect() == []
    assert topics.fit(df.where("text is null")).dots.shape == (topics.BUCKETS, 1)


def test_every_text_is_in_the_fit(spark):
    rows = [(i, f"own{i} common", "en") for i in range(5000)]
    model = topics.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), topics=2)
    with_word = Counter(b for i in range(5000) for b in {bucket(f"own{i}"), bucket("common")})
    want = [round(topics.GRID * (math.log(5001 / (1 + with_word[b])) + 1e-6) ** 2) for b in range(topics.BUCKETS)]
    assert np.abs(model.squares - want).max() <= 1


def test_entries_of_texts_survive_packing_and_slices():
    texts = ["", "One two one", "\t", "three  four é", ""]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    ends, entries, words = topics.word_weights(data, offsets)
    packed = topics._binary(ends, entries)
    for first in range(len(texts)):
        row, at, value = topics._entries(packed.slice(first))
        found = sorted(zip(row.tolist(), at.tolist(), value.tolist(), strict=True))
        want = [(k, bucket(w), round(topics.STEP * math.log(1 + n))) for k, t in enumerate(texts[first:]) for w, n in Counter(t.lower().split()).items()]
        assert found == sorted(want)
    assert words.tolist() == [0, 3, 0, 3, 0]


def test_words_are_counted_where_topics_are_given(spark):
    rows = [(None,), ("",), (" \t\n",), ("a",), ("a b c   d\x0b\x0ce\x00f\n",), ("word " * 60_000,)]
    df = spark.createDataFrame(rows, "text string").withColumn("lang", F.lit("en"))
    model = topics.fit(df, topics=2)
    found = df.select(topics.topic_and_words(model, F.col("text"), F.col("lang"))["n_words"].alias("n"), mixing.token_count(F.col("text")).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in found) and sorted(r["n"] for r in found) == [0, 0, 0, 1, 5, 60_000]
