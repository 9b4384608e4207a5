"""Suffix-array dedup: against a table of all strings of 50 bytes, on awkward rows."""

import hashlib
import random

import pytest

from changelens.llm import suffix_dedup as sd


def texts(draw):
    letters = "abcd é\n"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    passages = [word(n) for n in (20, 40, 49, 50, 51, 60, 90, 200, 1000)] + ["a" * 300, "ab" * 100, "-" * 49, "x" * 50]
    rows = []
    for i in range(80):
        parts = [draw.choice(passages)[draw.choice([0, 0, 1, 7]) :] if draw.random() < 0.6 else word(draw.choice([1, 5, 30, 80])) for _ in range(draw.randrange(6))]
        rows.append((i * 3, "".join(parts)))
    rows += [(900 + i, t) for i, (_, t) in enumerate(rows[::7])]  # exact copies
    for i, (_, t) in enumerate(rows[:40:4]):  # near copies
        if t:
            k = draw.randrange(len(t))
            rows.append((1000 - i, t[:k] + "Q" + t[k + 1 :]))
    draw.shuffle(rows)
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x", b"") for d, t in rows], "doc_id long, text string, done0 int, open1 string, kept binary")
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in sd.remove_repeats(df.repartition(5)).collect())


def brute(rows):
    return sorted(sd.plain_removed([(d, (t or "").encode()) for d, t in rows]))


@pytest.mark.parametrize(("seed", "flush"), [(1, 8 << 20), (2, 300)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, flush):
    rows = texts(random.Random(seed))
    inner = sd._entries

    def entries(found, bits, final):
        run = inner(found, bits, final)

        def smaller(batches):  # in the task's process
            from changelens.llm import suffix_dedup

            usual, suffix_dedup.FLUSH = suffix_dedup.FLUSH, flush
            try:
                yield from run(batches)
            finally:
                suffix_dedup.FLUSH = usual

        return smaller

    monkeypatch.setattr(sd, "_entries", entries)
    assert result(spark, rows) == brute(rows)


def test_texts_of_several_pieces(spark):
    draw = random.Random(12)
    base = "".join(draw.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, base), (2, "xyz" + base[1000:]), (3, base[:300_000] + "noise" * 3 + base[300_000:]), (4, "q" * 700_000), (5, "r" + "q" * 600_000)]
    assert result(spark, rows) == brute(rows)


def test_runs_do_not_hang_on_what_stands_around():
    draw = random.Random(5)
    import numpy as np

    core = bytes(draw.randrange(97, 100) for _ in range(400))
    seen = []
    for before, after in ((b"", b""), (b"zzz", b"yy"), (b"q" * 77, b"p" * 90)):
        data = np.frombuffer(before + core + after, np.uint8)
        r = sd.Runs(data, np.array([0, len(data)]))
        gram = {}
        for f, t, g in zip(r.first.tolist(), r.last.tolist(), r.gram.tolist()):
            gram |= {i: g - i for i in range(f, t + 1)}
        seen.append([gram[len(before) + i] for i in range(len(core) - sd.LENGTH + 1)])
        assert sorted(gram) == list(range(len(data) - sd.LENGTH + 1))
    assert seen[0] == seen[1] == seen[2]


def test_awkward_rows(spark):
    long = "One sentence that is surely longer than fifty bytes, é included, stands here. "
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, "x" + long), (4, long), (None, long), (None, None), (7, long * 3000), (6, "y" * 49), (8, "y" * 49), (9, "y" * 50), (10, "y" * 51), (-5, "end " + long)]
    named = [r for r in rows if r[0] is not None]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.remove_repeats(found).collect()
    mine = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got if r["doc_id"] is not None)
    assert mine == brute(named)
    assert sorted((r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got if r["doc_id"] is None) == [(0, 0, b""), (len(long.encode()), 0, long.encode())]
    assert sd.remove_repeats(found.limit(0)).collect() == []
