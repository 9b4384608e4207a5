"""Spelling variants: against all pairs, with lists of any length, on awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from changelens.llm import spelling


def one_apart(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= 10 * counts[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def texts(draw):
    letters = "abcdeéÿÀZ×"
    base = ["".join(draw.choice(letters) for _ in range(draw.choice([7, 8, 8, 9, 12, 30]))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ababababab", "x" * 300]
    words = []
    for w in base:
        words += [w] * draw.choice([2, 2, 40, 400])
        for _ in range(draw.choice([3, 12])):
            i, c = draw.randrange(len(w)), draw.choice(letters)
            other = draw.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c])
            words += [other] * draw.choice([1, 2, 4, 30])
    draw.shuffle(words)
    out = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    return [*enumerate(out), (None, out[0].upper()), (3, "don't-stop_believing1believing"), (3, out[3]), (4, None), (5, ""), (6, "𝒳unicodeßĀextended short")]


@pytest.mark.parametrize(("seed", "most"), [(1, 256), (2, 4), (3, 2)])
def test_variants_equal_all_pairs(spark, seed, most):
    rows = texts(random.Random(seed))
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n int, word string")
    found = spelling.variants(df, most=most).collect()
    assert len(found) == len({r["word"] for r in found})
    assert {tuple(r) for r in found} == brute(rows)


def test_scan_equals_all_pairs():
    draw = random.Random(9)
    for _ in range(150):
        words = sorted({"".join(draw.choice("ab") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(1, 60))})
        lcp = spelling.shared_prefixes(words)
        lower = spelling.lower_next(lcp)
        for q in words:
            assert [words[i] for i in spelling.one_edit(q, words, lcp, lower)] == [w for w in words if one_apart(q, w)]


def test_many_words_with_one_start(spark):
    stem = "commonbeginning"
    rows = [(i, f"{stem}{a}{b}{c} {stem}{a}{b}{c}") for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in spelling.variants(df, most=16).collect()} == brute(rows)


def test_no_words(spark):
    df = spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")
    assert spelling.variants(df).collect() == [] and spelling.variants(df.limit(0)).collect() == []
