"""Model operators against plain Python: a walk down single trees, votes by pairs, raking with dictionaries."""

import math
import random
from itertools import combinations

import numpy as np

from changelens.llm import langid, mixing, quality


def test_flat_trees_equal_a_walk():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(600, 6)).astype(np.float32)
    x[:50] = x[0]  # ties
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1) ^ (draw.random(600) < 0.1)).astype(float)
    model = quality.HistogramTrees().fit(x, y)
    trees = len(model.feature) // model.inner
    assert trees > 5

    def walk(row):
        margin = float(model.bias)
        for tree in range(trees):
            node = 0
            while node < model.inner:
                split = tree * model.inner + node
                node = 2 * node + (2 if row[model.feature[split]] > model.cut[split] else 1)
            margin += model.value[tree * (model.inner + 1) + node - model.inner]
        return 1 / (1 + math.exp(-margin))

    np.testing.assert_allclose(model.predict(x), [walk(r) for r in x], rtol=1e-9)
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.8


def test_votes_equal_plain_counting():
    draw = np.random.default_rng(6)
    langs = ["aa", "ab", "ba", "bb", "ca"]
    centres = draw.normal(size=(5, 40))
    centres[1] = centres[0] + 0.4 * draw.normal(size=40)
    centres[3] = centres[2] + 0.4 * draw.normal(size=40)
    which = draw.integers(0, 5, 500)
    x = (centres[which] + 0.3 * draw.normal(size=(500, 40))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.Hierarchy().fit(x, np.array(langs)[which])
    code, score = model.predict(x)
    assert ((score >= 0) & (score <= 1)).all()
    for row, got in zip(x.astype(float), code):
        row = [*row, 1.0]
        dot = lambda w: sum(a * float(b) for a, b in zip(row, w))  # noqa: E731, B023
        families = [dot(w) for w in model.family_w] if model.family_w is not None else [0.0]
        members = model.families[families.index(max(families))]
        votes = dict.fromkeys(members, 0.0)
        margins = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            m = dot(model.pair_w[a, b])
            votes[a if m > 0 else b] += 1
            margins[a] += m
            margins[b] -= m
        totals = sorted((votes[k] + 1e-3 * math.tanh(margins[k]) for k in members), reverse=True)
        if len(totals) == 1 or totals[0] - totals[1] > 1e-5:
            assert got == max(members, key=lambda k: votes[k] + 1e-3 * math.tanh(margins[k]))
    assert (np.array(model.langs)[code] == np.array(langs)[which]).mean() > 0.9


def test_raking_equals_dictionaries():
    draw = random.Random(7)
    cells = sorted({(draw.choice("abc"), draw.choice("xy"), draw.choice("123")) for _ in range(14)})
    tokens = [draw.randrange(1, 5000) for _ in cells]
    values = [sorted({c[j] for c in cells}) for j in range(3)]
    codes = np.array([[values[j].index(c[j]) for j in range(3)] for c in cells])
    # targets that some weights meet
    some = [draw.random() for _ in cells]
    targets = [{v: sum(w for w, c in zip(some, cells) if c[j] == v) / sum(some) for v in values[j]} for j in range(3)]
    got = mixing.rake(np.array(tokens, float), codes, [np.array([targets[j][v] for v in values[j]]) for j in range(3)])
    weight = [n / sum(tokens) for n in tokens]
    for _ in range(2000):
        for j in range(3):
            have = {v: sum(w for w, c in zip(weight, cells) if c[j] == v) for v in values[j]}
            weight = [w * targets[j][c[j]] / have[c[j]] for w, c in zip(weight, cells)]
    np.testing.assert_allclose(got, np.array(weight) / sum(weight), rtol=1e-5, atol=1e-8)
    budget = 0.4 * sum(tokens)
    found = mixing.chances(np.array(tokens, float), got, budget)
    assert abs(float((found * tokens).sum()) - budget) < 1e-3 and found.max() <= 1
    scale = {round(float(f * n / w), 3) for f, n, w in zip(found, tokens, got) if f < 1}
    assert max(scale) - min(scale) <= 1e-3 * max(scale)
