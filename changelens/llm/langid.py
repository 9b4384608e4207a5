"""Language identification in two steps: a family of similar languages, then one-versus-one machines within it.

Texts become normalised counts of hashed byte trigrams (letters lower-cased, all other ASCII as one blank). Families
are found from the languages' mean profiles; a linear support vector machine per family picks one, and machines for
each pair of its languages vote. Machines are fitted on the driver to a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

SLOTS = 4096
#: Labelled rows used for fitting, at most about so many in all, evenly over the languages.
SAMPLE_ROWS = 4000
UNDETERMINED = "und"

_FOLD = np.where((np.arange(256) < 128) & ~np.isin(np.arange(256) | 32, np.arange(97, 123)), 32, textkit.LOWER).astype(np.uint8)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of square-rooted, length-one trigram counts for each text; zeros for one without trigrams."""
    n = len(offsets) - 1
    counts = np.zeros(n * SLOTS)
    if len(data) > 2:
        b = _FOLD[data].astype(np.uint32)
        code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        slot = (code * np.uint32(2654435761)) >> np.uint32(20)
        row = np.repeat(np.arange(n), np.diff(offsets))
        inside = (row[:-2] == row[2:]) & (code != np.uint32(0x202020))
        counts = np.bincount(row[:-2][inside] * SLOTS + slot[inside], minlength=n * SLOTS)
    x = np.sqrt(counts.astype(np.float32).reshape(n, SLOTS))
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(size, 1e-9)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine for labels -1 and 1: squared hinge loss, classes weighing the same."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, step = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w.astype(np.float32)))
        step = 0.9 * step - 0.2 * (penalty * w - 2 * x.T @ (weight * y * slack).astype(np.float32))
        w = w + step
    return w


class Hierarchy:
    """Families of languages, a machine for each family, and one for each pair of languages of one family."""

    def fit(self, x: np.ndarray, langs: np.ndarray, families: int | None = None) -> Hierarchy:
        self.langs = sorted(set(langs.tolist()))
        code = np.searchsorted(self.langs, langs)
        means = np.array([x[code == k].mean(0) for k in range(len(self.langs))]).reshape(len(self.langs), -1)
        self.families = self._families(means, families or max(1, round(len(self.langs) ** 0.5)))
        of = np.array([next(i for i, f in enumerate(self.families) if k in f) for k in range(len(self.langs))], int)
        several = len(self.families) > 1
        self.family_w = np.array([fit_machine(x, np.where(of[code] == i, 1, -1)) for i in range(len(self.families))]) if several else None
        self.pair_w = {}
        for members in self.families:
            for a, b in combinations(members, 2):
                mine = (code == a) | (code == b)
                self.pair_w[a, b] = fit_machine(x[mine], np.where(code[mine] == a, 1, -1))
        return self

    @staticmethod
    def _families(means: np.ndarray, wanted: int) -> list[list[int]]:
        """Average-link clusters of the mean profiles, centred so that what all languages share does not count."""
        centred = means - means.mean(0)
        unit = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
        groups = [[k] for k in range(len(means))]
        while len(groups) > wanted:
            near = {(i, j): float((unit[groups[i]] @ unit[groups[j]].T).mean()) for i, j in combinations(range(len(groups)), 2)}
            i, j = max(near, key=lambda p: (near[p], -p[0], -p[1]))
            groups[i] += groups.pop(j)
        return [sorted(g) for g in groups]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the languages, and a score of 0 to 1 from the weakest margin that decided."""
        n = len(x)
        x = np.column_stack([x, np.ones(n, x.dtype)])
        sure = lambda margin: 1 / (1 + np.exp(-4 * margin))
        family, score = np.zeros(n, int), np.ones(n)
        if self.family_w is not None:
            m = x @ self.family_w.T
            family = m.argmax(1)
            two = np.sort(m, axis=1)
            score = sure((two[:, -1] - two[:, -2]) / 2)
        code = np.zeros(n, int)
        for i, members in enumerate(self.families):
            mine = np.flatnonzero(family == i)
            votes, margins = np.zeros((len(mine), len(members))), np.zeros((len(mine), len(members)))
            least = np.full((len(mine), len(members)), np.inf)
            for a, b in combinations(range(len(members)), 2):
                m = x[mine] @ self.pair_w[members[a], members[b]]
                for side, sign in ((a, 1), (b, -1)):
                    votes[:, side] += sign * m > 0
                    margins[:, side] += sign * m
                    least[:, side] = np.minimum(least[:, side], sign * m)
            best = (votes + 1e-3 * np.tanh(margins)).argmax(1) if len(members) else np.zeros(len(mine), int)
            code[mine] = np.array(members)[best]
            if len(members) > 1:
                score[mine] *= sure(least[np.arange(len(mine)), best])
        return code, score


def _profiles(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the trigram row as half-precision bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for _, _, data, offsets in textkit.chunks(batch.column("text")) for r in trigrams(data, offsets).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(rows, pa.binary())], [*columns, "x"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{kinds}, x binary")


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Hierarchy | None:
    """Learned from about ``sample_rows`` rows with a language and a letter for which ``train`` holds; None without any.

    Each language gives the same number of rows, picked by a hash of id and text, or all it has.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in docs.where(train & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, sample_rows // len(sizes))
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in sizes.items()])
    picked = known.where(F.pmod(F.xxhash64("id", F.lit("pick")), F.lit(1 << 30)) < rate * (1 << 30))
    sample = _profiles(picked, ["id", "lang"]).toPandas().sort_values(["id", "lang"], kind="stable")
    if sample.empty:
        return None
    x = np.frombuffer(b"".join(sample["x"]), np.float16).reshape(len(sample), SLOTS).astype(np.float32)
    return Hierarchy().fit(x, sample["lang"].to_numpy(str))


def identify(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, lang_pred, score``.

    "und" with score 0 for null texts, texts without a letter, and everything if nothing could be learned. Repeated
    rows get equal results; only id and text are looked at; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNDETERMINED], object) if model else np.array([UNDETERMINED], object)
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            code, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if model:
                for first, last, data, offsets in textkit.chunks(batch.column("text")):
                    code[first:last], score[first:last] = model.predict(trigrams(data, offsets))
                code[~letters], score[~letters] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[code], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
