"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, on UTF-8 bytes, and written as a narrow table. Trees are fitted on
the driver to a bounded sample of labelled rows, flattened into arrays, and traversed by numpy, a level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .scratch import materialize

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "sign", "bar", "high", "blank",
    "distinct", "repeats", "line_bytes", "line_share", "stops", "top_word", "capitalised", "long_words",
)
#: Labelled rows used for fitting, at most about so many.
SAMPLE_ROWS = 20_000


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    some = np.maximum(sizes, 1)
    sums = np.zeros(len(data) + 1, np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    upper, digit, high, blank = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data >= 128, textkit.BLANK[data]
    lower = (data >= 97) & (data <= 122)
    starts, ends, rows = textkit.words(data, offsets)
    hashes = textkit.range_hashes(textkit.LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    at = textkit.by_row(rows, n)
    n_words = np.diff(at)
    any_words = np.maximum(n_words, 1)
    same = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 1:
        np.cumsum((hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]), out=same[2:])
    lines = count(data == 10) + 1

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(rows, mask, n) / any_words

    lengths = ends - starts
    distinct, top = np.ones(n), np.zeros(n)
    for i in np.flatnonzero(n_words).tolist():
        counts = np.unique(hashes[at[i] : at[i + 1]], return_counts=True)[1]
        distinct[i], top[i] = len(counts) / n_words[i], counts.max() / n_words[i]
    return np.column_stack([
        np.log1p(sizes), np.log1p(n_words), np.bincount(rows, lengths, n) / any_words, count(upper) / some, count(digit) / some,
        count(~(upper | lower | digit | high | blank)) / some, count(data == 124) / some, count(high) / some, count(blank) / some,
        distinct, (same[at[1:]] - same[at[:-1]]) / any_words, sizes / lines, lines / any_words,
        count((data == 46) | (data == 33) | (data == 63)) / any_words, top,
        per_word(upper[starts]) if len(starts) else np.zeros(n), per_word(lengths > 14),
    ]).astype(np.float32)


class HistogramTrees:
    """Boosted trees for a 0/1 label on up to ``bins`` quantile bins a feature; grown level by level."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> HistogramTrees:
        n, width = x.shape
        share = np.clip((y.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3) if n else 0.5
        self.bias = float(np.log(share / (1 - share)))
        inner = 2**self.depth - 1
        self.feature, self.cut, self.value = [], [], []
        if not n:
            return self._flatten(inner)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        cells = binned + np.arange(width) * self.bins
        margin = np.full(n, self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                where = ((node - first)[:, None] * width * self.bins + cells).ravel()
                gs, hs = (np.bincount(where, np.repeat(w, width), many * width * self.bins).reshape(many, width, self.bins).cumsum(2) for w in (g, h))
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best = gain.reshape(many, -1).argmax(1)
                for k in range(many):
                    f, b = divmod(int(best[k]), self.bins)
                    if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                        feature[first + k], cut[first + k] = f, cuts[f][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            gs, hs = (np.bincount(leaf, w, inner + 1) for w in (g, h))
            value = -self.rate * gs / (hs + self.penalty)
            margin += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self._flatten(inner)

    def _flatten(self, inner: int) -> HistogramTrees:
        """Complete trees one after the other: a node's children are at 2k+1 and 2k+2 of its tree."""
        self.inner = inner
        self.feature, self.cut, self.value = (np.concatenate(a) if a else np.zeros(0, t) for a, t in ((self.feature, np.int64), (self.cut, float), (self.value, float)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.bias), np.arange(len(x))
        for tree in range(len(self.feature) // self.inner):
            node, base = np.zeros(len(x), np.int64), tree * self.inner
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[base + node]] > self.cut[base + node])
            margin += self.value[tree * (self.inner + 1) + node - self.inner]
        return 1 / (1 + np.exp(-margin))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the STATISTICS of each row's text as one array; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(data, offsets) for _, _, data, offsets in textkit.chunks(batch.column(1))]
            if parts:
                x = np.concatenate(parts)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), values], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, x array<float>")


def in_fold(id_col: Column, modulus: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == fold, F.lit(False))


def fit(statistics_of: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> HistogramTrees:
    """Trees fitted to about ``sample_rows`` labelled rows (picked by a hash of the id) for which ``train`` holds.

    Labels other than 0 and 1 are ignored; an id labelled more than once counts once, as its largest label.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & train)
    rows = marked.count()
    keep = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, rows)))
    sample = statistics_of.join(marked.where(keep).groupBy("id").agg(F.max("y").alias("y")), "id").select("id", "x", "y").toPandas().sort_values("id", kind="stable")
    x = np.array(sample["x"].tolist(), np.float32).reshape(len(sample), len(STATISTICS))
    return HistogramTrees().fit(x, sample["y"].to_numpy(float))


def score(statistics_of: DataFrame, model: HistogramTrees) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.predict(x))], ["id", "score"])

    kind = statistics_of.schema["id"].dataType.simpleString()
    return statistics_of.mapInArrow(run, f"id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """One row per input row: ``id_col, score, predicted``; the score is the estimated chance of label 1.

    Null and empty texts get the score of an empty text. Without any usable label every score is 0.5. Repeated rows
    get equal scores. ``train`` (over ``id``) says which labelled rows may be learned from. An empty table gives an
    empty result; other columns are not looked at.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, F.lit(True) if train is None else train, id_col=id_col)
    return score(stats, model).select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
