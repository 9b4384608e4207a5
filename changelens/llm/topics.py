"""Topics of documents, learned without labels: hashed words, weighted by rarity, and k-means within languages.

Every distinct text is in the fit: its unit vector is written once, packed, and each round of k-means is one pass over them in tasks that hand
on sums for the centres. The model has a fixed size; every text is then given its topic where it lies, from all its words. Documents of one language look alike for that reason alone, so the mean of each
language is taken off first: what is left tells subjects, not languages, apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .scratch import materialize

TOPICS = 8
#: Buckets of hashed words.
BUCKETS = 1024
#: Languages with fewer texts, or less than one in MOST_LANGS of all, share the mean of all.
LEAST_TEXTS, MOST_LANGS = 8, 512
ROUNDS = 25
#: Fits from other first centres, side by side; the one with the smallest squared distances is taken.
STARTS = 4
#: Topic of a text that has no word.
NO_WORDS = "none"
#: Words' counts weigh round(STEP * log(1 + count)); centres are whole numbers of 1 / GRID. Sums of their products stay
#: below 2**53, so they are exact and a text's topic does not depend on the batch it comes in.
STEP, GRID = 256, 1 << 20
#: Bits of an entry's value, a weight or a part of a unit vector (at most GRID); its bucket stands above.
VALUE = np.uint32(21)


def word_weights(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ends, entries, words``: round(STEP * log(1 + n)) of the n words of a text in each bucket, as entries side by side, where
    each text's end, and how many words it has; A-Z are lowered."""
    n = len(offsets) - 1
    low = textkit.LOWER[data]
    starts, ends, rows = textkit.words(low, offsets)
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(0, np.uint32), np.zeros(n, np.int64)
    bucket = (textkit.range_hashes(low, starts, ends) >> np.uint64(32)).astype(np.int64) % BUCKETS
    counts = np.bincount(rows * BUCKETS + bucket, minlength=n * BUCKETS)
    at = np.flatnonzero(counts)
    weights = np.round(STEP * np.log1p(counts[at])).astype(np.uint32)
    return np.searchsorted(at, np.arange(1, n + 1) * BUCKETS), (at % BUCKETS).astype(np.uint32) << VALUE | weights, np.bincount(rows, minlength=n)


def _binary(ends: np.ndarray, entries: np.ndarray) -> pa.Array:
    """A binary value per text, from its entries."""
    offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(entries, np.uint32))])


def _entries(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, bucket, value`` of all entries of the texts; no text is touched on its own."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0]) // 4
    raw = np.frombuffer(packed.buffers()[2], np.uint32, size, int(offsets[0])) if size else np.zeros(0, np.uint32)
    return np.repeat(np.arange(len(packed)), np.diff(offsets) // 4), (raw >> VALUE).astype(np.int64), (raw & np.uint32((1 << VALUE) - 1)).astype(float)


def _table(rows: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
    found = np.zeros((rows, BUCKETS))
    found.ravel()[row * BUCKETS + bucket] = value
    return found


class Topics:
    """``rarity`` of buckets, centres (TOPICS by BUCKETS) and the means of languages."""

    def __init__(self, rarity: np.ndarray, centres: np.ndarray, means: dict[str | None, np.ndarray]):
        self.dots = np.round(GRID * rarity * centres).T
        self.squares = np.round(GRID * rarity**2)
        self.offsets = {v: centres @ m + (centres**2).sum(1) / 2 for v, m in means.items()}

    def assign(self, ends: np.ndarray, entries: np.ndarray, langs: list[str | None]) -> list[str]:
        """The topic whose centre is nearest; ties go to the first. Texts as ``word_weights`` gives them."""
        row, bucket, value = _entries(_binary(ends, entries))
        size = np.sqrt(np.bincount(row, value**2 * self.squares[bucket], len(ends)) / GRID)
        score = (_table(len(ends), row, bucket, value) @ self.dots) / GRID / np.maximum(size, 1e-300)[:, None]
        score -= np.array([self.offsets.get(v, self.offsets[None]) for v in langs]).reshape(score.shape)
        return [f"topic_{k}" if s > 0 else NO_WORDS for k, s in zip(score.argmax(1).tolist(), size.tolist(), strict=True)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            yield batch.slice(first, 512)


def _add(table: pa.Table) -> pa.Table:
    """Of one row, the sums of all tasks added up."""
    total = sum(np.frombuffer(v, np.int64) for v in table.column("sums").to_pylist())
    return pa.table({"k": table.column("k").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _sums(texts: DataFrame, rows: int, width: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sums over all texts of what ``add`` gives for a batch: whole numbers, rows by width. A task hands on one packed row for
    each of them, and tasks add these up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in _batches(batches):
            total += add(batch)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([v.astype(np.int64).tobytes() for v in total[some]], pa.binary())], ["k", "sums"])

    found = np.zeros((rows, width))
    for r in texts.mapInArrow(textkit.tidy(run), "k long, sums binary").groupBy("k").applyInArrow(_add, "k long, sums binary").collect():
        found[r["k"]] = np.frombuffer(r["sums"], np.int64)
    return found


def _next_centres(texts: DataFrame, means: np.ndarray, centres: list[list[np.ndarray]], seed: int) -> dict[int, np.ndarray]:
    """For every start a text drawn by its squared distance from the nearest centre: all race, by a hash of text and seed."""
    whole = np.round(GRID * means)
    means_squared = (whole**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [np.round(GRID * np.array(own).reshape(-1, BUCKETS)) for own in centres]
        lengths = [(grid**2).sum(1) for grid in grids]
        # of texts less the mean of their language; sums of whole numbers, so the same in any order
        against = np.concatenate([whole, *grids]).T
        between = whole @ against[:, len(whole) :]
        for batch in _batches(batches):
            row, bucket, value = _entries(batch.column("units"))
            of = batch.column("code").to_numpy()
            dots = _table(batch.num_rows, row, bucket, value) @ against
            squares = np.bincount(row, value**2, batch.num_rows) - 2 * dots[np.arange(len(of)), of] + means_squared[of]
            dots = dots[:, len(whole) :] - between[of]
            key, first = batch.column("key").to_numpy().view(np.uint64), 0
            for start, length in enumerate(lengths):
                mine = dots[:, first : first + len(length)]
                first += len(length)
                away = (squares + (length - 2 * mine).min(1)) / GRID**2 if len(length) else np.ones(len(of))
                u = ((textkit.mix(key + np.uint64((seed + start) * 1000 + len(length))) >> np.uint64(11)) + np.uint64(1)).astype(float) / 2.0**53
                race = np.where(away > 1e-9, np.log(u) / np.maximum(away, 1e-9), -np.inf)
                best = int(race.argmax())
                if race[best] > -np.inf:
                    one = [pa.array([start]), pa.array(race[best : best + 1]), *(batch.column(c).slice(best, 1) for c in ("key", "code", "units"))]
                    yield pa.RecordBatch.from_arrays(one, ["start", "race", "key", "code", "units"])

    best = texts.mapInArrow(textkit.tidy(run), "start long, race double, key long, code int, units binary")
    best = best.groupBy("start").agg(F.max(F.struct("race", "key", "code", "units")).alias("b")).collect()
    unit = lambda b: _table(1, *_entries(pa.array([bytes(b["units"])], pa.binary())))[0] / GRID
    return {r["start"]: unit(r["b"]) - means[r["b"]["code"]] for r in best}


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int | None = None, topics: int = TOPICS, seed: int = 11) -> Topics:
    """A model of all texts that are not null; copies of a text count once. An empty table gives a model with one topic.

    ``sample_rows`` restricts it to about so many rows, chosen by a hash of the text.
    """
    own = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull())
    if sample_rows is not None:
        limit = int(min(1.0, sample_rows / max(1, docs.count())) * (1 << 30))
        own = own.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < limit)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textkit.chunks(batch.column(1)):
                packed = _binary(*word_weights(data, offsets)[:2])
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in (batch.column(0), batch.column(2))), packed], ["key", "lang", "weights"])

    weighed = own.mapInArrow(textkit.tidy(weigh), "key long, lang string, weights binary")
    texts = weighed.groupBy("key").agg(F.min(F.struct("lang", "weights")).alias("w")).select("key", "w.lang", "w.weights")
    texts = materialize(texts, "topic-texts")
    n = texts.count()
    if not n:
        return Topics(np.full(BUCKETS, 1e-6), np.zeros((1, BUCKETS)), {None: np.zeros(BUCKETS)})
    found_in = _sums(texts, 1, BUCKETS, lambda b: np.bincount(_entries(b.column("weights"))[1], minlength=BUCKETS)[None])
    rarity = np.log((1 + n) / (1 + found_in[0])) + 1e-6
    known = texts.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(LEAST_TEXTS, n / MOST_LANGS)).orderBy("lang").collect()
    code = {r["lang"]: k for k, r in enumerate(known)}

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = np.round(GRID * rarity**2)
        for batch in _batches(batches):
            weights = batch.column("weights")
            row, bucket, value = _entries(weights)
            size = np.sqrt(np.bincount(row, value**2 * squares[bucket], len(weights)) / GRID)
            units = np.round(GRID * (value * rarity[bucket]) / size[row])
            packed = _binary(np.cumsum(np.bincount(row, minlength=len(weights))), bucket.astype(np.uint32) << VALUE | units.astype(np.uint32))
            codes = pa.array([code.get(v, len(code)) for v in batch.column("lang").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), codes, packed], ["key", "code", "units"])

    # texts of length 1, in whole numbers of 1 / GRID, whatever the batch: written once, read by every round
    texts = materialize(texts.mapInArrow(textkit.tidy(scale), "key long, code int, units binary"), "topic-units")

    def by_code(batch: pa.RecordBatch) -> np.ndarray:
        row, bucket, value = _entries(batch.column("units"))
        return np.bincount(batch.column("code").to_numpy()[row] * BUCKETS + bucket, value, (len(code) + 1) * BUCKETS).reshape(-1, BUCKETS)

    by_lang = _sums(texts, len(code) + 1, BUCKETS, by_code) / GRID
    means = {v: by_lang[k] / known[k]["n"] for v, k in code.items()} | {None: by_lang.sum(0) / n}
    table = np.array([means[v] for v in [*code, None]])

    centres: list[list[np.ndarray]] = [[] for _ in range(STARTS)]
    for _ in range(topics):
        for start, found in _next_centres(texts, table, centres, seed).items():
            centres[start].append(found)
    first = np.cumsum([0] + [len(own) for own in centres])
    now = np.array([c for own in centres for c in own]).reshape(-1, BUCKETS)
    for _ in range(ROUNDS + 1):
        dots, offsets = np.round(GRID * now), now @ table.T + (now**2).sum(1)[:, None] / 2

        def near(batch: pa.RecordBatch, dots: np.ndarray = dots, offsets: np.ndarray = offsets) -> np.ndarray:
            row, bucket, value = _entries(batch.column("units"))
            of = batch.column("code").to_numpy()
            score = _table(len(of), row, bucket, value) @ dots.T / GRID**2 - offsets.T[of]
            sums, each = np.zeros((len(dots), BUCKETS + len(table))), np.bincount(row, minlength=len(of))
            for a, b in zip(first[:-1], first[1:], strict=True):
                if b > a:
                    own = score[:, a:b].argmax(1)
                    sums[a:b, :BUCKETS] = np.bincount(np.repeat(own * BUCKETS, each) + bucket, value, (b - a) * BUCKETS).reshape(-1, BUCKETS)
                    sums[a:b, BUCKETS:] = np.bincount(own * len(table) + of, minlength=(b - a) * len(table)).reshape(-1, len(table))
            return sums

        sums = _sums(texts, len(now), BUCKETS + len(table), near)
        count, inside = sums[:, BUCKETS:].sum(1, keepdims=True), sums[:, :BUCKETS] / GRID - sums[:, BUCKETS:] @ table
        new = np.where(count > 0, inside / np.maximum(count, 1), now)
        # the larger the squares of the means, times their texts, the smaller the squared distances from them
        spread = [float((count[a:b] * new[a:b] ** 2).sum()) for a, b in zip(first[:-1], first[1:], strict=True)]
        if np.array_equal(new, now):
            break
        now = new
    best = int(np.argmax(spread))
    return Topics(rarity, now[first[best] : first[best + 1]], means)


def topic(model: Topics, text: Column, lang: Column) -> Column:
    """The topic of a text, from all its words; null text, and text without a word, is NO_WORDS."""
    return topic_and_words(model, text, lang)["topic"]


def topic_and_words(model: Topics, text: Column, lang: Column) -> Column:
    """A struct of ``topic`` and of ``n_words``, the runs without ASCII white space, counted on the way."""

    def assign(texts: pa.Array, langs: pa.Array) -> pa.Array:
        found, count = [], [np.zeros(0, np.int64)]
        for first, last, data, offsets in textkit.chunks(texts):
            ends, entries, words = word_weights(data, offsets)
            found += model.assign(ends, entries, langs.slice(first, last - first).to_pylist())
            count.append(words)
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.concatenate(count).astype(np.int64))], ["topic", "n_words"])

    return F.arrow_udf(assign, "topic string, n_words long")(text.cast("string"), lang.cast("string"))
