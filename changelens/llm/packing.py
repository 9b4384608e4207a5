"""Best-fit packing of tokenised documents by exact-complement hashing.

Only lengths matter for packing, and lengths are at most ``capacity``: the histogram of piece lengths, bounded by
``capacity`` rows however large the corpus, is packed on the driver into patterns (multisets of lengths, with how many
sequences use them). Pieces then take their places by rank within their length, in parallel.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .scratch import materialize

CAPACITY = 2048
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class FastIds:
    """Ids of a byte-level BPE tokenizer file, each distinct pre-token encoded once.

    Texts are cut where the tokenizer's own pre-tokenizer cuts them: runs of letters, of numbers, of other signs, each
    with one space before it, English contractions, and white space. The class of a character is asked of the
    tokenizer itself, so that its Unicode tables hold. Added tokens are cut out first, as the library does. The cache is emptied when it has ``most`` entries.
    """

    LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.find_added = re.compile("|".join(map(re.escape, self.added))).finditer if self.added else None
        self.classes = np.full(0x110000, self.UNKNOWN, np.uint8)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _class_of(self, point: int) -> int:
        pieces = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
        c = chr(point)
        return next((k for k, like in ((self.LETTER, "a"), (self.NUMBER, "1"), (self.OTHER, "!")) if pieces(like + c) == 1), self.SPACE)

    def _starts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each code point; edges: the texts' offsets."""
        kind = self.classes[points]
        if (kind == self.UNKNOWN).any():
            for p in np.unique(points[kind == self.UNKNOWN]).tolist():
                self.classes[p] = self._class_of(p)
            kind = self.classes[points]
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        start = edge[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last of a run of white space stands alone, or joins what follows if it is a plain space
        space = kind == self.SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        for q in np.flatnonzero((points == 39) & start).tolist():
            tail = points[q + 1 : q + 3].tolist()
            if tail and not edge[q + 1]:
                long = "".join(map(chr, tail)) in ("re", "ve", "ll") and not edge[q + 2]
                if long or chr(tail[0]) in "stmd":
                    start[q + 1] = False
                    stop = q + (3 if long else 2)
                    if stop < n:
                        start[stop] = True
        return start

    def _added(self, texts: list[str], edges: np.ndarray) -> np.ndarray:
        """Start and end of every added token, leftmost first and the longest of several."""
        holders = [k for k, text in enumerate(texts) if any(t in text for t in self.added)]
        spans = [(edges[k] + m.start(), edges[k] + m.end()) for k in holders for m in self.find_added(texts[k])]
        return np.array(spans, np.int64).reshape(-1, 2)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the texts' offsets into them."""
        whole = "".join(texts)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not whole:
            return np.zeros(0, np.uint32), edges
        if len(self.slots) > self.most:
            self._clear()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        added = self._added(texts, edges)
        start = self._starts(points, np.union1d(edges, added.ravel()))
        for a, b in added.tolist():
            start[a + 1 : b] = False
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points))
        hashes, first, where = np.unique(textkit.range_hashes(points, starts, ends), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        slots = [self.slots.get(k, -1) for k in keys]
        missing = [i for i, s in enumerate(slots) if s < 0]
        if missing:
            parts = [whole[starts[first[i]] : ends[first[i]]] for i in missing]
            new = [e.ids for k in range(0, len(parts), 4096) for e in self.tokenizer.encode_batch_fast(parts[k : k + 4096], add_special_tokens=False)]
            sizes = np.array([len(e) for e in new], np.int64)
            ids = np.array([x for e in new for x in e], np.uint32)
            base, room = len(self.slots), self.used + len(ids)
            while room > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while base + len(new) > len(self.begin):
                self.begin, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.size))
            self.flat[self.used : room] = ids
            self.begin[base : base + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[base : base + len(new)] = sizes
            self.used = room
            for j, i in enumerate(missing):
                slots[i] = self.slots[keys[i]] = base + j
        slot = np.array(slots)[where]
        sizes = self.size[slot]
        to = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.begin[slot] - to[:-1], sizes) + np.arange(to[-1])]
        return ids, to[np.searchsorted(starts, edges)]


def piece_bounds(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of a document; only the first may be shorter than the capacity."""
    short = length % capacity or min(length, capacity)
    return [(0, short)] + [(s, capacity) for s in range(short, length, capacity)]


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32`` (and ``ids``); every document ends with END_ID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = FastIds(path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            for first, last, _, _ in textkit.chunks(texts):
                own = [t or "" for t in texts.slice(first, last - first).to_pylist()]
                ids, at = fast.encode(own)
                for k in range(last - first):
                    mine = np.append(ids[at[k] : at[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for p, (start, length) in enumerate(piece_bounds(len(mine), capacity)):
                        part = mine[start : start + length]
                        for name, value in zip(out, (first + k, p, start, length, zlib.crc32(part), part if with_ids else None), strict=True):
                            out[name].append(value)
            columns = [names.take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *[pa.array(out[c], pa.int64()) for c in ("start", "length", "crc")]]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(textkit.tidy(run), schema)


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in falling order, number of sequences) that use up ``counts`` pieces of each length.

    The longest piece left opens a sequence. Its gap is closed exactly by a single length, a pair or a triple if the
    sums of what is available hit it; else the longest piece that fits goes in and the rest of the gap is tried
    again. A pattern is repeated as often as its scarcest length allows, so each one uses up a length.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []

    def usable(lengths: list[int]) -> bool:
        return all(left[x] >= lengths.count(x) for x in lengths)

    def exact(gap: int, used: list[int]) -> list[int] | None:
        for x in used:
            left[x] -= 1
        try:
            if gap <= capacity and left[gap]:
                return [gap]
            have = left > 0
            for a in np.flatnonzero(have[1:gap] & have[gap - 1 : 0 : -1])[::-1] + 1:
                if usable([int(a), gap - int(a)]):
                    return [int(a), gap - int(a)]
            there = np.flatnonzero(have[: gap + 1])[::-1]
            sums = np.fft.irfft(np.fft.rfft(have[: gap + 1], 2 * gap + 2) ** 2)[: gap + 1] > 0.5  # which lengths two pieces add up to
            for a in there.tolist():
                rest = gap - a
                if rest >= 2 and sums[rest]:
                    for b in np.flatnonzero(have[1:rest] & have[rest - 1 : 0 : -1]) + 1:
                        if usable([a, int(b), rest - int(b)]):
                            return [a, int(b), rest - int(b)]
            return None
        finally:
            for x in used:
                left[x] += 1

    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return patterns
        pattern, gap = [longest], capacity - longest
        while gap:
            found = exact(gap, pattern)
            if found is None:
                there = np.flatnonzero(left[: gap + 1] > 0)[::-1]
                found = next(([int(x)] for x in there if left[x] > pattern.count(int(x))), None)
            if found is None:
                break
            pattern += found
            gap -= sum(found)
        times = min(int(left[x]) // pattern.count(x) for x in set(pattern))
        for x in pattern:
            left[x] -= times
        patterns.append((sorted(pattern, reverse=True), times))


def segments(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, offset): where the pieces of each length go by rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in dict.fromkeys(lengths):
            each = lengths.count(x)
            rows.append((x, rank.get(x, 0), each, sequence, offset))
            rank[x] = rank.get(x, 0) + each * times
            offset += each * x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY, per_group: int = 500) -> DataFrame:
    """``pieces`` (with ``id, piece, length``) plus ``sequence_id`` and ``offset``.

    Ranks within a length come from windows over (length, salt) with about ``per_group`` rows, plus the counts of the
    salts before: one very common length is spread like any other. Full pieces are sequences of their own, numbered
    below 0 where they stand. ``pieces`` must be a written table, so that numbers do not change.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == capacity)
    pieces = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = segments(pack_lengths(counts, capacity))
    salts = spark.createDataFrame([(x, -(-n // per_group)) for x, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.join(before, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    )
    names = [c for c in pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = [batch.column(c) for c in names] + [pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    alone = full.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.select(*names, "rank").mapInArrow(run, schema).unionByName(alone)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Null text equals empty text: one piece with the end id alone. Repeated rows are packed each on their own. Other
    columns are not looked at; an empty table gives an empty result. ``path`` is a file of the tokenizers library
    that must exist on every executor. Only the histogram of lengths, at most ``capacity`` rows, reaches the driver.
    """
    pieces = materialize(tokenised_pieces(docs, path or default_tokenizer(), capacity, id_col, text_col, with_ids), "pieces")
    placed = place(pieces, capacity)
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return placed.select(F.col("id").alias(id_col), *columns)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Whole training sequences from ``pack(with_ids=True)``: ``sequence_id, ids, members`` in order of offset."""
    part = F.struct("offset", F.col(id_col).alias("member"), "piece", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: F.struct(p["member"].alias(id_col), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("members"))
