"""Suffix-array dedup to a depth of 50 bytes by bucket-pointer refinement: initial q-gram buckets are refined by the bucket
identifiers of later offsets, and what was decided is used again one step finer.

The suffixes that begin at every byte are compared to LENGTH bytes only. Identifiers of strings are 64-bit names of
their content, so all tasks agree on them without a shuffle; two strings count as equal where two names agree (at least 80
bits together). A suffix belongs to the q-gram of GRAM bytes with the smallest name among those in its first LENGTH
bytes; that gram lies at the same place in every copy, so a run of neighbouring suffixes with one gram is one entry.

1. The initial bucket of a run is its gram. It is refined by the identifiers of its first and its last suffix, which is a
   later offset: runs that agree are equal, and only the one of the smallest document goes on. A gram with one run
   in all documents is finished. A gram with different runs is undecided.
2. Undecided runs are cut into blocks of BLOCK suffixes at fixed places from the gram. The bucket is what all suffixes of
   a block have in common, refined in the same way.
3. Undecided blocks come down to single suffixes: the bucket is the name of both halves, refined by that of the second,
   which is the identifier at a later offset. Now each is decided.

So each step shuffles only what the one before left open, as packed arrays by bucket. A task sends a bucket at
most once per FLUSH bytes of text, whatever the number of its copies, so a passage in a third of all documents does not meet
in one place. What was decided comes back by document; exact copies of whole texts are settled before all that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .scratch import fresh, join_facts, materialize, probably_in

#: Bytes of a string that counts as repeated; bytes of the initial grams; suffixes in a run; suffixes in a block.
LENGTH, GRAM, BLOCK = 50, 19, 4
SPAN = LENGTH - GRAM + 1
#: Bytes of text that a task sends off together, and that are named at once. PIECE is not below textkit.CHUNK, so
#: only texts that stand alone are cut, in every step at the same places.
FLUSH, PIECE = 8 << 20, 1 << 18
#: Entries in one group of buckets.
GROUP = 400_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64(63)
_WIDE = {2: np.uint16, 4: np.uint32, 8: np.int64}
_ENTRY = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("width", pa.int32()), ("cores", pa.binary()), ("fulls", pa.binary()), ("docs", pa.binary()), ("own", pa.binary())])
_ENTRIES = "bucket int, base long, width int, cores binary, fulls binary, docs binary, own binary"
_ANSWER = np.dtype([("doc", np.int64), ("key", np.uint64), ("settled", np.int64)])


class Names:
    """Names of the strings in one array of bytes, by place and length."""

    def __init__(self, data: np.ndarray):
        up, self.down = textkit.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return textkit.mix((self.sums[places + length] - self.sums[places]) * self.down[places])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return textkit.mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def keys(core: np.ndarray, full: np.ndarray) -> np.ndarray:
    """By which a run or block is known within its document."""
    return full >> np.uint64(24) << np.uint64(24) | core >> np.uint64(40)


def _full(names: Names, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return textkit.mix(names.at(first, LENGTH) * _A + names.at(last, LENGTH) * _B + (last - first).astype(np.uint64))


class Runs:
    """The runs of one piece: the first and last suffix, the gram's place, the row of its text, bucket and refinement."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.names = names = Names(data)
        empty = np.zeros(0, np.int64)
        if len(data) < LENGTH:
            self.first = self.last = self.gram = self.row = empty
            self.core = self.full = np.zeros(0, np.uint64)
            return
        h = names.all(GRAM)
        low = h & ~_LOW  # the six lowest bits count how far behind the suffix the smallest gram stands
        for step in (1, 2, 4, 8, 16):
            low = np.minimum(low[:-step], low[step:] + np.uint64(step))
        inside = np.ones(len(low) + LENGTH, bool)
        for end in offsets[1:].tolist():
            inside[max(0, end - LENGTH + 1) : end] = False
        at = np.flatnonzero(inside[: len(low)])
        gram = at + (low[at] & _LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = gram[1:] != gram[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        self.first, self.last, self.gram = at[begin], at[end[: len(begin)]], gram[begin]
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        self.core, self.full = h[self.gram], _full(names, self.first, self.last)

    def suffixes(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all suffixes in the runs ``open_``, and the run of each."""
        size = self.last[open_] - self.first[open_] + 1
        run = np.repeat(open_, size)
        return np.arange(len(run)) + np.repeat(self.first[open_] - (np.cumsum(size) - size), size), run

    def blocks(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last suffix, run, bucket and refinement of the blocks in the runs ``open_``."""
        at, run = self.suffixes(open_)
        place = (self.gram[run] - at) // BLOCK
        new = np.ones(len(at), bool)
        new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1])
        begin = np.flatnonzero(new)
        first, last = at[begin], at[np.append(begin[1:], len(at))[: len(begin)] - 1]
        run, place = run[begin], place[begin]
        core = self.names.at(self.gram[run] - place * BLOCK, LENGTH - BLOCK + 1)
        return first, last, run, textkit.mix(core + place.astype(np.uint64) * _C), _full(self.names, first, last)

    def single(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and refinement of single suffixes."""
        one, two = self.names.at(at, LENGTH // 2), self.names.at(at + LENGTH // 2, LENGTH - LENGTH // 2)
        return textkit.mix(one * _A + two * _B), two


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets) of parts that overlap such that each suffix of LENGTH bytes lies in exactly one."""
    for start in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        stop = min(len(data), start + PIECE + LENGTH - 1)
        yield start, data[start:stop], np.clip(offsets - start, 0, stop - start)


def _packed(core: np.ndarray, full: np.ndarray, doc: np.ndarray, bits: int, final: bool) -> pa.RecordBatch:
    """One flush: what its own documents decide, and one entry per bucket for all others.

    Of equal runs those of larger documents are settled. A bucket with several different runs is undecided here
    already: these go on, and its entry says so by a refinement of 0. ``final``: nothing is undecided any more.
    """
    short = np.maximum(np.uint64(1), full >> np.uint64(24))
    order = np.lexsort((doc, short, core))
    core, full, short, doc = core[order], full[order], short[order], doc[order]
    bucket_new, new = np.ones(len(core), bool), np.ones(len(core), bool)
    bucket_new[1:] = core[1:] != core[:-1]
    new[1:] = bucket_new[1:] | (short[1:] != short[:-1])
    begin = np.flatnonzero(new)
    least = np.repeat(doc[begin], np.diff(np.append(begin, len(doc))))
    settled = doc > least
    group = np.cumsum(bucket_new) - 1
    several = np.zeros(len(core), bool) if final else (np.bincount(group, weights=new) > 1)[group]
    told = settled | several
    own = np.zeros(int(told.sum()), _ANSWER)
    own["doc"], own["key"], own["settled"] = doc[told], keys(core, full)[told], settled[told]
    # of undecided buckets one entry with the smallest document, of others one with the run; finally one for each suffix
    one = new if final else bucket_new
    at = np.flatnonzero(one)
    smallest = doc[at] if final else np.minimum.reduceat(doc, at) if len(at) else doc[:0]
    entry_full = np.where(several[at], np.uint64(0), short[at])
    where = (core[at] & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cores, fulls, docs, where = (core[at] >> np.uint64(24))[order], entry_full[order], smallest[order], where[order]
    base = int(docs.min()) if len(docs) else 0
    reach = int(docs.max()) - base if len(docs) else 0
    width = 2 if reach < 1 << 16 else 4 if reach < 1 << 32 else 8
    narrow = lambda a: np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :5])
    cores, fulls, docs = narrow(cores), narrow(fulls), (docs if width == 8 else (docs - base)).astype(_WIDE[width])
    edges = np.searchsorted(where, np.arange((1 << bits) + 1))
    rows = [
        (b, base, width, cores[edges[b] : edges[b + 1]].tobytes(), fulls[edges[b] : edges[b + 1]].tobytes(), docs[edges[b] : edges[b + 1]].tobytes(), b"")
        for b in np.flatnonzero(np.diff(edges)).tolist()
    ]
    if len(own):
        rows.append((int(own["doc"][0]) % (1 << bits), 0, width, b"", b"", b"", own.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY, strict=True)] if rows else [pa.array([], f.type) for f in _ENTRY], schema=_ENTRY)


def _entries(found: Callable, bits: int, final: bool):
    """A function of batches (doc, text, ...) that sends the entries ``found`` gives for (batch, rows, runs of a piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            core, full, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return _packed(core, full, doc, bits, final)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in textkit.chunks(batch.column(1)):
                lists = found(batch, first, last)
                for _, part, own in pieces(data, offsets):
                    core, full, row = lists(Runs(part, own))
                    held.append((core, full, ids[first + row]))
                    size += len(part)
                    if size >= FLUSH:
                        size = 0
                        yield flush()
        if held:
            yield flush()

    return run


def _refine(final: bool):
    """Of one group of buckets: ``doc, key, settled`` of what entries of other documents decide or leave open."""

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_pylist() for c in table.column_names if c != "bucket"}
        bucket = table.column("bucket")[0].as_py()

        def wider(raw: bytes) -> np.ndarray:
            out = np.zeros((len(raw) // 5, 8), np.uint8)
            out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
            return out.view(np.uint64).ravel()

        core = wider(b"".join(column["cores"]))
        full = wider(b"".join(column["fulls"]))
        docs = [np.frombuffer(d, _WIDE[w]).astype(np.int64) + (0 if w == 8 else base) for d, w, base in zip(column["docs"], column["width"], column["base"], strict=True)]
        doc = np.concatenate(docs)
        own = np.frombuffer(b"".join(column["own"]), _ANSWER)
        order = np.lexsort((doc, full, core))
        core, full, doc = core[order], full[order], doc[order]
        bucket_new, new = np.ones(len(core), bool), np.ones(len(core), bool)
        bucket_new[1:] = core[1:] != core[:-1]
        new[1:] = bucket_new[1:] | (full[1:] != full[:-1])
        begin = np.flatnonzero(new)
        least = np.repeat(doc[begin], np.diff(np.append(begin, len(doc))))
        settled = (doc > least) & (full > 0)
        several = np.zeros(len(core), bool) if final else (np.bincount(np.cumsum(bucket_new) - 1, weights=new) > 1)[np.cumsum(bucket_new) - 1]
        told = settled | (several & (full > 0))
        key = full[told] << np.uint64(24) | core[told] >> np.uint64(16)
        return pa.table({
            "doc": pa.array(np.concatenate([own["doc"], doc[told]])),
            "key": pa.array(np.concatenate([own["key"], key]).view(np.int64)),
            "settled": pa.array(np.concatenate([own["settled"] > 0, settled[told]])),
        })

    return run


def _answers(rows: DataFrame, found: Callable, bits: int, final: bool) -> DataFrame:
    """``doc, done, open``: the settled and the undecided keys of every document that has any."""
    sent = rows.mapInArrow(textkit.tidy(_entries(found, bits, final)), _ENTRIES)
    told = sent.groupBy("bucket").applyInArrow(_refine(final), "doc long, key long, settled boolean")
    return told.groupBy("doc").agg(F.collect_list(F.when(F.col("settled"), F.col("key"))).alias("done"), F.collect_list(F.when(~F.col("settled"), F.col("key"))).alias("open"))


def _known(batch: pa.RecordBatch, name: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Row (from ``first``) and key of a column of key lists."""
    lists = batch.column(batch.schema.get_field_index(name)).slice(first, last - first)
    lists = pa.chunked_array([lists]).combine_chunks() if lists.offset else lists
    size = np.array([0 if x is None else len(x) for x in lists.to_pylist()], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(last - first), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _member(row: np.ndarray, key: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether (row, key) is among the known ones."""
    if not len(known[0]) or not len(row):
        return np.zeros(len(row), bool)
    name = lambda r, k: textkit.mix(k + r.astype(np.uint64) * _C)
    return np.isin(name(row, key), name(*known))


def _runs_of(batch: pa.RecordBatch, first: int, last: int) -> Callable:
    return lambda r: (r.core, r.full, r.row)


def _open_blocks(r: Runs, open_: tuple) -> tuple:
    return r.blocks(np.flatnonzero(_member(r.row, keys(r.core, r.full), open_)))


def _blocks_of(batch: pa.RecordBatch, first: int, last: int) -> Callable:
    open_ = _known(batch, "open0", first, last)

    def found(r: Runs) -> tuple:
        _, _, run, core, full = _open_blocks(r, open_)
        return core, full, r.row[run]

    return found


def _open_suffixes(r: Runs, open_: tuple, finer: tuple) -> tuple:
    """Places, rows, buckets and refinements of the suffixes in undecided blocks of undecided runs; the blocks too."""
    blocks = first, last, run, core, full = _open_blocks(r, open_)
    some = np.flatnonzero(_member(r.row[run], keys(core, full), finer))
    size = last[some] - first[some] + 1
    at = np.arange(size.sum()) + np.repeat(first[some] - (np.cumsum(size) - size), size)
    return at, r.row[np.repeat(run[some], size)], *r.single(at), blocks


def _suffixes_of(batch: pa.RecordBatch, first: int, last: int) -> Callable:
    open_, finer = _known(batch, "open0", first, last), _known(batch, "open1", first, last)

    def found(r: Runs) -> tuple:
        _, row, core, full, _ = _open_suffixes(r, open_, finer)
        return core, full, row

    return found


_RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept binary"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the bytes that decided runs, blocks and suffixes cover."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in textkit.chunks(batch.column(1)):
            lists = {n: _known(batch, n, first, last) for n in ("done0", "open0", "done1", "open1", "done2")}
            edge = np.zeros(len(data) + 1, np.int64)
            for start, part, own in pieces(data, offsets):
                r = Runs(part, own)
                at, row, core, full, (b_first, b_last, run, b_core, b_full) = _open_suffixes(r, lists["open0"], lists["open1"])
                for f, t, hit in (
                    (r.first, r.last, _member(r.row, keys(r.core, r.full), lists["done0"])),
                    (b_first, b_last, _member(r.row[run], keys(b_core, b_full), lists["done1"])),
                    (at, at, _member(row, keys(core, full), lists["done2"])),
                ):
                    np.add.at(edge, start + f[hit], 1)
                    np.add.at(edge, start + t[hit] + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out = []
            for i in range(last - first):
                text, cut = data[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
                spans = int((cut[1:] & ~cut[:-1]).sum() + cut[:1].sum())
                out.append((int(ids[first + i]), len(text), int(cut.sum()), spans, text[~cut].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def _copies(own: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The rows whose whole text a smaller document has too, all others, and the bytes of all texts."""
    digests = own.select("doc", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.reverse(F.left("text", F.lit(4096))), "text").alias("h2"))
    digests = materialize(digests, "digests")
    total = digests.agg(F.sum("size")).first()[0] or 0
    name = ("h1", "h2", "size")
    groups = digests.where(F.col("size") >= LENGTH).groupBy(*name).agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = join_facts(digests, materialize(groups, "copied"), *name).where("doc > least").select("doc", "h1").distinct()
    later = materialize(later, "later-copies")
    hit, h1 = fresh(own.columns, "_hit", "_h1")
    flagged = probably_in(own, later.select("doc"), "doc", flag=hit).withColumn(h1, F.when(F.col(hit), F.xxhash64("text")))
    some = flagged.where(hit).join(later.select("doc", F.col("h1").alias(h1), F.lit(True).alias("again")), ["doc", h1], "left")
    rest = flagged.where(~F.col(hit)).select("doc", "text").unionByName(some.where("again is null").select("doc", "text"))
    return some.where("again").select("doc", "text"), rest, total


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept`` (the remaining bytes).

    Removed are the bytes covered by a string of LENGTH bytes that also starts in a document with a smaller id. Null text
    is empty; texts under LENGTH bytes stay. Rows that repeat an id are one document to others and do not remove each other's
    strings; ids should repeat seldom, as such rows share one list of decided keys. Rows without an id stay whole
    and remove nothing. Ids are whole numbers. Other columns are not looked at. An empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = named.where(F.col("doc").isNotNull())
    copies, rest, total = _copies(own)
    bits = min(24, max(6, math.ceil(math.log2(max(1, total / 16 / GROUP)))))
    first = materialize(_answers(rest, _runs_of, bits, False).select("doc", F.col("done").alias("done0"), F.col("open").alias("open0")), "runs")
    hit = fresh(rest.columns, "_hit")[0]
    flagged = probably_in(rest, first.select("doc"), "doc", flag=hit)
    # the texts are shuffled by document once; the steps below read that exchange again
    base = flagged.where(hit).select("doc", "text").join(first, "doc", "left")
    second = _answers(base.select("doc", "text", "open0"), _blocks_of, bits, False).select("doc", F.col("done").alias("done1"), F.col("open").alias("open1"))
    finer = base.join(second, "doc", "left")
    third = _answers(finer.select("doc", "text", "open0", "open1"), _suffixes_of, bits, True).select("doc", F.col("done").alias("done2"))
    done = finer.join(third, "doc", "left").select("doc", "text", "done0", "open0", "done1", "open1", "done2").mapInArrow(textkit.tidy(_applied), _RESULT)
    size = F.octet_length("text").cast("long")
    whole = lambda rows: rows.select("doc", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.to_binary("text", F.lit("utf-8")).alias("kept"))
    again = copies.select("doc", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.to_binary(F.lit(""), F.lit("utf-8")).alias("kept"))
    found = done.unionByName(again).unionByName(whole(flagged.where(~F.col(hit)))).unionByName(whole(named.where(F.col("doc").isNull())))
    return found.withColumnRenamed("doc", id_col)


def plain_removed(texts: list[tuple[int, bytes]]) -> list[tuple[int, int, int, int, str]]:
    """What ``remove_repeats`` gives, from a table of all strings; for tests."""
    first: dict[bytes, int] = {}
    for doc, text in texts:
        for i in range(len(text) - LENGTH + 1):
            s = text[i : i + LENGTH]
            first[s] = min(doc, first.get(s, doc))
    out = []
    for doc, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - LENGTH + 1):
            if first[text[i : i + LENGTH]] < doc:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


#: DuckDB SQL for the query over ``documents``, on hexadecimal text.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(greatest(0, length(x) // 2 - 49))) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
hits AS (SELECT s.doc_id, s.i FROM s JOIN f USING (g) WHERE f.least < s.doc_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r
         FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM hits)),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, r),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
sums AS (
  SELECT p.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
         string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM parts p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""
