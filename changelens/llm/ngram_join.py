"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, exact at the threshold of 3/4.

1. Every text becomes a set of 64-bit shingle hashes. The shingles whose hash lies in the lowest REGION of the hash
   range are counted across the corpus in buckets; what repeats within a batch is settled there. A set with more
   unique shingles than its size allows to miss cannot have a partner and is done; few texts remain.
2. Sets with equal content form one class and go on as one.
3. Shingles are put in order of their frequency among the sets that are left, rare ones first. A set's prefix must
   share its first element with any partner, so unique elements in it shorten what has to be looked up.
4. Small sets enumerate the two-element subsets of their prefix, large ones scan the inverted lists of their prefix
   elements; the size that separates them is where both cost the same, given the average length of a list.
5. Candidates are verified on whole sets, pivot by pivot, until each list lies in one group (see groups).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .groups import add_links, link_groups, shared_keys
from .scratch import join_facts, materialize, probably_in

WORDS = 5
#: Links need 100 * intersection >= 75 * union, so a set of n can miss n // 4 of its elements and have a partner.
#: Share of the hash range in which shingles are counted.
REGION = int(0.4 * 2**40)
MASK = 2**40 - 1
#: Longest prefix whose subsets may stand in one row; longer ones are always heavy, which is as exact.
MOST_SUBSET_PREFIX = 64
FLUSH = 400_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; shorter texts have one for their whole word sequence."""
    n = len(offsets) - 1
    low = textkit.LOWER[data]
    starts, ends, rows = textkit.words(low, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    h = textkit.range_hashes(low, starts, ends)
    odd = [np.uint64(2 * k * 0x632BE59BD9B4E019 + 1 & 2**64 - 1) for k in range(1, WORDS + 1)]
    joined = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        joined += h[k : len(h) - WORDS + 1 + k] * odd[k]
    joined = textkit.mix(joined)
    at = textkit.by_row(rows, n)
    sets = []
    for i in range(n):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= WORDS:
            sets.append(np.unique(joined[a : b - WORDS + 1]))
        elif b > a:
            whole = sum((h[a + k : a + k + 1] * odd[k] for k in range(b - a)), np.full(1, b - a, np.uint64))
            sets.append(textkit.mix(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


_BLOCK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("base", pa.int64()), ("wide", pa.bool_()), ("keys", pa.binary()), ("docs", pa.binary()), ("known", pa.binary())])
_ROW = "kind int, doc long, n long, s1 long, s2 long, counted long, repeated long"
_INFO = ("doc", "n", "s1", "s2", "counted", "repeated")


def _blocks(bits: int):
    """A function of batches (id, text) that gives blocks: 0 set summaries, 1 elements to count by bucket."""

    def flush(docs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        rows: list[tuple] = []
        sizes = np.array([len(s) for s in sets], np.int64)
        info = np.zeros((len(docs), 6), np.int64)
        info[:, 0], info[:, 1] = docs, sizes
        parts, owners = [], []
        for k, s in enumerate(sets):
            counted = int(np.searchsorted(s >> np.uint64(24), REGION))
            with np.errstate(over="ignore"):
                info[k, 2:5] = np.array([s.sum(dtype=np.uint64), textkit.mix(s).sum(dtype=np.uint64), counted], np.uint64).view(np.int64)
            parts.append(s[:counted])
            owners.append(np.full(counted, k))
        tokens, owner = np.concatenate(parts), np.concatenate(owners)
        key = (tokens & np.uint64((1 << bits) - 1)) << np.uint64(40) | tokens >> np.uint64(24)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        equal = key[1:] == key[:-1]
        again = np.zeros(len(key), bool)
        again[1:] |= equal
        first = ~again
        again[:-1] |= equal
        info[:, 5] = np.bincount(owner[again], minlength=len(docs))
        rows.append((0, docs[0] % (1 << bits), 0, False, info.tobytes(), b"", b""))
        one, known = ~again, again & first
        keys, owner, known = key[one], np.array(docs, np.int64)[owner[one]], key[known]
        base = int(owner.min()) if len(owner) else 0
        wide = bool(len(owner)) and int(owner.max()) - base >= 2**32
        owner = owner if wide else (owner - base).astype(np.uint32)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(40)
        at, known_at = np.searchsorted(keys, edges), np.searchsorted(known, edges)
        narrow = lambda a: np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :5])
        keys, known = narrow(keys), narrow(known)
        for b in np.flatnonzero((np.diff(at) > 0) | (np.diff(known_at) > 0)).tolist():
            mine = slice(at[b], at[b + 1])
            rows.append((1, b, base, wide, keys[mine].tobytes(), owner[mine].tobytes(), known[known_at[b] : known_at[b + 1]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCK, strict=True)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, held = [], [], 0
        for batch in batches:
            ids = _ids(batch.column(0)).tolist()
            for first, last, data, offsets in textkit.chunks(batch.column(1)):
                new = shingle_sets(data, offsets)
                docs += ids[first:last]
                sets += new
                held += sum(map(len, new)) * 2 // 5
                if held >= FLUSH:
                    yield flush(docs, sets)
                    docs, sets, held = [], [], 0
        if docs:
            yield flush(docs, sets)

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: set summaries as rows (kind 0), and per document how many of its elements are elsewhere too (1)."""
    column = {c: table.column(c).to_pylist() for c in table.column_names}
    info = [np.frombuffer(x, np.int64).reshape(-1, len(_INFO)) for x, kind in zip(column["keys"], column["kind"], strict=True) if kind == 0]
    info = np.concatenate(info) if info else np.zeros((0, len(_INFO)), np.int64)
    keys, owners, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

    def wider(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        return out.view(np.uint64).ravel()

    for i, kind in enumerate(column["kind"]):
        if kind == 1:
            keys.append(wider(column["keys"][i]))
            raw = column["docs"][i]
            owners.append(np.frombuffer(raw, np.int64) if column["wide"][i] else column["base"][i] + np.frombuffer(raw, np.uint32).astype(np.int64))
            known.append(wider(column["known"][i]))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    known = np.unique(np.concatenate(known))
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    again = np.zeros(len(key), bool)
    if len(key):
        equal = key[1:] == key[:-1]
        again[1:] |= equal
        again[:-1] |= equal
        if len(known):
            again |= known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
    doc, n = np.unique(owner[again], return_counts=True)
    m, k = len(info), len(doc)
    both = lambda a, b: pa.chunked_array([a, b]).combine_chunks()
    rest = {c: both(pa.array(info[:, j].copy()), pa.nulls(k, pa.int64())) for j, c in enumerate(_INFO) if j not in (0, 5)}
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], [m, k]), pa.int32()),
        "doc": pa.array(np.concatenate([info[:, 0], doc])),
        **rest,
        "repeated": pa.array(np.concatenate([info[:, 5], n.astype(np.int64)])),
    })


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textkit.chunks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends), values)], ["id", "elements"])

    return docs.select("id", "text").mapInArrow(textkit.tidy(run), "id long, elements array<long>")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in textkit.chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(data, offsets)], pa.int64())], ["n"])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id``.

    A text's set holds its distinct 5-word shingles; A-Z are lower-cased and words are runs without ASCII white space.
    With fewer words the whole sequence is the one element; null, empty and blank texts have none and link with
    nothing. Texts link if 100 * intersection >= 75 * union; the component is the smallest id reachable. Rows without
    an id have their size, no component, and link with nothing. Rows that repeat an id share a component. Ids are whole
    numbers. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    bits = min(24, max(9, math.ceil(math.log2(max(1, own.count()) / 200))))
    blocks = own.mapInArrow(textkit.tidy(_blocks(bits)), "kind int, bucket int, base long, wide boolean, keys binary, docs binary, known binary")
    counted = materialize(blocks.groupBy("bucket").applyInArrow(_count, _ROW), "shingles")
    info = counted.where("kind = 0").select(*_INFO)
    elsewhere = counted.where("kind = 1").groupBy("doc").agg(F.sum("repeated").alias("elsewhere"))
    unique = F.col("counted") - F.col("repeated") - F.coalesce("elsewhere", F.lit(0))
    alive = info.join(elsewhere, "doc", "left").where((F.col("n") > 0) & (unique <= F.floor(F.col("n") / 4))).select("doc", "n", "s1", "s2")
    alive = materialize(alive, "alive")
    content = ("n", "s1", "s2")
    classes = materialize(alive.groupBy(*content).agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    members = materialize(join_facts(alive, classes, *content).select("doc", "rep"), "members")

    # the sets that are left, and their prefixes in order of frequency among them
    sets = materialize(_sets(probably_in(own, members.where("doc = rep").select("doc"), "id")), "sets")
    elements = sets.select("id", F.size("elements").alias("size"), F.explode("elements").alias("tok"))
    shared = elements.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = elements.join(shared, "tok").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("c", "tok"))).alias("listed"))
    # of size // 4 + 1 (for pairs of elements + 2) prefix elements the unique ones come first
    left = F.floor(F.col("size") / 4) + 1 - (F.col("size") - F.size("listed"))
    upto = lambda n: F.transform(F.slice("listed", 1, F.greatest(F.lit(0), n).cast("int")), lambda e: e["tok"])
    average = F.aggregate(F.slice("listed", 1, F.greatest(F.lit(0), left).cast("int")), F.lit(0).cast("long"), lambda acc, e: acc + e["c"])
    reps = materialize(listed.select("id", "size", F.size("listed").alias("shared"), upto(left).alias("one"), upto(left + 1).alias("two"), average.alias("met")), "prefixes")

    # light sets cost their subsets as keys, heavy ones the lengths of their prefix elements' lists
    level = F.least(F.floor(F.col("size") / 4) + 1, F.lit(MOST_SUBSET_PREFIX + 1))
    subsets = F.size("two") * (F.size("two") - 1) / 2
    costs = {r["level"]: r for r in reps.groupBy(level.alias("level")).agg(F.sum(subsets).alias("light"), F.sum("met").alias("heavy")).collect()}
    cost = lambda longest: sum(r["light"] if p <= longest else r["heavy"] for p, r in costs.items())
    boundary = 4 * min(range(1, MOST_SUBSET_PREFIX + 1), key=cost) - 1
    first = F.col("size") - F.col("shared")  # unique elements stand before all others
    pairs_of = F.flatten(
        F.transform("two", lambda x, i: F.transform(F.slice("two", i + 2, F.greatest(F.size("two") - i - 1, F.lit(0))), lambda y, j: F.struct(F.xxhash64(F.lit(2), x, y).alias("key"), (first + i + j).alias("at"))))
    )
    lists_of = F.transform("one", lambda t, i: F.struct(F.xxhash64(F.lit(1), t).alias("key"), (first + i).alias("at")))
    keyed = lambda rows, of, leads: rows.select(F.explode(of).alias("k"), "id", "size", leads.alias("leads")).select("k.key", "id", "size", F.col("k.at").alias("at"), F.lit(0).alias("rank"), "leads")
    light = keyed(reps.where((F.col("size") <= boundary) & (F.col("size") > 2)), pairs_of, F.lit(True))
    heavy = keyed(reps.where(F.col("size") * 4 >= F.lit(boundary * 3)), lists_of, F.col("size") > boundary)
    keys = light.unionByName(heavy)

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        return pairs.join(left, "a").join(right, "b").where(common * 100 >= (F.size("x") + F.size("y") - common) * 75).select("a", "b").distinct()

    def compatible(a: Column, b: Column) -> Column:
        """A link's intersection is at least 3/7 of both sizes together, and at the pair's first common key all of it
        lies at or after the place of that key in both sets."""
        rest = F.least(a["size"] - a["at"], b["size"] - b["at"])
        return rest * 7 >= (a["size"] + b["size"]) * 3

    def possible(size: Column, at: Column, least: Column) -> Column:
        """What ``compatible`` asks of one side alone, with a partner of at least ``least`` elements."""
        return (size - at) * 7 >= (size + F.greatest(least, F.ceil(size * 3 / 4))) * 3

    groups = link_groups(shared_keys(keys, possible), verify, compatible, 0.75)
    found = members.distinct()
    # an id that is repeated with unlike texts joins their classes
    several = found.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a <> hi").select("doc", "a")
    joined = materialize(found.join(several, "doc").where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "joined")
    if not joined.isEmpty():
        groups = add_links(groups, joined)
    if groups is None:
        found = found.withColumnRenamed("rep", "component")
    else:
        sizes = classes.join(groups.withColumnRenamed("id", "rep"), "rep").groupBy("rep", "component").agg(F.sum("copies").alias("copies"))
        linked = join_facts(found, sizes, "rep").select("doc", "component")
        found = linked.unionByName(found.join(groups.select(F.col("id").alias("rep")), "rep", "left_anti").select("doc", F.col("rep").alias("component"))).distinct()
    found = info.join(found, "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    nameless = nameless.mapInArrow(textkit.tidy(_sizes), "n long").select(F.lit(None).cast("long").alias("doc"), "n", F.lit(None).cast("long").alias("component"))
    return found.unionByName(nameless).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
