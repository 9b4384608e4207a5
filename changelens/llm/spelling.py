"""Spelling variants: words one edit apart by dynamic programming over sorted lists, and the forms they lead to.

1. Words are taken, damaged where the contract says so and counted with DataFrame functions; counts are combined before
   the shuffle, so a very common word is one row a task.
2. Two words whose edit lies in the places [a, b) of the shorter one share the first a code points and those from b on.
   Every word goes to the list of each half (of its own length and of the length below), by that shared part. Lists of
   more than MOST words split their interval into halves, again and again; with one place left a list has at most as
   many words as two free letters allow. So no list grows with the vocabulary.
3. In each sorted list every word of the shorter length is a query. The scan keeps the rows of the edit matrix, banded
   to one edit, as far as the next word shares the prefix of the last one, and where all values of a row exceed one
   edit it jumps behind all words that share the prefix so far.
4. The near word of largest count is a word's form if it is TIMES as common; roots follow by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .scratch import materialize

#: Least code points and occurrences of a word; how much more common a form must be; one run in so many is damaged.
LEAST, OCCURRENCES, TIMES, DAMAGED = 7, 2, 10, 31
#: Words in one sorted list, beyond which its interval is split.
MOST = 256
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = r"A-Za-z\u00C0-\u00FF") -> DataFrame:
    """``word, n``: the damaged runs of letters with LEAST code points that occur OCCURRENCES times, lower-cased in A-Z."""
    lower = F.translate(F.col(text_col), _UPPER, _UPPER.lower())
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[{letters}]{{{LEAST},}}+"), F.lit(0))).alias("run"))
    at = F.crc32(F.concat("id", F.lit(":"), "run"))
    runs = runs.select("run", at.alias("h"))
    cut = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % DAMAGED == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


_LIST = ("m", "a", "b", "key")


def _parts(rows: DataFrame, a, middle, b) -> DataFrame:
    """Every word of ``rows`` (m, word, n) in the lists of [a, middle) and [middle, b)."""
    both = F.explode(F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b"))))
    rows = rows.select("m", "word", "n", both.alias("s")).select("m", "word", "n", "s.a", "s.b")
    key = F.xxhash64(F.substring("word", F.lit(1), F.col("a")), F.right("word", F.col("m") - F.col("b")))
    return rows.select("m", "a", "b", key.alias("key"), "word", "n")


def _lists(words: DataFrame, most: int) -> list[DataFrame]:
    """Tables ``m, a, b, key, word, n`` of all lists with several words; ``m`` is the shorter length of a pair."""
    size = F.char_length("word")
    rows = words.select(F.explode(F.array(size, size - 1)).alias("m"), "word", "n").where(F.col("m") >= LEAST)
    rows = materialize(_parts(rows, F.lit(0), F.floor(F.col("m") / 2).cast("int"), F.col("m")), "halves")
    found = []
    while True:
        sizes = materialize(rows.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "list-sizes")
        long = (F.col("size") > most) & (F.col("b") - F.col("a") > 1)
        found.append(rows.join(sizes.where(~long).drop("size"), list(_LIST), "left_semi"))
        if sizes.where(long).isEmpty():
            return found
        rows = rows.join(sizes.where(long).drop("size"), list(_LIST), "left_semi")
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        rows = materialize(_parts(rows.select("m", "a", "b", "word", "n"), F.col("a"), middle, F.col("b")), "halves")


def shared_prefixes(words: list[str]) -> list[int]:
    """Of each word of a sorted list, how many code points it begins like the one before it; 0 for the first."""
    out = [0] * len(words)
    for i in range(1, len(words)):
        x, y = words[i - 1], words[i]
        n = 0
        for c, d in zip(x, y):
            if c != d:
                break
            n += 1
        out[i] = n
    return out


def lower_next(lcp: list[int]) -> list[int]:
    """Of each place the next one with a smaller value."""
    out, open_ = [len(lcp)] * len(lcp), []
    for i, v in enumerate(lcp):
        while open_ and lcp[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return out


def one_edit(query: str, words: list[str], lcp: list[int], lower: list[int], begin: int = 0) -> Iterator[int]:
    """The places, from ``begin`` on, of words exactly one edit from ``query``, in one scan of a sorted list.

    ``rows[d]`` has the distances of the first d code points of a word to the first d - 1, d and d + 1 of the query,
    2 standing for more than one.
    """
    n, i, count = len(query), begin, len(words)
    rows = [(2, 0, 1)]
    depth = 0  # rows that hold for the word in hand
    while i < count:
        word = words[i]
        size, dead = len(word), False
        del rows[depth + 1 :]
        while depth < size:
            before, same, after = rows[depth]
            depth += 1
            c = word[depth - 1]
            low = min(before + (c != query[depth - 2]), same + 1) if 1 < depth <= n + 1 else depth if depth == 1 else 2
            mid = min(same + (c != query[depth - 1]), after + 1, low + 1) if depth <= n else 2
            high = min(after + (c != query[depth]), mid + 1) if depth < n else 2
            rows.append((min(low, 2), min(mid, 2), min(high, 2)))
            if low > 1 and mid > 1 and high > 1:
                dead = True
                break
        if not dead and -1 <= n - size <= 1 and rows[size][1 + n - size] == 1:
            yield i
        nxt = i + 1
        if dead:
            while nxt < count and lcp[nxt] >= depth:
                nxt = lower[nxt]
        if nxt < count:
            depth = min(depth, lcp[nxt])
        i = nxt


def _near(a: int, b: int, m: int, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
    """Of one list: each pair one edit apart whose first possible place of the edit lies in [a, b), in both directions."""
    lcp = shared_prefixes(words)
    lower = lower_next(lcp)
    for q, query in enumerate(words):
        if len(query) != m:
            continue
        for w in one_edit(query, words, lcp, lower):
            word = words[w]
            if len(word) == m and w < q:
                continue
            place = next((i for i, (x, y) in enumerate(zip(query, word)) if x != y), m)
            if a <= min(place, m - 1) < b:
                yield query, counts[q], word, counts[w]
                yield word, counts[w], query, counts[q]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n, near, near_n`` of sorted rows ``m, a, b, key, word, n``; a list can go over several batches."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    own, words, counts, out = None, [], [], []

    def batch() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return found

    for rows in batches:
        for m, a, b, key, word, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (m, a, b, key) != own:
                if len(words) > 1:
                    out += _near(own[1], own[2], own[0], words, counts)
                own, words, counts = (m, a, b, key), [], []
                if len(out) > 5000:
                    yield batch()
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        out += _near(own[1], own[2], own[0], words, counts)
    if out:
        yield batch()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """``word, n, near, near_n`` of every two words (word, n) that are exactly one edit apart, once in each direction."""
    found = None
    for rows in _lists(words, most):
        near = rows.repartition(*_LIST).sortWithinPartitions(*_LIST, "word").mapInArrow(textkit.tidy(_scan), "word string, n long, near string, near_n long")
        found = near if found is None else found.unionByName(near)
    return found


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Null text has no words; a null id counts as an empty one where runs are damaged. Rows repeated in full count one by
    one. Of near words with the same count the first in code-point order is the form. Texts without a run of LEAST
    letters and empty tables give no rows. Other columns are not looked at.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("rest"), "near")).alias("best")
    near = materialize(near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "near")
    common = -F.col("best.rest") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.rest")).alias("form_n")
    )
    rows = materialize(rows, "forms")
    roots = materialize(rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:  # a form is TIMES as common as its word, so chains are short
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL for the query over ``documents``; near words meet by what is left when one code point is taken out.
ORACLE = r"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
long AS (SELECT run, encode(id || ':' || run) AS k FROM runs WHERE length(run) >= 7),
hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295,
           list_transform(range(1, octet_length(k) + 1), lambda i: ('0x' || substr(hex(k), 2 * i - 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM long, crcs),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
shorter AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS near, y.n FROM shorter x JOIN shorter y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM shorter x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM shorter x JOIN words y ON x.rest = y.word),
best AS (SELECT word, count(*) AS n_near, min({rest: -n, near: near}) AS b FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.rest >= 10 * w.n THEN b.near END AS form, CASE WHEN -b.rest >= 10 * w.n THEN -b.rest END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.root FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""
