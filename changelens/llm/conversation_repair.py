"""Conversation structure repair: cheapest edits to a well-formed role sequence, by rank-convergence parallel Viterbi.

Rows are put in order by one range shuffle, so a conversation lies in one partition, or in a run of them if it is long.
Each task cuts its rows into chunks. A conversation that lies wholly inside a task is repaired there. The others, at
most two a task and those longer than a chunk, go on as chunks:

1. Backward Viterbi: a chunk's cost vector (cheapest way to the end from each of four states) follows from the vector of
   the next chunk. All chunks start at once from a speculative vector. Fix-up passes hand every chunk the vector
   that its successor has found; only chunks where it differs by more than a constant run again.
2. Only differences within a vector decide, so the stitched vectors give the letters: each chunk traces the ASCII-least
   cheapest edits from all four states, which gives a map of states; prefixes of these maps, composed by doubling, give
   the state in which a chunk is entered.
3. Chunks write their edits and repaired rows; a streaming pass in order joins them, in constant memory but for the audit.

Vectors are few (differences are at most ten), so one step is a lookup by vector and row symbol. Rows that must be
deleted cost the same in every state and take no part in the steps. Whole texts go through one range shuffle; those of
cut conversations through one more, since a digest of a whole conversation is serial.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .scratch import materialize

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. Of user and assistant one may follow a state, and leads to NEXT.
NEXT = (2, 2, 3, 2)
EMITS = ("user", "user", "assistant", "user")
#: Cost from each state to an accepted end when no row is left.
END = (0, 2 * INSERT, INSERT, 0)
#: Largest chunk of one conversation.
CHUNK_ROWS, CHUNK_CHARS = 1 << 16, 4 << 20
_BLANKS = " \t\n\x0b\x0c\r"


@functools.lru_cache(None)
def step(after: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Of a row: the cost vector before it, less its minimum, and per state the letters and the state after it.

    ``symbol`` is the role's initial (x for others), upper-case if the row is truncated.
    """
    initial, extra = symbol.lower(), TRUNCATED * symbol.isupper()
    kept = [1 if initial == "s" and s == 0 else NEXT[s] if initial == EMITS[s][0] else None for s in range(4)]
    ways = [[DELETE + after[s], REROLE + extra + after[NEXT[s]]] + [extra + after[k] for k in [kept[s]] if k is not None] for s in range(4)]
    before = [min(w) for w in ways]
    before[2] = min(before[2], INSERT + before[3])
    for s in (3, 0, 1):
        before[s] = min(before[s], INSERT + before[NEXT[s]])

    def least(s: int) -> tuple[str, int]:
        if DELETE + after[s] == before[s]:
            return "D", s
        if INSERT + before[NEXT[s]] == before[s]:
            letters, end = least(NEXT[s])
            return "I" + letters, end
        if kept[s] is not None and extra + after[kept[s]] == before[s]:
            return "K", kept[s]
        return "R", NEXT[s]

    low = min(before)
    return tuple(b - low for b in before), tuple(least(s) for s in range(4))


def backward(symbols: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple[tuple[str, int], ...]]]:
    """The vector before the first of the live rows, and their choices."""
    choices = []
    for symbol in reversed(symbols):
        after, choice = step(after, symbol)
        choices.append(choice)
    return after, choices[::-1]


def _live(marks: str) -> str:
    return marks.replace("-", "").replace(".", "")


def _text_vector(v: tuple[int, ...]) -> str:
    return ",".join(str(x - min(v)) for x in v)


def _vector(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def walk(roles: list, texts: list, marks: str, choices: list, state: int) -> tuple[str, list[str], int, int]:
    """Letters, repaired rows, cost and last state, from the state in which the rows are entered."""
    letters, lines, cost, live = [], [], 0, iter(choices)
    for role, text, mark in zip(roles, texts, marks, strict=True):
        if mark == ".":
            continue
        if mark == "-":
            letters.append("D")
            continue
        edit, after = next(live)[state]
        letters.append(edit)
        for _ in edit[:-1]:
            lines.append(f"{EMITS[state]}:")
            state = NEXT[state]
        if edit[-1] != "D":
            lines.append(f"{role if edit[-1] == 'K' else EMITS[state]}:{text}")
            cost += TRUNCATED * mark.isupper()
        state = after
    edits = "".join(letters)
    return edits, lines, cost + edits.count("D") * DELETE + edits.count("R") * REROLE + edits.count("I") * INSERT, state


def closing(state: int) -> list[str]:
    """The rows to insert at the end of a conversation."""
    return {0: [], 1: ["user:", "assistant:"], 2: ["assistant:"], 3: []}[state]


_LEGAL = {"su", "ua", "au"}


@dataclass
class Chunk:
    """Rows of one conversation in order; a dropped row has no role."""

    conv: object
    later: bool = False  # whether the same task has handed on rows of this conversation before
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    turns: list = field(default_factory=list)
    marks: list = field(default_factory=list)
    chars: int = 0

    def facts(self) -> dict:
        """Counts of the rows; repeated rows are marked here where their first one is in this chunk."""
        seen, blank, duplicate = set(), 0, 0
        for i, mark in enumerate(self.marks):
            if mark == ".":
                continue
            row = (self.roles[i], self.texts[i])
            if mark == "-":
                blank += 1
            elif row in seen:
                self.marks[i] = "-"
                duplicate += 1
            seen.add(row)
        initials = [r[:1] for r in self.roles if r is not None]
        turns = [t for t, r in zip(self.turns, self.roles, strict=True) if r is not None and t is not None]
        return {
            "blank": blank,
            "duplicate": duplicate,
            "truncated": sum(m.isupper() for m in self.marks),
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
            "low": turns[0] if turns else None,
            "high": turns[-1] if turns else None,
            "distinct": len(set(turns)),
            "first_initial": initials[0] if initials else None,
            "last_initial": initials[-1] if initials else None,
        }


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_CHUNK = [
    ("part", pa.int32()), ("seq", pa.int32()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("marks", pa.string()), ("digests", pa.list_(pa.binary())),
    ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
]
_RESULT = [("gaps", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _digest(conv: object, role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{conv is None}:{conv}:{len(role)}:{role}:{text}".encode(), digest_size=16).digest()


def _cut(conv_type: pa.DataType, rows: int, chars: int):
    """A function of sorted rows that repairs the conversations inside a task and hands on the others as chunks."""
    schema = pa.schema([("kind", pa.int32()), ("conv", conv_type), *_CHUNK, *_RESULT])

    def whole(chunk: Chunk) -> dict:
        facts = chunk.facts()
        marks = "".join(chunk.marks)
        edits, lines, cost, state = walk(chunk.roles, chunk.texts, marks, backward(_live(marks), END)[1], 0)
        more = closing(state)
        gaps = facts["high"] - facts["low"] + 1 - facts["distinct"] if facts["low"] is not None else 0
        return {
            "kind": 0, "conv": chunk.conv, "gaps": gaps, **{c: facts[c] for c in _COUNTS},
            "cost": cost + INSERT * len(more), "audit": edits + "I" * len(more), "repaired_sha256": hashlib.sha256("\n".join(lines + more).encode()).hexdigest(),
        }

    def piece(chunk: Chunk, part: int, seq: int) -> dict:
        facts = chunk.facts()
        live = [_digest(chunk.conv, r, t) if m not in "-." else None for r, t, m in zip(chunk.roles, chunk.texts, chunk.marks, strict=True)]
        return {"kind": 1, "conv": chunk.conv, "part": part, "seq": seq, "roles": chunk.roles, "texts": chunk.texts, "marks": "".join(chunk.marks), "digests": live, **facts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, chunk, first, part, seq = [], 0, None, True, 0, 0

        def batch() -> pa.RecordBatch:
            found = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return found

        for rows_in in batches:
            for part, conv, turn, role, text, mark in zip(*(c.to_pylist() for c in rows_in.columns), strict=True):
                if chunk is None or conv != chunk.conv:
                    if chunk is not None:
                        out.append(piece(chunk, part, seq) if first or chunk.later else whole(chunk))
                        held, first, seq = held + chunk.chars, False, seq + 1
                    chunk = Chunk(conv)
                elif len(chunk.marks) >= rows or chunk.chars >= chars:
                    out.append(piece(chunk, part, seq))
                    held, chunk, seq = held + chunk.chars, Chunk(conv, True), seq + 1
                if held >= CHUNK_CHARS or len(out) >= 2000:
                    held = 0
                    yield batch()
                chunk.roles.append(role)
                chunk.texts.append(text)
                chunk.turns.append(turn)
                chunk.marks.append(mark)
                chunk.chars += len(text or "")
        if chunk is not None:
            out.append(piece(chunk, part, seq))
        if out:
            yield batch()

    return run, schema


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, mark``: the rows after the damage that their key asks for, dropped ones without role.

    ``mark``: "." dropped, "-" blank, else the role's initial or x, upper-case where the text is truncated.
    """
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(either("conv"), F.lit(":"), either("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(either("text"), ".!?", "")).when(F.col("kind") != 0, either("text"))
    role = F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, either("role"))
    rows = rows.withColumn("kind", kind).select("conv", "turn", "kind", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    last = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    mark = F.when(F.col("kind") == 0, ".").when(last == "", "-").when(last.isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    return rows.select("conv", "turn", "role", "text", mark.alias("mark"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn (nulls first), then role, the first 64 code points and a hash of the text; with their partition."""
    rows = rows.withColumn("head", F.left("text", F.lit(64))).withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "head", "hash", "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "text", "mark")


def _run_chunks(table: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on every row (a dict) of a table of chunks."""
    out = pa.schema([(f.name, _arrow(f.dataType)) for f in T._parse_datatype_string(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([work(batch.slice(i, 1).to_pylist()[0])], out)

    return table.mapInArrow(textkit.tidy(run), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def converge(live: DataFrame) -> DataFrame:
    """``live`` (cid, k, symbols) with ``after``: each chunk's vector from behind, right but for a constant.

    Speculative vectors first; then every pass hands on what the next chunk has found, until no vector changes.
    """
    end = _text_vector(END)
    schema = "cid long, k int, symbols string, after string, before string"

    def again(row: dict) -> dict:
        before = row["before"] if row["same"] else _text_vector(backward(row["symbols"], _vector(row["after"]))[0])
        return {"cid": row["cid"], "k": row["k"], "symbols": row["symbols"], "after": row["after"], "before": before}

    state = live.withColumn("after", F.lit(end)).withColumn("before", F.lit(None).cast("string")).withColumn("same", F.lit(False))
    following = Window.partitionBy("cid").orderBy("k")
    while True:
        state = materialize(_run_chunks(state, again, schema), "vectors")
        state = state.withColumn("found", F.coalesce(F.lead("before").over(following), F.lit(end)))
        state = state.withColumn("same", F.col("found") == F.col("after"))
        if state.where(~F.col("same")).isEmpty():
            return state.select("cid", "k", "symbols", "after")
        state = state.select("cid", "k", "symbols", F.col("found").alias("after"), "before", "same")


def entered(maps: DataFrame) -> DataFrame:
    """``cid, k, state``: the state after chunk k, from ``map`` (a digit for each state), by prefix doubling."""
    most = maps.agg(F.max("k")).first()[0] or 0
    apart = 1
    while apart <= most:
        earlier = maps.select("cid", (F.col("k") + apart).alias("k"), F.col("map").alias("earlier"))
        then = [F.substring("map", F.substring("earlier", s + 1, 1).cast("int") + 1, F.lit(1)) for s in range(4)]
        joined = F.when(F.col("earlier").isNull(), F.col("map")).otherwise(F.concat(*then))
        maps = materialize(maps.join(earlier, ["cid", "k"], "left").select("cid", "k", joined.alias("map")), "states")
        apart *= 2
    return maps.select("cid", "k", F.substring("map", 1, 1).cast("int").alias("state"))


def _join_chunks(chunks: DataFrame) -> DataFrame:
    """The results of the conversations that lie in several chunks (or may)."""
    place = F.col("part").cast("long") * (1 << 31) + F.col("seq")
    own = Window.partitionBy("conv")
    names = chunks.select("conv", "part", "seq", place.alias("place"), F.min(place).over(own).alias("cid"), *_COUNTS, "low", "high", "distinct", "first_initial", "last_initial")
    names = materialize(names, "chunk-names")

    # a row that an earlier chunk has too
    digests = chunks.select(place.alias("place"), F.posexplode("digests").alias("at", "digest")).where(F.col("digest").isNotNull())
    first = digests.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = digests.join(first, "digest").where("place > first").groupBy("place").agg(F.collect_list("at").alias("again"))
    facts = names.select("place", "cid").join(again, "place", "left")
    marked = chunks.select(place.alias("place"), "marks").join(facts, "place")

    def mark(row: dict) -> dict:
        marks = list(row["marks"])
        for i in row["again"] or ():
            marks[i] = "-"
        marks = "".join(marks)
        return {"place": row["place"], "cid": row["cid"], "marks": marks, "symbols": _live(marks), "n_again": len(row["again"] or ()), "n_cut": sum(m.isupper() for m in marks)}

    marked = materialize(_run_chunks(marked, mark, "place long, cid long, marks string, symbols string, n_again long, n_cut long"), "marks")
    number = F.row_number().over(Window.partitionBy("cid").orderBy("place"))
    live = materialize(marked.where("symbols <> ''").select("cid", "place", "symbols", number.alias("k")), "live")
    after = materialize(converge(live.select("cid", "k", "symbols")), "stitched")

    def trace(row: dict) -> dict:
        choices = backward(row["symbols"], _vector(row["after"]))[1]
        ends = list(range(4))
        for choice in choices:
            ends = [choice[s][1] for s in ends]
        return {"cid": row["cid"], "k": row["k"], "map": "".join(map(str, ends))}

    left = materialize(entered(materialize(_run_chunks(after, trace, "cid long, k int, map string"), "maps")), "left")
    start = left.select("cid", (F.col("k") + 1).alias("k"), F.col("state").alias("state"))
    known = live.select("cid", "k", "place").join(after.select("cid", "k", "after"), ["cid", "k"]).join(start, ["cid", "k"], "left")
    known = known.select("place", "after", F.coalesce("state", F.lit(0)).alias("state"))

    def emit(row: dict) -> dict:
        choices = backward(row["symbols"], _vector(row["after"]))[1] if row["symbols"] else []
        edits, lines, cost, _ = walk(row["roles"], row["texts"], row["marks"], choices, row["state"] or 0)
        return {"cid": row["cid"], "place": row["place"], "edits": edits, "lines": "\n".join(lines) if lines else None, "cost": cost}

    pieces = chunks.select(place.alias("place"), "roles", "texts").join(marked, "place").join(known, "place", "left")
    pieces = _run_chunks(pieces, emit, "cid long, place long, edits string, lines string, cost long")
    last = left.groupBy("cid").agg(F.max_by("state", "k").alias("last"))
    pieces = materialize(pieces.join(last, "cid", "left").select("cid", "place", "edits", "lines", "cost", F.coalesce("last", F.lit(0)).alias("last")), "pieces")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cid", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        own, seen, audit, cost, digest, state = None, False, [], 0, None, 0

        def finish() -> pa.RecordBatch:
            for line in closing(state):
                digest.update(("\n" * (seen or line != closing(state)[0]) + line).encode())
            more = len(closing(state))
            return pa.RecordBatch.from_pylist([{"cid": own, "cost": cost + INSERT * more, "audit": "".join(audit) + "I" * more, "repaired_sha256": digest.hexdigest()}], schema)

        for batch in batches:
            for row in range(batch.num_rows):
                cid, _, edits, lines, more, last = (c[row].as_py() for c in batch.columns)
                if cid != own:
                    if own is not None:
                        yield finish()
                    own, seen, audit, cost, digest = cid, False, [], 0, hashlib.sha256()
                state, cost = last, cost + more
                audit.append(edits)
                if lines is not None:
                    digest.update(("\n" * seen + lines).encode())
                    seen = True
        if own is not None:
            yield finish()

    repaired = pieces.repartition("cid").sortWithinPartitions("cid", "place").mapInArrow(textkit.tidy(gather), "cid long, cost long, audit string, repaired_sha256 string")

    order = Window.partitionBy("cid").orderBy("place")
    inner = names.join(marked.select("place", "n_again", "n_cut"), "place")
    rows = inner.where(F.col("first_initial").isNotNull()).withColumn("before", F.lag("last_initial").over(order))
    seams = rows.where(F.col("before").isNotNull() & ~F.concat("before", "first_initial").isin(*_LEGAL)).groupBy("cid").agg(F.count(F.lit(1)).alias("seams"))
    turns = inner.where(F.col("low").isNotNull()).withColumn("same", (F.lag("high").over(order) == F.col("low")).cast("int"))
    turns = turns.groupBy("cid").agg((F.max("high") - F.min("low") + 1 - F.sum("distinct") + F.coalesce(F.sum("same"), F.lit(0))).alias("gaps"))
    sums = [F.sum("blank").alias("blank"), (F.sum("duplicate") + F.sum("n_again")).alias("duplicate"), F.sum("n_cut").alias("truncated"), F.sum("illegal").alias("illegal")]
    counts = inner.groupBy("conv", "cid").agg(*sums)
    found = counts.join(turns, "cid", "left").join(seams, "cid", "left").join(repaired, "cid")
    illegal = F.col("illegal") + F.coalesce("seams", F.lit(0))
    return found.select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", illegal.alias("illegal"), "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation: ``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are damaged first, as the contract says. Null role and text count as one space, null turns come first, and null
    conversation ids are one conversation. Rows of one turn go by role, then by the first 64 code points and a hash
    of their text; rows repeated in full count one by one. A conversation whose rows are all dropped has zeros, an empty audit
    and the digest of an empty string. Turns are whole numbers. Other columns are not looked at. An empty table gives
    an empty result.
    """
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    run, schema = _cut(_arrow(own.schema["conv"].dataType), chunk_rows, CHUNK_CHARS)
    kind = own.schema["conv"].dataType.simpleString()
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.list_(pa.binary()): "array<binary>"}
    ddl = ", ".join(f"{f.name} {kind if f.name == 'conv' else names[f.type]}" for f in schema)
    cut = materialize(_ordered(damaged(own)).mapInArrow(textkit.tidy(run), ddl), "conversations")
    results = [name for name, _ in _RESULT]
    found = cut.where("kind = 0").select("conv", *results).unionByName(_join_chunks(cut.where("kind = 1")))
    return found.withColumnRenamed("conv", conv_col)


#: DuckDB SQL for the query over ``conversations``: the same costs by a forward table over (row, state).
ORACLE = r"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295,
           list_transform(range(1, octet_length(k) + 1), lambda i: ('0x' || substr(hex(k), 2 * i - 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crcs),
rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM rows),
faults AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) || role[1] AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
moves(s, t, edit, emits) AS (VALUES
  (0, 2, 'R', 'user'), (1, 2, 'R', 'user'), (2, 3, 'R', 'assistant'), (3, 2, 'R', 'user')),
inserts(s, t, edits, cost, body) AS (VALUES
  (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 5, chr(10) || 'user:'), (1, 2, 'I', 5, chr(10) || 'user:'), (2, 3, 'I', 5, chr(10) || 'assistant:'), (3, 2, 'I', 5, chr(10) || 'user:'),
  (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')),
best AS (
  SELECT conv_id, 0::BIGINT AS p, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS body FROM counts
  UNION ALL
  SELECT conv_id, p, s, min(w).cost, min(w).audit, min(w).body FROM (
    SELECT b.conv_id, f.p, e.s, {cost: b.cost + i.cost + e.cost, audit: b.audit || i.edits || e.edit, body: b.body || i.body || e.body} AS w
    FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.p = b.p + 1
    JOIN inserts i ON i.s = b.s,
    LATERAL (
      SELECT i.t AS s, 'D' AS edit, 2 AS cost, '' AS body
      UNION ALL
      SELECT m.t, 'R', 1 + 5 * f.cut::INT, chr(10) || m.emits || ':' || f.text FROM moves m WHERE m.s = i.t AND NOT f.blank AND NOT f.again
      UNION ALL
      SELECT m.t, 'K', 5 * f.cut::INT, chr(10) || f.role || ':' || f.text FROM moves m WHERE m.s = i.t AND f.role[1] = m.emits[1] AND NOT f.blank AND NOT f.again
      UNION ALL
      SELECT 1, 'K', 5 * f.cut::INT, chr(10) || f.role || ':' || f.text WHERE i.t = 0 AND f.role[1] = 's' AND NOT f.blank AND NOT f.again) e)
  GROUP BY conv_id, p, s),
ends AS (
  SELECT b.conv_id, min({cost: b.cost + i.cost, audit: b.audit || i.edits, body: b.body || i.body}) AS w
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.p
  JOIN inserts i ON i.s = b.s WHERE i.t IN (0, 3) GROUP BY b.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0) AS cost,
       coalesce(w.audit, '') AS audit, sha256(coalesce(w.body[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
