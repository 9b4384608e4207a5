"""Conversation repair: against an exhaustive search, in chunks of any size, on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from changelens.llm import conversation_repair as cr

LONG = 10**9


def damaged(rows):
    """The rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def brute(rows):
    """All edit sequences with at most two inserted rows before each row and at the end."""
    rows, seen, faults = damaged(rows), set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    ways = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    for picks in itertools.product(*ways):
        base = sum(2 if p == "D" else (p[0] == "R") + 5 * (f == "truncated") for p, f in zip(picks, faults))
        if best and base > best[0]:
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, out = "", []
            for gap, pick, row in zip(gaps, (*picks, None), (*rows, None)):
                audit += "I" * len(gap)
                out += [({"u": "user", "a": "assistant"}[c], "") for c in gap]
                if pick is not None:
                    audit += pick[0]
                    if pick != "D":
                        out.append(({"K": row[1], "Ru": "user", "Ra": "assistant"}[pick], row[2]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": best[0],
        "audit": best[1],
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest(),
    }


def plain(symbols, start, end):
    """Cheapest cost and least letters from a state to a cost vector, by a forward table."""
    table = {start: (0, "")}
    for symbol in symbols:
        wide = dict(table)
        for _ in range(2):
            for s, (c, w) in list(wide.items()):
                wide[cr.NEXT[s]] = min(wide.get(cr.NEXT[s], (LONG, "")), (c + 5, w + "I"))
        table, extra = {}, 5 * symbol.isupper()
        for s, (c, w) in wide.items():
            ways = [(s, c + 2, w + "D"), (cr.NEXT[s], c + 1 + extra, w + "R")]
            if symbol.lower() == cr.EMITS[s][0]:
                ways.append((cr.NEXT[s], c + extra, w + "K"))
            if symbol.lower() == "s" and s == 0:
                ways.append((1, c + extra, w + "K"))
            for t, cost, letters in ways:
                table[t] = min(table.get(t, (LONG, "")), (cost, letters))
    return min((c + end[s], w) for s, (c, w) in table.items())


def test_steps_equal_a_forward_table():
    draw = random.Random(4)
    for _ in range(400):
        symbols = "".join(draw.choice("suaxSUAX" if draw.random() < 0.3 else "ua") for _ in range(draw.randrange(1, 25)))
        choices, start = cr.backward(symbols, cr.END)[1], draw.randrange(4)
        state, letters = start, ""
        for choice in choices:
            edit, state = choice[state]
            letters += edit
        assert letters == plain(symbols, start, cr.END)[1], (symbols, start)


def conversations(draw):
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "Ends. \n", "x.", "Well then.", "à bientôt.", "so.so"]
    rows = []
    for conv in [*range(60), None]:
        for i in range(draw.choice([1, 2, 3, 4])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "User", ""])
            rows.append((conv, draw.choice([i, i, i, 7 * i, 1, None]), role, draw.choice(texts)))
    return rows


@pytest.mark.parametrize("chunk", [1, 2, 1 << 16])
def test_repair_equals_exhaustive_search(spark, chunk):
    rows = [r for r in conversations(random.Random(8))]
    few = [r for r in rows if len(damaged([x for x in rows if x[0] == r[0]])) <= 5]
    df = spark.createDataFrame([(*r, 1, "x") for r in few], "conv_id long, turn long, role string, text string, kind int, part string")
    found = {r["conv_id"]: r.asDict() for r in cr.repair(df, chunk_rows=chunk).collect()}
    assert set(found) == {r[0] for r in few}
    for conv, got in found.items():
        assert {"conv_id": conv, **brute([r for r in few if r[0] == conv])} == got, conv


def test_one_conversation_over_many_chunks(spark):
    draw = random.Random(3)
    rows = [(5, t, draw.choice(["user", "user", "assistant", "system"]), draw.choice([f"Text {t}.", f"Text {t}", "Same.", "Same."])) for t in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = cr.repair(df).collect()
    assert len(want) == 1 and cr.repair(df, chunk_rows=7).collect() == want
    after, seen, marks = damaged(rows), set(), ""
    for _, role, text in after:
        marks += "" if (role, text) in seen or not text.strip() else role[0] if text[-1] == "." else role[0].upper()
        seen.add((role, text))
    cost = plain(marks, 0, cr.END)[0] + 2 * (len(after) - len(marks))
    assert want[0]["cost"] == cost and want[0]["audit"].count("D") + want[0]["audit"].count("K") + want[0]["audit"].count("R") == len(after)


def test_conversations_of_dropped_rows_and_none(spark):
    gone = [(c, t) for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    conv = next(c for c, _ in gone)
    df = spark.createDataFrame([(conv, t, "user", "Hi.") for c, t in gone if c == conv], "conv_id long, turn long, role string, text string")
    (row,) = cr.repair(df).collect()
    assert (row["cost"], row["audit"], row["repaired_sha256"], row["gaps"], row["blank"]) == (0, "", hashlib.sha256(b"").hexdigest(), 0, 0)
    assert cr.repair(df.limit(0)).collect() == []
