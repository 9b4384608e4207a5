"""Personal data, sharding, exact dedup: against plain Python, on awkward rows."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from changelens.llm import exact_dedup, pii, sharding

SCHEMA = "doc_id long, text string, digest string, key string, bits long"  # extra columns with names used inside


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)


# ---- personal data: the contract's patterns, run by Python's engine
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expected(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def test_base_spans_equal_the_plain_patterns(spark):
    draw = random.Random(3)
    texts = [None, "", " ", "é😀 a.b@c.de 1.2.3.4", "a@b.c_x@y.z", "a@b@c.d.", "@@", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.001", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (017) 555-7713", "+()()", "+1 2+3 45678901", "x" * 50_000 + "@y.z", "1" * 50_000]
    texts += ["".join(draw.choice("a1.@-+ ()9é5") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    found = pii.find_pii(docs_of(spark, texts)).select("doc_id", pii.span_text(F.col("base")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in found} == {i: expected(t) for i, t in enumerate(texts)}


def test_trees_add_secrets_and_leave_plain_numbers(spark):
    draw = random.Random(5)
    hexes = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    texts = [f'say token = "{hexes()}" now' for _ in range(200)] + [f"in {draw.randint(1900, 2020)} there were {draw.randint(10**6, 10**7)} of them" for _ in range(200)]
    found = pii.find_pii(docs_of(spark, texts)).collect()
    extra = {r["doc_id"]: [s["kind"] for s in r["extra"]] for r in found}
    assert all(extra[i] == ["secret_like"] for i in range(200))
    assert all(not extra[i] for i in range(200, 400))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, [texts[0], "mail a.b@c.de or 1.2.3.4", None])).collect()}
    assert clean[1] == "mail [EMAIL] or [IP]" and clean[2] is None


def test_pii_of_no_rows(spark):
    assert pii.find_pii(docs_of(spark, [])).collect() == []


def test_native_operators_run_no_python(spark):
    docs = docs_of(spark, ["a", "b c", "a "])
    for df in (pii.find_pii(docs), exact_dedup.exact_dedup(docs), sharding.extendible_shards(docs, 100)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- exact dedup


def test_exact_dedup_of_awkward_and_frequent_rows(spark):
    draw = random.Random(1)
    texts = [None, "", " \t\n\x0b\x0c\r", "a b", "ab", "a  b", "A b", "é x", " "] + ["hot text"] * 500 + ["hot  text"] * 3
    texts += ["".join(draw.choice("ab \n") for _ in range(draw.randint(0, 6))) for _ in range(600)] + ["z" * 200_000]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, "a b")]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "doc_id long, text string, digest string, points int")
    found = exact_dedup.exact_dedup(df, top=64, tracked=128).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i if i is not None else float("inf"), i))
    want = []
    for norm, members in groups.items():
        keep = min(members)[2]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, _, i in members]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []


# ---- sharding


def test_shards_fit_and_cover(spark):
    draw = random.Random(2)
    texts = [None, "", "x" * 5000] + ["y" * draw.randint(0, 90) for _ in range(800)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(17, "z" * 60)] * 40 + [(None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.extendible_shards(df, 1000).collect()
    assert len(found) == len(rows)
    sizes, members = {}, {}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
        members[r["shard"]] = members.get(r["shard"], 0) + 1
    assert all(s <= 1000 or members[k] == 1 for k, s in sizes.items())
    plain = {r["shard"]: r["depth"] for r in found if r["shard"].endswith(":0")}
    parents = {}
    for shard, depth in plain.items():
        parents.setdefault((depth - 1, int(shard.split(":")[1]) >> 1), 0)
    assert len(sizes) < 200  # splits only what is too large
    assert sharding.extendible_shards(df.limit(0), 1000).collect() == []


@pytest.mark.parametrize("limit", [10**9, 200])
def test_shard_depth_is_the_shortest_that_fits(spark, limit):
    rows = [(i, "t" * (i % 50)) for i in range(500)]
    found = {r["doc_id"]: r["depth"] for r in sharding.extendible_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()}
    bits = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) for i, _ in rows}
    for i, _ in rows[:60]:
        depth = next(d for d in range(33) if sum(len(t) for j, t in rows if bits[j] >> (32 - d) == bits[i] >> (32 - d)) <= limit)
        assert found[i] == depth


def test_directory_goes_as_deep_as_it_takes(spark):
    """Ids whose hashes share many bits are told apart by further ones, as in the operator's own SQL."""
    bits = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) for i in range(60_000)}
    ordered = sorted(bits, key=bits.get)
    close = sorted(zip(ordered, ordered[1:], strict=False), key=lambda p: bits[p[0]] ^ bits[p[1]])[:12]
    ids = sorted({117, 211, *(i for p in close for i in p)})
    assert max(32 - (bits[a] ^ bits[b]).bit_length() for a, b in close) >= 24
    df = spark.createDataFrame([(i, "x" * 70, "y") for i in ids], "doc_id long, text string, bits string")
    found = sorted(map(tuple, sharding.extendible_shards(df, 100).collect()))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, "x" * 70) for i in ids])
    assert found == sorted(con.sql(sharding.oracle(100)).fetchall())


def test_free_spans_against_brute_force(spark):
    draw = random.Random(11)
    cases = []
    for i in range(60):
        spans = lambda n: [(a, a + draw.randint(1, 6)) for a in (draw.randint(0, 80) for _ in range(n))]
        cases.append((i, spans(draw.randint(0, 9)), spans(draw.randint(0, 30))))
    df = spark.createDataFrame(cases, "id long, base array<struct<s:int,e:int>>, loose array<struct<s:int,e:int>>")
    got = {r["id"]: sorted(map(tuple, r["free"])) for r in df.select("id", pii.free_of(F.col("base"), F.col("loose"), "struct<s:int,e:int>").alias("free")).collect()}
    want = {i: sorted(c for c in loose if not any(s < c[1] and c[0] < e for s, e in base)) for i, base, loose in cases}
    assert got == want


def test_pii_trees_add_disturbed_formats(spark):
    """Mail addresses with spaces around the "@", after words that announce one, are found though no strict pattern takes them."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    texts = [f"{word()} contact: {word()}@{word()}.org and {word()} {word()} on {draw.randint(10**6, 10**7)}" for _ in range(300)]
    texts += [f"{word()} contact: {word()} @ {word()}.org {word()}" for _ in range(5)]
    rows = pii.find_pii(docs_of(spark, texts)).collect()
    extra = {r["doc_id"]: [s["kind"] for s in r["extra"]] for r in rows}
    assert sum(extra[i] == ["mail_like"] for i in range(300, 305)) == 5
    assert not any(extra[i] for i in range(300))


def test_pii_of_a_very_long_text(spark):
    text = "12 34.5 a@b.co " * 12_000
    (row,) = pii.find_pii(docs_of(spark, [text])).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).collect()
    assert row["n"] == 12_000 and (row["last"]["s"], row["last"]["e"]) == (len(text) - 7, len(text) - 1)
