"""Row features on hand-written rows: the traps of path rules, signals, completeness, redaction, labels."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from changelens.functions import paths, text
from changelens.functions import records as r


def values(spark, rows, schema, *columns):
    return [tuple(x) for x in spark.createDataFrame(rows, schema).select(*columns).collect()]


KINDS = {
    "package-lock.json": "lockfile",
    "a/Cargo.lock": "lockfile",
    "vendor/x.py": "generated_or_vendor_path",
    "src/app.min.js": "generated_or_vendor_path",
    "src/test_a.py": "test_path",
    "tests": "test_path",
    "a.spec.ts": "test_path",
    "docs/a.py": "documentation_path",
    "README": "documentation_path",
    "src/Main.JAVA": "source_candidate",
    ".github/workflows/a.txt": "configuration_path",
    "Dockerfile": "configuration_path",
    ".gitignore": "other_or_unknown",
    ".py": "other_or_unknown",
    "a.": "other_or_unknown",
    "./src//x.go": "source_candidate",
}


def test_file_kinds(spark):
    got = values(spark, [(p,) for p in KINDS] + [(None,)], "path string", "path", paths.file_kind(F.col("path")))
    assert dict(got) == KINDS | {None: None}
    parsed = paths.parse(spark.createDataFrame([(p,) for p in KINDS], "path string"))
    again = parsed.select("path", paths.file_kind(F.col("path"), paths.Parsed(struct=F.col("_p")))).collect()
    assert dict(map(tuple, again)) == KINDS


MODULE_CASES = [
    ("src/api/UserAuth.ts", "source_candidate", {"service_api": "api", "security": "file:auth"}),
    ("web/ui/page.html", "source_candidate", {"interface": "ui|extension:.html"}),
    ("site/sales-security.html", "source_candidate", {"interface": "extension:.html"}),
    ("db/migrations/1.sql", "source_candidate", {"storage": "db|migrations|extension:.sql"}),
    ("src/my.tests/api/x.py", "source_candidate", {}),
    ("src/OrderTests.cs", "source_candidate", {}),
    (".github/workflows/ci.yml", "configuration_path", {"automation": ".github/workflows"}),
    ("Makefile", "configuration_path", {"automation": "build/deploy-file:makefile"}),
    ("docs/api.md", "documentation_path", {}),
]


def test_module_evidence(spark):
    rows = [(p, k) for p, k, _ in MODULE_CASES]
    df = spark.createDataFrame(rows, "path string, kind string").select("path", paths.module_evidence(F.col("path"), F.col("kind")).alias("e"))
    assert {x["path"]: {m["module"]: m["evidence"] for m in x["e"]} for x in df.collect()} == {p: e for p, _, e in MODULE_CASES}
    strict = spark.createDataFrame(rows, "path string, kind string").select("path", paths.module_evidence(F.col("path"), F.col("kind"), True).alias("e"))
    assert {m["module"] for m in strict.collect()[0]["e"]} == {"service_api"}


def test_agents_and_assignment(spark):
    rows = [("Codex/a", None, None), (None, "x\nco-authored-by: claude <a>", "Devin-AI-Integration[bot]"), (None, "Generated with [Claude Code](https://x.y)", "me"), (None, None, None)]
    one = r.agent_evidence(F.col("b"), F.col("t"), F.col("a"))
    two = r.agent_evidence(F.col("b"), F.col("t"), F.col("a"), markdown=True)
    got = values(spark, rows, "b string, t string, a string", r.agent_names(one), r.agent_names(two))
    assert got == [("codex", "codex"), ("claude_code|devin", "claude_code|devin"), ("", "claude_code"), ("", "")]
    signals = values(spark, [("x", ["a"]), (None, ["a"]), (None, ["a", "b"]), (None, [])], "l string, s array<string>", r.assigned_agent(F.col("l"), F.col("s")))
    assert signals == [("x",), ("a",), ("multiple_or_unknown",), ("multiple_or_unknown",)]


def test_humans_bins_windows(spark):
    got = values(spark, [("me", "User"), ("x[bot]", "User"), ("x", "Bot"), ("x", "BOT"), (" ", "User"), (None, None)], "l string, k string", r.is_human(F.col("l"), F.col("k")), r.is_human(F.col("l"), F.col("k"), True))
    assert got == [(True, True), (False, False), (False, False), (True, False), (False, False), (False, False)]
    got = values(spark, [(0,), (10,), (11,), (99,), (None,)], "v int", r.bins(F.col("v"), [-1, 10, 50], ["low", "high"]))
    assert [x for (x,) in got] == ["low", "low", "high", None, None]
    times = values(spark, [("2025-01-01",), ("2025-02-01",), (None,)], "t string", r.in_window(F.to_timestamp("t"), F.lit("2025-01-01").cast("timestamp"), F.lit("2025-02-01").cast("timestamp")))
    assert [x for (x,) in times] == [True, False, False]


def test_completeness_and_unknowns(spark):
    files = lambda *p: [{"path": x, "additions": 2, "deletions": 1} for x in p]
    rows = [(files("a.py", "b/c.py"), False, 2), (files("a.py", "a.py"), False, 2), (files("a.py"), True, 1), (files("a.py"), None, 2)]
    schema = "f array<struct<path:string,additions:bigint,deletions:bigint>>, cut boolean, n int"
    complete = r.files_complete(F.col("f"), F.col("cut"), F.col("n"))
    m = r.source_measures(F.col("f"), complete)
    got = values(spark, rows, schema, complete, m["source_files"], m["source_lines"], m["listed_directories"], m["source_cross_file"])
    assert got == [(True, 2, 6, 2, True), (False, None, None, None, None), (False, None, None, None, None), (False, None, None, None, None)]


def test_review_gate_lists_reasons(spark):
    rows = [("MERGED", "t", "APPROVED", 1, 0, "a", "b"), ("OPEN", None, None, 0, 2, "", None)]
    got = values(spark, rows, "s string, m string, d string, t int, o int, b string, h string", r.review_gate(*[F.col(c) for c in "smdtobh"]))
    assert got[0][0] == [] and len(got[1][0]) == 5


def test_redaction_reaches_nested_strings(spark):
    token = "ghp_" + "a" * 24
    row = (1, [{"x": token, "y": {"z": [token, "ok"]}}], {"k": token + token}, None)
    df = spark.createDataFrame([row], "id int, a array<struct<x:string,y:struct<z:array<string>>>>, m map<string,string>, n string")
    out = text.redact(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = out.first()
    assert got["a"][0]["x"] == "[REDACTED]" and got["a"][0]["y"]["z"] == ["[REDACTED]", "ok"] and token not in got["m"]["k"] and got["n"] is None
    n = df.select(sum((text.occurrences(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(0))).first()[0]
    assert n >= 3


@pytest.mark.parametrize(
    "content, errors",
    [
        ('{"is_code_issue": true, "categories": ["performance", "security"], "severity": "high", "confidence": 0.12345, "evidence_quote": "The  Loop", "rationale": "r"}', []),
        ('```json\n{"is_code_issue": false, "categories": ["non_code_issue"], "severity": "low", "confidence": 1, "evidence_quote": "loop", "rationale": "r"}\n```', []),
        ('{"is_code_issue": false, "categories": ["security"], "severity": "low", "confidence": 1, "evidence_quote": "loop", "rationale": "r"}', ["categories"]),
        ('{"is_code_issue": true, "categories": [], "severity": "bad", "confidence": 2, "evidence_quote": "", "rationale": " "}', ["no_categories", "severity", "confidence", "quote_not_in_body", "rationale"]),
    ],
)
def test_label_contract(spark, content, errors):
    df = spark.createDataFrame([(content, "in the loop it breaks")], "c string, b string")
    fixed, wrong = text.validate_label(text.parse_label(F.col("c")), F.col("b"))
    got = df.select(fixed.alias("f"), wrong.alias("w")).first()
    assert got["w"] == errors
    if content.startswith('{"is_code_issue": true, "categories": ["perf'):
        assert got["f"]["categories"] == ["other_code_issue", "security"] and got["f"]["normalizations"] == ["performance->other_code_issue"] and got["f"]["confidence"] == 0.1235


def test_clean_paths_equal_the_plain_patterns(spark):
    draw = random.Random(4)
    given = [None, "", "/", ".", "./", "a", *("".join(draw.choices("ab./\n", weights=[3, 2, 3, 4, 0.3], k=draw.randint(1, 9))) for _ in range(500))]
    df = spark.createDataFrame([(p,) for p in given], "path string")
    plain = F.regexp_replace(F.regexp_replace("path", r"/(?:\.?/)+", "/"), r"^(?:\./)+|/+\.?$", "")
    differ = df.where(~paths.clean_path(F.col("path")).eqNullSafe(plain) | ~paths.file_name(F.col("path")).eqNullSafe(F.regexp_extract(plain, r"([^/]*)$", 1)))
    assert differ.collect() == []


def test_every_listed_token_gives_evidence(spark):
    tokens = {
        "interface": ["ui", "gui", "renderer"],
        "service_api": ["api", "server", "controller", "router"],
        "storage": ["db", "database"],
        "security": ["auth", "authentication", "authorization", "security", "crypto", "cryptography", "oauth", "oauth2"],
    }
    rows = [(f"lib/{word}.py", module) for module, words in tokens.items() for word in words] + [("src/oauth2_client.py", "security"), ("src/MyOauthLogin.ts", "security")]
    df = paths.classified(spark.createDataFrame(rows, "path string, module string"), lambda p, kind: {"e": paths.module_evidence(F.col("path"), kind, False, p)})
    assert all([r["module"]] == [e["module"] for e in r["e"]] for r in df.collect())
    assert df.count() == len(rows)


def test_distinct_paths_are_classified_as_single_ones(spark):
    rows = [(p, i) for i, p in enumerate([*KINDS, *KINDS, None])]
    df = spark.createDataFrame(rows, "path string, i int")
    found = paths.classified(df, lambda p, kind: paths.stage_flags(F.col("path"), kind, p))
    want = df.select("path", "i", paths.file_kind(F.col("path")).alias("kind"), *[x.alias(k) for k, x in paths.stage_flags(F.col("path"), paths.file_kind(F.col("path"))).items()])
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_corpus_repairs_are_wider(spark):
    titles = ["hotfix now", "hotfixes", "Fixing it", "prefix", "éfix", "regressions", "a regression", None]
    got = values(spark, [(x, [x]) for x in titles], "t string, l array<string>", r.repair_title(F.col("t"), r.CORPUS_REPAIR_TITLE), r.bug_label(F.col("l"), r.CORPUS_BUG_LABELS))
    assert [a for a, _ in got] == [True, False, True, False, False, False, True, False]
    assert values(spark, [(["Type: Hot-Fix"],), (["bug fixes"],), (["debug"],)], "l array<string>", r.bug_label(F.col("l"), r.CORPUS_BUG_LABELS)) == [(True,), (True,), (False,)]


def test_requests_of_reviews_with_their_context(spark):
    review = "change_id long, place long, review_id string, source string, url string, author string, created_at string, body string"
    reviews = spark.createDataFrame(
        [(1, 0, "a", "thread", None, None, None, " Crashes\n on empty  input "), (1, 1, "b", "review", None, None, None, "fine"), (1, 2, None, None, None, None, None, None), (1, 3, "", None, None, None, None, None), (9, 0, "a", "x", None, None, None, "unknown change"), (None, 0, "a", "x", None, None, None, "no change")],
        review,
    )
    changes = spark.createDataFrame([(1, "u", "o/r", 7, "T" * 600, "B" * 2000, None)], "change_id long, url string, repository string, number long, title string, body string, agent string")
    states = spark.createDataFrame([(1, "a", "APPROVED"), (1, "b", "COMMENTED"), (1, None, "x")], "change_id long, text_id string, review_state string")
    schema = "change_id long, text_id string, path string, line long, original_line long, is_outdated boolean, is_resolved boolean, diff_hunk string"
    threads = spark.createDataFrame([(1, "a", "parser.py", 3, None, False, None, "@@  x" * 1000)], schema)

    def asked(version="v1", contract=None, rows=threads, about=changes):
        return {r["review_id"]: r for r in text.classification_requests(reviews, about, text.evidence_contexts(states, rows), version, contract or {"b": 1, "a": [2]}, "Label.").collect()}

    found = asked()
    own = [hashlib.sha256(f"\0\0{n}".encode()).hexdigest()[:20] for n in (2, 3)]
    assert sorted(found) == sorted(["a", "b", *own])
    a, b = found["a"]["evidence"]["review"], found["b"]["evidence"]["review"]
    assert (a["context"]["path"], a["context"]["review_state"], len(a["context"]["diff_hunk"]), a["body"]) == ("parser.py", None, 2500, "Crashes on empty input")
    assert (b["context"]["path"], b["context"]["review_state"]) == (None, "COMMENTED") and found[own[0]]["evidence"]["review"]["context"] is None
    change = found["b"]["evidence"]["change"]
    assert (len(change["title"]), len(change["body_context"]), change["agent_signal"], change["number"]) == (500, 1000, "unknown", 7)
    assert found[own[0]]["request_id"] == f"1:unknown:{own[0]}" and found["a"]["prompt"].startswith('Label.\n{"a":[2],"b":1}\n{"change":{') and "Crashes on empty input" in found["a"]["prompt"]
    hashes = {k: r["input_hash"] for k, r in found.items()}
    assert all(asked("v2")[k]["input_hash"] != h for k, h in hashes.items()) and all(asked(contract={"b": 2})[k]["input_hash"] != h for k, h in hashes.items())
    assert {k: r["input_hash"] for k, r in asked(contract={"a": [2], "b": 1}).items()} == hashes
    moved = asked(rows=threads.withColumn("is_resolved", F.lit(True)))
    assert [k for k, h in hashes.items() if moved[k]["input_hash"] != h] == ["a"]
    assert asked(about=changes.limit(0)) == {}
