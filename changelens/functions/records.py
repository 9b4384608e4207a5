"""Row features of change documents: scope, time, actors, signals, completeness, gates. Columns only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

# What marks a repair and a bug in the two sources of documents.
REPAIR_TITLE = r"(?i)(?U)\b(fix(?:es|ed|ing)?|bugs?|regressions?|hotfix(?:es)?)\b"
BUG_LABELS = ("bug", "bugfix", "typebug", "kindbug", "typebugfix")
#: Branch prefixes, signatures and logins of coding agents.
BRANCH_SIGNALS = {"codex": "codex/", "copilot": "copilot/"}
BODY_SIGNALS = {"claude_code": (r"(?i)Co-Authored-By:\s*Claude\b|Generated with Claude Code", "explicit_claude_body_signature")}
AUTHOR_SIGNALS = {
    "jules": (("google-labs-jules[bot]", "google-labs-jules"), "jules_author"),
    "devin": (("devin-ai-integration[bot]", "devin-ai-integration"), "devin_author"),
}
MARKDOWN_SIGNATURE = r"(?i)Generated\s+with\s+\[Claude\s+Code\]\(https?://[^\s)]+\)"
#: What excludes a repository.
RESOURCE_LANGUAGES = ("Markdown", "Jupyter Notebook")
RESOURCE_TOPICS = "awesome awesome-list roadmap study-plan books courses coding-interview interview-prep interview-practice interview-preparation".split()
RESOURCE_DESCRIPTION = r"\b(curated list|collective list|list of|study plan|roadmaps|skills for real engineers|freely available programming books)\b"
#: The wider pattern and names of the cross-repository corpus.
CORPUS_REPAIR_TITLE = r"(?i)(?U)\b(fix(?:es|ed|ing)?|bug(?:fix)?|regression|hotfix)\b"
CORPUS_BUG_LABELS = ("bug", "bugfix", "bugfixes", "typebug", "kindbug", "typebugfix", "hotfix", "typehotfix")


def share(part: Column, whole: Column) -> Column:
    """A percentage; null where there is nothing to divide by."""
    return F.when(whole != 0, F.lit(100.0) * part.cast("double") / whole.cast("double"))


def changed_lines(additions: Column, deletions: Column) -> Column:
    return additions + deletions


def cross_file(changed_files: Column) -> Column:
    return changed_files >= 2


def quarter(when: Column) -> Column:
    return F.concat(F.year(when).cast("string"), F.lit("Q"), F.quarter(when).cast("string"))


def month(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM")


def in_window(when: Column, start: Column, end: Column) -> Column:
    """Half-open; a missing time is outside."""
    return F.coalesce((when >= start) & (when < end), F.lit(False))


def elapsed(start: Column, end: Column, unit_seconds: int) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(unit_seconds * 1_000_000.0)


def age_days(created: Column, collected: Column) -> Column:
    return elapsed(created, collected, 86_400)


def merge_minutes(created: Column, merged: Column) -> Column:
    return elapsed(created, merged, 60)


def bins(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((value > low) & (value <= high), label).otherwise(out)
    return out


def is_human(login: Column, kind: Column, any_case: bool = False) -> Column:
    """A login that is there, is not of type Bot and does not end in [bot]; ``any_case`` folds the type's case."""
    bot = (F.lower(kind) == "bot") if any_case else (kind == "Bot")
    return F.coalesce(F.trim(login) != "", F.lit(False)) & ~F.coalesce(bot, F.lit(False)) & ~F.lower(F.coalesce(login, F.lit(""))).endswith("[bot]")


def repair_title(title: Column, pattern: str = REPAIR_TITLE) -> Column:
    return F.coalesce(title.rlike(pattern), F.lit(False))


def bug_label(labels: Column, names: Sequence[str] = BUG_LABELS) -> Column:
    return F.coalesce(F.exists(labels, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "").isin(*names)), F.lit(False))


def agent_evidence(branch: Column, body: Column, author: Column, markdown: bool = False) -> Column:
    """map<agent, evidence> from branch prefix, body signature and author; ``markdown`` also takes linked signatures."""
    branch, body, author = F.lower(F.coalesce(branch, F.lit(""))), F.coalesce(body, F.lit("")), F.lower(F.coalesce(author, F.lit("")))
    seen = {a: F.when(branch.startswith(p), "head:" + p) for a, p in BRANCH_SIGNALS.items()}
    for agent, (pattern, said) in BODY_SIGNALS.items():
        seen[agent] = F.when(body.rlike(pattern), said)
        if markdown:
            seen[agent] = F.coalesce(seen[agent], F.when(body.rlike(MARKDOWN_SIGNATURE), "markdown_claude_body_signature"))
    seen |= {a: F.when(author.isin(*logins), said) for a, (logins, said) in AUTHOR_SIGNALS.items()}
    return F.map_filter(F.create_map(*[x for a, c in seen.items() for x in (F.lit(a), c)]), lambda _, v: v.isNotNull())


def agent_names(evidence: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(evidence)), "|")


def search_agents(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["agent"])))


def assigned_agent(label: Column, signals: Column) -> Column:
    """The manifest's agent, else the only signal, else unknown."""
    return F.coalesce(label, F.when(F.size(signals) == 1, signals[0]), F.lit("multiple_or_unknown"))


def files_complete(listed: Column, truncated: Column, declared: Column) -> Column:
    """Not truncated, no path twice, and as many as declared."""
    n = F.size(listed)
    return ~F.coalesce(truncated, F.lit(False)) & (F.size(F.array_distinct(F.transform(listed, lambda f: f["path"]))) == n) & (n == declared)


def files_reconcile(listed: Column, additions: Column, deletions: Column) -> Column:
    total = lambda name: F.aggregate(listed, F.lit(0).cast("long"), lambda acc, f: acc + F.coalesce(f[name], F.lit(0)))
    return (total("additions") == additions) & (total("deletions") == deletions)


def source_measures(
    listed: Column,
    complete: Column,
    kind: Callable[[Column], Column] = lambda f: paths.file_kind(f["path"]),
    folder: Callable[[Column], Column] = lambda f: paths.parent_directory(f["path"]),
) -> dict[str, Column]:
    """Counts over source files, null unless the list is complete: unknown is not zero.

    Give ``kind`` and ``folder`` where the list holds them already: inside an array nothing that is parsed is shared.
    """
    source = F.filter(listed, lambda f: kind(f) == "source_candidate")
    lines = F.aggregate(source, F.lit(0).cast("long"), lambda acc, f: acc + f["additions"] + f["deletions"])
    folders = F.size(F.array_distinct(F.transform(listed, folder)))
    return {
        "source_files": F.when(complete, F.size(source).cast("long")),
        "source_lines": F.when(complete, lines),
        "listed_directories": F.when(complete, folders.cast("long")),
        "source_cross_file": F.when(complete, F.size(source) >= 2),
    }


def human_texts(reviews: Column, comments: Column, threads: Column, author: Column) -> Column:
    """Texts of people other than the author from reviews, comments and threads, in that order, with their source."""

    def tagged(events: Column, source: str) -> Column:
        return F.transform(
            F.coalesce(events, F.array()),
            lambda e: F.struct(F.lit(source).alias("source"), e["id"].alias("id"), e["body"].alias("body"), e["createdAt"].alias("createdAt"), e["author"]["login"].alias("login"), e["author"]["__typename"].alias("kind")),
        )

    inline = F.flatten(F.transform(F.coalesce(threads, F.array()), lambda t: t["comments"]))
    everything = F.concat(tagged(reviews, "review"), tagged(comments, "comment"), tagged(inline, "inline"))
    return F.filter(everything, lambda e: is_human(e["login"], e["kind"], True) & F.coalesce(F.trim(e["body"]) != "", F.lit(False)) & ~F.lower(e["login"]).eqNullSafe(F.lower(author)))


def review_gate(state: Column, merged_at: Column, decision: Column, texts: Column, open_threads: Column, base: Column, head: Column) -> Column:
    """The reasons why a change is no candidate; empty for one that is."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = {
        "not_merged": ~state.eqNullSafe("MERGED") | merged_at.isNull(),
        "not_approved": ~decision.eqNullSafe("APPROVED"),
        "no_non_author_human_review_text": F.coalesce(texts, F.lit(0)) == 0,
        "active_unresolved_review_thread": F.coalesce(open_threads, F.lit(0)) > 0,
        "missing_base_or_head_oid": blank(base) | blank(head),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))


def repository_exclusion(language: Column, topics: Column, description: Column) -> Column:
    """Why a repository is no software project; empty if it may be one."""
    return (
        F.when(language.isNull() | language.isin(*RESOURCE_LANGUAGES), "non_programming_primary_language")
        .when(F.coalesce(F.arrays_overlap(topics, F.array(*[F.lit(t) for t in RESOURCE_TOPICS])), F.lit(False)), "resource_or_study_repository")
        .when(F.lower(F.coalesce(description, F.lit(""))).rlike(RESOURCE_DESCRIPTION), "resource_collection_description")
        .otherwise("")
    )


def actor_flags(author: Column, merger: Column) -> dict[str, Column]:
    """Whether the author's and the merger's accounts are known, and are one; unknown accounts are not the same."""
    there = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    same = there(author) & there(merger) & F.coalesce(F.lower(author) == F.lower(merger), F.lit(False))
    return {"author_known": there(author), "merger_known": there(merger), "same_author_merger": same}


def suppressed(value: Column, n: Column, least: int = 20) -> Column:
    """``value``, or null where it rests on fewer than ``least`` rows."""
    return F.when(n >= least, value)
