"""Credential redaction over nested schemas, request building, and validation of model outputs. Columns only."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what a stored access token looks like, and what replaces it.
TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})"
REDACTED = "[REDACTED]"


def redact_column(value: Column, kind: T.DataType, pattern: str = TOKEN, mark: str = REDACTED) -> Column:
    """``value`` with every string in it redacted, however deep; types and nulls stay."""
    if isinstance(kind, T.StringType):
        return F.regexp_replace(value, pattern, mark.replace("$", r"\$"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_column(x, kind.elementType, pattern, mark))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: redact_column(v, kind.valueType, pattern, mark))
    if isinstance(kind, T.StructType):
        fields = [redact_column(value[f.name], f.dataType, pattern, mark).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact(df: DataFrame, pattern: str = TOKEN, mark: str = REDACTED) -> DataFrame:
    return df.select(*[redact_column(F.col(f"`{f.name}`"), f.dataType, pattern, mark).alias(f.name) for f in df.schema.fields])


def occurrences(value: Column, kind: T.DataType, pattern: str = TOKEN) -> Column:
    """How often the pattern is found in all strings of ``value``."""
    zero = F.lit(0)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.regexp_count(value, F.lit(pattern)), zero)
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(F.transform(value, lambda x: occurrences(x, kind.elementType, pattern)), F.array().cast("array<int>")), zero, lambda a, b: a + b)
    if isinstance(kind, T.MapType):
        return occurrences(F.map_values(value), T.ArrayType(kind.valueType), pattern)
    if isinstance(kind, T.StructType):
        return sum((occurrences(value[f.name], f.dataType, pattern) for f in kind.fields), zero)
    return zero


def clean(value: Column, limit: int = 6000) -> Column:
    """White space squeezed, ends trimmed, cut to ``limit`` characters."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), F.lit(limit))


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with keys in alphabetical order; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def review_requests(texts: DataFrame, threads: DataFrame, keys: Sequence[str] = ("pr_id", "text_id")) -> DataFrame:
    """``texts`` (pr_id, text_id, body) with the context of their thread (text_id, path, line, hunk), request_id and input_hash."""
    joined = texts.join(threads, "text_id", "left")
    evidence = {"body": clean(F.col("body")), "path": F.col("path"), "line": F.col("line"), "hunk": clean(F.col("hunk"), 2000)}
    request = F.concat_ws(":", *keys)
    return joined.select(
        *keys,
        request.alias("request_id"),
        F.struct(*[c.alias(k) for k, c in sorted(evidence.items())]).alias("evidence"),
        canonical_hash(evidence | {"request_id": request}).alias("input_hash"),
    )


def evidence_contexts(states: DataFrame, threads: DataFrame) -> DataFrame:
    """``change_id, text_id, context``: what surrounds a review text, one row per text.

    ``states`` has change_id, text_id, review_state; ``threads`` change_id, text_id, path, line, original_line, is_outdated,
    is_resolved, diff_hunk. A text of a thread has the thread's fields and no review state. Of several rows for one text
    the smallest of its thread rows, else of its states, is taken; rows without an id give no context.
    """
    kinds = {"diff_hunk": "string", "is_outdated": "boolean", "is_resolved": "boolean", "line": "long", "original_line": "long", "path": "string", "review_state": "string"}

    def rows(df: DataFrame, rank: int, **given: Column) -> DataFrame:
        context = F.struct(*[given.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])
        return df.where("change_id is not null and text_id is not null").select("change_id", "text_id", F.struct(F.lit(rank).alias("rank"), context.alias("context")).alias("c"))

    thread = {k: F.col(k) for k in ("path", "line", "original_line", "is_outdated", "is_resolved")} | {"diff_hunk": clean(F.col("diff_hunk"), 2500)}
    both = rows(threads, 0, **thread).unionByName(rows(states, 1, review_state=F.col("review_state")))
    return both.groupBy("change_id", "text_id").agg(F.min("c").alias("c")).select("change_id", "text_id", F.col("c.context").alias("context"))


def classification_requests(reviews: DataFrame, changes: DataFrame, contexts: DataFrame, prompt_version: str, contract: dict, instructions: str = "") -> DataFrame:
    """One row per review of a known change: ``request_id, change_id, review_id, evidence, input_hash, prompt``.

    ``reviews`` has change_id, place (its number within the change), review_id, source, url, author, created_at, body;
    ``changes`` change_id, url, repository, number, title, body, agent; ``contexts`` is of ``evidence_contexts``. A review
    without an id is named by a hash of source, text and place. The hash covers the version of the prompt, the contract and
    all evidence, in JSON with sorted keys and nulls, so a change of any of them makes a request new. Reviews of unknown
    changes have no evidence and give no request. A text without context keeps null fields.
    """
    body, source = clean(F.col("body")), F.coalesce("source", F.lit("unknown"))
    own = F.substring(F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit("\0"), body, F.lit("\0"), F.col("place").cast("string")), 256), 1, 20)
    texts = reviews.select("change_id", F.coalesce(F.nullif(F.col("review_id").cast("string"), F.lit("")), own).alias("text_id"), source.alias("source"), "url", "author", "created_at", body.alias("body"))
    about = changes.select("change_id", F.struct(
        F.coalesce("agent", F.lit("unknown")).alias("agent_signal"),
        clean(F.col("body"), 1000).alias("body_context"),
        F.coalesce(F.col("number").cast("long"), F.lit(0)).alias("number"),
        F.coalesce("repository", F.lit("")).alias("repository"),
        clean(F.col("title"), 500).alias("title"),
        "url",
    ).alias("change"))
    joined = texts.join(about, "change_id").join(contexts, ["change_id", "text_id"], "left")
    review = F.struct("author", "body", "context", "created_at", F.col("text_id").alias("id"), "source", "url")
    joined = joined.select("change_id", "text_id", "source", F.struct("change", review.alias("review")).alias("evidence"))
    evidence = F.to_json("evidence", {"ignoreNullFields": "false"})
    plain = lambda v: F.lit(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    canonical = F.concat(F.lit('{"evidence":'), evidence, F.lit(',"prompt_version":'), plain(prompt_version), F.lit(',"schema":'), plain(contract), F.lit("}"))
    return joined.select(
        F.concat_ws(":", "change_id", "source", "text_id").alias("request_id"),
        "change_id",
        F.col("text_id").alias("review_id"),
        "evidence",
        F.sha2(canonical, 256).alias("input_hash"),
        F.concat(F.lit(instructions), F.lit("\n"), plain(contract), F.lit("\n"), evidence).alias("prompt"),
    )


# The contract of a label.
CATEGORIES = (
    "functional_bug implementation_deviation design_maintainability insufficient_testing duplication_redundancy "
    "other_code_issue compatibility edge_case documentation security"
).split()
NO_ISSUE = "non_code_issue"
SEVERITIES = ("high", "medium", "low", "unknown")
ALIASES = {"documentation_issue": "documentation", "style_convention": "other_code_issue", "performance": "other_code_issue"}
LABEL_SCHEMA = "is_code_issue boolean, categories array<string>, severity string, confidence double, evidence_quote string, rationale string"


def parse_label(content: Column) -> Column:
    """The label in a model's answer, with or without a code fence; null if it is no JSON object."""
    bare = F.regexp_replace(F.trim(content), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, LABEL_SCHEMA, {"mode": "PERMISSIVE"})


def folded(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def validate_label(
    label: Column, body: Column, categories: Sequence[str] = CATEGORIES, severities: Sequence[str] = SEVERITIES, aliases: dict[str, str] = ALIASES
) -> tuple[Column, Column]:
    """The label in normal form, and an array of what is wrong with it (empty: accepted).

    Aliases are mapped and listed as normalizations, categories are distinct in order, texts are squeezed and cut.
    """
    known = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    given = label["categories"]
    mapped = F.array_distinct(F.transform(given, lambda c: F.coalesce(known[c], c)))
    quote, rationale = clean(label["evidence_quote"], 400), clean(label["rationale"], 500)
    changed = F.transform(F.filter(given, lambda c: F.map_contains_key(known, c)), lambda c: F.concat(c, F.lit("->"), known[c]))
    fixed = F.when(
        label.isNotNull(),
        F.struct(
            label["is_code_issue"].alias("is_code_issue"),
            mapped.alias("categories"),
            label["severity"].alias("severity"),
            F.round(label["confidence"], 4).alias("confidence"),
            quote.alias("evidence_quote"),
            rationale.alias("rationale"),
            changed.alias("normalizations"),
        ),
    )
    outside = F.size(F.array_except(mapped, F.array(*[F.lit(c) for c in categories]))) > 0
    fine = F.when(label["is_code_issue"], ~outside).otherwise(mapped == F.array(F.lit(NO_ISSUE)))
    rules = {
        "is_code_issue": label["is_code_issue"].isNull(),
        "no_categories": F.coalesce(F.size(given), F.lit(0)) <= 0,
        "categories": label["is_code_issue"].isNotNull() & (F.coalesce(F.size(given), F.lit(0)) > 0) & ~F.coalesce(fine, F.lit(False)),
        "severity": ~F.coalesce(label["severity"].isin(*severities), F.lit(False)),
        "confidence": ~F.coalesce(label["confidence"].between(0, 1), F.lit(False)),
        "quote_not_in_body": (quote == "") | ~F.coalesce(F.contains(folded(body), folded(quote)), F.lit(False)),
        "rationale": rationale == "",
    }
    return fixed, F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
