"""What a file path says: its kind, the stages it belongs to, the modules it gives evidence of. Columns only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

# Names, suffixes and directory words that decide a path's class.
SOURCE_SUFFIXES = (
    ".c .cc .cpp .cxx .h .hpp .cs .go .java .js .jsx .ts .tsx .py .rb .rs .php .swift .kt .kts .scala .vue .svelte .dart .ex .exs .erl .lua .m .mm .r .jl .sh .sql "
    ".html .css .scss .sass .less .f .f90 .pl .pm .clj .cljs .hs .ml .fs .sol .zig"
).split()
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock uv.lock cargo.lock composer.lock gemfile.lock go.sum".split()
GENERATED_PARTS = "node_modules vendor dist build generated __generated__".split()
TEST_PARTS = "test tests __tests__ spec specs testing".split()
DOCUMENT_PARTS = "doc docs documentation".split()
DOCUMENT_SUFFIXES = ".md .rst .adoc".split()
CONFIG_SUFFIXES = ".yaml .yml .json .toml .ini .cfg .xml".split()
DEPLOY_PARTS = "deploy deployment deployments k8s kubernetes helm terraform".split()
CI_NAMES = "jenkinsfile .gitlab-ci.yml .travis.yml".split()
MODULES = ("interface", "service_api", "storage", "security", "automation")
MODULE_DIRECTORIES = {
    "interface": "frontend front-end ui gui screens widgets styles css renderer webapp".split(),
    "service_api": "api apis backend back-end server servers service services controllers controller routers".split(),
    "storage": "db database databases storage migrations prisma sequelize typeorm alembic".split(),
    "security": "auth authentication authorization security crypto cryptography oauth oauth2 permissions".split(),
    "automation": "ci cicd deployment deployments docker terraform k8s kubernetes helm".split(),
}
MODULE_TOKENS = {
    "interface": "ui gui renderer".split(),
    "service_api": "api server controller router".split(),
    "storage": "db database".split(),
    "security": "auth authentication authorization security crypto cryptography oauth oauth2".split(),
}
INTERFACE_SUFFIXES = ".jsx .tsx .vue .svelte .html .css .scss .sass .less".split()
MARKUP_SUFFIXES = ".html .css .scss .sass .less".split()
BUILD_NAMES = (
    "makefile gnumakefile cmakelists.txt jenkinsfile .gitlab-ci.yml .travis.yml azure-pipelines.yml build.gradle build.gradle.kts pom.xml".split()
)
#: The suffixes and directory marks of the narrower source-or-test rule.
REVIEW_SUFFIXES = ".c .cc .cpp .cs .css .dart .ex .exs .go .h .hpp .html .java .js .jsx .kt .kts .lua .m .mm .php .pl .py .r .rb .rs .scala .sh .sql .swift .ts .tsx .vue .xml".split()
#: A suffix starts at the last dot; names that only start with dots or end with one have none.
SUFFIX = r"[^.].*?(\.[^.]+)$"
FILE_KINDS = ("lockfile", "generated_or_vendor_path", "test_path", "documentation_path", "source_candidate", "configuration_path", "other_or_unknown")


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_path(path: Column) -> Column:
    """Without empty and "." steps, as a path library sees it. Only paths that hold such a step meet the patterns."""
    clean = F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)+", "/"), r"^(?:\./)+|/+\.?$", "")
    breaks = reduce(lambda a, b: a | b, (path.contains(c) for c in ("//", "/./", "\n", "\r", "\u0085", "\u2028", "\u2029")))
    return F.when(breaks | path.startswith("./") | path.endswith("/") | path.endswith("/."), clean).otherwise(path)


def parts(path: Column) -> Column:
    return F.split(clean_path(path), "/", -1)


def directories(path: Column) -> Column:
    return F.slice(parts(path), 1, F.size(parts(path)) - 1)


def file_name(path: Column) -> Column:
    return F.substring_index(clean_path(path), "/", -1)


def suffix(path: Column) -> Column:
    """From the last dot; empty for names that only start with dots or end with one."""
    return F.regexp_extract(file_name(path), SUFFIX, 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def parent_directory(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(clean_path(path), r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


class Parsed:
    """What the rules look at. Built from a path column, or from columns that hold its parts so that nothing is parsed twice."""

    FIELDS = ("low", "parts", "dirs", "name", "suffix", "tokens")

    def __init__(self, path: Column | None = None, struct: Column | None = None, prefix: str | None = None):
        if prefix is not None:
            self.low, self.parts, self.dirs, self.name, self.suffix, self.tokens = (F.col(f"{prefix}{f}") for f in self.FIELDS)
        elif struct is not None:
            self.low, self.parts, self.dirs, self.name, self.suffix, self.tokens = (struct[f] for f in self.FIELDS)
        else:
            self.low = clean_path(F.lower(path))
            self.parts, self.dirs, self.name, self.suffix, self.tokens = F.split(self.low, "/", -1), directories(F.lower(path)), file_name(self.low), suffix(self.low), stem_tokens(path)

    def has(self, words: list[str]) -> Column:
        return F.arrays_overlap(self.parts, _words(words))


def parse(df: DataFrame, path: str = "path", name: str = "_p") -> DataFrame:
    """Adds a struct of Parsed.FIELDS under ``name``; give ``Parsed(struct=...)`` to the rules and drop it afterwards."""
    p = Parsed(F.col(path))
    flat = df.withColumns({f"{name}_low": p.low, f"{name}_name": p.name, f"{name}_parts": p.parts})
    low, last, steps = (F.col(f"{name}_{k}") for k in ("low", "name", "parts"))
    fields = {"low": low, "parts": steps, "dirs": F.slice(steps, 1, F.size(steps) - 1), "name": last, "suffix": F.regexp_extract(last, SUFFIX, 1), "tokens": p.tokens}
    return flat.withColumn(name, F.struct(*[c.alias(k) for k, c in fields.items()])).drop(f"{name}_low", f"{name}_name", f"{name}_parts")


def classified(df: DataFrame, rules: Callable[[Parsed, Column], dict[str, Column]] | None = None, path: str = "path") -> DataFrame:
    """``df`` with ``kind`` and the columns of ``rules(parsed, kind)``.

    A change record repeats few paths many times, so each distinct one is looked at once and its facts are joined back.
    The facts are written first, so that Spark knows their size when it plans the join: small ones are broadcast and no
    row of ``df`` moves, else it is a shuffle, with Spark's own handling of skewed paths. Parts that no rule asks for
    are not computed. A null path has nulls.
    """
    p = "_path_"
    own = Parsed(F.col(path))
    flat = df.select(path).where(F.col(path).isNotNull()).distinct().withColumns({f"{p}low": own.low})
    flat = flat.withColumns({f"{p}parts": F.split(f"{p}low", "/", -1), f"{p}name": F.substring_index(f"{p}low", "/", -1), f"{p}tokens": own.tokens})
    flat = flat.withColumns({f"{p}dirs": F.slice(f"{p}parts", 1, F.size(f"{p}parts") - 1), f"{p}suffix": F.regexp_extract(f"{p}name", SUFFIX, 1)})
    parsed = Parsed(prefix=p)
    flat = flat.withColumn("kind", file_kind(F.col(path), parsed))
    more = rules(parsed, F.col("kind")) if rules else {}
    facts = flat.select(path, "kind", *[c.alias(n) for n, c in more.items()])
    # paths are distinct and already dealt out by path, so this moves nothing; a filter on a fact stops here instead of
    # going down with the whole rule in it, once for each use
    facts = facts.groupBy(path).agg(*[F.first(c).alias(c) for c in facts.columns if c != path])
    return df.join(written(facts, "path-facts"), path, "left")


def file_kind(path: Column, parsed: Parsed | None = None) -> Column:
    """One of FILE_KINDS, the first rule that matches; null for null."""
    p = parsed or Parsed(path)
    name, end = p.name, p.suffix
    return (
        F.when(path.isNull(), None)
        .when(name.isin(*LOCKFILES) | name.endswith(".lock"), "lockfile")
        .when(p.has(GENERATED_PARTS) | name.rlike(r"\.min\.(js|css)$|\.g\.cs$|\.pb\.(go|cc|h)$"), "generated_or_vendor_path")
        .when(p.has(TEST_PARTS) | name.rlike(r"^test_|_test\.|\.(test|spec)\.|test\.java$"), "test_path")
        .when(end.isin(*DOCUMENT_SUFFIXES) | p.has(DOCUMENT_PARTS) | name.rlike(r"^(readme|license|changelog)"), "documentation_path")
        .when(end.isin(*SOURCE_SUFFIXES), "source_candidate")
        .when(end.isin(*CONFIG_SUFFIXES) | p.has([".github"]) | name.isin("dockerfile", "makefile"), "configuration_path")
        .otherwise("other_or_unknown")
    )


def is_container_file(name: Column) -> Column:
    return name.rlike(r"^(dockerfile|docker-compose|compose\.y)")


def stage_flags(path: Column, kind: Column, parsed: Parsed | None = None) -> dict[str, Column]:
    """Overlapping flags: a path may be in several stages."""
    p = parsed or Parsed(path)
    return {
        "code_path": kind == "source_candidate",
        "test_path": kind == "test_path",
        "ci_path": p.low.contains(".github/workflows") | p.has([".circleci"]) | p.name.isin(*CI_NAMES),
        "deployment_path": p.has(DEPLOY_PARTS) | is_container_file(p.name) | (p.suffix == ".tf"),
        "documentation_path": kind == "documentation_path",
    }


def stem_tokens(path: Column) -> Column:
    """Lower-cased words of the file's stem; CamelCase breaks are seen on the original case."""
    return F.split(F.regexp_replace(F.lower(F.regexp_replace(stem(path), r"([a-z0-9])([A-Z])", r"$1_$2")), r"[-.]", "_"), "_", -1)


def _module_rules(strict: bool, kind: Column, p: Parsed) -> list[tuple[str, Column, list[tuple[Column, Column]]]]:
    """(module, whether the file can count at all, [(condition, its evidence as an array)])."""
    dirs, end, name = p.dirs, p.suffix, p.name
    test = F.exists(dirs, lambda d: d.rlike(r"(^|[._-])(tests?|specs?)([._-]|$)")) | name.rlike(r"(tests?|specs?)\.(cs|java|kt|swift)$")

    def common(words: Column, known: list[str]) -> tuple[Column, Column]:
        return F.arrays_overlap(words, _words(known)), F.array_sort(F.array_intersect(words, _words(known)))

    found = []
    for module in MODULES[:-1]:
        seen = [common(dirs, MODULE_DIRECTORIES[module])]
        if not strict:
            hit, tokens = common(p.tokens, MODULE_TOKENS[module])
            seen.append((hit if module == "interface" else hit & ~end.isin(*MARKUP_SUFFIXES), F.transform(tokens, lambda t: F.concat(F.lit("file:"), t))))
            if module == "interface":
                seen.append((end.isin(*INTERFACE_SUFFIXES), F.array(F.concat(F.lit("extension:"), end))))
            if module == "storage":
                seen.append((end == ".sql", F.array(F.lit("extension:.sql"))))
        found.append((module, (kind == "source_candidate") & ~test, seen))
    seen = [common(dirs, MODULE_DIRECTORIES["automation"]), (F.array_contains(dirs, ".github") & F.array_contains(dirs, "workflows"), F.array(F.lit(".github/workflows")))]
    if not strict:
        seen.append((name.isin(*BUILD_NAMES) | is_container_file(name) | (end == ".tf"), F.array(F.concat(F.lit("build/deploy-file:"), name))))
    return [*found, ("automation", kind.isin("source_candidate", "configuration_path", "other_or_unknown") & ~test, seen)]


def module_evidence(path: Column, kind: Column, strict: bool = False, parsed: Parsed | None = None) -> Column:
    """array<struct<module, evidence>>; ``strict`` takes directory names only. Explicit test paths give none."""
    nothing = F.array().cast("array<string>")
    rules = _module_rules(strict, kind, parsed or Parsed(path))
    text = lambda may, seen: F.when(may, F.array_join(F.concat(*[F.when(c, e).otherwise(nothing) for c, e in seen]), "|")).otherwise("")
    return F.filter(F.array(*[F.struct(F.lit(m).alias("module"), text(may, seen).alias("evidence")) for m, may, seen in rules]), lambda e: e["evidence"] != "")


def module_flags(path: Column, kind: Column, strict: bool = False, parsed: Parsed | None = None) -> dict[str, Column]:
    """Whether there is evidence of each module, without its text."""
    rules = _module_rules(strict, kind, parsed or Parsed(path))
    return {m: F.coalesce(may & reduce(lambda a, b: a | b, (c for c, _ in seen)), F.lit(False)) for m, may, seen in rules}


def is_source_or_test(path: Column) -> Column:
    low = F.lower(F.trim(path))
    marked = reduce(lambda a, b: a | b, (F.concat(F.lit("/"), low).contains(f"/{m}/") for m in ("test", "tests", "spec", "specs")))
    return F.coalesce((low != "") & (suffix(low).isin(*REVIEW_SUFFIXES) | marked), F.lit(False))
