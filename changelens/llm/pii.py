"""Personal data: candidate gradient boosting, with DataFrame functions only.

Generators propose spans: four strict patterns with checks (e-mail, ip, card, phone), which always stay, and three
loose high-recall ones (anything around an "@", digit runs with separators, long hexadecimal runs), which overlap them
freely. What can be added is a loose candidate that no strict span overlaps, so the trees learn on just these, by
coarse format and context features. Positives are the strict spans in a disturbed format (spaces around the "@", dots
in a card number, no plus) at their own place, and hexadecimal runs assigned in quotes; all other candidates are negatives.
Since features are binned, all examples of the corpus collapse to a contingency table whose size the bins bound, so
boosted trees are fitted on everything, exactly, from that table. The trees become CASE expressions, evaluated where
the text is. A threshold per generator, calibrated on held-out documents, selects the extra redactions.

Positions come from lengths: the pieces that ``split`` leaves and the matches between them add up to code points.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
LOOSE_KINDS = ("mail_like", "number_like", "secret_like")

#: The strict patterns. Possessive loops and the look-behinds only keep the search linear: inside a run
#: of allowed characters no later start can match where the first one fails.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail_like": r"(?<![^\s<>()\[\],;:\x22'|])[^\s@<>()\[\],;:\x22'|]++[\x20]?@[\x20]?[^\s@<>()\[\],;:\x22'|]++",
    "number_like": r"(?<![0-9])(?:\+\x20?)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret_like": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,}+(?![0-9A-Za-z])",
}
#: Words that, right before a span, say what it is.
CONTEXT = {
    "secret": r"(?i)(?:token|secret|passw\w*|key|auth|bearer)\W*$",
    "contact": r"(?i)(?:mail|contact|tel\w*|phone|call|fax|mobile)\W*$",
    "payment": r"(?i)(?:card|visa|credit|account|iban|pay\w*)\W*$",
}
BEFORE = 24


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum over a string of at most 19 digits is right."""
    back = F.reverse(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 0, doubled(back.substr(i, F.lit(1)).cast("int"))).otherwise(back.substr(i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(value, r"\."), lambda p: part(p) & (F.when(part(p), F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")).otherwise(999) <= 255))
    if kind in ("card", "phone"):
        low, high = (16, 19) if kind == "card" else (8, 15)
        digits = digits_of(value)
        fits = F.length(digits).between(low, high)
        return F.when(fits, luhn(digits)).otherwise(F.lit(False)) if kind == "card" else fits
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """array<struct<gap, len, val, left>>: of each match the code points before it since the last one, and its own."""
    pattern = PATTERNS[kind]
    return F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda piece, value: F.struct(
            F.char_length(piece).alias("gap"),
            F.char_length(value).alias("len"),
            value.alias("val"),
            F.substring(F.right(piece, F.lit(BEFORE)), 1, BEFORE).alias("left"),
        ),
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, state: Column, step, emit, out: str) -> Column:
    """array<out>: ``emit(state, item)`` for each item in order, with ``state = step(state, item)`` after it.

    An array grows by copying, so one accumulator would cost the square of its length. Runs of about the root of the
    length are scanned into arrays of their own and joined at the end: n to the 1.5 in all.
    """
    root = lambda a: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
    cut = lambda a: let(root(a), lambda run: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / run).cast("int")), lambda i: F.slice(a, i * run + 1, run)))
    inside = lambda before, part: F.aggregate(
        part,
        F.struct(before.alias("now"), F.expr(f"cast(array() as array<{out}>)").alias("out")),
        lambda acc, m: F.struct(step(acc["now"], m).alias("now"), F.concat(acc["out"], F.array(emit(acc["now"], m))).alias("out")),
    )
    whole = lambda a: F.aggregate(
        cut(a),
        F.struct(state.alias("now"), F.expr(f"cast(array() as array<array<{out}>>)").alias("out")),
        lambda acc, part: let(inside(acc["now"], part), lambda done: F.struct(done["now"].alias("now"), F.concat(acc["out"], F.array(done["out"])).alias("out"))),
        lambda acc: F.flatten(acc["out"]),
    )
    return let(items, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(F.expr(f"cast(array() as array<{out}>)")))


FOUND = "struct<s:int,e:int,val:string,left:string>"


def positioned(found: Column) -> Column:
    """Adds start and end to each match; the last piece of ``split`` has no match and goes."""
    return scan(
        F.filter(found, lambda m: m["val"].isNotNull()),
        F.lit(0),
        lambda pos, m: pos + m["gap"] + m["len"],
        lambda pos, m: F.struct((pos + m["gap"]).alias("s"), (pos + m["gap"] + m["len"]).alias("e"), m["val"].alias("val"), m["left"].alias("left")),
        FOUND,
    )


def free_of(base: Column, loose: Column, item: str) -> Column:
    """The ``loose`` spans (structs of type ``item``) that overlap no ``base`` span, by two scans in order of position."""
    mark = lambda is_loose: lambda m: F.struct(m["s"].alias("s"), F.lit(is_loose).alias("loose"), m["e"].alias("e"), (m if is_loose else F.lit(None).cast(item)).alias("item"))

    def judge(both: Column) -> Column:
        ends = scan(both, F.lit(0), lambda end, m: F.when(m["loose"], end).otherwise(F.greatest(end, m["e"])), lambda end, m: end <= m["s"], "boolean")
        starts = scan(F.reverse(both), F.lit(2**31 - 1), lambda start, m: F.when(m["loose"], start).otherwise(m["s"]), lambda start, m: start >= m["e"], "boolean")
        judged = F.zip_with(both, F.zip_with(ends, F.reverse(starts), lambda x, y: x & y), lambda m, alone: F.struct((alone & m["loose"]).alias("free"), m["item"].alias("item")))
        return F.transform(F.filter(judged, lambda m: m["free"]), lambda m: m["item"])

    return let(F.array_sort(F.concat(F.transform(base, mark(False)), F.transform(loose, mark(True)))), judge)


#: Features of a loose candidate and the number of values each can take; their product bounds the table.
FEATURES = {"kind": 3, "digits": 6, "share": 4, "length": 5, "seps": 3, "plus": 2, "secret": 2, "contact": 2, "payment": 2, "dotted": 3}


def features(kind: str, c: Column) -> list[Column]:
    value, left = c["val"], c["left"]
    n_digits, n = F.length(digits_of(value)), F.char_length(value)
    cut = lambda x, at: sum((F.when(x >= a, 1).otherwise(0) for a in at[1:]), F.when(x >= at[0], 1).otherwise(0))
    flag = lambda x: F.when(x, 1).otherwise(0)
    return [
        F.lit(LOOSE_KINDS.index(kind)).alias("kind"),
        cut(n_digits, (1, 8, 12, 16, 20)).alias("digits"),
        cut(n_digits / n, (0.3, 0.6, 0.95)).alias("share"),
        cut(n, (10, 16, 20, 32)).alias("length"),
        cut(n - F.length(F.regexp_replace(value, r"[\x20()-]", "")), (1, 3)).alias("seps"),
        flag(value.startswith("+") | left.endswith("+")).alias("plus"),
        flag(left.rlike(CONTEXT["secret"])).alias("secret"),
        flag(left.rlike(CONTEXT["contact"])).alias("contact"),
        flag(left.rlike(CONTEXT["payment"])).alias("payment"),
        cut(F.length(value) - F.length(F.replace(value, F.lit("."))), (1, 3)).alias("dotted"),
    ]


#: The loose generator whose spans a strict kind looks like once its format is changed.
LOOSE_OF = {"email": "mail_like", "ip": "number_like", "card": "number_like", "phone": "number_like"}


def disturbed(kind: str, value: Column) -> Column:
    """A strict span as people also write it, in a form that no strict pattern takes whole."""
    if kind == "email":
        return F.replace(value, F.lit("@"), F.lit(" @ "))
    if kind == "ip":
        return F.replace(value, F.lit("."), F.lit(". "))
    if kind == "card":
        return F.regexp_replace(digits_of(value), "([0-9]{4})(?=[0-9])", "$1.")
    return F.substring(value, 2, 2**31 - 1)


def _valid_match(kind: str):
    return lambda m: valid(kind, m["val"])


def _base_span(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"))


def _disturbed_span(kind: str):
    return lambda m: F.struct(*features(LOOSE_OF[kind], {"val": disturbed(kind, m["val"]), "left": m["left"]}))


def _loose_span(kind: str):
    """A loose candidate; a hexadecimal run counts as a secret where it is assigned in quotes, which no feature sees."""
    secret = quoted if kind == "secret_like" else lambda left: F.lit(False)
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), secret(m["left"]).alias("y"), F.struct(*features(kind, m)).alias("x"))


def quoted(left: Column) -> Column:
    return left.rlike(r"""[=:]\s*["']$""")


class Boosted:
    """Boosted depth-two trees on binned features, fitted to counts (rows, positives) per distinct feature vector."""

    def __init__(self, rounds: int = 24, rate: float = 0.4, penalty: float = 1.0):
        self.rounds, self.rate, self.penalty = rounds, rate, penalty
        self.trees: list[tuple] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Boosted:
        share = (pos.sum() + 0.5) / (n.sum() + 1.0)
        self.bias = math.log(share / (1 - share))
        margin = np.full(len(n), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = n * p - pos, n * p * (1 - p)
            tree = self._grow(x, g, h, np.ones(len(n), bool), 2)
            if isinstance(tree, float):
                break
            self.trees.append(tree)
            margin = margin + self._apply(tree, x)
        return self

    def _grow(self, x, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for f in range(x.shape[1] if depth else 0):
            for cut in np.unique(x[rows, f])[1:]:
                left = rows & (x[:, f] < cut)
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                if gain > best[0]:
                    best = (gain, (f, int(cut), left))
        if best[1] is None:
            return float(-self.rate * gs / (hs + self.penalty))
        f, cut, left = best[1]
        return (f, cut, self._grow(x, g, h, left, depth - 1), self._grow(x, g, h, rows & ~left, depth - 1))

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] < cut, self._apply(low, x), self._apply(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x))))))

    def column(self, row: Column) -> Column:
        """The same margin as a CASE expression over a struct of features."""
        names = list(FEATURES)

        def case(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, low, high = tree
            return F.when(row[names[f]] < cut, case(low)).otherwise(case(high))

        return sum((case(t) for t in self.trees), F.lit(self.bias))


def thresholds(model: Boosted, x: np.ndarray, n: np.ndarray, pos: np.ndarray, precision: float) -> list[float]:
    """Per generator the lowest margin from which on held-out precision is at least ``precision``; else none."""
    cuts = []
    for kind in range(len(LOOSE_KINDS)):
        mine = (x[:, 0] == kind) & (n > 0)
        p, best = model.predict(x[mine]), math.inf
        order = np.argsort(-p, kind="stable")
        right, all_ = np.cumsum(pos[mine][order]), np.cumsum(n[mine][order])
        ends = np.append(np.diff(p[order]) != 0, True)[: len(order)]
        for i in np.flatnonzero(ends & (right >= precision * all_)):
            best = float(p[order][i])
        cuts.append(math.log(best / (1 - best)) - 1e-9 if 0 < best < 1 else math.inf)
    return cuts


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """One row per input row: ``id_col, base, extra``: arrays of struct<kind, s, e>, code points, end
    exclusive. ``base`` holds the strict spans, ``extra`` the loose ones that the trees select and no strict one overlaps.

    Null and empty texts have no spans. Repeated rows get equal results, each on its own. An empty table gives an empty
    result. The contingency table that reaches the driver has at most ``prod(FEATURES)`` rows per fold and label.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    may = {k: F.col("t").rlike("@" if "mail" in k else "[0-9]") for k in PATTERNS} | {"phone": F.col("t").contains("+")}
    nothing = F.expr("cast(array() as array<struct<gap:int,len:int,val:string,left:string>>)")
    found = raw.select("id", *[F.when(may[k], matches(F.col("t"), k)).otherwise(nothing).alias(k) for k in PATTERNS])
    found = found.select("id", *[F.when(F.size(k) > 1, positioned(F.col(k))).otherwise(F.expr(f"cast(array() as array<{FOUND}>)")).alias(k) for k in PATTERNS])
    found = found.select("id", *[F.filter(k, _valid_match(k)).alias(k) for k in BASE_KINDS], *LOOSE_KINDS)
    spans = found.select(
        "id",
        F.concat(*[F.transform(k, _base_span(k)) for k in BASE_KINDS]).alias("base"),
        F.concat(*[F.transform(k, _disturbed_span(k)) for k in BASE_KINDS]).alias("seen"),
        F.concat(*[F.transform(k, _loose_span(k)) for k in LOOSE_KINDS]).alias("loose"),
    )
    item = f"struct<kind:string,s:int,e:int,y:boolean,x:struct<{','.join(f'{f}:int' for f in FEATURES)}>>"
    alone = F.when((F.size("base") > 0) & (F.size("loose") > 0), free_of(F.col("base"), F.col("loose"), item)).otherwise(F.col("loose"))
    spans = materialize(spans.select("id", "base", "seen", alone.alias("loose")), "pii-spans")
    told = F.concat(F.transform("seen", lambda x: F.struct(F.lit(True).alias("y"), x.alias("x"))), F.transform("loose", lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"))))
    counts = (
        spans.where((F.size("loose") > 0) | (F.size("seen") > 0))
        .select(F.pmod(F.xxhash64("id"), F.lit(5)).alias("fold"), F.explode(told).alias("c"))
        .groupBy((F.col("fold") == 0).alias("held"), *[F.col(f"c.x.{f}").alias(f) for f in FEATURES])
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("c.y").alias("pos"))
        .orderBy("held", *FEATURES)
        .collect()
    )
    extra = F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")
    if counts:
        x = np.array([[r[f] for f in FEATURES] for r in counts])
        n, pos, held = (np.array([r[k] for r in counts], float) for k in ("n", "pos", "held"))
        model = Boosted().fit(x, n * (1 - held), pos * (1 - held))
        check = held if (n * held).sum() else 1 - held
        cuts = thresholds(model, x, n * check, pos * check, precision)
        cut = lambda c: sum((F.when(c["kind"] == k, F.lit(v)).otherwise(F.lit(0.0)) for k, v in zip(LOOSE_KINDS, cuts, strict=True)), F.lit(0.0))
        chosen = F.filter("loose", lambda c: model.column(c["x"]) >= cut(c))
        extra = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return spans.select(F.col("id").alias(id_col), "base", extra.alias("extra"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"], m["e"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span found in its text replaced by [KIND]; ids must be unique."""
    found = find_pii(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.concat("base", "extra").alias("_spans"))
    joined = docs.join(found, docs[id_col].eqNullSafe(found["_id"]))
    by_end = F.array_sort("_spans", lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).otherwise(b["e"] - a["e"]))
    start = F.struct(F.col(text_col).alias("t"), F.lit(2**31 - 1).alias("from"))
    clean = F.aggregate(
        by_end,
        start,
        lambda acc, m: F.when(m["e"] <= acc["from"], F.struct(F.concat(F.left(acc["t"], m["s"]), F.lit("["), F.upper(m["kind"]), F.lit("]"), F.substr(acc["t"], m["e"] + 1)).alias("t"), m["s"].alias("from"))).otherwise(acc),
        lambda acc: acc["t"],
    )
    return joined.withColumn(text_col, clean).drop("_id", "_spans")
