"""Operator 5: personal data, by base patterns and gradient-boosted selection among wider candidates.

Only DataFrame and SQL functions. Four base patterns always count. High-recall generators propose more spans, which may overlap;
boosted trees over format and context features score them; a threshold per generator, calibrated on held-out examples, selects
those that are redacted as well. The training examples are made from rules (see `examples`), labelled by how they were made,
and pass through the same generators and features. Only counts of feature cells reach the driver, where the trees are grown;
their number is bounded by N_EXAMPLES, and scoring is one SQL expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import table, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base patterns. Java needs possessive groups to walk long runs without recursion, and a look-behind so that a run is tried
#: from its start only; neither changes a match.
BASE = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Generators: kind of the spans, a quick test, the pattern. None bounds the length of a name or token; a run of characters is tried
#: from its start only, so long ones take time in proportion.
GENERATORS = (
    ("email", r"@|[(\[]at[)\]]", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+"),
    ("phone", r"[0-9]", r"\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+"),
    ("card", r"[0-9]", r"(?<![0-9])[0-9](?:[.\-]?[0-9]){11,}+"),
    ("secret", r"[=:]", r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]++\x20?[=:]\x20?[^\x20\x09-\x0D]{6,}+"),
    ("secret", r"[0-9]", r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+"),
)
CONTEXTS = (r"(?i)(?:tel|phone|call|mobil|fax|fon)", r"(?i)(?:mail|contact|write to)", r"(?i)(?:card|visa|iban|account|konto)", r"(?i)(?:password|passwd|pwd|secret|token|key|auth)", r"(?i)(?:version|isbn|order|invoice|number|no\.|id)")
#: Characters before a span that features look at.
BEFORE = 20
FEATURES = ("gen", "digits", "size", "luhn", "plus", "marks", "context", "mixed", "dotted", "edge")
N_EXAMPLES, ROUNDS, RATE, LEAF = 6000, 40, 0.3, 4.0
#: What calibration asks of the selected held-out examples of a generator.
PRECISION = 0.98

CHUNK = 128
_SPANS = "array<struct<s:int,e:int,m:string>>"


def _found(text: Column, test: str, pattern: str, keep=lambda m: F.lit(True)) -> Column:
    """array<struct<s,e,m>>: leftmost non-overlapping matches that pass `keep`, with start and end in code points.

    Matches are marked by a control character, which the text itself gives up for another that no pattern takes, and the text is
    split there: every other part is a match. Spans are gathered in chunks, so that texts with very many take time in proportion.
    """
    marked = F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01$0\x01")

    def step(a, x):
        end = a["at"] + F.length(x)
        span = F.struct(a["at"].alias("s"), end.alias("e"), x.alias("m"))
        full = F.size(a["out"]) >= CHUNK
        out = F.when(a["odd"], F.when(keep(x), F.array_append(F.when(full, none).otherwise(a["out"]), span)).otherwise(a["out"])).otherwise(a["out"])
        return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), out.alias("out"), F.when(a["odd"] & full & keep(x), F.array_append(a["all"], a["out"])).otherwise(a["all"]).alias("all"))

    none = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("out"), F.array().cast(f"array<{_SPANS}>").alias("all"))
    return F.when(text.rlike(test), F.aggregate(F.split(marked, "\x01", -1), start, step, lambda a: F.flatten(F.array_append(a["all"], a["out"])))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def add(a, d):
        n = d.cast("int") * (1 + a["odd"])
        return F.struct((a["sum"] + F.when(n > 9, n - 9).otherwise(n)).alias("sum"), (1 - a["odd"]).alias("odd"))

    return F.aggregate(F.split(F.reverse(_digits(m)), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")), add, lambda a: a["sum"] % 10 == 0)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(m) < 14, F.lit(False)).when((n >= 14) & (n <= 19), _luhn(m)).otherwise(F.lit(False))
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<s,k,e>> of the base patterns, sorted by start, then kind (place in KINDS)."""
    def valid(k):
        good = _found(text, *BASE[KINDS[k]], lambda m: _valid(KINDS[k], m))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    each = [valid(k) for k in range(len(BASE))]
    return F.array_sort(F.concat(*each))


def _level(x: Column, *bounds: int) -> Column:
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def candidates(text: Column) -> Column:
    """array<struct<s,e,k,FEATURES>> of all generators' spans; features are small integers."""

    def described(g, kind, x):
        m, n = x["m"], F.length(_digits(x["m"]))
        before = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - BEFORE), F.least(F.lit(BEFORE), x["s"]))
        place = F.lit(0)
        for c, pattern in enumerate(CONTEXTS):
            place = F.when(before.rlike(pattern), c + 1).otherwise(place)
        own = F.when(m.rlike(rf"^(?:{CONTEXTS[3]})"), 4)
        values = {
            "gen": F.lit(g),
            "digits": _level(n, 1, 4, 7, 9, 10, 12, 13, 14, 16, 17, 20),
            "size": _level(x["e"] - x["s"], 8, 12, 16, 20, 24, 32, 48),
            "luhn": F.when((n >= 12) & (n <= 19), F.when(_luhn(m), 2).otherwise(1)).otherwise(0),
            "plus": F.when(m.rlike(r"^\+"), 2).when(m.rlike(r"^\(?0"), 1).otherwise(0),
            "marks": _level(F.length(F.regexp_replace(m, r"[^\x20().\-/]", "")), 1, 2, 3, 4, 6),
            "context": F.coalesce(own, place),
            "mixed": F.when(m.rlike(r"[0-9].*[A-Za-z].*[0-9]|[A-Za-z][0-9]+[A-Za-z]"), 2).when(m.rlike(r"[A-Za-z]") & (n > 0), 1).otherwise(0),
            "dotted": F.when(m.rlike(r"[A-Za-z0-9-](?:\.|[(\[]dot[)\]]\x20?)[A-Za-z]{2,}$"), 2).when(m.rlike(r"//|^[0-9]{4}-[0-9]{2}-[0-9]{2}"), 1).otherwise(0),
            "edge": F.when(before.rlike(r"[A-Za-z0-9.]$"), 1).otherwise(0),
        }
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k"), *(values[f].cast("int").alias(f) for f in FEATURES))

    def proposed(g, kind, test, pattern):
        return F.transform(_found(text, test, pattern), lambda x: described(g, kind, x))

    return F.concat(*(proposed(g, *x) for g, x in enumerate(GENERATORS)))


def examples(spark: SparkSession, n: int = N_EXAMPLES) -> DataFrame:
    """part (0: training, 1: calibration), text, s (start of the made span), label: made from rules by the hash of a number."""
    r = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m)).cast("int")
    digits = lambda k, m: F.substring(F.lpad(F.translate(F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256), "abcdef", "123456"), 64, "0"), 1, m)
    token = lambda k, m: F.substring(F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256), 1, m)
    pick = lambda k, *xs: F.get(F.array(*(F.lit(x) for x in xs)), r(k, len(xs)))
    user, host, tld = F.concat(pick(1, "anna", "j.doe", "mika", "sales"), digits(2, 2)), pick(3, "mail", "post-box", "corp"), pick(4, "com", "org", "example.net")
    fifteen = F.concat(F.lit("4"), digits(5, 14))
    check = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(fifteen, d.cast("string"))), _luhn), F.lit(0))
    grouped = lambda x, mark: F.regexp_replace(x, r"([0-9]{4})(?=[0-9])", f"$1{mark}")
    at, dot = pick(6, " (at) ", "(at)", "[at]"), pick(7, ".", " (dot) ", "[dot]")
    tel, num, key = pick(8, "call ", "Tel. ", "phone: ", "mobile "), pick(9, "order ", "invoice no. ", "ISBN ", "version "), pick(10, "password", "api_key", "secret", "auth-token", "pwd")
    plain = pick(11, "in the ", "and ", "of ", "with them ", "")
    made = [
        (1, plain, F.concat(user, at, host, dot, tld)), (1, F.lit("mail "), F.concat(user, at, host, dot, tld)), (0, plain, F.concat(user, F.lit("@"), host)), (0, plain, F.concat(F.lit("look"), at, host)),
        (1, tel, F.concat(F.lit("0"), digits(12, 3), F.lit(" "), digits(13, 7))), (1, tel, F.concat(F.lit("("), digits(12, 3), F.lit(") 555-"), digits(13, 4))), (1, plain, F.concat(F.lit("(0"), digits(12, 2), F.lit(") "), digits(13, 4), F.lit("-"), digits(14, 4))),
        (0, num, digits(12, 8)), (0, num, F.concat(F.lit("978-3-"), digits(12, 2), F.lit("-"), digits(13, 6), F.lit("-"), digits(14, 1))), (0, plain, F.concat(F.lit("20"), digits(12, 2), F.lit("-0"), digits(13, 1), F.lit("-1"), digits(14, 1))), (0, plain, digits(12, 9)), (0, num, F.concat(digits(12, 2), F.lit("."), digits(13, 3), F.lit("."), digits(14, 4))),
        (1, plain, grouped(check, ".")), (1, F.lit("card "), check), (0, plain, grouped(F.concat(fifteen, F.lit("."), digits(16, 5)), ".")), (0, num, F.concat(F.lit("9"), digits(17, 13))), (0, plain, F.concat(fifteen, digits(18, 9))),
        (1, plain, F.concat(key, pick(19, "=", ": ", ":"), token(20, 18))), (1, plain, F.concat(key, F.lit("="), token(21, 32))), (1, F.lit("token "), token(22, 40)), (1, F.lit("key "), F.concat(F.lit("AK"), F.upper(token(23, 18)))),
        (0, plain, F.concat(pick(24, "note", "chapter", "https", "ratio"), F.lit(":"), pick(25, "something", "//example.org/page", "1234567", "introduction"))), (0, plain, F.lit("donaudampfschifffahrtsgesellschaft")), (0, plain, F.concat(F.lit("state-of-the-art-"), pick(26, "system", "method", "design"))), (0, num, token(27, 16)), (0, plain, F.concat(F.lit("width="), digits(28, 7))),
    ]
    rows = spark.range(n).select("id", F.get(F.array(*(F.struct(F.lit(y).alias("label"), a.alias("a"), b.alias("b")) for y, a, b in made)), F.pmod("id", F.lit(len(made))).cast("int")).alias("x"))
    return rows.select((F.pmod(F.expr(f"id div {len(made)}"), F.lit(2))).cast("int").alias("part"), F.concat(F.lit("It was said "), F.col("x.a"), F.col("x.b"), F.lit(" then.")).alias("text"), (12 + F.length("x.a")).alias("s"), F.col("x.label").alias("label"))


def grow(cells: list[tuple], rounds: int = ROUNDS, rate: float = RATE, leaf: float = LEAF) -> list[tuple]:
    """Trees of two levels for logistic loss. cells: (features, label, weight). A tree: (feature, bound, left, right), where a
    side is (feature, bound, low, high); a value goes left or low if it is at most the bound."""
    if not cells:
        return []
    x, y, w = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    cuts = [(f, int(b)) for f in range(len(FEATURES)) for b in np.unique(x[:, f])[:-1]]
    if not cuts:
        return []
    low = np.stack([x[:, f] <= b for f, b in cuts]).astype(float)  # cuts x cells
    score, trees = np.zeros(len(cells)), []

    def split(g, h):
        """feature, bound and the values of both sides of the cut that gains most; no gain gives one value for both."""
        total, mass, a, m = g.sum(), h.sum(), low @ g, low @ h
        gain = a * a / (m + leaf) + (total - a) ** 2 / (mass - m + leaf) - total * total / (mass + leaf)
        k = int(np.argmax(np.round(gain, 9)))  # of equal gains the first cut
        if gain[k] <= 1e-9:
            return 0, 0, float(rate * total / (mass + leaf)), float(rate * total / (mass + leaf))
        return *cuts[k], float(rate * a[k] / (m[k] + leaf)), float(rate * (total - a[k]) / (mass - m[k] + leaf))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        f, b, _, _ = split(g, h)
        under, sides = x[:, f] <= b, []
        for own in (under, ~under):
            f2, b2, less, more = split(g * own, h * own)
            sides.append((f2, b2, less, more))
            score = score + own * np.where(x[:, f2] <= b2, less, more)
        trees.append((f, b, *sides))
    return trees


def value(trees: list[tuple], x) -> float:
    side = lambda s: s[2] if x[s[0]] <= s[1] else s[3]
    return sum(side(t[2]) if x[t[0]] <= t[1] else side(t[3]) for t in trees)


def train(spark: SparkSession, n: int = N_EXAMPLES) -> tuple[list[tuple], list[float]]:
    """The trees, and per generator the least score at which held-out examples reach PRECISION (infinite if none does)."""
    rows = examples(spark, n).select("part", "s", "label", F.explode(candidates(F.col("text"))).alias("c")).where(F.abs(F.col("c.s") - F.col("s")) <= 1)
    cells = [(r["part"], tuple(r[f] for f in FEATURES), r["label"], r["count"]) for r in rows.select("part", "label", *(F.col(f"c.{f}") for f in FEATURES)).groupBy("part", "label", *FEATURES).count().orderBy("part", "label", *FEATURES).collect()]  # at most N_EXAMPLES x generators
    trees = grow([c[1:] for c in cells if c[0] == 0])
    bounds = []
    for g in range(len(GENERATORS)):
        held = sorted(((value(trees, x), y, w) for part, x, y, w in cells if part == 1 and x[0] == g), reverse=True)
        good = bad = 0
        bound = math.inf
        for k, (v, y, w) in enumerate(held):
            good, bad = good + w * y, bad + w * (1 - y)
            if (k + 1 == len(held) or held[k + 1][0] < v) and good >= PRECISION * (good + bad):
                bound = v - 1e-9
        bounds.append(max(bound, 0.0))
    return trees, bounds


def _score(trees: list[tuple], c: Column) -> Column:
    side = lambda s: F.when(c[FEATURES[s[0]]] <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
    out = F.lit(0.0)
    for f, b, left, right in trees:
        out = out + F.when(c[FEATURES[f]] <= b, side(left)).otherwise(side(right))
    return out


def personal_data(docs: DataFrame, model: tuple[list[tuple], list[float]]) -> DataFrame:
    """doc_id, base, added: arrays of struct<s,k,e> (start, place of the kind in KINDS, end; code points, end exclusive), by start.

    base: the validated base patterns over the whole text (null: empty). added: candidates whose score reaches their generator's
    bound, without what base spans or, from left to right, candidates before cover, so that one may give several spans. Repeated
    rows repeat.
    """
    trees, bounds = model
    limit = F.array(*(F.lit(b if math.isfinite(b) else 1e9) for b in bounds))
    text = F.col("text")
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    rows = rows.select("doc_id", "text", base_spans(text).alias("base"), F.when(text.rlike(r"[0-9@=:]|[(\[]at[)\]]"), candidates(text)).alias("c"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")

    chosen = F.filter("c", lambda c: _score(trees, c) >= F.get(limit, c["gen"]))
    ordered = F.array_sort(F.transform(chosen, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("n"), c["k"].alias("k"), c["e"].alias("e"))))

    def push(a, end, k):
        return F.when(a["at"] < end, F.array_append(a["out"], F.struct(a["at"].alias("s"), k.alias("k"), end.alias("e")))).otherwise(a["out"])

    def take(a, c):
        return F.aggregate(
            F.filter("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])),
            F.struct(F.greatest(a["at"], c["s"]).alias("at"), a["out"].alias("out")),
            lambda x, b: F.struct(F.greatest(x["at"], b["e"]).alias("at"), push(x, b["s"], c["k"]).alias("out")),
            lambda x: F.struct(F.greatest(x["at"], c["e"]).alias("at"), push(x, c["e"], c["k"]).alias("out")),
        )

    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    added = F.when(F.col("c").isNull() | (F.size("c") == 0), none).otherwise(F.aggregate(ordered, first, take, lambda a: a["out"]))
    return rows.select("doc_id", "text", "base", added.alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def redact(found: DataFrame, mark: str = "[{}]") -> DataFrame:
    """doc_id, text with every span of `found` (from personal_data) replaced by its kind; overlapping spans are merged, the first names them."""
    every = F.array_sort(F.concat("base", "added"))
    kinds = F.array(*(F.lit(mark.format(k.upper())) for k in KINDS))

    def step(a, x):
        new = F.struct(
            F.when(x["s"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), F.get(kinds, x["k"]))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], x["e"]).alias("at"),
        )
        return new

    end = F.aggregate(every, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.select("doc_id", end.alias("text"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), train(spark))

    def number(k):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *(number(k) for k in range(len(BASE))), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
