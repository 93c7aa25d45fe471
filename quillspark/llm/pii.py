"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

All of it is column expressions on each document alone: no shuffle, no Python on the
executors. The trees are fitted on made-up sentences (``samples``), whose features come from
the very same expressions; the fit is bounded and does not look at the corpus.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import spans_text, table

KINDS = ["email", "ip", "card", "phone"]

# The patterns of the base kinds. Runs are possessive and don't begin inside a run,
# which changes no match and keeps very long tokens linear.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = [
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_OCTETS = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"

#: (kind, pattern) of the generators beyond the base patterns: written-out mail addresses, national
#: phone numbers, numbers in groups of four inside longer runs, and IPv6 addresses.
MORE = [
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]++)++"),
    (3, r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])"),
    (2, r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{2,7}(?![0-9])"),
    (1, r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
]
#: What a text must hold for a generator, base ones first, to find anything in it: a plain search that spares most texts the rest.
NEEDS = ["@", None, None, "+", "dot", None, None, ":"]
#: Characters before a span that give context.
CONTEXT = 32
#: Rows made up for the fit, and the share of selected candidates that must be true there.
SAMPLES, PRECISION = 1800, 0.995

_BLOCK = 64
_PICK = "struct<k: int, s: bigint, t: int, q: double, n: bigint, e: bigint, g: int, clash: boolean>"
_SPAN = "array<struct<s: bigint, e: bigint, m: string, before: string, after: string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _blocks(rows: Column) -> Column:
    """An array that isn't empty in pieces; it is computed once, not for each piece."""
    return _let(rows, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / _BLOCK).cast("int")), lambda b: F.slice(r, b * _BLOCK + 1, F.lit(_BLOCK))))


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a pattern, with code-point offsets and the text around.

    What lies between matches comes from a split, the matches from an extraction; offsets are
    running sums of their lengths, taken in blocks so that very many matches don't cost a square.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_SPAN)

    def placed(found: Column) -> Column:
        def zipped(gaps: Column) -> Column:
            blocks = _blocks(F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("g"), F.get(gaps, i + 1).alias("n"))))
            start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

            def step(acc: Column, r: Column) -> Column:
                s = acc["at"] + F.char_length(r["g"])
                e = s + F.char_length(r["m"])
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), r["m"].alias("m"), F.right(r["g"], F.lit(CONTEXT)).alias("before"), F.left(r["n"], F.lit(1)).alias("after")))).alias("out"))

            def shifted(folded: Column) -> Column:
                ends = F.aggregate(folded, F.array(F.lit(0).cast("bigint")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
                return _let(ends, lambda at: F.flatten(F.transform(folded, lambda b, i: _moved(b["out"], F.get(at, i)))))

            return _let(F.transform(blocks, lambda b: F.aggregate(b, start, step)), shifted)

        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), zipped)).otherwise(none)

    return F.coalesce(_let(hits, placed), none)


def _moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right is doubled."""
    figures = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.aggregate(F.filter(figures, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x) % 10 == 0


def holds(x: Column) -> Column:
    """The check of a base match."""
    d = digits(x["m"])
    n = F.char_length(d)
    return F.when(x["k"] == 0, True).when(x["k"] == 1, x["m"].rlike(_OCTETS)).when(x["k"] == 2, F.when(n.between(14, 19), luhn(d)).otherwise(False)).otherwise(n.between(10, 15))


def _class(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z]"), 1).when(c.rlike("^[0-9]"), 2).when((c == "") | c.rlike(r"^\s"), 0).otherwise(3)


#: Words before a span that speak for or against a kind, in lower case.
WORDS = [
    r"mail|courriel|correo|contact|write to|reach",
    r"\bip\b|host|server|addr|client|from",
    r"card|visa|carte|karte|tarjeta|credit|amex|master",
    r"phone|tel\b|tel\.|call|mobile|fax|cell|ring|sms",
    r"version|\bver\b|\bv$|release|build|order|invoice|\bref\b|isbn|\bsku\b|\bid\b|no\.|serial|part|section|firmware",
]


def features(x: Column) -> list[Column]:
    """Integer features of a candidate: format of the span itself, then its context."""
    m, before = x["m"], F.lower(x["before"])
    d = digits(m)
    n = F.char_length(d)
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [
        x["g"],
        x["k"],
        F.char_length(m),
        n,
        F.char_length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        flag(n.between(14, 19) & luhn(d)),
        flag(m.rlike(_OCTETS)),
        F.char_length(F.regexp_extract(F.right(m, F.lit(16)), r"[A-Za-z]*$", 0)),
        F.size(F.array_distinct(F.split(d, ""))),
        _class(F.right(x["before"], F.lit(1))),
        _class(x["after"]),
        flag(m.startswith("+")),
        flag(m.contains("(")),
        flag(m.rlike(r"[\[({]at[\])}]")),
        *[flag(before.rlike(w)) for w in WORDS],
    ]


N_FEATURES = 14 + len(WORDS)


def candidates(text: Column) -> Column:
    """The matches of all generators with their number g and kind k: base patterns first, before their checks.

    Each generator but those of mail and IPv6 addresses needs a digit."""
    each = []
    for g, (kind, pattern) in enumerate([*enumerate(BASE), *MORE]):
        fits = F.contains(text, F.lit(NEEDS[g])) if NEEDS[g] else text.rlike("[0-9]")
        each.append(F.transform(F.when(fits, matches(text, pattern)).otherwise(F.array().cast(_SPAN)), _tagged(g, kind)))
    return F.concat(*each)


def _tagged(g: int, kind: int):
    return lambda x: F.struct(F.lit(g).alias("g"), F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))


def samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """(sentence, kind of its personal data or -1): invented, half of them with look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubdlmnrst") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def checked(k: int, good: bool) -> str:
        body = r.choice("3456") + num(k - 2)
        total = sum(v if i % 2 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(body))))
        last = -total % 10
        return body + str(last if good else (last + r.randint(1, 9)) % 10)

    def grouped(t: str, sep: str) -> str:
        return sep.join(t[i : i + 4] for i in range(0, len(t), 4))

    domain = lambda: f"{word()}{r.choice(['', num(1)])}"
    octets = lambda most: ".".join(str(r.randint(0, most)) for _ in range(4))
    national = lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(num(3), num(3), num(4))
    yes = [
        (0, lambda: f"{word()}.{num(2)}@{domain()}.example.com", ["", "mail", "contact"]),
        (0, lambda: f"{word()} [at] {domain()} [dot] {r.choice(['com', 'org', 'net', 'de'])}", ["", "mail", "contact", "write to"]),
        (0, lambda: f"{word()}(at){domain()}(dot){r.choice(['com', 'org', 'net', 'fr'])}", ["", "courriel", "mail"]),
        (0, lambda: f"{word()} at {domain()} dot {r.choice(['com', 'org', 'net', 'es'])}", ["mail", "contact", "write to", "reach me:"]),
        (1, lambda: octets(255), ["", "from", "host", "server"]),
        (1, lambda: ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8)), ["", "ip", "host", "addr"]),
        (2, lambda: grouped(checked(16, True), r.choice(["", " ", "-"])), ["", "card", "visa"]),
        (2, lambda: f"{r.randint(1, 99)} {checked(16, True)}", ["card", "visa", "credit"]),
        (3, lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", ["", "tel", "call"]),
        (3, national, ["call", "phone", "tel.", "mobile", "fax"]),
    ]
    no = [
        (lambda: octets(255), ["version", "release", "build", "firmware"]),
        (lambda: octets(900), ["", "section", "part"]),
        (lambda: checked(16, False), ["", "order", "invoice", "ref"]),
        (lambda: grouped(checked(16, False), r.choice(["-", " ", "."])), ["", "serial", "part", "order"]),
        (lambda: num(r.randint(14, 20)), ["id", "no.", "order", "sku", ""]),
        (national, ["invoice", "order", "sku", "isbn", "serial", "part"]),
        (lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", ["isbn", ""]),
        (lambda: f"{word()} at {word()} dot {word()}", ["", "look", "part"]),
        (lambda: f"+{num(1)} {num(2)}", ["", "score"]),
        (lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)} {num(2)} {num(2)}", ["", "date"]),
    ]
    out = []
    for i in range(n):
        if i % 2:
            make, contexts = no[i // 2 % len(no)]
            kind = -1
        else:
            kind, make, contexts = yes[i // 2 % len(yes)]
        lead = " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((" ".join(f"{lead} {r.choice(contexts)}".split() + [make(), *(word() for _ in range(r.randint(0, 3)))]), kind))
    return out


@dataclass
class Model:
    trees: boosting.Boosted
    #: By generator.
    thresholds: list[float]


_MODELS: dict[tuple[int, float], Model] = {}


def fit(spark: SparkSession, n: int = SAMPLES, precision: float = PRECISION) -> Model:
    """The trees and the threshold of each generator; fitted once a process, on ``n`` made-up sentences.

    Thresholds are taken on as many sentences of another draw, which neither the trees nor their calibration saw.
    """
    if (n, precision) in _MODELS:
        return _MODELS[n, precision]
    drawn = [*samples(n), *samples(n, seed=11)]
    said = F.from_json(F.lit(json.dumps([{"t": t, "k": k} for t, k in drawn])), "array<struct<t: string, k: int>>")
    rows = spark.range(1).select(F.posexplode(said).alias("i", "x")).select("i", "x.t", "x.k")
    got = rows.select("i", "k", F.explode(F.transform(candidates(F.col("t")), _numbers)).alias("f")).collect()
    got = sorted((r["i"], tuple(r["f"]), int(r["f"][1] == r["k"])) for r in got)
    learned, held = ([(f, t) for i, f, t in got if (i < n) == first] for first in (True, False))
    trees = boosting.fit([f for f, _ in learned], [t for _, t in learned])
    limits = []
    for g in range(len(BASE) + len(MORE)):
        own = [(f, t) for f, t in held if f[0] == g]
        limits.append(boosting.threshold(trees, [f for f, _ in own], [t for _, t in own], precision))
    _MODELS[n, precision] = Model(trees, limits)
    return _MODELS[n, precision]


def _numbers(x: Column) -> Column:
    return F.array(*[f.cast("int") for f in features(x)])


def _scored(found: Column, model: Model) -> Column:
    """The candidates that reach the threshold of their generator, with their probability p."""

    def one(x: Column) -> Column:
        p = _let(_numbers(x), lambda f: model.trees.expression([F.get(f, F.lit(i)) for i in range(N_FEATURES)]))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), p.alias("p"), x["g"].alias("g"))

    least = F.array(*[F.lit(float(t)) for t in model.thresholds])
    return F.filter(F.transform(found, one), lambda c: c["p"] >= F.get(least, c["g"]))


def _folded(rows: Column, start: Column, step) -> Column:
    """The state at the end of a fold over an array; the state's ``out`` is a list, kept in blocks so that a long one doesn't cost a square."""
    none = start["out"]

    def block(acc: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(acc["state"].alias("state"), none.alias("out")), step)
        return F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    begun = F.struct(start["state"].alias("state"), F.array(none).alias("out"))
    return F.aggregate(_blocks(rows), begun, block, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))


def selected(base: Column, scored: Column) -> Column:
    """The scored candidates (s, k, e, p) that overlap neither a base span of their kind nor a better candidate.

    Spans are put in order of kind and start. A first fold, from the last to the first, marks candidates that reach
    the base span after them; a second, from the first on, drops those and the ones that begin within a base span.
    Of candidates that overlap, from left to right, the one with the higher probability stays, then the earlier,
    then the longer: one that is open gives way to a better one. Both folds see each span once.
    """
    none = F.array().cast(f"array<{_PICK}>")
    pick = lambda x, t: F.struct(x["k"].cast("int").alias("k"), x["s"].alias("s"), F.lit(t).alias("t"), (-x["p"] if t else F.lit(-2.0)).alias("q"), -x["e"].alias("n"), x["e"].alias("e"), (x["g"] if t else F.lit(-1)).cast("int").alias("g"), F.lit(False).alias("clash")).cast(_PICK)
    spans = F.array_sort(F.concat(F.transform(base, lambda x: pick(x, 0)), F.transform(scored, lambda x: pick(x, 1))))

    def back(acc: Column, x: Column) -> Column:
        ahead = F.when(acc["state"]["k"] == x["k"], acc["state"]["s"])
        clash = (x["t"] == 1) & F.coalesce(ahead < x["e"], F.lit(False))
        state = F.when(x["t"] == 0, F.struct(x["k"].alias("k"), x["s"].alias("s"))).otherwise(acc["state"])
        marked = F.struct(x["k"].alias("k"), x["s"].alias("s"), x["t"].alias("t"), x["q"].alias("q"), x["n"].alias("n"), x["e"].alias("e"), x["g"].alias("g"), clash.alias("clash"))
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(marked)).alias("out"))

    begun = F.struct(F.lit(None).cast("struct<k: int, s: bigint>").alias("state"), none.alias("out"))
    marked = F.reverse(_folded(F.reverse(spans), begun, back)["out"])

    def onward(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["state"]["k"] == x["k"], F.lit(False))
        past, held = F.when(same, acc["state"]["past"]).otherwise(F.lit(0)), acc["state"]["held"]
        free = (x["t"] == 1) & ~x["clash"] & (x["s"] >= past)
        rival = F.when(same & (x["s"] < held["e"]), held)
        wins = free & (rival.isNull() | (x["q"] < rival["q"]))
        leaves = held.isNotNull() & (~same | (wins & rival.isNull()))
        state = F.struct(
            x["k"].alias("k"), F.when(x["t"] == 0, F.greatest(past, x["e"])).otherwise(past).alias("past"),
            F.when(wins, x).when(same, held).alias("held"),
        )
        return F.struct(state.alias("state"), F.when(leaves, F.concat(acc["out"], F.array(held))).otherwise(acc["out"]).alias("out"))

    begun = F.struct(F.lit(None).cast(f"struct<k: int, past: bigint, held: {_PICK}>").alias("state"), none.alias("out"))
    ended = lambda m: _let(_folded(m, begun, onward), lambda acc: F.concat(acc["out"], F.filter(F.array(acc["state"]["held"]), lambda x: x.isNotNull())))
    kept = F.transform(_let(marked, ended), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), (-x["q"]).alias("p")))
    return F.when(F.size(scored) > 0, kept).otherwise(F.array().cast("array<struct<s: bigint, k: int, e: bigint, p: double>>"))


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, added) of every row of ``docs(doc_id, text)``: arrays of (s, k, e[, p]), k as in KINDS.

    base has the matches of the base patterns that pass their checks. added has the candidates of
    all generators that the trees select and that overlap nothing of their kind in base, nor a better
    candidate of their kind (see ``selected``).
    Null and empty texts have none; texts of any length count whole, in time that grows with their
    length; repeated rows each give theirs; an empty table gives no rows; other columns are not looked at.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(F.col("text")).alias("found"))
    base = F.transform(F.filter("found", lambda x: (x["g"] < len(BASE)) & holds(x)), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    based = found.select("doc_id", base.alias("base"), _scored(F.col("found"), model).alias("scored"))
    return based.select("doc_id", "base", selected(F.col("base"), F.col("scored")).alias("added"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), fit(spark))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select(
        "doc_id",
        *map(count, range(4)),
        F.sha2(spans_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        spans_text(F.concat("base", slim(F.col("added"))), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
