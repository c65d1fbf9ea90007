"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose overlapping spans: the base rules' formats and looser ones (national phone
numbers, tax ids, obfuscated mail addresses, account numbers, IPv6). Boosted trees score each candidate
from its format and its context; a threshold for each kind, calibrated on rows the trees did not see,
selects which looser candidates join the base rules' matches. Base matches always stay.

Everything happens inside a document's own row and grows in proportion to its text: places come from
running sums over the gaps between matches (`scan`), the context of a candidate from the gaps beside it,
and overlaps with base matches from running bounds over the spans in order.

The trees are fitted on a labelled table of TRAINING generated rows (formats of personal data and of
look-alikes such as dates, versions, prices, ranges and ids, in personal and neutral contexts). The rows
fall into cells of equal features, at most the product of the features' values, so boosting needs the
cells' counts alone; scoring is one CASE expression a tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
EXTRA = ("masked_email", "tax_id", "national_phone", "account", "ipv6")
KINDS = (*BASE, *EXTRA)

TRAINING = 12_000
ROUNDS, RATE, DEPTH = 40, 0.3, 2
PRECISION = 0.98  # of the candidates a threshold selects, on the calibration rows

#: The base rules. Loops are possessive and email starts at the start of a run or behind
#: the last match, which changes no match but makes the search linear in the text.
EMAIL_RE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_RE = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_RE = r"[0-9](?:[\x20-]?[0-9])++"
PHONE_RE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: The looser generators.
EXTRA_RE = {
    "masked_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[({]\x20?at\x20?[\])}]\x20?[a-z0-9-]{1,63}+(?:\x20?(?:[\[({]\x20?dot\x20?[\])}]|\.)\x20?[a-z0-9-]{1,63}+){1,8}+",
    "national_phone": r"(?<![0-9A-Za-z+.(/-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,4}){1,4}(?![0-9A-Za-z/-])",
    "tax_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
PERSONAL = r"(?:phone|call|tel|mobile|cell|fax|mail|contact|reach|ssn|tax|social|iban|account|bank|card|address|name|kontakt|telefon|anruf|correo|teléfono|téléphone|appel|compte|konto)\W{0,4}(?:\w+\W{1,3}){0,2}$"
NEUTRAL = r"(?:version|ver|build|page|pages|chapter|isbn|issn|order|invoice|ref|item|model|no|date|on|from|since|until|between|year|usd|eur|total|score|ratio|table|line|section|commit|id)\W{0,4}(?:\w+\W{1,3}){0,1}$"


def matches(text: Column, pattern: str, may: Column) -> tuple[Column, Column]:
    """The gaps around the matches of a pattern, and the matches; empty arrays where `may` is false."""
    none = F.array().cast("array<string>")
    return F.when(may, F.split(text, pattern, -1)).otherwise(none), F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def scan(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array what `step` makes of the item's forerunner's result (null at first) and the item.

    Results are gathered in runs of about sqrt(n) items, since appending to an array copies it.
    """
    run = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(items))).cast("int"))
    runs = F.transform(F.sequence(F.lit(0), F.size(items) - 1, run), lambda i: F.slice(items, i + 1, run))
    none = F.array().cast(f"array<{kind}>")

    def fold(before: Column, own: Column) -> Column:
        return F.aggregate(own, none, lambda out, x: F.array_append(out, step(F.coalesce(F.try_element_at(out, F.lit(-1)), before), x)))

    def onward(out: Column, own: Column) -> Column:
        return F.array_append(out, fold(F.try_element_at(F.try_element_at(out, F.lit(-1)), F.lit(-1)), own))

    found = F.flatten(F.aggregate(runs, F.array().cast(f"array<array<{kind}>>"), onward))
    return F.when(F.size(items) > 0, found).otherwise(none)


def _placed(hits: Column, ends: Column, kind: str) -> Column:
    """Spans (kind, start, end, value) from matches and their ends, in code points."""
    span = lambda h, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(h)).alias("start"), end.alias("end"), h.alias("value"))
    return F.zip_with(hits, ends, span)


def _with_context(gaps: Column, hits: Column, ends: Column, kind: str) -> Column:
    """Spans (kind, start, end, value, left, right): with 40 code points before and 8 behind, as far as the match before and the next."""
    text = lambda array, i: F.coalesce(F.get(array, i), F.lit(""))

    def span(s: Column, i: Column) -> Column:
        left = F.concat(text(hits, i - 1), F.get(gaps, i))
        right = F.concat(F.get(gaps, i + 1), text(hits, i + 1))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.right(left, F.lit(40)).alias("left"), F.left(right, F.lit(8)).alias("right"))

    return F.transform(_placed(hits, ends, kind), span)


def _before(items: str, first: Column) -> Column:
    """The array whose every item is the one before; `first` at the start."""
    return F.concat(F.array(first), F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))))


def _cleared(row: DataFrame) -> DataFrame:
    """row(_base, _more, ...) with the spans of `_more` that overlap none of `_base`.

    All spans in order of their starts (base ones first among equal starts): a span overlaps a base one before
    it if the largest end of those exceeds its start, and one behind it if the next start falls short of its end.
    """
    mark = lambda s, x: F.struct(s["start"].alias("at"), F.lit(x).alias("more"), s["end"].alias("end"), (s if x else F.lit(None).cast(_SPAN)).alias("span"))
    order = F.sort_array(F.concat(F.transform("_base", lambda s: mark(s, 0)), F.transform("_more", lambda s: mark(s, 1))))
    row = row.withColumn("_order", F.when((F.size("_base") > 0) & (F.size("_more") > 0), order)).withColumn("_back", F.reverse("_order"))
    reached = scan(F.col("_order"), "int", lambda end, x: F.greatest(end, F.when(x["more"] == 0, x["end"])))
    ahead = scan(F.col("_back"), "int", lambda start, x: F.when(x["more"] == 0, x["at"]).otherwise(start))
    row = row.withColumn("_reached", reached).withColumn("_ahead", ahead)
    free = lambda z: (z["x"]["more"] == 1) & (F.coalesce(z["r"], F.lit(0)) <= z["x"]["at"]) & F.coalesce(z["a"] >= z["x"]["end"], F.lit(True))
    zipped = F.arrays_zip(F.col("_order").alias("x"), F.col("_reached").alias("r"), F.reverse("_ahead").alias("a"))
    kept = F.when(F.col("_order").isNull(), F.col("_more")).otherwise(F.transform(F.filter(zipped, free), lambda z: z["x"]["span"]))
    return row.withColumn("_more", kept).drop("_order", "_back", "_reached", "_ahead")


def _settled(row: DataFrame) -> DataFrame:
    """row(_more, ...) with the spans of `_more`(span, p) that stay: of each run of overlapping ones by falling p, what overlaps none before.

    Within a run this takes the square of its length, which candidates of bounded length keep short.
    """
    order = F.sort_array(F.transform("_more", lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["p"].alias("p"), x["span"].alias("span"))))
    row = row.withColumn("_order", F.when(F.size("_more") > 1, order))
    row = row.withColumn("_reached", scan(F.col("_order"), "int", lambda end, x: F.greatest(end, x["end"])))
    row = row.withColumn("_new", F.zip_with("_order", _before("_reached", F.lit(0)), lambda x, end: (end <= x["start"]).cast("int")))
    row = row.withColumn("_run", scan(F.col("_new"), "int", lambda n, x: F.coalesce(n, F.lit(0)) + x))
    numbered = F.zip_with("_order", "_run", lambda x, n: F.struct(n.alias("run"), (-x["p"]).alias("q"), x["start"].alias("start"), x["end"].alias("end"), x["span"].alias("span")))
    row = row.withColumn("_order", F.sort_array(numbered))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(s: Column, x: Column) -> Column:
        own = F.when(s["run"] == x["run"], s["own"]).otherwise(none)
        free = ~F.exists(own, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"]))
        kept = F.when(free, F.array_append(own, F.struct(x["start"].alias("start"), x["end"].alias("end")))).otherwise(own)
        return F.struct(x["run"].alias("run"), kept.alias("own"), free.alias("free"))

    row = row.withColumn("_state", scan(F.col("_order"), "struct<run:int,own:array<struct<start:int,end:int>>,free:boolean>", step))
    both = F.filter(F.arrays_zip(F.col("_order").alias("x"), F.col("_state").alias("s")), lambda z: z["s"]["free"])
    kept = F.when(F.size("_more") > 1, F.transform(both, lambda z: z["x"]["span"])).otherwise(F.transform("_more", lambda x: x["span"]))
    return row.withColumn("_more", kept).drop("_order", "_reached", "_new", "_run", "_state")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return s + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(12, 19) & luhn(F.when(n.between(12, 19), _digits(value)).otherwise(F.lit("1")))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda s: _valid(kind, s["value"])


def _may(kind: str, text: Column) -> Column:
    """Cheap conditions without which a pattern can't match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ipv6":
        return F.contains(text, F.lit(":")) & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")
    if kind == "masked_email":
        return text.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]")
    return F.col("_digits")


_SPAN = "struct<kind:string,start:int,end:int,value:string,left:string,right:string>"

# features -----------------------------------------------------------------------------------------

#: Number of values of each feature of a candidate.
FEATURES = {"kind": len(EXTRA), "digits": 6, "marks": 4, "parts": 5, "left": 3, "right": 3, "money": 2, "dated": 2}


def _features(kind: Column, value: Column, left: Column, right: Column) -> dict[str, Column]:
    """Format features (first five) and context features of a candidate with its neighbouring text."""
    n = F.length(_digits(value))
    low = F.lower(left)
    return {
        "kind": F.array_position(F.array(*[F.lit(k) for k in EXTRA]), kind).cast("int") - 1,
        "digits": F.when(n < 6, 0).when(n < 8, 1).when(n < 9, 2).when(n < 10, 3).when(n < 12, 4).otherwise(5),
        "marks": F.when(value.rlike(r"[()]"), 3).when(value.rlike(r"[/.]"), 2).when(value.rlike("-"), 1).otherwise(0),
        "parts": F.least(F.size(F.split(value, r"[\x20./:-]")), F.lit(5)) - 1,
        "left": F.when(low.rlike(PERSONAL), 2).when(low.rlike(NEUTRAL), 1).otherwise(0),
        "right": F.when(right.rlike(r"^\W{0,2}$"), 0).when(right.rlike(r"^[\x20,.;]?\x20?[a-zA-Z]"), 1).otherwise(2),
        "money": F.when(left.rlike(r"[$€£#v]\x20?$") | right.rlike(r"^\x20?(?:[$€£%]|usd|eur|km|kg|ms)"), 1).otherwise(0),
        "dated": F.when(value.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2})$") | value.rlike(r"^(?:1[5-9]|20)[0-9]{2}[\x20/-](?:1[5-9]|20)?[0-9]{2}$"), 1).otherwise(0),
    }


def _training(spark: SparkSession) -> DataFrame:
    """TRAINING generated candidates (kind, value, left, right, label, held): formats by kind and contexts, by hash."""
    def pick(seed: int, *values: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(values))) + 1).cast("int"))

    def filled(mask: Column) -> Column:
        """Each 9 of a mask becomes a digit, each A a capital, each f a hex digit, by the hash of id and place."""
        def draw(c: Column, i: Column) -> Column:
            h = F.xxhash64("id", i)
            return (
                F.when(c == "9", F.pmod(h, F.lit(10)).cast("string"))
                .when(c == "A", F.char(F.pmod(h, F.lit(26)) + 65))
                .when(c == "~", F.substring(F.lit("0123456789abcdef"), (F.pmod(h, F.lit(16)) + 1).cast("int"), F.lit(1)))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(mask, ""), draw), "")

    yes = {
        "masked_email": ("joe.doe [at] mail.example [dot] com", "info(at)firm.org", "a99 {at} host{dot}net", "mary99 [at] site.co.uk"),
        "national_phone": ("(999) 999-9999", "999-999-9999", "999.999.9999", "0999 999 9999", "99 99 99 99 99", "0999/999 9999", "(09) 9999 9999"),
        "tax_id": ("999-99-9999",),
        "account": ("DE99 9999 9999 9999 9999 99", "GB99AAAA99999999999999", "FR9999999999999999999999999", "ES99 9999 9999 9999 9999 9999"),
        "ipv6": ("2001:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", "fe80:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~"),
    }
    no = {
        "masked_email": ("version [at] 9.9", "meet (at) 9.99", "x [at] y.9"),
        "national_phone": ("2099-09-19", "19.09.2019", "1999-2009", "99.99", "9999 9999", "99 99", "999.99", "99-99", "999/99", "2019/09", "9999-9999", "09.99.99", "999 999", "99 99 99"),
        "tax_id": ("999-99-9999",),
        "account": ("AB99CDEF99GH99IJ99KL", "US99 MODEL SIZE BLUE"),
        "ipv6": ("99:99:99:99", "12:30:45:10", "a:b:c:d", "~~:~~:~~:~~:~~:~~"),
    }
    personal = ("call me at ", "my phone: ", "contact: ", "tel. ", "mail to ", "ssn ", "bank account: ", "telefon ", "reach us on ", "fax ")
    neutral = ("order no. ", "version ", "pages ", "on ", "isbn ", "from ", "score ", "total $", "the result ", "and of ", "line ", "build v")
    rows = spark.range(TRAINING).withColumn("label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")).withColumn("kind", pick(2, *EXTRA))
    shape = reduce(lambda c, k: F.when((F.col("kind") == k) & (F.col("label") == 1), pick(3, *yes[k])).when((F.col("kind") == k) & (F.col("label") == 0), pick(3, *no[k])).otherwise(c), EXTRA, F.lit(""))
    # nine in ten personal data stand in a personal or plain context, look-alikes in a neutral or plain one
    odd = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(10)) == 0
    strict = F.col("kind") == "tax_id"  # its look-alikes differ by context alone
    warm, cold = F.coalesce(pick(5, *personal)), F.coalesce(pick(6, *neutral))
    plain = pick(7, "seen here: ", "there was ", "it is ", "und dann ")
    mixed = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2)) == 0
    left = F.when(F.col("label") == 1, F.when(odd & ~strict, cold).when(mixed & ~strict, plain).otherwise(warm)).otherwise(F.when(odd & ~strict, warm).when(mixed, plain).otherwise(cold))
    return rows.select("id", "kind", "label", filled(shape).alias("value"), left.alias("left"), pick(9, "", " please", ".", " and more", ", thanks", " %").alias("right"), (F.pmod(F.xxhash64("id", F.lit(10)), F.lit(4)) == 0).alias("held"))


# boosting -----------------------------------------------------------------------------------------

Tree = list[tuple[list[tuple[str, int, bool]], float]]  # leaves: conditions (feature, value, equal), value


@dataclass(frozen=True)
class Booster:
    """Trees over categorical features, and the least probability that selects a candidate, by kind."""

    trees: tuple
    prior: float
    thresholds: dict

    def margin(self, features: dict[str, Column]) -> Column:
        def leaf(tree: Tree) -> Column:
            out = F.lit(0.0)
            for conditions, value in tree:
                test = reduce(lambda a, b: a & b, [(features[f] == v) if same else (features[f] != v) for f, v, same in conditions], F.lit(True))
                out = F.when(test, F.lit(value)).otherwise(out)
            return out

        return reduce(lambda a, b: a + b, [leaf(t) for t in self.trees], F.lit(self.prior))

    def score(self, kind: Column, features: dict[str, Column]) -> Column:
        """The probability of a candidate that its kind's threshold selects; null for others."""
        edge = lambda k: -math.log(1 / self.thresholds[k] - 1) if self.thresholds[k] < 1 else math.inf
        least = reduce(lambda c, k: F.when(kind == k, F.lit(edge(k))).otherwise(c), EXTRA, F.lit(math.inf))
        above = F.filter(F.array(self.margin(features)), lambda m: m >= least)  # so that the trees are summed once
        return F.get(F.transform(above, lambda m: 1 / (1 + F.exp(-m))), F.lit(0))


def _grow(cells: list[tuple[dict, float, float]], depth: int, path: list) -> Tree:
    """A regression tree on (features, gradient, hessian) of cells by the second-order gain."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best, split = 1e-6, None
    if depth:
        for f, n in FEATURES.items():
            for v in range(n):
                gl = sum(c[1] for c in cells if c[0][f] == v)
                hl = sum(c[2] for c in cells if c[0][f] == v)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best:
                    best, split = gain, (f, v)
    if split is None:
        return [(path, RATE * g / (h + 1))]
    f, v = split
    inside, outside = [c for c in cells if c[0][f] == v], [c for c in cells if c[0][f] != v]
    return _grow(inside, depth - 1, [*path, (f, v, True)]) + _grow(outside, depth - 1, [*path, (f, v, False)])


def _value(tree: Tree, x: dict) -> float:
    return next(v for conditions, v in tree if all((x[f] == k) == same for f, k, same in conditions))


def boost(cells: list[tuple[dict, int, int, int, int]]) -> Booster:
    """Boosted logistic trees from cells (features, fit negatives, fit positives, held negatives, held positives)."""
    pos, neg = sum(c[2] for c in cells), sum(c[1] for c in cells)
    prior = math.log((pos + 1) / (neg + 1))
    margin, trees = [prior] * len(cells), []
    for _ in range(ROUNDS):
        rows = []
        for (x, n, p, _, _), m in zip(cells, margin, strict=True):
            q = 1 / (1 + math.exp(-m))
            rows.append((x, p - (n + p) * q, (n + p) * q * (1 - q)))
        trees.append(_grow(rows, DEPTH, []))
        margin = [m + _value(trees[-1], c[0]) for m, c in zip(margin, cells, strict=True)]
    thresholds = {}
    for i, kind in enumerate(EXTRA):
        held = sorted(((1 / (1 + math.exp(-m)), c[3], c[4]) for m, c in zip(margin, cells, strict=True) if c[0]["kind"] == i), reverse=True)
        good = bad = 0
        thresholds[kind] = 2.0  # selects nothing
        for p, n, y in held:
            good, bad = good + y, bad + n
            if good and good >= PRECISION * (good + bad):
                thresholds[kind] = p - 1e-9
    return Booster(tuple(trees), prior, thresholds)


def train(spark: SparkSession) -> Booster:
    """Fits the trees on the cells of the generated table; they are few, whatever TRAINING is."""
    rows = _training(spark).select("label", "held", *[c.alias(n) for n, c in _features(F.col("kind"), F.col("value"), F.col("left"), F.col("right")).items()])
    count = lambda held, label: F.count(F.when((F.col("held") == held) & (F.col("label") == label), 1))
    cells = rows.groupBy(*FEATURES).agg(count(False, 0).alias("fn"), count(False, 1).alias("fp"), count(True, 0).alias("hn"), count(True, 1).alias("hp"))
    found = sorted(cells.collect(), key=lambda r: tuple(r))
    return boost([({f: r[f] for f in FEATURES}, r["fn"], r["fp"], r["hn"], r["hp"]) for r in found])


# operators ----------------------------------------------------------------------------------------


def find_personal_data(docs: DataFrame, booster: Booster) -> DataFrame:
    """docs with spans: the base rules' matches and the looser candidates that the trees select.

    A span is (kind, start, end, value), in code points, end exclusive, of KINDS, base rules first. Looser
    ones overlap no base match; of looser ones that overlap each other the most probable stays, then what it
    leaves free (of equal ones the first, then the shorter one).
    A null or empty text has none. Every column of docs stays (one named `spans` is replaced); repeated rows
    are judged one by one. An empty table gives an empty table.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = {"email": EMAIL_RE, "ip": IP_RE, "card": CARD_RE, "phone": PHONE_RE, **EXTRA_RE}
    row = docs.select(F.struct(*own).alias("_row"), text.alias("_text"), text.rlike("[0-9][\\x20()./-]*[0-9]").alias("_digits"))
    found = []
    for k, p in patterns.items():
        gaps, hits = matches(F.col("_text"), p, _may(k, F.col("_text")))
        found += [gaps.alias(f"_g_{k}"), hits.alias(f"_h_{k}")]
    row = row.select("_row", *found)
    lengths = lambda k: F.zip_with(F.slice(f"_g_{k}", F.lit(1), F.size(f"_h_{k}")), f"_h_{k}", lambda g, h: F.length(g) + F.length(h))
    row = row.select("*", *[lengths(k).alias(f"_n_{k}") for k in patterns])
    row = row.select("*", *[scan(F.col(f"_n_{k}"), "int", lambda end, n: F.coalesce(end, F.lit(0)) + n).alias(f"_e_{k}") for k in patterns])
    none = lambda kind: F.array().cast(f"array<{kind}>")
    some = lambda k, spans, kind: F.when(F.size(f"_h_{k}") > 0, spans).otherwise(none(kind))
    base = {k: F.filter(_placed(F.col(f"_h_{k}"), F.col(f"_e_{k}"), k), _passes(k)) for k in BASE}
    more = {k: _with_context(F.col(f"_g_{k}"), F.col(f"_h_{k}"), F.col(f"_e_{k}"), k) for k in EXTRA}
    slim = "struct<kind:string,start:int,end:int,value:string>"
    row = row.select("_row", F.concat(*[some(k, s, slim) for k, s in base.items()]).alias("_base"), F.concat(*[some(k, s, _SPAN) for k, s in more.items()]).alias("_more"))
    row = _cleared(row)

    def featured(s: Column) -> Column:
        bare = F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value")])
        return F.struct(bare.alias("span"), *[c.alias(f"f_{n}") for n, c in _features(s["kind"], s["value"], s["left"], s["right"]).items()])

    score = lambda x: F.struct(x["span"].alias("span"), booster.score(x["span"]["kind"], {n: x[f"f_{n}"] for n in FEATURES}).alias("p"))
    scored = F.filter(F.transform(F.transform("_more", featured), score), lambda x: x["p"].isNotNull())
    row = row.withColumn("_more", F.when(F.size("_more") > 0, scored).otherwise(none(f"struct<span:{slim},p:double>")))
    row = _settled(row).select("_row", F.concat("_base", "_more").alias("spans"))
    return row.select("_row.*", "spans")


CHUNK = 1024


def redact(found: DataFrame) -> DataFrame:
    """The rows of find_personal_data without spans, each span of `text` replaced by its kind, as [EMAIL].

    Overlapping spans become one mark of the first one's kind (of equal starts, the longest one's). A null
    text stays null. Texts are cut from pieces of CHUNK code points, so a place costs the same wherever it is.
    """
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def cut(start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        held = F.slice("_chunks", first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1)
        return F.when(start < end, F.substring(F.array_join(held, ""), start - first * CHUNK + 1, end - start)).otherwise("")

    order = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    row = found.withColumn("_chunks", F.when(F.size("spans") > 0, chunks)).withColumn("_order", F.when(F.size("spans") > 0, order))
    row = row.withColumn("_reached", scan(F.col("_order"), "int", lambda end, x: F.greatest(end, -x["back"])))

    def piece(x: Column, at: Column) -> Column:
        return F.when(x["start"] >= at, F.concat(cut(at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

    rest = cut(F.element_at("_reached", -1), F.length("text"))
    marked = F.concat(F.array_join(F.zip_with("_order", _before("_reached", F.lit(0)), piece), ""), rest)
    return row.withColumn("text", F.when(F.size("spans") > 0, marked).otherwise(F.col("text"))).drop("spans", "_chunks", "_order", "_reached")
