"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A classifier fitted on the labelled documents predicts each document's posterior over domains; rates
(how often a document is to be taken, on average) are fitted so that the expected tokens by domain meet
the targets: minimise sum_k (sum_d r_d n_d p_dk - T_k)^2 / S_k + ridge, subject to r >= 0. T_k is the
target share of all tokens and S_k what domain k has at rate 1, so that a rare domain counts as much as a
frequent one. This is the least-squares solution; where posteriors are too soft to tell domains apart, no
rates meet the targets, and the solution misses them by as little as it can.

The classifier is naive Bayes over word hashes of a bounded number of FEATURES, with posteriors tempered
by text length so that they stay soft. The rates are fitted by accelerated projected gradient until no document's
projected gradient is left. As the curvatures lie up to 1 / RIDGE apart, from rates of 1 that takes hundreds of
passes over the documents, so the descent starts near its end: at the solution a document's rate follows from its
own posteriors and one K-vector, which Newton steps on that vector find. Each step of either kind is one
distributed sum of a few numbers over (tokens, posteriors); no rate is ever gathered.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import stored

FEATURES = 1 << 14
LABELLED = 200_000  # documents the classifier is fitted on
STEPS, GAP = 200, 1e-7  # most steps of the descent, and the projected gradient of a document that ends it
PASSES, SETTLED = 200, 1e-8  # most sums over all documents; the gradient, as a share of a domain, that ends them
RIDGE = 0.002  # pull of every rate towards 1
TEMPER = 10.0  # words of evidence a posterior counts at most
ALPHA = 0.5

DOMAINS = ("good", "poor", "toxic")
#: The registered target: shares of the expected tokens.
TARGETS = {"good": 0.8, "poor": 0.19, "toxic": 0.01}


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, x): the feature of each word of a text; features are hashes of lower-cased runs of non-space."""
    words = rows.select(*keys, F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''")
    return words.select(*keys, F.pmod(F.xxhash64("w"), F.lit(FEATURES)).cast("int").alias("x"))


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, e): of each feature the array of its log-probabilities in DOMAINS; at most FEATURES rows.

    It is fitted on about LABELLED labelled documents, which the hash of doc_id picks (all, if there are
    fewer than twice as many), so their ids are a bounded broadcast and no text is shuffled. An id with
    labels of several domains teaches nothing. Without labels every domain is alike.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("quality"), F.col("toxic")).alias("domain"))
    known = known.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
    known = known.where("domain = other").drop("other")
    share = max(1, labels.count() // LABELLED)
    taught = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(taught, "doc_id")
    counts = _words(rows, "domain").groupBy("x").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS])
    counts = stored(counts, "features")  # FEATURES rows
    totals = counts.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(f"t_{d}") for d in DOMAINS])
    e = F.array(*[F.ln((F.col(d) + ALPHA) / (F.col(f"t_{d}") + ALPHA * FEATURES)) for d in DOMAINS])
    return counts.crossJoin(F.broadcast(totals)).select("x", e.alias("e"))  # one row of totals


def posteriors(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(key, tokens, p): words of each of texts(key, text) and its posterior over DOMAINS; wordless texts are left out.

    Words are scored where they are read and summed by text before the shuffle.
    """
    known = _words(texts.where("text IS NOT NULL"), "key").join(F.broadcast(model), "x", "left")  # FEATURES rows
    sums = [F.sum(F.coalesce(F.col("e")[i], F.lit(0.0))).alias(f"s{i}") for i in range(len(DOMAINS))]
    scored = known.groupBy("key").agg(F.count(F.lit(1)).alias("tokens"), *sums)
    raw = [F.col(f"s{i}") * F.least(F.lit(1.0), TEMPER / F.col("tokens")) for i in range(len(DOMAINS))]
    ex = [F.exp(r - F.greatest(*raw)) for r in raw]
    return scored.select("key", "tokens", F.array(*[x / sum(ex[1:], ex[0]) for x in ex]).alias("p"))


ETA = 1.0 / (1.0 + RIDGE)
_ROOT = ((1.0 + RIDGE) / RIDGE) ** 0.5
MOMENTUM = (_ROOT - 1) / (_ROOT + 1)


def fit_rates(members: DataFrame, targets: Mapping[str, float] = TARGETS, start: Column | None = None, steps: int = STEPS) -> tuple[list[list[float]], float]:
    """Projected gradient steps on the rates of members(tokens, p), from `start` (1, without): their K-vectors and the gap.

    In units of all tokens: a_k = sum_d r_d n_d p_dk / N, target t_k, s_k = a_k at rate 1. The gradient for
    document d, per token, is sum_k p_dk (a_k - t_k) / s_k + RIDGE (r_d - 1), so a step needs of all documents the K
    sums alone. Posteriors sum to 1, so the curvature lies between RIDGE and 1 + RIDGE: the step length ETA never
    overshoots, and MOMENTUM is that of strongly convex functions. Steps end when no document's projected gradient
    is above GAP, or after `steps`; the gap is the largest one left before the last step.
    """
    want = [float(targets.get(d, 0.0)) for d in DOMAINS]
    norm = sum(want) or 1.0
    history: list[list[float]] = []
    table = members.select("tokens", "p")
    tokens, p = F.col("tokens"), F.col("p")
    first = table.agg(F.sum("tokens"), *[F.sum(tokens * p[k]) for k in range(len(DOMAINS))]).first()
    total, gap = first[0], 0.0
    if not total:
        return history, gap
    share = [x / total for x in first[1:]]
    for _ in range(max(1, steps)):
        at = _rates(p, start, history)["ahead"]
        a = table.agg(*[F.sum(at * tokens * p[k]) / total for k in range(len(DOMAINS))]).first()
        g = [(x - w / norm) / s if s > 1e-12 else 0.0 for x, w, s in zip(a, want, share, strict=True)]
        slope = sum((p[k] * F.lit(float(x)) for k, x in enumerate(g)), F.lit(0.0)) + RIDGE * (at - 1)
        gap = table.agg(F.max(F.abs(at - F.greatest(F.lit(0.0), at - slope)))).first()[0]
        history.append(g)
        if gap < GAP:
            break
    return history, gap


def _rates(p: Column, start: Column | None, history: list[list[float]]) -> Column:
    """struct(rate, ahead) after the recorded steps: the rate, and where the next gradient is taken."""
    begin = F.lit(1.0) if start is None else start
    begin = F.struct(begin.alias("rate"), begin.alias("ahead"))
    if not history:
        return begin
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in history])
    push = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def step(was, g):
        new = F.greatest(F.lit(0.0), was["ahead"] - ETA * (push(g) + RIDGE * (was["ahead"] - 1)))
        return F.struct(new.alias("rate"), (new + MOMENTUM * (new - was["rate"])).alias("ahead"))

    return F.aggregate(steps, begin, step)


def rate(p: Column, start: Column | None, history: list[list[float]]) -> Column:
    """The rate after the recorded steps: each is a gradient step and a projection on r >= 0."""
    return _rates(p, start, history)["rate"]


def settled_rate(p: Column, g: list[float]) -> Column:
    """The rate at which the gradient, projected on r >= 0, is 0 for a document, if g is the vector of all."""
    return F.greatest(F.lit(0.0), 1 - sum((p[k] * F.lit(float(x)) for k, x in enumerate(g)), F.lit(0.0)) / RIDGE)


def solve_rates(members: DataFrame, targets: Mapping[str, float] = TARGETS) -> list[float]:
    """The vector g_k = (a_k - t_k) / s_k of the least-squares rates over members(tokens, p): where the descent starts.

    Units are those of fit_rates. With r(g) from settled_rate, g is the minimum of the convex function
    sum_k (s_k g_k^2 / 2 + t_k g_k) + RIDGE / 2 sum_d n_d r_d(g)^2 / N, found by Newton steps with halving.
    """
    n = len(DOMAINS)
    want = np.array([float(targets.get(d, 0.0)) for d in DOMAINS])
    want /= want.sum() or 1.0
    first = members.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[k]) for k in range(n)]).first()
    total = first[0]
    if not total:
        return [0.0] * n
    share = np.array(first[1:]) / total
    live = np.flatnonzero(share > 1e-12)  # what no document has is out of reach
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def at(g):
        r, p = settled_rate(F.col("p"), list(g)), lambda k: F.col("p")[k]
        on = F.when(r > 0, F.col("tokens")).otherwise(0)
        sums = [F.sum(F.col("tokens") * r * r), *[F.sum(F.col("tokens") * r * p(k)) for k in range(n)], *[F.sum(on * p(i) * p(j)) for i, j in pairs]]
        row = np.array(members.agg(*sums).first(), dtype=float) / total
        curve = np.diag(share)
        for (i, j), x in zip(pairs, row[n + 1 :], strict=True):
            curve[i, j] += x / RIDGE
            curve[j, i] = curve[i, j]
        return share @ (g * g) / 2 + want @ g + RIDGE / 2 * row[0], (share * g + want - row[1 : n + 1])[live], curve[np.ix_(live, live)]

    g = np.zeros(n)
    value, slope, curve = at(g)
    step, length = None, 1.0
    for _ in range(PASSES):
        if np.abs(slope / share[live]).max() < SETTLED:
            return g.tolist()
        if step is None:
            step, length = np.zeros(n), 1.0
            step[live] = -np.linalg.solve(curve, slope)
        new = at(g + length * step)
        if new[0] <= value + 1e-4 * length * (slope @ step[live]) + 1e-13 * abs(value):
            g, (value, slope, curve), step = g + length * step, new, None
        else:
            length /= 2
    return g.tolist()


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """(doc_id, tokens, p_good, p_poor, p_toxic, rate) of each row of docs(doc_id, text, ..).

    labels has (doc_id, quality, toxic). A null or blank text has no tokens, equal posteriors and rate 0.
    Rows of one doc_id and text share their result; other columns are ignored. Targets are shares,
    normalised to 1; missing domains have target 0; they are met as far as posteriors allow. An empty table gives an empty table, and without
    labels posteriors are equal and rates stay near 1.
    """
    alike = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().count() < docs.count()
    key = F.xxhash64("doc_id", "text") if alike else F.col("doc_id").cast("long")
    keyed = docs.select("doc_id", "text", key.alias("key"))
    texts = keyed.select("key", "text")
    members = stored(posteriors(texts.dropDuplicates(["key"]) if alike else texts, train(docs, labels)), "members")
    copies = keyed.select("doc_id", "key").join(members, "key", "left")
    start = settled_rate(F.col("p"), solve_rates(members, targets))
    history, _ = fit_rates(members, targets, start)
    k = len(DOMAINS)
    p = F.coalesce("p", F.array(*[F.lit(1.0 / k)] * k))
    return copies.select(
        "doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), *[p[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        F.when(F.col("tokens") > 0, rate(F.col("p"), start, history)).otherwise(F.lit(0.0)).alias("rate"),
    )
