from __future__ import annotations

import math
import random
import re
import time

from pyspark.sql import functions as F

from foliospark.llm import pii


def passes_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_base(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and passes_luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


CASES = [
    "mail a.b+c@x-y.co.uk, then a@b and x@y.z_q@r.st end", "ips 1.2.3.4.5.6.7.8 300.1.1.1 0255.01.1.1 1.2.3",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005 5", "+1 (523) 555-1055 or +12 3 +123456789012345678 +4420 7946 0958.",
    "é日本 🙂 joe@host.example 🙂 10.0.0.1", "@@a@b.c@d.e", "a" * 500 + "@" + "b" * 500 + ".c" * 500, "1 " * 3000, "+1" + " " * 2000 + "9",
    "\u0001 x@y.zz \u0002", "1.1.1.1" * 50, "00000000000000",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans_of(frame):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in frame.collect()}


def test_base_rules(spark, sf):
    booster = pii.train(spark)
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = CASES + docs
    got = spans_of(pii.find_personal_data(rows(spark, texts), booster))
    for i, t in enumerate(texts):
        assert sorted(s for s in got[i] if s[0] in pii.BASE) == plain_base(t), t[:200]


def test_looser_candidates(spark):
    booster = pii.train(spark)
    yes = {"call me at (555) 123-4567 please": "national_phone", "my ssn 123-45-6789.": "tax_id", "mail to joe.doe [at] mail.example [dot] com": "masked_email", "bank account: DE89 3704 0044 0532 0130 00": "account"}
    no = ["pages 1999-2009 of it", "on 2021-03-04 we met", "version 12.34.56", "it is plain text", "order no. 4521 7788", "the ratio 3:4:5:6"]
    got = spans_of(pii.find_personal_data(rows(spark, [*yes, *no]), booster))
    for i, (t, kind) in enumerate(yes.items()):
        assert [s[0] for s in got[i]] == [kind], t
    for i, t in enumerate(no):
        assert got[len(yes) + i] == [], t


def long_text(matches):
    """A text of very many matches of several rules, with candidates between them."""
    parts = ("10.0.{}.7", "+1 523 555 {:04d}", "a{}@b.example", "call 0999 123 {:04d}", "joe [at] mail{}.example [dot] com", "é {} 🙂", "2021-03-{}")
    return " ".join(parts[i % len(parts)].format(i % 250) for i in range(matches))


def test_long_texts_of_matches(spark):
    """The time grows in proportion to the text: 2 MB of matches are a matter of seconds."""
    booster = pii.train(spark)
    texts = [long_text(3_000), long_text(130_000)]
    assert len(texts[1]) > 1_900_000
    for t in texts:
        began = time.time()
        found = pii.find_personal_data(rows(spark, [t]), booster)
        spans = sorted(spans_of(found)[0])
        clean = pii.redact(found).first().text
        assert time.time() - began < 60
        assert [s for s in spans if s[0] in pii.BASE] == plain_base(t)
        assert not [s for s in plain_base(clean)] and clean.count("🙂") == t.count("🙂")


def test_overlaps_with_base_matches_against_all_pairs(spark):
    rng = random.Random(6)
    cases = []
    for _ in range(60):
        base, more = ([(a, a + rng.randrange(1, 9)) for a in rng.choices(range(60), k=rng.randrange(9))] for _ in range(2))
        cases.append((base, more))
    kinds = "base array<struct<start:int,end:int>>, more array<struct<start:int,end:int>>"
    table = spark.createDataFrame(cases, kinds)
    full = lambda c: F.transform(c, lambda s: F.struct(F.lit("k").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[F.lit("").alias(x) for x in ("value", "left", "right")]))
    spans = table.select("base", "more", full("base").alias("_base"), full("more").alias("_more"))
    for r in pii._cleared(spans).collect():
        want = [(a, b) for a, b in r.more if not any(a < y and x < b for x, y in r.base)]
        assert sorted((s.start, s.end) for s in r._more) == sorted(want)


def test_overlapping_candidates_settle_by_probability(spark):
    rng = random.Random(9)
    cases = [[(a, a + rng.randrange(1, 9), rng.randrange(5) / 5) for a in rng.sample(range(50), k=rng.randrange(12))] for _ in range(60)]
    table = spark.createDataFrame([(c,) for c in cases], "found array<struct<start:int,end:int,p:double>>")
    span = lambda s: F.struct(F.lit("k").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("value"))
    spans = table.select("found", F.transform("found", lambda s: F.struct(span(s).alias("span"), s["p"].alias("p"))).alias("_more"))
    for r in pii._settled(spans).collect():
        want = []
        for s in sorted(r.found, key=lambda s: (-s.p, s.start, s.end)):
            if not any(s.start < b and a < s.end for a, b in want):
                want.append((s.start, s.end))
        assert sorted((s.start, s.end) for s in r._more) == sorted(want)


def test_running_sums(spark):
    table = spark.range(400).select("id", F.when(F.col("id") > 0, F.sequence(F.lit(1), F.col("id").cast("int"))).otherwise(F.array().cast("array<int>")).alias("x"))
    for r in table.select("id", pii.scan(F.col("x"), "int", lambda s, x: F.coalesce(s, F.lit(0)) + x).alias("s")).collect():
        assert r.s == [i * (i + 1) // 2 for i in range(1, r.id + 1)]


def test_trees_against_a_plain_evaluation(spark):
    """The compiled CASE expressions give the sums of the trees' leaves."""
    booster = pii.train(spark)
    rng = random.Random(2)
    cases = [{f: rng.randrange(n) for f, n in pii.FEATURES.items()} for _ in range(200)]
    frame = spark.createDataFrame([tuple(x.values()) for x in cases], ", ".join(f"{f} int" for f in pii.FEATURES))
    got = frame.select(*pii.FEATURES, booster.margin({f: F.col(f) for f in pii.FEATURES}).alias("margin")).collect()
    for r in got:
        x = {f: r[f] for f in pii.FEATURES}
        leaves = [[v for conditions, v in tree if all((x[f] == k) == same for f, k, same in conditions)] for tree in booster.trees]
        assert all(len(v) == 1 for v in leaves)
        assert math.isclose(r.margin, booster.prior + sum(v[0] for v in leaves), rel_tol=1e-9, abs_tol=1e-9)


def test_redaction_round_trip(spark, sf):
    booster = pii.train(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = pii.find_personal_data(docs, booster)
    clean = pii.redact(found)
    assert clean.columns == docs.columns
    spans, texts = spans_of(found), {r.doc_id: r.text for r in docs.collect()}
    for r in clean.collect():
        want, at = "", 0
        for k, a, b in sorted(spans[r.doc_id], key=lambda s: (s[1], -s[2])):
            if a >= at:
                want += texts[r.doc_id][at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert r.text == want + texts[r.doc_id][at:]
        assert not plain_base(r.text)


def test_odd_and_empty_rows(spark, odd_docs, no_docs):
    booster = pii.train(spark)
    found = pii.find_personal_data(odd_docs, booster)
    assert found.count() == odd_docs.count()
    assert pii.redact(found).columns == odd_docs.columns
    assert sorted(r.text or "" for r in pii.redact(found).collect()) == sorted(r.text or "" for r in odd_docs.collect())
    assert pii.find_personal_data(no_docs, booster).count() == 0


def test_thresholds_come_from_held_out_cells():
    x = {f: 0 for f in pii.FEATURES}
    booster = pii.boost([({**x, "left": 2}, 0, 50, 0, 20), ({**x, "left": 1}, 50, 0, 20, 0)])
    assert booster.thresholds[pii.EXTRA[0]] < 1 and booster.thresholds[pii.EXTRA[1]] == 2.0
