from __future__ import annotations

import random
import re
from collections import Counter

from foliospark.llm.decontaminate import RADIUS, _blocks, _fingerprint, _near_blocks, find_leaks
from pyspark.sql import functions as F


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingled(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items, threshold=0.8):
    """Every item-sized window of every document."""
    out = {}
    for d, t in docs:
        s = shingled(words(t))
        for i, it in items:
            c = Counter(shingled(words(it)))
            n = sum(c.values())
            if not n or len(s) < n or not set(s) & set(c):
                continue
            best = 0
            for a in range(len(s) - n + 1):
                w = Counter(s[a : a + n])
                k = sum((w & c).values())
                best = max(best, k / (2 * n - k))
            if best >= threshold:
                out[d, i] = round(best, 9)
    return out


def got(frame):
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in frame.collect()}


def test_sample_against_all_windows(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert got(find_leaks(docs, bench)) == brute(rows, items)


def test_altered_passages(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(60))) for i in range(4)] + [(4, "a b"), (5, None), (6, "x y z q r " * 6)]
    docs = [(0, "clean " + " ".join(say(200))), (1, " ".join([*say(50), items[0][1], *say(30)])), (2, items[1][1].upper().replace(" ", ", "))]
    for k in range(3, 9):  # one to six words changed at the end or in the middle
        w = items[2][1].split()
        for j in range(k - 2):
            w[-1 - j if k % 2 else 30 + j] = "changed"
        docs.append((k, " ".join([*say(7), *w, *say(5)])))
    docs += [(20, "x y z q r " * 9), (21, None), (22, ""), (None, items[0][1])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    want = brute([d for d in docs if d[0] is not None], items)
    assert got(find_leaks(frame(docs, "doc_id"), frame(items, "item_id"))) == want
    assert {(1, 0), (2, 1), (3, 2), (20, 6)} <= set(want) and not any(d == 0 for d, _ in want)


def test_blocks_cover_the_radius(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(100):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), RADIUS):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b)))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k long, f long, h long")
    entered = _near_blocks(rows.select(F.col("k").alias("l"), "h"))
    met = rows.select("k", F.inline(_blocks(F.col("f")))).join(entered, ["i", "v"]).where("k = l").select("k").distinct()
    assert met.count() == len(pairs)


def test_fingerprint_is_the_weighted_majority(spark):
    rng = random.Random(4)
    rows = [(1, rng.getrandbits(63), rng.randint(1, 5)) for _ in range(40)]
    f = _fingerprint(spark.createDataFrame(rows, "k long, g long, w long"), "k").first().f
    total = sum(w for *_, w in rows)
    want = sum(1 << b for b in range(64) if 2 * sum(w for _, g, w in rows if g >> b & 1) > total)
    assert f % (1 << 64) == want


def test_odd_and_empty_rows(spark, odd_docs, no_docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert find_leaks(odd_docs, bench).count() == 0
    assert find_leaks(no_docs, bench).count() == 0
    assert find_leaks(odd_docs, bench.where("false")).count() == 0


def test_shifted_cut_and_reordered_passages(spark):
    """Leaks whose best window stands at other offsets than the item's, or where the text is shorter than the item."""
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item = say(60)
    docs = [
        (1, item[3:] + say(40)), (2, say(40) + item[:-3]), (3, say(40) + item[:30] + item[31:]), (4, say(20) + item[30:] + item[:30] + say(20)),
        (5, say(9) + item[:20] + ["new"] + item[20:] + say(9)), (6, item[:30] + item[31:] + say(20)), (7, say(80)), (8, item[30:] + item[:30]),
    ]
    short = [(20, item[3:]), (21, item[:-6]), (22, item[5:-6]), (23, item[12:]), (24, item[:3])]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    want = brute([(i, " ".join(w)) for i, w in docs], [(0, " ".join(item))])
    assert {d for d, _ in want} >= {1, 2, 4, 5, 8}
    for d, w in short:
        n = len(shingled(w))
        if n / 56 >= 0.8:
            want[d, 0] = round(n / 56, 9)
    found = find_leaks(frame(docs + short, "doc_id"), frame([(0, item)], "item_id"))
    assert got(found) == want
    assert {r.doc_id: (r.start, r.n_words) for r in found.collect()}[20] == (0, 57)


def test_texts_under_one_id_and_a_long_item(spark):
    """Texts of one doc_id are one document with its best window; a long item is found inside a longer text."""
    rng = random.Random(31)
    say = lambda n: [rng.choice([f"w{i}" for i in range(4000)]) for _ in range(n)]
    item, long = say(60), say(1500)
    near = list(item)
    near[30] = "changed"
    inside = say(40) + long[:700] + ["put", "in"] + long[700:] + say(40)
    docs = [(1, " ".join(say(20) + near)), (1, " ".join(item + say(9))), (1, None), (2, " ".join(say(300))), (3, " ".join(inside)), (None, " ".join(item))]
    items = [(7, " ".join(item)), (8, " ".join(long))]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    one = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(one) == {(1, 7), (3, 8)} and one[1, 7].similarity == 1.0 and one[1, 7].start == 0
    assert got(found.where("doc_id = 3")) == brute([(3, " ".join(inside))], items)
