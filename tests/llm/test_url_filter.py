from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from foliospark.llm import url_filter as u


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fits = [(h + p, v) for v, h, p in u.DEFAULT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0])) if fits else (None, None)


ODD = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com", "http://example.com/en/", "x://net/es/a", "x://sub.net/fr/", "a://b://c/d", "http://Ünet/es/", "://?x", "http://com/", "http://xcom/", "http://a.com?/en/"]


def test_hosts_paths_and_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(ODD)], "page_id long, url string")
    both = pages.unionByName(odd)
    urls = {r.page_id: r.url for r in both.collect()}
    rows = u.judge_urls(both).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = plain(urls[r.page_id])
        name, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name), urls[r.page_id]
        assert r.verdict == (verdict or ("allow" if r.score >= r.threshold else "block"))


def test_model_against_plain_counts():
    texts = ["abc/de", "abd.com", "xyz-1", "ab"]
    counts = [np.zeros(n, dtype=np.int64) for n in u.SIZES]
    grams, _ = u._grams(pa.array(texts))
    for k, g in enumerate(grams):
        np.add.at(counts[k], g, 1)
    seen = [defaultdict(Counter) for _ in range(u.ORDER + 1)]
    fold = lambda t: [0] * u.ORDER + [int(u._CODE[b]) for b in t.encode()]
    for t in texts:
        c = fold(t)
        for i in range(u.ORDER, len(c)):
            for k in range(u.ORDER + 1):
                seen[k][tuple(c[i - k : i])][c[i]] += 1
    for t in ["abq", "zz", "abc"]:
        c, want = fold(t), 0.0
        for i in range(u.ORDER, len(c)):
            p = 1 / u.ALPHABET
            for k in range(u.ORDER + 1):
                n = seen[k][tuple(c[i - k : i])]
                if n:
                    p = (n[c[i]] + len(n) * p) / (sum(n.values()) + len(n))
            want += math.log(p)
        got = u.Markov(counts).log_probability(u._grams(pa.array([t]))[0]).sum()
        assert got == pytest.approx(want)


def test_separates_held_out_urls(spark):
    good = [(i, f"http://news{i % 40}.org/story/{i}.html") for i in range(300)]
    bad = [(1000 + i, f"http://cheap-pills{i % 40}.biz/buy?x={i}") for i in range(300)]
    rules = [("allow", f"news{k}.org", "/") for k in range(30)] + [("block", f"cheap-pills{k}.biz", "/") for k in range(30)]
    rows = u.judge_urls(spark.createDataFrame(good + bad, "page_id long, url string"), rules).where("rule IS NULL").collect()
    assert len(rows) == 140
    assert sum((r.verdict == "allow") == (r.page_id < 1000) for r in rows) == 140


def test_empty_tables(spark):
    assert u.judge_urls(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0
    row = u.judge_urls(spark.createDataFrame([(1, None, "x")], "page_id long, url string, score string")).first()
    assert (row.host, row.path, row.rule, row.score) == ("", "", None, 0.0)


def test_null_and_repeated_page_ids(spark, sf):
    """Each row is judged by its own url, whatever its id; repeated rows come back as often."""
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").limit(60).collect()]
    rows = pages + pages[:5] + [(None, pages[7][1]), (None, None), (pages[3][0], "http://net/es/other"), (pages[3][0], None)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS verdict")
    got = sorted(((-1 if r.page_id is None else r.page_id), r.host, r.path, r.rule or "") for r in u.judge_urls(table).collect())
    want = sorted(((-1 if i is None else i), *plain(url), rule_of(*plain(url))[0] or "") for i, url in rows)
    assert got == want
