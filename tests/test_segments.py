from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import index, query
from foliospark.plans import index_queries
from foliospark.sources import segments
from foliospark.sources.manifest import Conflict, Manifest
from foliospark.sources.segments import SegmentedIndex, blocked, partition_of

WORDS = ["alpha", "beta", "gamma", "con", "delta", "aux", "omega", "zeta", "eta", "iota"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "book_id long, text string")


def plain(rows):
    out = {}
    for i, text in rows:
        for w in text.split():
            out.setdefault(w, set()).add(i)
    return out


def dict_of(postings):
    out = {}
    for r in postings.collect():
        assert r.book_id not in out.setdefault(r.term, set())
        out[r.term].add(r.book_id)
    return out


def queries(spark, lines):
    return query.parse_queries(spark.createDataFrame([("\n".join(lines),)], "content string"))


def answers(frame):
    out = {}
    for r in frame.collect():
        assert r.book_id not in out.setdefault(r.query_id, set())
        out[r.query_id].add(r.book_id)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(segments, "DENSE", 8)


def test_batches_are_served_and_compaction_changes_nothing(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    rows = [(rng.choice([i, 40_000 + i, 200_000 + i]), " ".join(rng.choices(WORDS, k=3))) for i in range(1, 121)]
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    assert stored.postings().count() == 0 and stored.lookup("alpha").count() == 0
    for a in range(0, 120, 20):
        assert stored.add(frame(spark, rows[a : a + 20]))
    want = plain(rows)
    assert dict_of(stored.postings()) == want
    asked = queries(spark, ["alpha beta", "gamma", "alpha beta gamma", "absent alpha", "eta eta iota"])
    hits = {1: want["alpha"] & want["beta"], 2: want["gamma"], 3: want["alpha"] & want["beta"] & want["gamma"], 5: want["eta"] & want["iota"]}
    hits = {k: v for k, v in hits.items() if v}
    assert answers(stored.conjunctive(asked)) == hits
    before = stored.state()
    assert len(before["segments"]) == 6
    assert stored.compact(most=2) > 0
    assert dict_of(stored.postings()) == want and answers(stored.conjunctive(asked)) == hits
    assert len(stored.state()["books"]) == 1 and stored.compact(most=2) == 0
    old = [p for s in before["segments"] for p in s["partitions"]]
    assert all(old.count(p) <= 2 or sum(p in s["partitions"] for s in stored.state()["segments"]) == 1 for p in old)
    gone = stored.vacuum(keep=1)
    assert gone and dict_of(stored.postings()) == want
    for w in [*WORDS, "Alpha"]:
        assert {r.book_id for r in stored.lookup(w).collect()} == want.get(w, set())


def test_books_are_added_once(spark, tmp_path):
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    stored.add(frame(spark, [(1, "cat dog"), (2, "cat"), (3, None), (None, "owl")]))
    stored.add(frame(spark, [(2, "cat"), (1, "dog emu"), (4, "emu"), (4, "emu cat")]))
    assert dict_of(stored.postings()) == {"cat": {1, 2, 4}, "dog": {1}, "emu": {1, 4}}
    assert sorted(r.book_id for r in stored.books().collect()) == [1, 2, 3, 4]
    assert stored.add(frame(spark, [(5, "fox")]), "stream", 7)
    assert not stored.add(frame(spark, [(6, "fox")]), "stream", 7)
    assert dict_of(stored.lookup_terms(spark.createDataFrame([("fox",), ("no",)], "term string"))) == {"fox": {5}}


def test_known_books_read_their_partitions_only(spark, tmp_path):
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    stored.add(frame(spark, [(i, " ".join(WORDS)) for i in range(1, 30)]))
    missing = stored._missing(frame(spark, [(3, "alpha beta")]), stored.state())
    folders = lambda *words: {"letter={}/bucket={}".format(*partition_of(w)) for w in words}
    read = lambda frame: {"/".join(f.split("/")[-3:-1]) for f in frame.inputFiles()}
    assert read(missing) == folders("alpha", "beta") and "EqualTo(block,1)" in missing._jdf.queryExecution().toString()
    assert missing.count() == 0
    look = stored.conjunctive(queries(spark, ["gamma con"]))
    assert read(look) == folders("gamma", "con") and "In(term, [" in look._jdf.queryExecution().toString()
    assert read(stored.lookup("zeta")) == folders("zeta")


@pytest.mark.parametrize("ids", [[1, 32_768, 32_769, 65_536, 65_537], [0, -1, -32_767, -32_768, 7], list(range(-40_000, 40_000, 9))])
def test_dense_and_sparse_blocks_hold_the_same(spark, tmp_path, monkeypatch, ids):
    rows = spark.createDataFrame([("cat", i) for i in ids + ids[:2]], "term string, book_id long")
    for dense in (1, 10**6):
        monkeypatch.setattr(segments, "DENSE", dense)
        found = blocked(rows, 1)
        assert {r.bits is None for r in found.collect()} == {dense > 1}
        assert max(r.n for r in found.collect()) <= segments.BLOCK
        assert sorted(r.book_id for r in SegmentedIndex._opened(found).collect()) == sorted(ids)
        probe = spark.createDataFrame([(i,) for i in range(-40_001, 40_001)], "id long") if len(ids) > 5 else spark.createDataFrame([(i,) for i in ids], "id long")
        if dense == 1:
            kept = probe.join(found, F.bitmap_bucket_number("id") == F.col("block")).where(segments.holds(F.col("bits"), F.col("id")))
            assert sorted(r.id for r in kept.collect()) == sorted(ids)


def test_blocks_without_an_answer_are_not_read(spark, tmp_path, small_blocks):
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    width = segments.BLOCK
    rows = [("cat", b * width + k) for b in range(20) for k in range(1, 12)] + [("dog", 3 * width + 5), ("dog", 7 * width + 9000), ("owl", 30 * width)]
    stored.replace(spark.createDataFrame(rows, "term string, book_id long"))
    asked = queries(spark, ["cat dog", "cat owl", "cat nowhere", "cat"])
    alive = {}
    for r in stored.surviving_blocks(asked).collect():
        alive.setdefault(r.query_id, []).append(r.block)
    assert alive.pop(4) and alive == {1: [4]}  # of 20 blocks one; in block 8 the ranges do not meet
    found = answers(stored.conjunctive(asked))
    assert found[1] == {3 * width + 5} and set(found) == {1, 4} and len(found[4]) == 220
    assert stored.conjunctive(queries(spark, ["cat owl"])).count() == 0


def test_hot_term_is_many_rows_and_equals_plain_division(spark, tmp_path):
    rng = random.Random(8)
    n = 100_000
    rare = sorted(rng.sample(range(1, n), 300))
    rows = spark.range(1, n).select(F.lit("hot").alias("term"), F.col("id").alias("book_id")).unionByName(
        spark.createDataFrame([("rare", i) for i in rare], "term string, book_id long")
    ).unionByName(spark.range(1, n, 3).select(F.lit("warm").alias("term"), F.col("id").alias("book_id")))
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    stored.replace(rows)
    kept = stored.blocks().where("term = 'hot'").collect()
    assert len(kept) == 4 and all(len(r.bits) == 4096 and r.ids is None for r in kept)
    asked = queries(spark, ["hot rare warm", "hot warm", "warm rare"])
    assert answers(stored.conjunctive(asked)) == answers(query.conjunctive_query(asked, rows))


def test_many_terms_are_joined_instead_of_pushed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "PUSHED", 2)
    rows = [(i, " ".join(WORDS[i % 5 : i % 5 + 4])) for i in range(1, 40)]
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    stored.add(frame(spark, rows))
    asked = queries(spark, ["gamma con", "delta", "alpha beta gamma con", "zeta alpha"])
    got = answers(stored.conjunctive(asked))
    assert got == answers(query.conjunctive_query(asked, index.build_postings(frame(spark, rows))))
    assert dict_of(stored.lookup_terms(asked)) == {w: ids for w, ids in plain(rows).items() if w in {"gamma", "con", "delta", "alpha", "beta", "zeta"}}


def test_two_writers_and_odd_terms(spark, tmp_path):
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    rows = [("Élan", 1), ("/x", 2), ("9", 3), ("", 4), ("ßa", 5), (None, 6), ("a", None)]
    stored.replace(spark.createDataFrame(rows, "term string, book_id long"))
    for term, i in rows[:5]:
        assert [r.book_id for r in stored.lookup(term).collect()] == [i]
    base, state = stored.manifest.latest()
    stored.manifest.commit(base, state)
    with pytest.raises(Conflict):
        stored.manifest.commit(base, state)
    other = Manifest(spark, str(tmp_path / "m"))
    assert other.latest() == (0, {}) and other.commit(0, {"a": 1}) == 1
    assert not other.files.create("_manifest/000000000001.json", "{}") and other.at(1) == {"a": 1}


def test_bitmaps_open_to_their_ids_within_a_scan_of_bytes(spark):
    """Every pattern of a byte, on both sides of 0; a block's bytes are looked up once each."""
    ids = spark.range(-40_000, 70_000).where("xxhash64(id) % 3 <> 0").select("id")
    maps = ids.groupBy(F.bitmap_bucket_number("id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")).localCheckpoint()
    opened = segments._decoded(F.col("block"), F.col("bits"))
    assert maps.select(F.explode(opened).alias("id")).exceptAll(ids).isEmpty() and maps.select(F.sum(F.size(opened))).first()[0] == ids.count()
    assert "getbit" not in str(opened._jc.toString()).lower()


def test_an_index_is_listed_once(spark, tmp_path):
    """Both kinds of blocks come from one pass over the pairs."""
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    rows = spark.range(1, 3001).select(F.lit("cat").alias("term"), F.col("id").alias("book_id")).unionByName(spark.createDataFrame([("dog", 5)], "term string, book_id long"))
    SegmentedIndex(spark, str(tmp_path / "i")).replace(rows.mapInArrow(seen, rows.schema), rows.select("book_id"))
    assert passes.value == 3001
    assert SegmentedIndex(spark, str(tmp_path / "i")).postings().exceptAll(rows).isEmpty()


def test_indexes_are_compared_block_by_block(spark, tmp_path, small_blocks):
    """Of one segment or several, arrays beside bitmaps, ids on both sides of 0; blocks are shuffled, pairs are not."""
    rng = random.Random(5)
    rows = [(rng.choice([i - 60, 40_000 + i, 200_000 + i]), " ".join(rng.choices(WORDS, k=3))) for i in range(1, 121)]
    one, two, none = (SegmentedIndex(spark, str(tmp_path / n)) for n in "ab0")
    one.replace(index.build_postings(frame(spark, rows[:100])))
    for part in (rows[30:70], rows[60:], [(rows[40][0], "only here")]):
        two.add(frame(spark, part))
    pairs_of = lambda rs: {(w, i) for w, ids in plain(rs).items() for i in ids}
    a, b = pairs_of(rows[:100]), pairs_of([*rows[30:], (rows[40][0], "only here")]) - {("here", rows[40][0]), ("only", rows[40][0])}
    want = sorted([(*p, "left") for p in a - b] + [(*p, "right") for p in b - a])
    found = one.difference(two)
    assert sorted(map(tuple, found.collect())) == want and {r[2] for r in want} == {"left", "right"}
    assert sorted(map(tuple, one.difference(none).collect())) == sorted((*p, "left") for p in a)
    assert one.difference(one).isEmpty() and none.difference(none).isEmpty()
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert dealt and not any("book_id" in line for line in dealt)


def test_the_query_of_differences_deals_no_pairs(spark):
    plan = index_queries.q_index_difference(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "book_id" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_books_that_are_there_meet_block_by_block(spark, tmp_path, small_blocks):
    """A batch joins a stored block once, in whichever segments and forms it lies; only missing pairs are found."""
    rng = random.Random(6)
    ids = [rng.choice([i - 60, 40_000 + i]) for i in range(1, 121)]
    rows = [(i, " ".join(rng.choices(WORDS, k=3))) for i in ids]
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    for a in (0, 60):
        stored.add(frame(spark, rows[a : a + 60]))
    again = [(i, " ".join(rng.choices([*WORDS, "fresh"], k=3))) for i in ids]
    have, want = plain(rows), plain(again)
    lacks = sorted((w, i) for w in want for i in want[w] - have.get(w, set()))
    for many in (False, True):
        missing = stored._missing(frame(spark, again), stored.state(), many)
        assert sorted(map(tuple, missing.collect())) == lacks
    dealt = [line for line in missing._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert dealt and not any("book_id" in line.split("hashpartitioning")[1].split(", REPART")[0].split("ENSURE")[0] for line in dealt if "hashpartitioning" in line)
    joins = [line for line in missing._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "array_contains" not in joins[0] and "getbit" not in joins[0]
    stored.add(frame(spark, again))
    assert dict_of(stored.postings()) == {w: have.get(w, set()) | want.get(w, set()) for w in {*have, *want}}


def test_compaction_puts_blocks_together_not_pairs(spark, tmp_path, small_blocks, monkeypatch):
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    rows = [(i - 20, " ".join(WORDS[i % 5 : i % 5 + 4])) for i in range(60)]
    for a in (0, 20, 40):
        stored.add(frame(spark, rows[a : a + 20]))
    plans, sent = [], segments._sent
    monkeypatch.setattr(segments, "_sent", lambda met, parts: plans.append(met._jdf.queryExecution().optimizedPlan().toString()) or sent(met, parts))
    assert stored.compact(most=2) > 0 and dict_of(stored.postings()) == plain(rows)
    assert len(plans) == 1 and "Aggregate [term" in plans[0] and "Generate" not in plans[0]
    whole = stored.blocks().groupBy("term", "block").count()
    assert whole.where("count > 1").isEmpty()


@pytest.mark.parametrize("batches", [1, 2])
def test_an_index_with_books_meets_them_block_by_block(spark, tmp_path, small_blocks, batches):
    stored = SegmentedIndex(spark, str(tmp_path / "i"))
    rows = [(i - 20, " ".join(WORDS[i % 5 : i % 5 + 4])) for i in range(60)]
    for k in range(batches):
        stored.add(frame(spark, rows[k:40:batches]))
    books = frame(spark, [*rows[20:], (5, "fresh alpha"), (5, "fresh"), (None, "owl beta"), (None, "owl"), (7, None)])
    found = stored.with_books(books)
    want = index.add_books(stored.postings(), books)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.where("book_id IS NULL").count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join LeftOuter, ((term" in plan and "(book_id" not in plan.split("Join")[1].splitlines()[0]
    assert sorted(map(tuple, stored.postings().collect())) == sorted((w, i) for w, ids in plain(rows[:40]).items() for i in ids)


def test_the_query_of_added_books_joins_no_pairs(spark):
    plan = index_queries.q_add_book(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("book_id" in line for line in joins)
