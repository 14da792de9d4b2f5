"""Scan, containment and lookup operators against plain Python, on their small and their large path."""

import random

import pytest
from pyspark.sql import functions as F

from lintfleet.operators import keyed
from lintfleet.operators.ranges import covered
from lintfleet.operators.scan import Chunks, Running, chunk_width, equi_depth, running, seen_before
from lintfleet.streaming import metrics as MM


def rows_for(seed=1, keys=3, n=60):
    rnd = random.Random(seed)
    out = []
    for k in range(keys):
        for pos in rnd.sample(range(500), n):
            out.append((k, pos, rnd.choice([None, 1, 2, 3, -4]), rnd.random() < 0.2))
    return out


def brute(rows, kind, before, reverse):
    result = {}
    for k in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=reverse)
        for i, r in enumerate(ordered):
            seen = [x[2] for x in ordered[: i if before else i + 1] if x[2] is not None]
            if kind == "sum":
                v = sum(seen)
            elif kind == "count":
                v = len(seen)
            elif not seen:
                v = None
            else:
                v = {"min": min(seen), "max": max(seen), "last": seen[-1], "first": seen[0]}[kind]
            result[(k, r[1])] = v
    return result


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("chunk", [None, 7, 64])
def test_running_equals_brute_force(spark, chunk, before, reverse):
    rows = rows_for()
    df = spark.createDataFrame(rows, "k int, pos int, v int, e boolean")
    kinds = ["sum", "count", "min", "max", "last", "first"]
    aggs = [Running(kind, kind, F.col("v")) for kind in kinds]
    got = running(df, ["k"], ["pos"], aggs, before=before, reverse=reverse, chunk=chunk).collect()
    for kind in kinds:
        want = brute(rows, kind, before, reverse)
        assert {(r.k, r.pos): r[kind] for r in got} == want, kind


@pytest.mark.parametrize("chunk", [None, 16])
def test_seen_before(spark, chunk):
    rows = [(1, p, p % 3, p % 4 == 0) for p in range(80)]
    df = spark.createDataFrame(rows, "k int, pos int, name int, e boolean")
    key = F.struct("name")
    got = seen_before(df, ["k"], "pos", key, F.when(F.col("e"), key), "seen", chunk=chunk).collect()
    assert len(got) == 80
    for r in got:
        assert r.seen == any(p < r.pos and p % 3 == r.name and p % 4 == 0 for p in range(80))


def test_chunk_width_sees_the_largest_key(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 3, "k int")
    assert chunk_width(df, ["k"], limit=100) is None
    assert chunk_width(df, ["k"], limit=10) is not None
    assert chunk_width(df.filter("k > 9"), ["k"]) is None


def test_only_hot_keys_are_cut(spark):
    rows = rows_for(keys=2) + [(9, p, 1, False) for p in range(5)]
    df = spark.createDataFrame(rows, "k int, pos int, v int, e boolean")
    cut = chunk_width(df, ["k"], limit=10)
    assert len(cut.hot) == 2
    got = running(df, ["k"], ["pos"], [Running("s", "sum", F.col("v"))], chunk=Chunks(cut.keys, 16, cut.hot)).collect()
    assert {(r.k, r.pos): r.s for r in got} == brute(rows, "sum", True, False)


@pytest.mark.parametrize("chunk", [None, 20])
def test_covered_equals_brute_force(spark, chunk):
    rnd = random.Random(4)
    spans = [(i, i % 4, s := rnd.randrange(200), s + rnd.randrange(20)) for i in range(150)]
    ranges = [(i % 4, s := rnd.randrange(200), s + rnd.randrange(30)) for i in range(25)]
    asks = spark.createDataFrame(spans, "id int, k int, s int, e int")
    offers = spark.createDataFrame(ranges, "k int, s int, e int")
    got = covered(asks, offers, ["k"], ask_at=F.col("s"), ask_reach=F.col("e"), offer_at=F.col("s"), offer_reach=F.col("e"), name="hit", chunk=chunk)
    for r in got.collect():
        assert r.hit == any(k == r.k and s <= r.s and r.e <= e for k, s, e in ranges)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_is_the_same_broadcast_and_salted(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, v int")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 200, 2)] + [(1, 11)], "k int, w int")
    small = sorted(map(tuple, keyed.lookup(left, right, ["k"], how).collect()), key=str)
    large = sorted(map(tuple, keyed.lookup(left, right, ["k"], how, limit=5).collect()), key=str)
    assert small == large == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)


def test_union_all(spark):
    parts = [spark.createDataFrame([(i,)], "a int") for i in range(7)]
    assert sorted(r.a for r in keyed.union_all(parts).collect()) == list(range(7))


def bursts(seed=5):
    """One hot key with microseconds in bursts of very different density, and a small key."""
    rnd = random.Random(seed)
    rows, at = [], 0
    for i in range(3000):
        at += 1 if i % 500 < 400 else rnd.randrange(1, 40_000_000)
        rows.append(("hot", at))
    return rows + [("cold", 7_000_000 * i) for i in range(40)] + [("cold", None)]


def test_hot_keys_are_cut_into_chunks_of_like_size(spark):
    df = spark.createDataFrame([r for r in bursts() if r[1] is not None], "k string, at long").withColumn("n", F.lit(1))
    assert equi_depth(df, ["k"], F.col("at"), limit=5000) is None
    cut = equi_depth(df, ["k"], F.col("at"), limit=300)
    sizes = {(r.k, r.c): r["count"] for r in cut.add(df, F.col("at"), "c").groupBy("k", "c").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert sizes["cold", 0] == 40 and len(hot) == 20 and max(hot) <= 2 * 3000 / len(hot)
    for reverse in (False, True):
        plain, chunked = (running(df, ["k"], ["at"], [Running("s", "sum", F.col("n"))], reverse=reverse, chunk=c) for c in (None, cut))
        assert sorted(plain.collect()) == sorted(chunked.collect())


def test_sessions_of_a_hot_type_are_merged_from_chunks(spark):
    df = spark.createDataFrame([(k, at, 1.0) for k, at in bursts()], "event_type string, at long, value double").withColumn("ts", F.timestamp_micros("at"))
    cut = equi_depth(df, ["event_type"], F.unix_micros("ts"), limit=300)
    want = []
    for key in ("hot", "cold"):
        ats = sorted(at for k, at in bursts() if k == key and at is not None)
        first = last = ats[0]
        n = 0
        for at in [*ats, None]:
            if at is None or at - last >= 10_000_000:
                want.append((key, first, last + 10_000_000, n, float(n)))
                first, n = at, 0
            last, n = at, n + 1
    for chunk in (None, cut):
        rows = MM.sessions(df, 10, chunk).select("event_type", F.unix_micros("start"), F.unix_micros("end"), "n", "total").collect()
        assert sorted(tuple(r) for r in rows) == sorted(want)
    assert any(n > 300 for *_, n, _ in want)  # a session over several chunks


def test_span_timings_of_a_hot_call_site(spark):
    rows = [(k, 1, i, at, "enter" if i % 2 else "exit") for i, (k, at) in enumerate(bursts()) if at is not None]
    df = spark.createDataFrame(rows, "callsite string, span_id int, seq int, micros long, kind string").withColumn("at", F.timestamp_micros("micros"))
    cut = equi_depth(df, ["callsite", "span_id"], F.unix_micros("at"), limit=300)
    assert sorted(MM.span_timings(df).collect()) == sorted(MM.span_timings(df, cut).collect())
