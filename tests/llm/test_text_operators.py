"""Each operator against a plain version on small tables, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lintfleet.llm import brown_lm, decontaminate, jaccard_join, langid, packing, pii, sharding, toxicity
from tests.llm.conftest import WORDS

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def variants(seed=3, groups=12, copies=5):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.choice([3, 5, 20, 60, 150]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    return rows


# --- sharding


def test_shards_are_even_and_gapless(spark, docs_of, odd_rows):
    rows = odd_rows + [(100 + i, "w " * (i % 37)) for i in range(400)]
    out = sharding.shard_by_bytes(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    largest, total = max(r.size for r in out), sum(r.size for r in out)
    for s in range(8):
        mine = [r for r in out if r.shard == s]
        assert abs(sum(r.size for r in mine) - total / 8) <= largest
        assert sorted(r.slot for r in mine) == list(range(len(mine)))


def test_shards_are_those_of_one_running_sum(spark, docs_of, odd_rows):
    rows = odd_rows + [(100 + i, "w " * (i % 37)) for i in range(400)]
    ordered = sorted(rows, key=lambda r: ("" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest(), r[0] is not None, r[0]))
    sizes = [len((t or "").encode()) + 1 for _, t in ordered]
    want, before, places = Counter(), 0, Counter()
    for (i, _), size in zip(ordered, sizes, strict=True):
        shard = min(8 * (2 * before + size) // (2 * sum(sizes)), 7)
        want[i, size, shard, places[shard]] += 1
        before, places[shard] = before + size, places[shard] + 1
    for parts in (1, 5):
        spread = sharding.shard_by_bytes(docs_of(rows).repartition(parts)).collect()
        assert Counter((r.doc_id, r.size, r.shard, r.slot) for r in spread) == want


def test_shards_of_nothing(docs_of):
    assert sharding.shard_by_bytes(docs_of([])).count() == 0


# --- packing


def test_pieces_and_places(docs_of, odd_rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = odd_rows + [(100 + i, "It's THE sum, of 12 ... parts'll do! " * (i % 9)) for i in range(60)]
    pieces = packing.tokenize(docs_of(rows), VOCABULARY).collect()
    got = Counter()
    for p in pieces:
        got[p.doc_id, p.piece, p.start, p.length, tuple(np.frombuffer(p.ids, "<u4"))] += 1
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[i, at // 2048, at, len(part), tuple(part)] += 1
    assert got == want
    placed = packing.pack(packing.tokenize(docs_of(rows), VOCABULARY).drop("ids")).collect()
    assert len(placed) == len(pieces)
    bins = {}
    for p in placed:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(p.length for p in placed) / 2048) + 1


def test_sum_of_squares_takes_the_best_gap_each_time():
    rng = random.Random(5)
    sizes = np.array([rng.randint(1, 30) for _ in range(300)])
    bins, offsets = packing.sum_of_squares(sizes, 32)
    level, count = {}, Counter()
    for item in np.argsort(-sizes, kind="stable"):
        size = sizes[item]

        def squares(gap):
            c = Counter(count)
            if gap < 32:
                c[gap] -= 1
            if gap > size:
                c[gap - size] += 1
            return sum(v * v for v in c.values())

        gaps = [g for g in range(size, 32) if count[g]] + [32]
        best = min(squares(g) for g in gaps)
        gap = 32 - level.get(bins[item], 0)
        assert offsets[item] == 32 - gap
        assert squares(gap) == best
        if gap < 32:
            count[gap] -= 1
        if gap > size:
            count[gap - size] += 1
        level[bins[item]] = 32 - gap + size


# --- similarity join


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent", "frequent"), [(4, 85, 64), (5, 80, 64), (2, 85, 3)])
def test_join_equals_brute_force(docs_of, monkeypatch, words, percent, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "COMMON", frequent + 2)
    rows = variants()
    got = {tuple(r) for r in jaccard_join.join_similar(docs_of(rows), words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_join_of_odd_rows(docs_of, odd_rows):
    got = Counter(tuple(r) for r in jaccard_join.join_similar(docs_of(odd_rows)).collect())
    assert sum(got.values()) == len(odd_rows)
    assert got[1, 0, 1] == got[2, 0, 2] == got[3, 0, 3] == 1
    assert got[4, 1, 4] == 2 and got[5, 1, 4] == 1 and got[None, 1, None] == 1
    assert {c for (i, _, c) in got if i in (6, 7)} == {6}
    assert jaccard_join.join_similar(docs_of([])).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_prefixes_always_reach_their_coverage(percent):
    """However tokens fall into classes and groups, a document has enough coverage in each band it is indexed in."""
    for n in [*range(4, 400), 1000, 5000]:
        if n * 100 // percent == n:
            continue
        for band in jaccard_join.bands(n, percent):
            (k2, g2), (k3, g3) = jaccard_join.groups_of(band)
            assert n - (k2 - 1) * g2 - (k3 - 1) * g3 >= jaccard_join.slack(n, percent) + 1, (n, band)


# --- decontamination


def test_passages_equal_brute_force(spark, docs_of, odd_rows):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([1, 3, 9, 10, 11, 25, 40])] + [(50, None), (None, "x y"), (51, "...")]
    rows = odd_rows + [(100 + i, " ".join(rng.choice(WORDS) for _ in range(30)) + ", " + (rng.choice(items[:7])[1] if i % 2 else "") + "! " + rng.choice(WORDS)) for i in range(40)]
    table = spark.createDataFrame(items, "item_id long, text string")
    for slice_bytes in (decontaminate.SLICE_BYTES, 150):
        out = decontaminate.find_passages(docs_of(rows), table, slice_bytes=slice_bytes).select("doc_id", "passages.*").collect()
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in out)
        want = Counter()
        cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        for i, t in rows:
            w, hit, found = cut.findall(lower(t)), set(), set()
            for item, text in items:
                v = cut.findall(lower(text)) if item is not None else []
                size = min(10, len(v))
                windows = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if size else set()
                for k in range(len(w) - size + 1 if size else 0):
                    if tuple(w[k : k + size]) in windows:
                        hit.update(range(k, k + size))
                        found.add(str(item))
            want[i, len(w), len(hit), tuple(sorted(found))] += 1
        assert got == want
    empty = decontaminate.find_passages(docs_of(rows), table.limit(0)).select("passages.n_hit").distinct().collect()
    assert [r.n_hit for r in empty] == [0]


# --- personal data


def test_personal_data(docs_of, odd_rows):
    rows = odd_rows + [
        (20, "Mail a.b+c@x-y.example.com, call +1 (212) 555-0100."), (21, "card 4111 1111 1111 1111 and 4111 1111 1111 1112"),
        (22, "10.0.0.255 10.0.0.256 01.002.3.4"), (23, "a@b.com_foo@d.org é@x.y ü a@b.co"), (24, "IBAN DE89370400440532013000 or DE89370400440532013001"),
        (25, "ssn 123-45-6789"), (26, "part 123-45-6789"), (27, "1" * 20_000), (28, "a." * 20_000), (29, "+" + "(" * 20_000),
    ]
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(docs_of(rows)).collect()}
    assert out[20] == [("email", 5, 26), ("phone", 33, 50)]
    assert out[21] == [("card", 5, 24)]
    assert out[22] == [("ip", 0, 10), ("ip", 22, 32)]
    assert [s[:1] for s in out[23]] == [("email",)] * 3
    assert out[24] == [("iban", 5, 27)] and out[25] == [("ssn", 4, 15)]
    assert all(out[i] == [] for i in (1, 2, 8, 26, 27, 28, 29))
    masked = {r.doc_id: r.text for r in pii.masked(docs_of(rows)).collect()}
    assert masked[20] == "Mail [email], call [phone]." and masked[1] is None and masked[26] == "part 123-45-6789"


# --- language model


def test_base_score_is_exact_and_model_sums_to_one(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, " ".join(random.Random(i).choices(WORDS, k=40))) for i in range(60)]
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(re.findall(r"[^\x20\x09-\x0d]+", lower(t)) + [" "])
    total, distinct = sum(counts.values()), len(counts)
    got = Counter()
    out = brown_lm.score_documents(docs_of(rows)).collect()
    for r in out:
        got[r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)] += 1
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(t)) + [" "]
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        want[i, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)] += 1
    assert got == want
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    model, _ = brown_lm.train(docs_of(rows).select("text"))
    assert np.allclose((10**model.log_transition).sum(1), 1)
    assert brown_lm.score_documents(docs_of([])).count() == 0


def test_rare_words_have_classes(docs_of, monkeypatch):
    """Words far down the ranks, each seen a few times, still tell what stands where; how they reach the tasks changes nothing."""
    monkeypatch.setattr(brown_lm, "CLUSTERED", 4)
    rng = random.Random(5)
    rows = [(i, " ".join(f"aa x{rng.randrange(300)} bb y{rng.randrange(300)}" for _ in range(10))) for i in range(200)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], "aa x7 bb y7 aa x8 bb y8"), (held[1], "aa y7 bb x7 aa y8 bb x8")]
    scores = []
    for known in (4, 100, 30_000):
        monkeypatch.setattr(brown_lm, "KNOWN", known)
        scores.append({r.doc_id: r.score for r in brown_lm.score_documents(docs_of(rows)).collect()})
    assert scores[0] == pytest.approx(scores[1]) and scores[0] == pytest.approx(scores[2])
    assert scores[0][held[0]] > scores[0][held[1]] + 2


def test_joined_words_leave_a_block_once(docs_of, odd_rows, monkeypatch):
    """Documents travel in blocks, whose number changes nothing; neither joined words nor documents are collected by aggregates."""
    monkeypatch.setattr(brown_lm, "CLUSTERED", 4)
    monkeypatch.setattr(brown_lm, "KNOWN", 8)
    rng = random.Random(8)
    rows = odd_rows + [(100 + i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(6)))) for i in range(900)]
    docs, found = docs_of(rows).coalesce(1), []
    for size in (1, 40, 100_000):
        monkeypatch.setattr(brown_lm, "BLOCK_WORDS", size)
        monkeypatch.setattr(brown_lm, "GATHERED", size)
        found.append(sorted(map(repr, brown_lm.score_documents(docs).collect())))
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    source = docs.selectExpr("doc_id", "text", "monotonically_increasing_id() _row")
    model, rest = brown_lm.learn_classes(source)
    assert "ObjectHash" not in brown_lm.class_lines(source, model, rest)._jdf.queryExecution().sparkPlan().toString()


def test_groups_are_not_cut():
    rng = random.Random(4)
    for _ in range(200):
        keys = sorted(rng.randrange(6) for _ in range(rng.randrange(1, 30)))
        cuts = [0, *sorted(rng.randrange(len(keys) + 1) for _ in range(6)), len(keys)]
        whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(len(keys)))], names=["k", "v"])
        rows = rng.randrange(1, 12)
        out = [b.to_pylist() for b in brown_lm._whole_groups([whole.slice(a, b - a) for a, b in itertools.pairwise(cuts)], rows)]
        assert [r["v"] for b in out for r in b] == list(range(len(keys)))
        groups = [{r["k"] for r in b} for b in out]
        assert sum(map(len, groups)) == len(set(keys))
        assert [int(x) for x in brown_lm._starts(whole.column(0))] == [1] + [int(a != b) for a, b in itertools.pairwise(keys)]


def test_classes_follow_the_vocabulary():
    assert brown_lm.sizes(100) == (600, 16) and brown_lm.sizes(100_000_000) == (10_000, 100)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    symbols, total = 22, np.zeros((22, 22))
    for _ in range(4000):  # words 0-9 follow words 10-19 and the other way round
        a = rng.integers(0, 10) + 10 * rng.integers(0, 2)
        b = rng.integers(0, 10) + (10 if a < 10 else 0)
        total[a, b] += 1
    cls = brown_lm.exchange(total, 20, classes=2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:])) == 1 and cls[0] != cls[19]
    assert symbols == len(total)


# --- classifiers


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    out = langid.identify(docs, model).collect()
    fold = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in fold) >= 0.97 * len(fold)


def test_language_of_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows).drop("score")
    model = langid.train(docs)
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {1, 2, 3, 8}
    assert langid.train(docs.filter("text is null")) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_segments_are_the_maximal_ones():
    rng = random.Random(2)
    for _ in range(60):
        scores = np.array([rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(0, 14))], "f8")

        def best(a, b):
            """Definition: the highest-scoring segment (shortest, then first), then the same left and right of it."""
            found = [(scores[i:j].sum(), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not found or max(found)[0] <= 0:
                return []
            s, _, _, i, j = max(found)
            return [*best(a, i), (i, j, s), *best(j, b)]

        assert sum(s for _, _, s in toxicity.segments(scores)) == pytest.approx(sum(s for _, _, s in best(0, len(scores))))


def test_toxicity_held_out(spark, docs_of, odd_rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    fold = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    hit = sum(out[r.doc_id] >= 0.3 for r in fold if r.toxic == 1)
    assert hit >= 0.85 * sum(r.toxic == 1 for r in fold)
    assert sum(out[r.doc_id] >= 0.3 for r in fold if r.toxic == 0) <= 0.06 * sum(r.toxic == 0 for r in fold)
    odd = toxicity.score(docs_of(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.train(docs, labels.filter("toxic = 0")).odds == {}


def test_toxic_words_that_few_documents_hold(spark, docs_of):
    """Words in 1% of the toxic documents and in no clean one are features."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=8)) + (f" vile{i // 2 % 100:02d}q" if i % 2 else "")) for i in range(6000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), labels)
    assert sum(f"vile{k:02d}q".encode() in model.odds for k in range(100)) >= 90
    assert not any(w.encode() in model.odds for w in WORDS)


def test_set_key_is_stable():
    assert jaccard_join.set_key(jaccard_join.shingles("a b c d e")) == jaccard_join.set_key(jaccard_join.shingles("A  b\tc D e"))
    assert hashlib.blake2b(b"").digest_size == 64


def test_worker_drops_what_other_operators_hold():
    from lintfleet.llm.common import take_worker

    held = {"a": 1}
    take_worker("one", held.clear)
    take_worker("one", held.clear)
    assert held
    take_worker("two")
    assert not held
