"""Texts with very many matches and pages with very deep markup: whole results, in time that grows with the row."""

import random
import re
import time

from pyspark.sql import functions as F

from lintfleet.llm import dom, pii
from lintfleet.llm.inrow import blocks_of, let, piece, running, stretch


def expected(text):
    """Emails and addresses with their scores, by plain loops over the text."""
    out = []
    for kind, pattern, score, context in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.8, "mail|contact|write|kontakt|contacto"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0.7, "ip|address|host|server|adresse"),
    ):
        for m in re.finditer(pattern, text):
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            near = text[max(m.start() - 40, 0) : m.start()] + "\n" + text[m.end() : m.end() + 40]
            out.append((kind, m.start(), m.end(), m[0], score + (0.2 if re.search(context, near.lower()) else 0.0)))
    return out


def replaced(text, spans):
    done, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if start >= at:
            done += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(done) + text[at:]


def test_many_matches_against_plain_loops(docs_of):
    rng = random.Random(8)
    parts = ["a.b@c.org", "10.0.0.7", "300.1.1.1", "ünï", "日本", "😀", "server", "kontakt", "x" * 300, " ", "\n", "9.9.9.9@h.net", "w"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.choice([0, 1, 30, 63, 64, 65, 128, 700])))) for i in range(40)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(docs_of(rows)).collect()}
    assert {i: [(*s[:4], round(s[4], 6)) for s in found[i]] for i, _ in rows} == {i: [(*s[:4], round(s[4], 6)) for s in expected(t)] for i, t in rows}
    masked = {r.doc_id: r.text for r in pii.masked(docs_of(rows)).collect()}
    assert masked == {i: replaced(t, expected(t)) for i, t in rows}


def test_time_grows_with_the_matches(docs_of):
    def seconds(n):
        docs = docs_of([(1, "10.20.30.40 at " * n)])
        start = time.time()
        assert pii.find_personal_data(docs).select(F.size("spans").alias("n")).first().n == n
        assert pii.masked(docs).first().text == "[ip] at " * n
        return time.time() - start

    seconds(100)
    assert seconds(80_000) < 5 * seconds(20_000) + 5


def test_masking_keeps_columns_of_any_name(docs_of):
    docs = docs_of([(1, "mail a@b.co"), (2, None)]).withColumns({"_spans": F.lit("mine"), "a.b": F.lit(3)})
    out = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert out[1].text == "mail [email]" and out[2].text is None
    assert all(r["_spans"] == "mine" and r["a.b"] == 3 for r in out.values()) and out[1].asDict().keys() == docs.first().asDict().keys()


def test_running_values_and_pieces(spark):
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 1000):
        values, text = [rng.randint(-9, 9) for _ in range(n)], "".join(rng.choices("aü日😀\n", k=n))
        df = spark.createDataFrame([(values, text)], "v array<bigint>, t string")
        got = df.select(
            running(F.col("v"), lambda a, b: a + b, F.lit(0).cast("bigint")).alias("sums"),
            running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(-9).cast("bigint")).alias("most"),
            let(blocks_of(F.col("t")), lambda b: F.array(*[piece(b, F.lit(s), F.lit(40)) for s in (0, 20, 250, 990)])).alias("pieces"),
            let(blocks_of(F.col("t")), lambda b: F.array(*[stretch(b, F.lit(s), F.lit(e)) for s, e in ((0, n), (n // 2, n), (n // 3, n // 3))])).alias("stretches"),
        ).first()
        assert got.sums == [sum(values[:i]) for i in range(n)] and got.most == [max(values[:i], default=-9) for i in range(n)]
        assert got.pieces == [text[s : s + 40] for s in (0, 20, 250, 990)]
        assert got.stretches == [text, text[n // 2 :], ""]


def test_deep_markup_takes_seconds():
    for source in ("<div>" * 100_000, "<div><li>" * 50_000 + "word", "<div></section>" * 100_000):
        start = time.time()
        assert len(dom.read_page(source).elements) == 100_001
        assert time.time() - start < 10


def test_implied_ends_of_elements():
    def shape(source):
        page = dom.read_page(source)
        return [(e.tag, e.parent) for e in page.elements[1:]]

    assert shape("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("ul", 0), ("li", 1), ("li", 1), ("ul", 3), ("li", 4), ("li", 1)]
    assert shape("<table><tr><td>a<td>b</td><tr><td><table><tr><td>c") == [
        ("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 5), ("table", 6), ("tr", 7), ("td", 8)]
    assert shape("<p>a<div>b</p>c<p>d<p>e") == [("p", 0), ("div", 0), ("p", 2), ("p", 2)]
