"""The Merkle manifest against a plain tree, with blocks small enough for several tiers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lintfleet.llm import manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[i : i + fan])) for i in range(0, len(last), fan)])
    return out


def way(tree, i, fan):
    out = []
    for level in tree[:-1]:
        first = i - i % fan
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + fan])))
        i //= fan
    return out


def plain(rows, fan):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = levels([h for _, h in groups[name]], fan)
    top = levels([trees[name][-1][0] for name in names], fan)
    return [(i, h, trees[name][-1][0], top[-1][0], way(trees[name], at, fan) + way(top, n, fan))
            for n, name in enumerate(names) for at, (i, h) in enumerate(groups[name])]


def odd(n):
    rng = random.Random(n)
    rows = [(None, "web", "en", 3, "abc"), (None, "web", "en", 3, "abc"), (7, None, None, None, None), (7, "a", "", 0, ""), (8, "é", "ünï", 2, "日本"),
            (9, "web", "en", 1, "x" * 100_000), (10, "=", "=", 1, ":")]
    rows += [(rng.randrange(n), "s", rng.choice(["en", "en", "en", "de", None]), rng.randrange(9), "t" * rng.randrange(9)) for _ in range(n)]
    return rows + rows[-40:] + [(1, "same", "en", 4, "same")] * n


SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


def table(spark, rows):
    """With columns whose names those of the operator's results and helpers clash with."""
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    return df.select("*", *[F.lit("x").alias(c) for c in ("leaf", "root", "path", "_group", "_pos", "hash", "a.b", "tree", "_block")])


@pytest.mark.parametrize("shape", [manifest.Shape(), manifest.Shape(2, 2, 1), manifest.Shape(2, 1, 2), manifest.Shape(3, 2, 1)])
def test_manifest_equals_a_plain_tree(spark, shape):
    rows = odd(90)
    out = manifest.manifest(table(spark, rows), shape=shape).select(
        "doc_id", "leaf", "subroot", "root", "path", manifest.folded(F.col("leaf"), F.col("path")).alias("folded"), manifest.proof_digest(F.col("path")).alias("proof"))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path], r.folded, r.proof) for r in out.collect()]
    want = [(*x, x[3], digest("".join(a + b for a, b in x[4]))) for x in plain(rows, shape.fan)]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2], x[4])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_tampering_is_found(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, "t") for i in range(50)]
    changed = F.when(F.col("doc_id") % 10 == 0, manifest.leaf_of([F.col(c) if c != "text" else F.lit("u") for c in manifest.FIELDS]))
    out = manifest.manifest(table(spark, rows), carry={"changed": changed})
    found = out.filter(manifest.folded(F.coalesce("changed", "leaf"), F.col("path")) != F.col("root"))
    assert sorted(r.doc_id for r in found.collect()) == [0, 10, 20, 30, 40]


@pytest.mark.parametrize("rows", [[], [(5, "s", "en", 1, "t")], [(5, "s", None, 1, "t"), (6, "s", "en", 1, "t")]])
def test_few_rows(spark, rows):
    out = manifest.manifest(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in out) == sorted(plain(rows, 2))
