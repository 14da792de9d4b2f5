"""Stages keep columns whose names are those that they use on the way, and names with a dot."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lintfleet.llm import decontaminate, langid
from tests.llm.conftest import WORDS

NAMES = ["_passages", "_part", "_row", "_more", "_spans", "_language", "_language_lang_pred", "a.b"]


def test_stages_keep_all_columns(spark, docs_of, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(12))) for i in range(6)] + [(6, None), (7, "")]
    docs = docs_of(rows).withColumns({n: F.lit(n) for n in NAMES})
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(r[n] == n for r in kept for n in NAMES), name
        if name == "benchmark_decontamination":
            assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 5, 6, 7]
    model = langid.train(docs_of(rows))
    assert all(r["_language"] == "_language" for r in langid.identify(docs, model).collect())


def test_a_benchmark_of_many_slices(spark, docs_of):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([3, 12, 40, 400, 2000])]
    rows = [(1, None), (2, ""), (3, items[3][1]), (4, "x " + items[4][1] + " y " + items[1][1]), (5, items[0][1]), (5, items[0][1]), (None, items[2][1])]
    docs = docs_of(rows).withColumns({n: F.lit(n) for n in NAMES})
    table = spark.createDataFrame(items, "item_id long, text string")

    def found(size):
        out = decontaminate.find_passages(docs, table, slice_bytes=size)
        assert out.columns == [*docs.columns, "passages"]
        return sorted(out.select("doc_id", "passages.*").collect(), key=str)

    whole = found(1 << 20)
    assert [r.n_hit for r in whole if r.doc_id == 3] == [400] and sum(r.n_hit > 0 for r in whole) == 5
    assert found(2000) == whole
