"""The pipeline's Jaccard stage decides by row, whatever the identifiers are."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_jaccard_stage_with_null_repeated_and_shared_ids(spark):
    rng = random.Random(5)
    p, q, r, s, other = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(5))
    rows = [(2, p), (1, p), (2, other), (None, q), (None, q), (3, r), (3, r), (None, s), (9, s), (4, None), (5, None)]
    out = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert out.columns == ["doc_id", "text"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, p), (2, other), (None, q), (3, r), (9, s), (4, None), (5, None)], key=str)


def awkward(spark, folder):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns, beside small tables."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "  \n", "x", passage, passage, " ".join(word() for _ in range(300)), f"{passage} {' '.join(word() for _ in range(900))}"]
    rows = [(i if i % 3 else None, t, len(t or "")) for i, t in enumerate([*texts, *texts])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(("n_bytes", "spans", "contaminated", "st", "sid", "part", "kind", "component_id", "__key", "n_hit", "score", "A b"))})
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, passage


def test_stages_on_awkward_tables(spark, tmp_path):
    docs, passage = awkward(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(r["A b"] == 11 and r["spans"] == 1 for r in out.collect()), name
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0, name
    stages = dict(corpus_pipeline.STAGES)
    cleaned = stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect()
    assert not any(passage in (r.text or "") for r in cleaned) and sum(r.text is None for r in cleaned) == 2
    assert sum(len(r.text or "") > 5000 and r.n_chars == len(r.text) for r in cleaned) == 2
    packed = stages["best-fit packing"](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == 16 and stages["best-fit packing"](spark, docs.limit(0), str(tmp_path)).count() == 0
