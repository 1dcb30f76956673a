"""The pipeline against brute force, stage by stage."""

import corpus_pipeline

from .test_queries import components, contamination, linked_pairs, shingles


def test_stages(spark, sf_dir, tmp_path):
    d = sf_dir[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, benchmark = docs.columns, [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "langid":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {40, 41, 42, 43} and all(r.text for r in after)
        elif name == "near_duplicates":
            at = components(len(before), linked_pairs([shingles(r.text) for r in before]))
            assert len(after) == len(set(at))
            assert {at[[r.text for r in before].index(r.text)] for r in after} == set(at)
        elif name == "decontaminate":
            want = sorted(str(r.doc_id) for r in before if not contamination(r.text, benchmark)[-1])
            assert sorted(str(r.doc_id) for r in after) == want and len(after) < len(before)
        elif name == "secrets":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
        else:
            assert len(after) == len(before) and all(len(r["ids_"]) == 4 * r.n_tokens for r in after)


def test_empty(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir[1]).count() == 0


def test_secrets_are_replaced(spark):
    df = spark.createDataFrame([(1, 'a token = "0123456789abcdef0123456789" z', 99)], "doc_id long, text string, n_chars long")
    r = corpus_pipeline.stage_secrets(spark, df, "").first()
    assert "0123456789" not in r.text and "[SECRET]" in r.text and r.n_chars == len(r.text)
