"""The pipeline against its stages' own brute-force forms, on rows that SQL can't judge."""

from __future__ import annotations

import corpus_pipeline
from footfall.llm import queries


def test_stages_take_effect(spark, tmp_path):
    prose = [" ".join(f"word{(i * i * k + 3 * i + k) % 1009}" for i in range(120)) for k in range(1, 41)]
    texts = [*prose, prose[0], prose[1] + " tail", None, "", "too short", "same words " * 60]
    rows = [(k, t, "en", f"s{k % 4}", None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose[5].split()[10:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in docs.collect()})
    quality, deduped, clean, mixed = seen
    assert quality == set(range(42))
    assert deduped == set(range(40))
    assert clean == deduped - {5}
    assert mixed <= clean
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in result) == sorted(r["doc_id"] for r in docs.collect())
    at = 0
    for r in sorted(result, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [*[f"op{k}" for k in range(1, 14)], "pipeline"]
    assert set(queries.SQL) <= set(queries.QUERIES)
