import hashlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import quality

from test_native import contaminated
from test_texts import classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{i}")
        kept.append(docs.count())
        if i < 4:
            assert docs.columns == before.columns
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[1] > kept[2] > kept[3] == kept[5]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"file://{tmp_path}/3").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in docs.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in text.items()}


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_stages_take_odd_rows(spark, sf):
    """Null and empty texts, repeated rows, one id on two texts, no id, a long text, and columns with odd names; no lang or source."""
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, 0), (2, "", 0), (3, "x" * 50_000, 1), (None, words + " no id here", 1), (4, words, 3), (4, words, 3), (5, words + " a@b.cc", 4), (5, "unlike the other " + words[::-1], 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `ids.x` long")
    stages = dict(corpus_pipeline.STAGES)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 100").first().text
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    accepted = quality.classify(docs.select("doc_id", "text", F.col("text").alias("own")), labels).filter("predicted = 1")
    assert rows_of(stages["quality"](spark, docs, sf), "doc_id", "text") == rows_of(accepted, "doc_id", "own")
    kept = rows_of(stages["near_dedup"](spark, docs, sf), "doc_id", "text")
    assert kept == sorted([(1, None), (2, ""), (3, "x" * 50_000), (4, words), (5, "unlike the other " + words[::-1])], key=str)
    dirty = docs.unionByName(spark.createDataFrame([(6, item, 0), (6, "clean words", 0), (None, item, 0)], docs.schema))
    assert rows_of(stages["decontamination"](spark, dirty, sf), "doc_id", "text") == sorted([(r[0], r[1]) for r in rows] + [(6, "clean words")], key=str)
    assert rows_of(stages["pii"](spark, docs, sf), "doc_id", "text") == sorted([(r[0], r[1] and r[1].replace("a@b.cc", "[EMAIL]")) for r in rows], key=str)
    out = stages["bpe"](spark, docs, sf)
    assert out.columns == ["doc_id", "ids.x", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert rows_of(out, "doc_id", "decoded_sha256") == sorted([(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows], key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_against_plain_python(spark, sf):
    """Each stage on its own input: what it keeps follows from the operators' own results, found another way."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf)
    scored = {r.doc_id: r.predicted for r in quality.quality(docs, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scored.items() if p}
    source = good.collect()
    groups = classes([r.doc_id for r in source], [r.text for r in source], 5, 80)
    assert {r.doc_id for r in stages["near_dedup"](spark, good, sf).collect()} == {i for i, n, root, own in groups if own or not n}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in source], items) if r[5]}
    assert {r.doc_id for r in stages["decontamination"](spark, good, sf).collect()} == {r.doc_id for r in source} - bad


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
