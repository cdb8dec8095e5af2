"""The pipeline's stages against brute force on the small tables."""

import hashlib

import corpus_pipeline
from quadloom.llm import quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (_, good), (_, lines), (_, near), (_, mix), (_, bpe) = corpus_pipeline.STAGES
    predicted = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    a = good(spark, docs, SF).cache()
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == predicted
    b = lines(spark, a, SF).cache()
    gone = brute.removed_lines([(r.doc_id, r.text) for r in a.collect()], 50)
    before = {r.doc_id: r.text for r in a.collect()}
    assert b.columns == docs.columns and all(r.text == "\n".join(x for i, x in enumerate(before[r.doc_id].split("\n")) if i not in gone[r.doc_id]) and r.n_chars == len(r.text) for r in b.collect())
    c = near(spark, b, SF).cache()
    words = {r.doc_id: r.text.lower().split() for r in b.collect()}
    own = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    like = {(x, y): len(own[x] & own[y]) / len(own[x] | own[y]) for x in own for y in own if y < x}
    left = {r.doc_id for r in c.collect()}
    assert not any(x in left and y in left for (x, y), j in like.items() if j >= 0.9)
    loose = brute.components(sorted(own), lambda x, y: like[max(x, y), min(x, y)] >= 0.5)
    assert all(any(loose[k] == loose[i] for k in left) for i in own) and len(left) == c.count() < len(own)
    d = mix(spark, c, SF).cache()
    assert d.columns == docs.columns and {r.doc_id for r in d.collect()} <= {r.doc_id for r in c.collect()}
    e = bpe(spark, d, SF)
    texts = {r.doc_id: r.text for r in c.collect()}
    rows = e.collect()
    assert len(rows) == d.count() and all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows)


def test_run_equals_stages_and_takes_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)]
    folder = str(tmp_path)
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
    assert sorted(map(str, now.collect())) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.isEmpty()
