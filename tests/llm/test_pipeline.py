"""The pipeline against its stages in plain Python, on the smallest tables and on odd rows."""


import corpus_pipeline
from parchment.llm import secrets, tokens, toxicity

from .test_operators import SF, brute_classes, brute_hits, brute_links, table


def expected(spark, docs, labels, bench):
    frame = spark.createDataFrame([(int(r.doc_id), r.text) for r in docs.itertuples()], "doc_id long, text string")
    model = toxicity.train_toxicity_model(frame, labels)
    rows = [(int(r.doc_id), r.text) for r, s in zip(docs.itertuples(), model.predict(docs["text"].tolist())) if s < 0.5]
    rows = [x for i, (x, c) in enumerate(zip(rows, brute_classes(brute_links([t for _, t in rows])))) if c == i]
    items = [(r.item_id, r.text) for r in bench.itertuples()]
    kept = [(i, t) for i, t in rows for n, h, _, _ in [brute_hits(t, items)] if not (h and 20 * h >= n)]
    return kept, items


def test_pipeline_against_plain_python(spark):
    docs = table("documents").sort_values("doc_id")
    kept, items = expected(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"), table("benchmark"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in kept}
    scanner, coder = secrets.Scanner(), tokens.ChunkEncoder(tokens.default_tokenizer())
    size = {r["doc_id"]: r["doc_tokens"] for r in got}
    for i, t in kept:
        if not brute_hits(t, items)[1]:
            total = len(coder.encode([scanner.redact(t)])[0]) // 4 + 1
            assert size[i] == total == sum(r["length"] for r in got if r["doc_id"] == i)


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    for name, rows in (("odd", odd), ("none", none)):
        sf = f"{tmp_path}/{name}"
        rows.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == rows.columns
        got = corpus_pipeline.run(spark, sf).collect()
        assert {r["doc_id"] for r in got} == ({None, 1, 2, 3, 4, 6} if name == "odd" else set())
