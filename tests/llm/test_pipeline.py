"""The pipeline on the smallest tables, each stage against a plain version."""

import os

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_near_dup import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from voxelith.llm import decontaminate, secret_scan, toxicity
    from voxelith.llm.tokens import default_tokenizer, encoder
    from pyspark.sql import functions as F

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs)
    first = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    model = toxicity.fit_toxicity(first, spark.read.parquet(f"{SF}/labels.parquet"), usable=toxicity.fold(F.col("doc_id")) != 1)
    bad = {r.doc_id for r in toxicity.score_toxicity(first, model).collect() if r.predicted}
    assert ids(tables[0]) == ids(first) - bad
    rows = [(r.doc_id, r.text) for r in tables[0].collect()]
    assert ids(tables[1]) == {i for i, root in brute(rows, 5, 80, 100).items() if i == root}
    leaks = {r.doc_id for r in decontaminate.find_leaks(tables[1], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and ids(tables[2]) == ids(tables[1]) - leaks
    before = {r.doc_id: r.text for r in tables[2].collect()}
    after = {r.doc_id: r for r in tables[3].collect()}
    assert set(before) == set(after)
    for i, t in before.items():
        assert after[i].text == secret_scan.redacted(t, secret_scan.scan(t)[1]) and after[i].n_chars == len(after[i].text)
    enc = encoder(default_tokenizer())
    got = {}
    for r in tables[4].collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, r in after.items():
        assert b"".join(x for _, x in sorted(got[i])) == enc.encode(r.text) + np.array([0], "<u4").tobytes()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids(tables[4])


def test_stages_on_odd_rows(spark, make):
    from pyspark.sql import functions as F
    from voxelith.llm import toxicity

    first = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_toxicity(first, spark.read.parquet(f"{SF}/labels.parquet"), usable=toxicity.fold(F.col("doc_id")) != 1)
    scored = toxicity.score_toxicity(first, model).join(first, "doc_id")
    bad = scored.where("predicted = 1").orderBy("doc_id").first().text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    plain = " ".join(f"plain{k}" for k in range(60))
    rows = [(1, bad), (1, plain), (None, bad), (2, item), (None, item), (2, plain), (2, plain), (3, plain + " more"), (None, plain), (4, "alone"), (None, "alone"), (None, "other"), (None, "other"), (5, None), (None, None), (6, ""), (7, "x " * 200_000), (1, plain)]
    docs = make(rows)
    texts = lambda df: sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in df.collect())
    key = lambda i: (i is None, i or 0)
    out = toxicity.drop_toxic(docs, model)
    assert out.columns == docs.columns and texts(out) == sorted((key(i), t or "") for i, t in rows if t != bad)
    out = corpus_pipeline.jaccard_join(spark, docs.where(F.col("text").isNull() | (F.col("text") != bad)), SF)
    left = [(1, plain), (2, item), (4, "alone"), (5, None), (6, ""), (7, "x " * 200_000), (None, "other"), (None, None)]
    got = texts(out)
    assert out.columns == docs.columns
    assert [x for x in got if x[1] in ("alone", "other", "")] == sorted((key(i), t or "") for i, t in left if t in ("alone", "other", "", None))
    assert [x for x in got if x[1] == plain] == [(key(1), plain)] and not [x for x in got if x[1].endswith("more")]
    out = corpus_pipeline.decontamination(spark, docs, SF)
    assert out.columns == docs.columns and texts(out) == sorted((key(i), t or "") for i, t in rows if t != item)
    assert corpus_pipeline.secrets(spark, docs, SF).count() == len(rows)
    assert {r[0] for r in corpus_pipeline.packing(spark, docs, SF).select("doc_id").collect()} == {i for i, _ in rows}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
