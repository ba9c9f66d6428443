"""The pipeline on a small fixture: what each stage drops or changes, and columns whose names clash with the stages' own."""

import json

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
CLASH = ["n_words", "kept", "clean_text", "base_failed", "contaminated", "leaked_items", "pii_base", "pii_all", "_id", "_key"]
GOOD = "The first line of this clean document says enough to be kept by every rule.\nIts second line number {} is as good as the first one, we think."
ITEM = "A train leaves the old station with many passengers and travels far to reach the town where somebody waits for it"
DOCS = {1: GOOD.format("one"), 2: GOOD.format("one"), 3: "too few words", 4: "home | news | shop | about\n" * 30,
        5: GOOD.format("five") + " Nothing else. " + ITEM + ".", 6: GOOD.format("six") + " Unlike the others, it has words of its own: reach me at a.b@mail.org or 10.1.2.3 please, any time.",
        7: None, 8: ""}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipe"))
    docs = spark.createDataFrame([*DOCS.items()], "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"),
                             **{c: F.concat(F.lit(f"{c} of "), "doc_id") for c in CLASH}})
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    import corpus_pipeline
    out, cur = {}, spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, cur, d).write.parquet(f"{d}/{k}")
        cur = out[name] = spark.read.parquet(f"{d}/{k}")
    return out, docs.columns, corpus_pipeline, d


def test_stages(made):
    out, columns, _, _ = made
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").distinct().collect()) for name, df in out.items()}
    assert ids == {"quality rules": [1, 2, 5, 6], "near-duplicates": [1, 5, 6], "benchmark decontamination": [1, 6], "personal data": [1, 6],
                   "packing": [1, 6]}
    for name, df in out.items():
        if name != "packing":
            assert sorted(df.columns) == sorted(columns)
            assert all(r[c] == f"{c} of {r.doc_id}" for r in df.collect() for c in CLASH)
    texts = {r.doc_id: r.text for r in out["personal data"].collect()}
    assert texts == {1: DOCS[1], 6: DOCS[6].replace("a.b@mail.org", "<email>").replace("10.1.2.3", "<ip>")}


def test_run_is_its_stages(spark, made):
    out, _, pipeline, d = made
    got, want = (sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect()) for df in (pipeline.run(spark, d), out["packing"]))
    assert got == want
