import public_tokenizers  # noqa: F401 - the packing stage needs it
from test_copies import brute_kept
from test_packing import check_rows
from test_quality import brute

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf_dir)
        rows[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            frame = spark.createDataFrame(rows[name], docs.schema)
    ids = {n: {r.doc_id for r in v} for n, v in rows.items()}
    assert ids["toxicity"] <= {r.doc_id for r in docs.collect()} and ids["quality"] <= ids["toxicity"]
    for r in rows["quality"]:
        words, _, _, _, repeats = brute(r.text)
        assert words >= 50 and 100 * repeats <= 50 * words
    assert ids["near_duplicates"] == brute_kept([(r.doc_id, r.text) for r in rows["quality"]])
    check_rows(rows["packing"], {r.doc_id: r.text for r in rows["near_duplicates"]}, 4096)


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 0
