"""The stages of the pipeline on a small corpus."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests_llm_data import rows


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows()[3][1].split("\n")[0] + " " + rows()[3][1].split("\n")[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"] for r in d.collect()})
        if name != "packing":
            assert d.columns == corpus_pipeline.COLUMNS
    every = {r[0] for r in rows()}
    assert seen[0] == every - {90, 91, 92}  # null, empty, no letter
    assert seen[1] == seen[0] - {50, 51}  # a copy and a near copy of 2
    assert seen[2] == seen[1]
    assert seen[3] == seen[2] - {3}
    assert seen[4] == seen[3]


def test_rows_without_doc_id_and_repeated_ones(spark, tmp_path):
    """Every stage on rows that doc_id does not tell apart: decided by row."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    say = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    spark.createDataFrame([(1, say(7, 20)), (2, say(4, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(1, say(1)), (1, say(1)), (2, say(2)), (2, say(3)), (None, say(5)), (None, say(5)), (None, say(6)), (None, say(1)), (3, say(2)), (4, say(4)), (4, say(8)), (None, say(7))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], schema)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    read = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=key)
    stages = dict(corpus_pipeline.STAGES)
    near = stages["ngram_jaccard"](spark, docs, str(tmp_path))
    got = read(near)
    assert [x for x in got if x[1] != say(2)] == sorted([(1, say(1)), (2, say(3)), (None, say(5)), (None, say(6)), (4, say(4)), (4, say(8)), (None, say(7))], key=key)
    assert [x[1] for x in got].count(say(2)) == 1
    clean = stages["decontamination"](spark, docs, str(tmp_path))
    assert read(clean) == sorted([x for x in texts if x[1] not in (say(4), say(7))], key=key)
    long = [(5, say(20)), (5, say(21) + " " + say(20)), (None, say(22) + " " + say(20)), (6, say(23))]
    cut = read(stages["suffix_array"](spark, spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in long], schema), str(tmp_path)))
    assert sum(say(20)[50:-50] in t for _, t in cut) == 1
    packed = stages["packing"](spark, docs, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    want = stages["packing"](spark, docs.withColumn("doc_id", F.monotonically_increasing_id()), str(tmp_path))
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, None}
    assert sum(r["sum(length)"] for r in packed) == want.agg(F.sum("length")).first()[0]
