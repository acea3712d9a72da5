"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import corpus_pipeline
import pytest
from enclosa.llm import decontamination, language_id, license_scan, packing, quality_ranker, quality_rules, set_join, substring_dedup, token_files, url_filter
from enclosa.llm.queries import vocabulary
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", `row` long, h long, id long, sig long, a long, b long, bucket long, score double, n_words long, host string, own binary, file_id long, labels string, x binary, t string, block long, anchor long, pos long"
WIDTH = 18


def say(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


LONG = say(99, 40_000)
ROWS = [
    (1, say(1, 60)), (1, say(1, 60)), (1, say(2, 60)), (2, say(1, 60)), (None, say(3, 60)), (None, say(3, 60)), (None, None), (3, None), (4, ""), (5, LONG), (6, LONG + " end"),
    (7, "mit license " * 2000), (8, " \n\t "), (9, "…"), (10, say(4, 60) + " " + say(1, 60)), (11, say(5, 60)), (12, say(6, 60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, ("en", "de", None)[k % 3], "s", len(t or ""), *([None] * WIDTH)) for k, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, COLUMNS + CLASH).repartition(3)


def test_language_id(docs):
    got = language_id.language_id(docs, language_id.fit(docs)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((d is None, d or 0) for d, _ in ROWS)
    assert sum(r["lang_pred"] == "und" for r in got) == 5
    none = docs.limit(0)
    assert language_id.language_id(none, language_id.fit(none)).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, say(1, 60), 7), (1, say(1, 60), 7), (2, None, 7), (None, say(3, 60), 7), (3, "", 7), (4, " ".join(LONG.split()[20_000:20_030]).upper(), 7)], "item_id long, text string, doc_id long")
    got = decontamination.leaks(docs, items).collect()
    pairs = sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in got)
    assert {p for p in pairs} == {(1, 1), (2, 1), (10, 1), (-1, -1), (5, 4), (6, 4)}
    assert all(r["similarity"] == 1 and r["distance"] == 0 for r in got)
    assert decontamination.leaks(docs, items.limit(0)).count() == 0 and decontamination.leaks(docs.limit(0), items).count() == 0


def test_quality_rules(docs):
    got = quality_rules.weak_supervision(docs).collect()
    assert len(got) == len(ROWS) and sum(r["base_failed"] for r in got) == 6
    assert max(r["n_words"] for r in got) == 40_001


def test_token_files(spark, docs):
    made = token_files.flat_blocks(docs, vocabulary(), 50256, block_tokens=1000).cache()
    counts = token_files.token_counts(made.where("tokens IS NOT NULL"), 50256)
    assert counts.count() == len(ROWS) and made.where("tokens IS NULL").count() == len(ROWS)
    assert token_files.token_counts(made.limit(0), 50256).count() == 0


def test_packing(docs, monkeypatch):
    whole = packing.pack_documents(docs, vocabulary())
    assert whole.agg(F.sum("length")).first()[0] == whole.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert whole.where("start = 0").count() == len(ROWS)
    monkeypatch.setattr(packing, "PORTION", 7)
    small = packing.pack_documents(docs, vocabulary()).collect()
    by = {}
    for r in sorted(small, key=lambda r: r["offset"]):
        assert by.setdefault(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 1024 and sum(by.values()) == whole.agg(F.sum("length")).first()[0]


def test_packing_splits_one_repeated_document(spark, monkeypatch):
    """Rows of one document, and rows without a doc_id, are packed in portions, not in one block."""
    monkeypatch.setattr(packing, "PORTION", 50)
    d = spark.createDataFrame([(k % 2 or None, "one two three") for k in range(400)], "doc_id long, text string")
    got = packing.pack_documents(d, vocabulary()).collect()
    assert len(got) == 400 and {r["doc_id"] for r in got} == {1, None}
    assert len({r["sequence_id"] for r in got}) >= 8


def test_quality_ranker(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (7, 0), (7, 1), (None, 1), (11, None)], "doc_id long, quality int")
    got = quality_ranker.rank_quality(docs, quality_ranker.fit(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_ranker.fit(docs.limit(0), labels) is None and quality_ranker.fit(docs, labels.limit(0)) is None
    assert quality_ranker.rank_quality(docs.limit(0), quality_ranker.fit(docs, labels)).count() == 0


def test_license_scan(spark, docs):
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(ROWS)
    seven = next(r for r in got if r["doc_id"] == 7)
    assert (seven["n_base"], seven["first_word"], seven["last_word"], seven["permissive"]) == (2000, 0, 3998, True)
    assert all(r["permissive"] is None and r["score"] == 0 for r in got if r["doc_id"] != 7)


@pytest.mark.parametrize("text, labels, permissive", [
    ("SPDX-License-Identifier: GPL-2.0 OR MIT", "gpl-2.0,mit", True),
    ("SPDX-License-Identifier: GPL-2.0 AND MIT", "gpl-2.0,mit", False),
    ("Released under the MIT License.", "mit", True),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", False),
    ("Licensed under the Apache License, Version 2.0.", "apache", True),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", False),
    ("Licensed under (GPL-2.0 OR MIT) AND Apache-2.0 at your choice", "apache-2.0,gpl-2.0,mit", True),
    ("license: the usual one", "", None),
    ("nothing here", "", None),
])
def test_expressions_are_evaluated(spark, text, labels, permissive):
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["labels"], r["permissive"]) == (labels, permissive)


def test_set_join(docs):
    got = set_join.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[2] == {1} and by[6] == {5} and by[1] == {1} and by[10] == {10} and by[4] == {4}
    assert by[None] == {None}
    assert set_join.near_duplicates(docs.limit(0)).count() == 0


def test_substring_dedup(docs):
    got = substring_dedup.removals(docs, extra=["row", "h", "own"]).collect()
    assert len(got) == len(ROWS) and got[0].asDict().keys() >= {"row", "h", "own"}
    gone = {}
    for r in got:
        gone.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert gone[None] == [(0, 0), (359, 0), (359, 0)] or sorted(gone[None]) == [(0, 0), (359, 0), (359, 0)]
    assert gone[2] == [(359, 359)] and gone[6][0][1] >= len(LONG) and sorted(x[1] for x in gone[1])[:3] == [0, 0, 0]
    assert substring_dedup.removals(docs.limit(0)).count() == 0


def test_url_filter(spark):
    pages = [(1, "http://a.example.com/", 5, 1, "x", "y"), (1, "http://a.example.com/", 5, 1, "x", "y"), (None, "http://a.example.com/", 15, 1, "x", "y"), (2, "http://" + "a." * 40 + "example.com/" + "p" * 50_000, 12, 1, "x", "y"), (3, None, None, 1, "x", "y"), (4, "", 3, 1, "x", "y")]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched long, capture long, domain string, action string")
    entries = spark.createDataFrame([("example.com", "block", 10, 1), ("example.com", "allow", 10, 1), ("example.com", "block", 10, 2), ("a.example.com", "allow", 14, 1)], "host string, action string, day long, at long")
    got = url_filter.temporal_filter(captures, entries).collect()
    assert sorted((r["page_id"] or -1, r["matched"], r["kept"]) for r in got if r["page_id"] not in (3, 4)) == [(-1, "a.example.com", True), (1, None, True), (1, None, True), (2, "example.com", False)]
    assert all(r["kept"] and r["host"] is None for r in got if r["page_id"] in (3, 4))
    assert url_filter.temporal_filter(captures, entries.limit(0)).where("kept").count() == len(pages)
    assert url_filter.temporal_filter(captures.limit(0), entries).count() == 0


# --- pipeline ---


def test_every_stage_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, say(1, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_edges(spark, docs, tmp_path):
    spark.createDataFrame([(1, say(6, 60)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "ngram_jaccard", "suffix_array", "decontamination"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        left = [(r["doc_id"], r["text"]) for r in out.collect()]
        texts = [t for _, t in left]
        if name == "ngram_jaccard":
            assert texts.count(say(1, 60)) == 1 and texts.count(say(3, 60)) == 1 and texts.count(say(2, 60)) == 1 and texts.count(None) == 2 and sum(t in (LONG, LONG + " end") for t in texts) == 1
        if name == "suffix_array":
            assert sum(say(1, 60) in (t or "") for t in texts) == 2  # the two equal rows of one document
            assert any(d == 10 and t.startswith(say(4, 60)[:200]) and say(1, 60) not in t for d, t in left)
        if name == "decontamination":
            assert sorted((d is None, d or 0) for d, _ in left) == sorted((d is None, d or 0) for d, t in ROWS if t != say(6, 60))


def test_run_cuts_passages_and_keeps_the_rest(spark, tmp_path):
    passage = say(500, 70)
    rows = [(k, say(600 + k, 80) + " " + (passage if k % 4 == 0 else say(700 + k, 70)) + " " + say(800 + k, 80)) for k in range(24)]
    rows += [(30, rows[3][1]), (31, rows[5][1].replace(rows[5][1].split()[7], "other", 1)), (32, say(900, 30) + " " + say(901, 25) + " " + say(902, 30)), (33, "12 34"), (34, None)]
    spark.createDataFrame([(d, t, "en" if d % 2 else "de", "s", len(t or "")) for d, t in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, say(901, 25))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert set(seen) == set(range(24))
    plain = {r["doc_id"]: r["doc_tokens"] for r in packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect()}
    assert [k for k in range(24) if seen[k] < 0.9 * plain[k]] == [4, 8, 12, 16, 20]
    assert all(seen[k] == plain[k] for k in range(24) if k % 4)


def test_hot_contexts_are_cut_again_and_not_spelt_out():
    """Wider anchors cover the starts of a context once, in few rows; equal prefixes keep a common anchor."""
    import pyarrow as pa
    from enclosa.llm import substring_dedup as sd

    r = random.Random(3)
    line = bytes(r.choice(b"abcdefgh ") for _ in range(150))
    own = [bytes(r.choice(b"abcdefgh ") for _ in range(30)) + line[15 * (k % 2) :] for k in range(40)]
    rows = pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([k << sd.START_BITS for k in range(40)], pa.int64())], ["context", "pos"])
    windows = [(w, p) for b in sd._windows([rows]) for w, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    for k, share in zip(sd.WIDER, (8, 3), strict=True):
        found = [x for b in sd._parts(k)([rows]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(found) * share < len(windows)
        spelt = [(c[i : i + sd.LENGTH], p + i, a) for a, c, p in found for i in range(len(c) - sd.LENGTH + 1)]
        assert sorted((w, p) for w, p, _ in spelt) == sorted(windows)
        anchors = {}
        for w, _, a in spelt:
            assert anchors.setdefault(w, a) == a
