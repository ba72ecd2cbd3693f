import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

import corpus_pipeline
from civicflow.llm import decontam, gray_simhash, packing, pii, quality, tokens
from civicflow.llm.common import materialise, release_scratch, scratch_path


def test_stages_one_by_one_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now.toPandas(), materialise(stage(spark, now, SF_SMALL), "stage")
        after = now.toPandas()
        if name != "packing":
            assert now.columns == docs.columns
        if name == "quality classifier":
            model = quality.fit_quality(docs, quality.rated(spark.read.parquet(f"{SF_SMALL}/labels.parquet")))
            scored = quality.score_quality(docs, model).toPandas()
            assert set(after.doc_id) == set(scored.doc_id[scored.tail_probability >= quality.KEEP_FROM])
        elif name == "SimHash near-dedup":
            fps = np.array([gray_simhash.fingerprint(t) for t in before.sort_values("doc_id").text], np.uint64)
            ids, kept = sorted(before.doc_id), []
            component = list(range(len(fps)))
            for i in range(len(fps)):
                for j in range(i):
                    if int(fps[i] ^ fps[j]).bit_count() <= 2:
                        a, b = component[i], component[j]
                        component = [min(a, b) if c in (a, b) else c for c in component]
            kept = [ids[i] for i, c in enumerate(component) if c == i]
            assert sorted(after.doc_id) == kept
        elif name == "benchmark decontamination":
            bad = {r.doc_id for r in decontam.overlaps(spark.createDataFrame(before), spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
            assert set(after.doc_id) == set(before.doc_id) - bad
        elif name == "PII":
            both = after.merge(before, on="doc_id")
            assert len(both) == len(before) and (both.text_x == both.text_y.map(pii.mask_text)).all()
            assert (both.n_chars_x == both.text_x.map(len)).all()
            assert not any(pii.find_plain(t) for t in both.text_x)
        else:
            want = dict(zip(before.doc_id, tokens.WordEncoder(tokens.vocabulary())._direct(before.text.tolist()), strict=True))
            for doc_id, rows in after.groupby("doc_id"):
                assert b"".join(map(bytes, rows.sort_values("start").ids)) == want[doc_id] + packing.END_ID.to_bytes(4, "little")
            assert set(after.doc_id) == set(before.doc_id)
            assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in after.itertuples())


def test_run_gives_the_rows_of_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert rows and sorted(r.sequence_id for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, empty, stage):
    out = stage(spark, odd, SF_SMALL)
    rows = out.collect()
    if stage is not corpus_pipeline.pack:
        assert out.columns == odd.columns
        assert any(r.doc_id == 5 for r in rows)
    assert stage(spark, empty, SF_SMALL).count() == 0


def test_scratch_is_released(spark):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    release_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_quality_stage_hands_over_each_text_once(spark, monkeypatch):
    import corpus_pipeline
    from civicflow.llm import quality
    found = []
    score = quality.score_quality
    monkeypatch.setattr(corpus_pipeline.quality, "score_quality", lambda rows, *more: found.append(rows) or score(rows, *more))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    docs = spark.createDataFrame([(1, "Some words to keep.", "x"), (2, None, "y"), (None, "", "z")], "doc_id long, text string, more string")
    kept = corpus_pipeline.keep_quality(spark, docs, "")
    assert found[0].schema.simpleString().count("text:") == 1
    assert kept.columns == docs.columns and {r["more"] for r in kept.collect()} <= {"x"}
