import io
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from civicflow.llm import queries, tokens
from civicflow.llm import token_blocks as tb


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([1, 7, 64, 512]), st.sampled_from([0.5, 0.95, 1.0]))
def test_blocks_round_trip(ids, block, share):
    x = np.array(ids, np.uint32)
    blocks = tb.encode_blocks(x, block, share)
    data = b"".join(blocks)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    assert (tb.decode_blocks(data, starts) == x).all()


class _Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_segment_ranges(monkeypatch):
    monkeypatch.setattr(tb, "CHUNK", 3)
    rng, sink, docs = np.random.default_rng(0), io.BytesIO(), []
    sink.close_later = True
    writer = tb.SegmentWriter(sink, block=16)
    for i, n in enumerate([0, 1, 200, 15, 16, 17, 0, 999]):
        docs.append((None if i == 3 else -i, rng.integers(0, 50_000, n).astype("<u4")))
        writer.add(docs[-1][0], docs[-1][1].tobytes())
    writer.close()
    reader = tb.SegmentReader(_Source(sink.getvalue()))
    for (doc_id, ids), (want_id, want) in zip(reader.documents(), docs, strict=True):
        assert doc_id == want_id and np.array_equal(np.concatenate([*ids, np.zeros(0, np.uint32)]), want)
    every = np.concatenate([d for _, d in docs])
    for start, n in [(0, 0), (0, 1), (3, 40), (200, 900), (len(every) - 1, 1)]:
        assert np.array_equal(reader.range(start, n), every[start:start + n])
    with pytest.raises(ValueError):
        tb.SegmentReader(_Source(b"x" * 100))


def test_outliers_are_exceptions():
    x = np.full(512, 5, np.uint32)
    x[100] = 4_000_000_000
    assert len(tb.encode_blocks(x)[0]) < 20


def test_query_against_whole_texts(spark):
    got = queries.op9_pfor_token_files(spark, SF_SMALL).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").toPandas().sort_values("doc_id")
    want = [d + (2).to_bytes(4, "little") for d in tokens.WordEncoder(tokens.vocabulary())._direct(docs.text.tolist())]
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.n_tokens.tolist() == [len(w) // 4 for w in want]
    assert got.start.tolist() == np.cumsum([0, *got.n_tokens])[:-1].tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(w) for w in want]


def test_defined_cases(spark, odd, empty):
    manifest = tb.write_token_files(odd)
    rows = sorted(tb.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8]  # null first, then ascending
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert tb.read_token_files(spark, tb.write_token_files(empty)).count() == 0


def test_rows_of_one_id_are_split(spark, make):
    rows = make([(7, f"text number {i}") for i in range(600)] + [(7, "one text")] * 600 + [(i, "x") for i in range(100, 160)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tb.write_token_files(rows)
        docs = [r.n_docs for r in manifest.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(docs) == 1260 and max(docs) < 700
    out = tb.read_token_files(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out) and len(out) == 1260


def test_stores_by_their_hadoop_names():
    import pytest
    assert tb._store_uri("s3a://bucket/x") == "s3://bucket/x"
    assert tb._store_uri("/tmp/x") == "file:///tmp/x" and tb._store_uri("file:/tmp/x") == "file:/tmp/x"
    with pytest.raises(ValueError, match="swift"):
        tb._store_uri("swift://bucket/x")


def test_every_width_is_unpacked():
    rng = np.random.default_rng(1)
    for width in range(33):
        for count in (1, 7, 512):
            values = rng.integers(0, 1 << width, (5, count)).astype(np.uint32)
            assert (tb._unpack_bits(tb._pack_bits(values, width), width, count) == values).all()
