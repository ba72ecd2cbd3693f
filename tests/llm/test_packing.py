import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from civicflow.llm import packing, queries, tokens
from civicflow.llm.tokens import WordEncoder


@pytest.mark.parametrize("n", [1, 2, 3, 31, 32, 2047, 2048, 2049, 10_000])
def test_pieces_cover_everything_by_powers_of_two(n):
    pieces = packing.binary_pieces(n)
    assert [p for p, _ in pieces] == list(np.cumsum([0, *(size for _, size in pieces)])[:-1])
    assert sum(size for _, size in pieces) == n
    assert all(size & (size - 1) == 0 and size <= 2048 for _, size in pieces)


def test_query_against_whole_texts(spark):
    got = queries.op4_power_of_two_packing(spark, SF_SMALL).toPandas()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").toPandas()
    e = WordEncoder(tokens.vocabulary())
    for doc_id, own in zip(docs.doc_id, e._direct(docs.text.tolist()), strict=True):
        ids = own + (1).to_bytes(4, "little")
        mine = got[got.doc_id == doc_id].sort_values("start")
        assert mine.length.sum() == len(ids) // 4 == mine.doc_tokens.iloc[0]
        for row in mine.itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[4 * row.start:4 * (row.start + row.length)])
    assert sorted(got.sequence_id) == list(range(len(got))) and (got.offset == 0).all()
    # one bucket per length
    by = got.sort_values("sequence_id").length.to_numpy()
    assert (np.diff(by) <= 0).all()


def test_defined_cases(odd, empty):
    rows = packing.pack_documents(odd).collect()
    only_end = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert [(r.doc_tokens, r.length, bytes(r.ids)) for r in only_end] == [(1, 1, b"\x01\0\0\0")] * 3
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 2
    assert packing.pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, max_length=1000)


def test_numbers_by_a_shuffle_join(odd, monkeypatch):
    want = sorted(map(tuple, packing.pack_documents(odd, with_ids=False).collect()), key=str)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, packing.pack_documents(odd, with_ids=False).collect()), key=str) == want
