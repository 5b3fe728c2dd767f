import zlib
from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fjordlake.llm import packing as K
from fjordlake.llm.tokens import Encoder, default_path

E = Encoder(default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\xa0\x1c ab.,'s!É1|", max_size=60))
def test_ids_are_those_of_the_whole_text(text):
    assert E.encode(text).tolist() == E.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "", None, "x" * 5000, "it's  two\n\nlines ", "naïve. Ünï, çé"])
def test_special_and_odd_texts(text):
    assert E.encode(text).tolist() == E.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_bins_hold_everything_once(lengths):
    lengths = np.array(lengths)
    first = K.best_fit(lengths, 50)
    bins = K.local_search([list(b) for b in first], lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 50 for b in bins) and len(bins) <= len(first)


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 5, 5, 7, 3, 3, 7])
    bins = K.local_search([[0], [1], [2], [3], [4, 5], [6], [7]], lengths, 10)
    assert len(bins) == 4
    # a swap of one for one, then a move
    assert len(K.local_search([[0, 1], [2, 3]], np.array([6, 2, 4, 2]), 10)) == 2


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def test_pack_documents(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"], rng.integers(0, 400))), "x") for i in range(150)]
    rows += [(7, "again", None), (900, None, None), (901, "", "y"), (902, "word " * 3000, None), (None, "no id", None)]
    found = K.pack_documents(docs(spark, rows), capacity=128, with_ids=True).collect()
    want = sorted(
        (i is None, i or 0, np.array([*E.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
        for i, t, _ in rows
    )
    by_doc = {}
    for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        assert 0 < r.length <= 128 and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len([r for r in found if r.piece == 0]) == len(rows)
    for missing, doc_id, ids in want:
        if doc_id == 7:
            continue
        parts = by_doc[None if missing else doc_id]
        assert b"".join(p.ids for p in parts) == ids
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts[:-1])]).tolist()
        assert all(p.length == 128 for p in parts[1:])
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist()
        assert sum(n for _, n in spans) <= 128
    total = sum(r.length for r in found)
    assert len(by_sequence) <= -(-total // 128) + 2


def test_rounds_of_groups(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "CAST(1 + (id * 7919) % 90 AS long) AS length")
    found = K.pack_pieces(pieces, 100, group_rows=600).collect()
    fill = {}
    for r in found:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(found) == 3000 and max(fill.values()) <= 100
    assert len(fill) <= 1.01 * -(-sum(fill.values()) // 100)


def test_sequences_and_empty(spark):
    packed = K.pack_documents(docs(spark, [(1, "a b", ""), (2, "c", "")]), with_ids=True)
    row = K.sequences(packed).collect()
    assert len(row) == 1 and len(row[0].ids) == 4 * row[0].n_tokens
    assert K.pack_documents(docs(spark, [])).count() == 0


def test_pack_documents_until_no_round_settles_any(spark, monkeypatch):
    monkeypatch.setattr(K, "pack_pieces", partial(K.pack_pieces, group_rows=16))  # many groups, so rounds count
    table = docs(spark, [(i, "word " * (1 + i * 37 % 90), "") for i in range(120)])
    few, whole = (K.pack_documents(table, capacity=64, rounds=r, fewer=f).collect() for r, f in ((1, 0.7), (None, 1.0)))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, few)) == sorted(map(key, whole))
    assert len({r.sequence_id for r in whole}) <= len({r.sequence_id for r in few})
