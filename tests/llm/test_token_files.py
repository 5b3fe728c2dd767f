import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fjordlake.llm import idcoder as C
from fjordlake.llm.token_files import read_token_files, write_token_files
from fjordlake.llm.tokens import Encoder, default_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 65535)), max_size=400), st.integers(1, 90))
def test_round_trip_of_any_ids(ids, block):
    data = C.write_segment([1, None], np.array(ids, np.uint32), np.array([len(ids), 0]), block)
    names, found, sizes = C.read_segment(data)
    assert names == [1, None] and found.tolist() == ids and sizes.tolist() == [len(ids), 0]


def test_repetition_is_learnt_and_blocks_stand_alone():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 50_000, 40)
    ids = np.concatenate([phrase if rng.random() < 0.8 else rng.integers(0, 50_000, 40) for _ in range(2000)]).astype(np.uint32)
    codes, lengths = C.encode_ids(ids, 1024, 50_000)
    assert sum(map(len, codes)) < 0.45 * 2 * len(ids)
    for k in (0, 7, len(codes) - 1):
        alone = C.decode_ids([codes[k]], lengths[k : k + 1], 50_000)[0]
        assert alone.tolist() == ids[1024 * k : 1024 * k + lengths[k]].tolist()


def test_counts_of_a_block_sharpen_its_predictions():
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 12, 4096).astype(np.uint32)  # in an order that orders 1 and 2 cannot learn
    codes, lengths = C.encode_ids(ids, 2048, 50_000)
    unlearnt = np.log2(len(C.classes(50_000)[1]))  # bits of a class of one id where nothing is counted yet
    assert 8 * sum(map(len, codes)) / len(ids) < 0.85 * unlearnt and lengths.tolist() == [2048, 2048]


def test_intervals_are_found_again_and_do_not_overlap():
    rng = np.random.default_rng(3)
    model = C.Models(50, 700)
    for _ in range(200):
        model.predict()
        ids = np.where(rng.random(50) < 0.7, rng.integers(0, 3, 50), rng.integers(0, 700, 50))
        first, size = model.interval(ids)
        for value in (first, first + size - 1):
            found = model.ids_at(value)
            assert all((a == b).all() for a, b in zip(found, (ids, first, size)))
        named = model.id2 == ids + 1
        assert (size > 0).all() and (size[named] == model.share2[named]).all() and (first[named] == 0).all()
        model.update(ids)


def test_damage_is_found():
    data = bytearray(C.write_segment([5], np.arange(3000, dtype=np.uint32) % 700, np.array([3000]), 512))
    data[-40] ^= 16
    with pytest.raises(ValueError):
        C.read_segment(bytes(data))


@pytest.mark.parametrize("segment_ids", [200, 1 << 22])
def test_files_and_back(spark, tmp_path, segment_ids):
    r = random.Random(4)
    rows = [(r.randrange(10**9), " ".join(r.choices(["one", "two", "three,"], k=r.randrange(90))), "p") for _ in range(200)]
    rows += [(5, None, None), (6, "", "q"), (7, "same", ""), (7, "again", ""), (None, "no id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    path = f"file://{tmp_path}/t{segment_ids}"
    write_token_files(docs, path, segment_ids=segment_ids, block=64)
    got = read_token_files(spark, path, with_ids=True).collect()
    tokenizer = Encoder(default_path()).tokenizer
    start = 0
    want = []
    for doc_id, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert read_token_files(spark, path).count() == 0
