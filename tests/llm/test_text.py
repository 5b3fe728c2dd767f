import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fjordlake.llm import text as T

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ 0\té\x1c\n.ß", max_size=40)), max_size=8))
@pytest.mark.parametrize("kind,pattern", [(T.SPACE, SPACE), (T.ALNUM, ALNUM)])
def test_words_are_those_of_the_pattern(kind, pattern, texts):
    found = T.words(pa.array(texts, pa.string()), kind)
    data = "".join(x or "" for x in texts).encode()
    want = [pattern.findall(lower(x)) for x in texts]
    assert found.counts().tolist() == [len(w) for w in want]
    got = [lower(data[a:b].decode()) for a, b in zip(found.starts, found.ends)]
    assert got == [w for ws in want for w in ws]
    by_word = {}
    for w, h in zip(got, found.hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_texts_cross_spans():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    found = T.words(pa.array([text, "w1", None, "x" * 2_000_000]), T.SPACE)
    assert found.counts().tolist() == [300_000, 1, 0, 1]
    assert len(np.unique(found.hashes)) == 978


def test_shingles():
    texts = ["a b c d e f", "A  B C\nD E", "a b", "", None, "b a", "a b c d e"]
    w = T.words(pa.array(texts), T.SPACE)
    flat, at = T.distinct_by_row(*T.shingles(w, 5), len(texts))
    sets = [set(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 0, 1, 1]
    assert sets[1] == sets[6] and sets[1] < sets[0] and sets[2] != sets[5]


def thue_morse():
    """A word of 1,024 letters and its complement, which no polynomial modulo 2**64 tells apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [8, 16, 40, 64, 1024])
def test_words_that_polynomials_confuse(size):
    a, b = (w[:size] for w in thue_morse())
    column = pa.array([a, b, a.upper(), a + "\0"])
    found = T.words(column, T.SPACE)
    assert found.hashes[0] != found.hashes[1] and found.hashes[0] == found.hashes[2] != found.hashes[3]
    number = T.exact(found, column).tolist()
    assert number[0] == number[2] and len(set(number)) == 3


def unmix(y):
    """The number that ``mix`` takes to y."""
    full = (1 << 64) - 1

    def unshift(x, by):
        out = x
        for _ in range(64 // by + 1):
            out = x ^ (out >> by)
        return out

    y = unshift(y, 31) * pow(0x94D049BB133111EB, -1, 1 << 64) & full
    y = unshift(y, 27) * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & full
    return (unshift(y, 30) - 0x9E3779B97F4A7C15) & full


PAIR = "forecastcurrents", "st8aqe1t3bls6ich"  # found by undoing the steps of hash_slices


def test_hard_hashes():
    a, b = PAIR
    assert unmix(int(T.mix(np.array([12345], np.uint64))[0])) == 12345
    column = pa.array([a, b, a.upper(), "", "a\0", "a", "\0a", "abcdefgh", "abcdefgh\0", "x" * 64, "x" * 65, "x" * 66])
    found = T.words(column, T.SPACE, T.hard_hashes)
    h = found.hashes.tolist()
    assert h[0] == h[2] and len(set(h)) == len(h) - 1
    assert T.words(column.slice(0, 2), T.SPACE).hashes.tolist()[0] == T.words(column.slice(1, 1), T.SPACE).hashes[0]
    # a second 8 bytes made so that the last steps would meet, as it is done for hash_slices, does not meet here
    lane = lambda w: int.from_bytes(w.encode(), "little")
    head = np.array([lane("currents")], np.uint64)
    for other in ("aaaaaaaa", "zzzzzzzz"):
        of = [T.mix(np.array([16 ^ int(T.mix(np.array([lane(w)], np.uint64))[0])], np.uint64))[0] for w in ("forecast", other)]
        tail = unmix(int(of[0] ^ of[1] ^ T.mix(head + np.uint64(8))[0])) - 8 & (1 << 64) - 1
        data = np.frombuffer(b"forecastcurrents" + other.encode() + tail.to_bytes(8, "little"), np.uint8)
        at = np.array([0, 16]), np.array([16, 32])
        plain, hard = T.hash_slices(data, *at), T.hard_hashes(data, *at)
        assert plain[0] == plain[1] and hard[0] != hard[1]


def test_operators_tell_words_of_one_plain_hash_apart(spark):
    from fjordlake.llm.decontaminate import contamination
    from fjordlake.llm.jaccard_join import near_duplicates
    from fjordlake.llm.suffix_tree import score_texts

    a, b = PAIR
    docs = spark.createDataFrame([(2, a), (11, b), (3, a.upper())], "doc_id long, text string")  # 11 is held out
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == [(2, 1, 2), (3, 1, 2), (11, 1, 11)]
    items = spark.createDataFrame([("x", a)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in contamination(docs, items).collect()} == {2: 1, 3: 1, 11: 0}
    assert {r.doc_id: r.n_known for r in score_texts(docs).collect()} == {2: 2, 3: 2, 11: 1}


@pytest.mark.parametrize("bits", [0, 3, 8])
def test_benchmark_words_are_compared_where_hashes_meet(monkeypatch, bits):
    from fjordlake.llm import decontaminate as D

    short = lambda *a: T.hash_slices(*a) & np.uint64((1 << bits) - 1)
    names = [f"w{i}" for i in range(400)]
    items = [("x", " ".join(names[:12])), ("y", " ".join(names[100:104])), ("z", " ".join(names[200:230]))]
    texts = pa.array([" ".join(names[:12]), " ".join(names[300:]), " ".join(["W7", *names[100:104]]), None, " ".join(names[219:231])])
    want = D._search(texts, D.TestSuffixes(items, 10))
    assert [r["n_hit"] for r in want] == [12, 0, 4, 0, 11]
    monkeypatch.setattr(D, "hard_hashes", short)
    assert D._search(texts, D.TestSuffixes(items, 10)) == want


def test_equal_hashes_are_told_apart_by_their_bytes():
    column = pa.array(["one two one", "two three One"])
    found = T.words(column, T.SPACE)
    found.hashes[:] = 7
    number = T.exact(found, column).tolist()
    assert number[0] == number[2] == number[5] and number[1] == number[3] and len(set(number)) == 3


def test_operators_tell_long_words_apart(spark):
    from fjordlake.llm.decontaminate import contamination
    from fjordlake.llm.jaccard_join import near_duplicates
    from fjordlake.llm.suffix_tree import score_texts

    a, b = thue_morse()
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    items = spark.createDataFrame([("x", b)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in contamination(docs, items).collect()} == {1: 0, 2: 1, 3: 0}
    known = {r.doc_id: r.n_known for r in score_texts(docs.where("doc_id <> 2")).collect()}
    assert known[1] == known[3] == 2
    train = spark.createDataFrame([(2, a), (11, b)], "doc_id long, text string")  # 11 is held out
    assert {r.doc_id: r.n_known for r in score_texts(train).collect()} == {2: 2, 11: 1}
