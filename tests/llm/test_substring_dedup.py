import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fjordlake.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, spans string, n_words int"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=25), min_size=1, max_size=4), st.integers(1, 6))
def test_windows_name_the_least_of_every_subsequence(rows, length):
    values = np.array([v << 40 for r in rows for v in r], np.uint64)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    lo, mid, hi = S.compact_windows(values, at, length)
    seen = {}
    for a, c, b in zip(lo.tolist(), mid.tolist(), hi.tolist()):
        assert values[c] == values[a : b + 1].min() and b - a + 1 >= length
        for i in range(a, c + 1):
            for j in range(max(c, i + length - 1), b + 1):
                assert (i, j) not in seen
                seen[i, j] = c
    want = {(i, j) for p, q in zip(at[:-1], at[1:]) for i in range(p, q) for j in range(i + length - 1, q)}
    assert set(seen) == want


def corpus():
    r = random.Random(9)
    new = iter(range(10**9))
    fresh = lambda n: [f"u{next(new)}" for _ in range(n)]
    passage, other = fresh(70), fresh(90)
    docs, planted = [], {}
    for i in range(60):
        w = fresh(r.choice([10, 60, 200]))
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            p = list(passage if i % 2 else other)
            if i % 4 == 0:
                p[r.randrange(len(p))] = "changed"
            elif i % 9 == 0:
                p.insert(len(p) // 2, "added")
            planted[i] = (at, at + len(p))
            w[at:at] = p
        if i % 3 == 1:
            w += passage[:30]  # too short to count
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w), "x", 0))
    return docs, planted


def test_planted_passages_are_found(spark):
    docs, planted = corpus()
    inner = " ".join(f"in{i}" for i in range(55))
    docs += [(100, f"{inner} a b c {inner}", "", 0), (101, None, "", 0), (102, "", None, 1), (None, docs[0][1], "", 1)]
    got = {r.doc_id: r for r in S.repeated_passages(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()}
    assert len(got) == len(docs)
    for i, *_ in docs[:60]:
        if i in planted:
            a, b = planted[i]
            assert got[i].n_spans == 1 and abs(got[i].spans[0].start - a) <= 6 and abs(got[i].spans[0].end - b) <= 6
        else:
            assert got[i].n_spans == 0
    assert [tuple(s) for s in got[100].spans] == [(0, 55), (58, 113)]
    assert got[101].n_spans == got[102].n_words == got[None].n_spans == 0


def test_empty(spark):
    assert S.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_passages_are_removed(spark):
    new = iter(range(10**9))
    fresh = lambda n: " ".join(f"n{next(new)}" for _ in range(n))
    p, tail = fresh(60), fresh(30)
    docs = [(4, f"{tail}\n{p}  {fresh(9)}", "x", 1), (2, p, None, 2), (9, f"start {p} {p} é end", "", 3), (None, p, "", 4), (5, None, "", 5), (6, fresh(80), "", 6)]
    frame = spark.createDataFrame(docs, SCHEMA)
    out = S.drop_repeated_passages(frame)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == frame.columns and len(got) == len(docs)
    assert got[2] == p and got[None] == p and got[5] is None and got[6] == docs[5][1]
    assert got[4] == docs[0][1].replace(p, "") and got[9].split() == ["start", "é", "end"]


def recall_corpus():
    """Pairs of passages of mixed changes, each in documents of their own, and by brute force which are near copies."""
    r = random.Random(77)
    new = iter(range(10**9))
    fresh = lambda n: [f"m{next(new)}" for _ in range(n)]
    docs, near = [], []
    for i in range(160):
        p = fresh(r.choice([50, 55, 70, 120]))
        q = list(p)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            k = r.randrange(2, len(q) - 2)
            kind = r.randrange(3)
            q[k : k + (kind < 2)] = [] if kind == 0 else fresh(1)
        sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (p, q)]
        if len(q) >= 50 and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]):
            near.append(i)
        docs += [(2 * i, " ".join(fresh(r.randrange(40)) + p + fresh(30))), (2 * i + 1, " ".join(fresh(r.randrange(40)) + q + fresh(9)))]
    return docs, near


def test_recall_on_mixed_changes(spark):
    docs, near = recall_corpus()
    got = {r.doc_id: r.n_spans for r in S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(near) > 80
    assert sum(bool(got[2 * i] and got[2 * i + 1]) for i in near) >= 0.95 * len(near)


def test_a_second_passage_beside_an_exact_one():
    x = np.arange(400, dtype=np.int32)
    y = np.concatenate([x[:60], 5000 + np.arange(40, dtype=np.int32), x[100:170], [9000, 9001], x[170:260]]).astype(np.int32)
    spans = S.near_spans(x, y, 0, 0, S.Limits(), False)
    assert {*range(60), *range(100, 260)} <= {t for p, q, *_ in spans for t in range(p, q)}
