import random

import numpy as np

from fjordlake.llm import substring_dedup as S


def test_pairs_that_are_not_looked_into_add_nothing():
    r, skipped, looked = random.Random(11), 0, 0
    for _ in range(400):
        n = r.randrange(46, 260)
        x = np.arange(n, dtype=np.int32)
        if r.random() < 0.3:
            x %= r.randrange(20, 90)  # shingles that repeat
        y = x.copy()
        for _ in range(r.randrange(12)):  # changes, also of lengths
            k, kind = r.randrange(1, max(2, len(y) - 8)), r.randrange(3)
            put = np.arange(r.choice([1, 5, 5, 12]), dtype=np.int32) + 10_000 * r.randrange(1, 99)
            y = np.concatenate([y[:k], put if kind else put[:0], y[k + (len(put) if kind == 1 else r.randrange(3)) :]])
        spans = S.near_spans(x, y, -2, 2, S.Limits(), False)
        cut = r.choice([0, 0, 4, 20])
        held = []
        for a, b in ((0, 1), (2, 3)):
            whole = [(s[a], s[b] - 1 - cut) for s in spans if s[b] - 1 - cut > s[a]]
            merged = []
            for p, q in sorted(whole):
                if merged and p <= merged[-1][1] + 1:
                    merged[-1] = (merged[-1][0], max(q, merged[-1][1]))
                else:
                    merged.append((p, q))
            held.append(np.array(merged, np.int64).reshape(-1, 2))
        inside = lambda h, p, q: any(a <= p and q <= b for a, b in h.tolist())
        adds = any(not inside(held[0], p, q - 1) or not inside(held[1], s, e - 1) for p, q, s, e in spans)
        may = S._may_be_new(x, y, -2, 2, *held, S.Limits())
        assert may or not adds
        skipped, looked = skipped + (not may), looked + may
    assert skipped > 50 and looked > 50


def test_equal_texts_meet_others_once(spark):
    fresh = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    part, long, short = fresh("p", 60), fresh("l", 80), fresh("s", 49)
    copied = " ".join(long + part)
    rows = [(9, copied), (3, copied), (4, copied), (3, copied), (2, " ".join(fresh("o", 20) + part)), (5, " ".join(short)), (6, " ".join(short)), (7, copied.replace("l0 ", "l0\n"))]
    rows += [(8, "x y"), (8, "x y"), (10, " ".join(long[:70])), (10, " ".join(long[:70]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    rest, copies = S._equal_texts(frame, S.Limits())
    assert sorted(r.doc_id for r in rest.collect()) == [2, 3, 3, 5, 7, 8, 8, 10, 10]
    assert {tuple(r) for r in copies.collect()} == {(3, 0, 140, False), (4, 0, 140, True), (9, 0, 140, True)}
    got = {(r.doc_id, *((s.start, s.end) for s in r.spans)) for r in S.repeated_passages(frame).collect()}
    assert got == {*((i, (0, 140)) for i in (3, 4, 7, 9)), (2, (20, 80)), (5,), (6,), (8,), (10, (0, 70))}
    kept = {r.doc_id: r.text.split() for r in S.drop_repeated_passages(frame).collect()}
    assert kept[2] == fresh("o", 20) + part and kept[3] == long and kept[4] == kept[7] == kept[9] == [] == kept[10]
