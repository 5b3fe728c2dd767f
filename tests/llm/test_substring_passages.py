import math
import random

import numpy as np
import pyarrow as pa

from fjordlake.llm import substring_dedup as S


def new_words(tag):
    n = iter(range(10**9))
    return lambda k: [f"{tag}{next(n)}" for _ in range(k)]


def found(spark, docs, **limits):
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    return {r.doc_id: [tuple(s) for s in r.spans] for r in S.repeated_passages(frame, limits=S.Limits(**limits)).collect()}


def test_votes_of_different_rounds_add_up(spark):
    limits = S.Limits(hashes=2, agree=2)
    passage = new_words("p")(50)

    def center(w):
        shingle, at = S._token_shingles(pa.array([" ".join(w)]), 5)
        values = S.mix(shingle ^ S.mix(np.array([2], np.uint64)))
        return shingle, S.compact_windows(values, at, 46)[1]

    shingle, at = center(passage)
    assert len(at) == 1
    for seed in range(100):  # a smaller document in the list of the second hash function alone
        fresh = new_words(f"f{seed}x")
        other = fresh(40) + passage[at[0] : at[0] + 5] + fresh(40)
        values, centers = center(other)
        if shingle[at[0]] in values[centers]:
            break
    got = found(spark, [(3, other), (10, passage), (20, passage)], hashes=2, agree=2)
    assert limits.length == 50 and got == {3: [], 10: [(0, 50)], 20: [(0, 50)]}


def near(x, y):
    return 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))


def test_near_copies_inside_a_chain():
    x = np.arange(116, dtype=np.uint64)
    y = x.copy()
    changed = [t for c in range(63, 120, 8) for t in range(c - 4, c + 1) if t < 116]  # one word, five shingles
    y[changed] += np.uint64(1000)
    assert not near(x.tolist(), y.tolist())
    spans = S.near_spans(x, y, 0, 0, S.Limits(), False)
    assert spans and min(s[0] for s in spans) == 0 and max(s[1] for s in spans) >= 59
    assert all(near(x[p:q].tolist(), y[r:s].tolist()) and q - p >= 46 for p, q, r, s in spans)


def test_every_near_span_inside_is_covered():
    r = random.Random(4)
    for _ in range(30):
        n = r.randrange(60, 200)
        x = np.arange(n, dtype=np.uint64)
        y = x.copy()
        share = [r.choice([0.0, 0.1, 0.3]) for _ in range(0, n, 40)]
        y[[t for t in range(n) if r.random() < share[t // 40]]] += np.uint64(1000)
        want, hit = set(), x == y
        for p in range(n):
            for q in range(p + 46, n + 1):
                both = int(hit[p:q].sum())
                if hit[p] and hit[q - 1] and 100 * both >= 80 * (2 * (q - p) - both):
                    want |= set(range(p, q))
        spans = S.near_spans(x, y, 0, 0, S.Limits(), False)
        assert want <= {t for p, q, *_ in spans for t in range(p, q)}


def test_recall_of_single_near_copies(spark):
    limits = S.Limits()
    chance = sum(math.comb(limits.hashes, k) * 0.8**k * 0.2 ** (limits.hashes - k) for k in range(limits.agree, limits.hashes + 1))
    assert chance >= 0.98  # by design, for one window of each hash function
    r, fresh, docs = random.Random(5), new_words("u"), []
    for i in range(400):
        p = fresh(r.randrange(50, 62))
        q = list(p)
        q[r.randrange(8, len(q) - 8)] = "changed"
        sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (p, q)]
        assert 0.80 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.85
        docs += [(2 * i, fresh(60) + p + fresh(60)), (2 * i + 1, fresh(60) + q + fresh(60))]
    got = found(spark, docs)
    assert sum(bool(got[2 * i] and got[2 * i + 1]) for i in range(400)) >= 0.985 * 400


def test_longer_copies_keep_their_tails(spark):
    for k in range(3):
        fresh = new_words(f"t{k}x")
        p = fresh(75)
        got = found(spark, [(1, fresh(50) + p[:60] + fresh(50)), (2, fresh(50) + p + fresh(50)), (3, fresh(50) + p + fresh(50))])
        assert got == {1: [(50, 110)], 2: [(50, 125)], 3: [(50, 125)]}


def test_groups_whose_copies_reach_beyond_a_common_passage(spark):
    common, docs, want = new_words("c")(60), [], {}
    docs.append((0, new_words("o")(30) + common + new_words("q")(30)))
    want[0] = [(30, 90)]
    for pair in range(12):  # each pair shares more words after the passage, or before it, than all share
        more = new_words(f"m{pair}x")(12 if pair % 3 else 20)
        for k in (1, 2):
            i, own = 2 * pair + k, new_words(f"w{pair}x{k}x")
            shared = common + more if pair % 2 else more + common
            docs.append((i, own(25) + shared + own(25)))
            want[i] = [(25, 25 + len(shared))]
    assert found(spark, docs) == want
