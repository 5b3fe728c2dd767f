import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fjordlake.llm import suffix_tree as S

SCHEMA = "doc_id long, text string, n long, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def corpus(n=500):
    r = random.Random(8)
    follow = {}
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = ["w0", "w1"]
        for _ in range(r.randrange(50)):
            pair = (w[-2], w[-1])
            follow.setdefault(pair, r.choice(vocabulary))
            w.append(follow[pair] if r.random() < 0.6 else r.choice(vocabulary) if r.random() < 0.9 else f"rare{r.randrange(900)}")
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else "\n".join(w), None, "k"))
    return rows + [(9000, None, 1, None), (9001, "", 2, ""), (9002, "unheard of", 3, "")]


def brute(rows):
    c = Counter(t for i, text, *_ in rows if not held(i) for t in tokens(text))
    total, distinct = sum(c.values()), len(c)
    out = {}
    for i, text, *_ in rows:
        ts = tokens(text)
        base = sum(math.log10((c[t] + 1) / (total + distinct + 1)) for t in ts)
        out[i] = (held(i), len(ts), sum(c[t] > 0 for t in ts), total, base)
    return out


@pytest.mark.parametrize("common", [2.0**-20, 0.01])
def test_counts_and_base_score(spark, common):
    rows = corpus()
    limits = S.Limits(common=common, symbol=max(common, 1e-5))
    got = {r.doc_id: r for r in S.score_texts(spark.createDataFrame(rows, SCHEMA), limits=limits).collect()}
    for i, (out, n, known, total, base) in brute(rows).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert abs(r.base_score - base) < 1e-6 and math.isfinite(r.score)
    of_held = [r for i, r in got.items() if r.held_out]
    assert sum(r.score for r in of_held) > 0.95 * sum(r.base_score for r in of_held)


def test_joined_tokens_score_as_broadcast_ones(spark):
    frame = spark.createDataFrame(corpus(200), SCHEMA)
    a, b = (
        {r.doc_id: (r.score, r.base_score) for r in S.score_texts(frame, limits=S.Limits(common=c, symbol=0.02)).collect()}
        for c in (1e-9, 0.02)
    )
    assert all(abs(x - y) < 1e-6 for i in a for x, y in zip(a[i], b[i]))


def test_states_are_distributions_and_longest_is_used(spark):
    texts = spark.createDataFrame([(t,) for _, t, *_ in corpus()], "text string")
    tree, _ = S.grow(texts, S.Limits(gain=3.0))
    assert len(tree.contexts[0]) and len(tree.contexts[1])
    size = len(tree.symbols)
    order0 = tree.order0(tree.counts[S.find(tree.common, tree.symbols)])
    for k in (0, 1):
        for at in (0, len(tree.contexts[k]) - 1):
            mine = tree.keys[k] // size == at
            assert abs(tree.shares[k][mine].sum() + tree.rest[k][at] - 1) < 1e-9
            assert 0 <= tree.rest[k][at] <= 1
    toks, at = S.tokens_of(pa.array(["w0 w1 w2", None]))
    assert at.tolist() == [0, 4, 5] and toks[3] == S.END == toks[4]
    steps = tree.multipliers(tree.numbers(toks), at[:-1])
    assert all(len(own) == len(toks) for own, _ in steps)
    assert 0 < order0.sum() <= 1
    for own, rest in steps:
        assert ((own >= 0) & (rest >= 0) & (own + rest <= 1 + 1e-9)).all()


def test_empty_repeated_and_null_ids(spark):
    assert S.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b a", 0, ""), (1, "a b a", 0, ""), (None, "a b", 0, "")]
    got = S.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_tokens for r in got) == [3, 4, 4]
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert np.isfinite([r.score for r in got]).all()


def test_continuations_below_entry_keep_their_share(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    a, b, c = (
        {r.doc_id: r.score for r in S.score_texts(frame, limits=S.Limits(gain=3.0, entry=e)).collect()} for e in (0.0, 2e-3, 1.0)
    )
    assert all(abs(a[i] - x[i]) < 1e-6 for x in (b, c) for i in a)  # in the tree, some joined, all joined
    texts = frame.where("doc_id < 9000").select("text")
    tree, _, more = S.grow_all(texts, S.Limits(gain=3.0, entry=2e-3))
    assert len(tree.keys[0]) and len({k < 0 for (k,) in more.select("key").collect()}) == 2
