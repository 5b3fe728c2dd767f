import math
from collections import Counter, defaultdict

import pytest

from fjordlake.llm import suffix_tree as S

from test_suffix_tree import SCHEMA, corpus, held, tokens


def scores(rows, limits):
    """The model, of lists and dictionaries: every token may follow a context, whatever its share."""
    train = [tokens(text) for i, text, *_ in rows if not held(i)]
    c = Counter(t for ts in train for t in ts)
    total, ones, twos = sum(c.values()), sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
    d0 = ones / (ones + 2 * twos)
    lead = {t for t, n in c.items() if n >= max(2, limits.symbol * total)}

    def steps(ts):
        for k, w in enumerate(ts):
            one = ts[k - 1] if k else None
            two = (ts[k - 2] if k > 1 else None) if k else "none"
            yield one, two, w

    pairs, triples = defaultdict(Counter), defaultdict(Counter)
    for ts in train:
        for one, _, w in steps(ts):
            if one in lead:
                pairs[one][w] += 1
    frequent = {(a, b): n for a in pairs for b, n in pairs[a].items() if b in lead and n >= max(2, limits.context * total)}
    for ts in train:
        for one, two, w in steps(ts):
            if (two, one) in frequent:
                triples[two, one][w] += 1

    def states(follow, all_of, parent):
        kept = {}
        for context, n in follow.items():
            m = all_of(context)
            if sum(k * math.log(k / m / parent(context, w)) for w, k in n.items()) >= limits.gain + len(n):
                own = {w: max(k - limits.discount, 0) / m for w, k in n.items()}
                kept[context] = own, 1 - sum(own.values())
        return kept

    first = states(pairs, lambda a: c[a], lambda a, w: c[w] / total)
    second = states(triples, lambda ab: frequent[ab], lambda ab, w: pairs[ab[1]][w] / c[ab[1]])
    out = {}
    for i, text, *_ in rows:
        score = 0.0
        for one, two, w in steps(tokens(text)):
            p = max(c[w] - d0, 1e-9) / (total + 1) if c[w] else max(d0 * len(c), 0.5) / (total + 1)
            for own, rest in [x for x in (first.get(one), second.get((two, one))) if x]:
                p = own.get(w, 0.0) + rest * p
            score += math.log10(p)
        out[i] = score
    return out, first, second, c


@pytest.mark.parametrize("common, entry", [(2.0**-20, 5e-7), (0.01, 5e-7), (0.01, 2e-3)])
def test_scores_of_all_continuations_by_brute_force(spark, common, entry):
    rows = corpus(900)
    limits = S.Limits(common=common, symbol=0.01, context=1e-3, entry=entry, gain=3.0)
    want, first, second, c = scores(rows, limits)
    below = {w for own, _ in [*first.values(), *second.values()] for w in own if c[w] < 0.01 * sum(c.values())}
    assert len(first) > 10 and len(second) > 10 and len(below) > 100  # rare words that have shares of their own
    got = {r.doc_id: r.score for r in S.score_texts(spark.createDataFrame(rows, SCHEMA), limits=limits).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
