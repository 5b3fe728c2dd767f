import random
import re

import pytest

from fjordlake.llm import jaccard_join as J
from fjordlake.llm.components import components

SCHEMA = "doc_id long, text string, n string, component string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    docs = []
    for i in range(n):
        kind = r.random()
        if docs and kind < 0.55:
            w = docs[r.randrange(len(docs))].split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            if kind < 0.1:
                w = w[: max(1, int(len(w) * 0.85))]
        else:
            w = r.choices(vocabulary, k=r.choice([1, 2, 4, 5, 6, 8, 12, 20, 60, 150]))
            if kind > 0.85:
                w += passage
        docs.append(" ".join(w))
    return [(i * 3 + 1, d) for i, d in enumerate(docs)]


@pytest.mark.parametrize("seed,least", [(1, 32), (2, 4)])
def test_against_brute_force(spark, monkeypatch, seed, least):
    monkeypatch.setattr(J, "_LEAST_COMMON", least)
    docs = corpus(seed)
    docs += [(9001, None), (9002, ""), (9003, " \n"), (9004, "a" * 50), (9005, "A" * 50)]
    frame = spark.createDataFrame([(i, t, "x", None) for i, t in docs], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(frame).collect()}
    assert got == brute(docs)


def test_boundary_follows_cost():
    assert J.choose_boundary({1: 5, 2: 5, 100: 50}, 3.0, 80, 100) >= 2
    assert J.choose_boundary({200: 50}, 0.0, 80, 100) == 0


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (3, None), (5, "q"), (5, "a b c d e f")]
    frame = spark.createDataFrame([(i, t, None, "z") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.near_duplicates(frame).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (5, 1, 1), (5, 2, 1)]
    kept = J.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    # another text under a repeated id is a row of its own
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.doc_id != 3) == [(0, "a b c d e f"), (1, "a b c d e f"), (5, "q")]
    assert J.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_at_exactly_the_threshold_and_long_texts(spark):
    at = [f"w{i}" for i in range(49)]  # 45 shingles; one inner word changed: 40 in common of 50
    below = [f"x{i}" for i in range(48)]
    long = [f"y{i % 5000}z{i // 5000}" for i in range(60_000)]
    change = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    docs = [(1, " ".join(at)), (2, change(at, 20)), (3, " ".join(below)), (4, change(below, 20)),
            (5, " ".join(long)), (6, change(long, 900)), (7, "w" * 300_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[2][1] == 1 and got[4][1] == 4 and got[6][1] == 5


def test_groups_without_their_original(spark):
    """Copies that are near to their original alone, or not even linked with most others, in long lists."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(400)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([4, 8, 9])):
            w[r.randrange(400)] = f"e{r.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    docs.append((500, " ".join(base)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(frame).collect()}
    assert got == brute(docs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90, 201: 200}
