import random

import numpy as np
import pyarrow as pa

from fjordlake.llm import quality as Q

SCHEMA = "doc_id long, text string, score string, n long"
GOOD, CAPS, SIGNS, SAME = range(4)


def text_of(r, kind):
    w = ["".join(r.choices("aeioulnrst", k=r.randrange(3, 9))) for _ in range(r.randrange(40, 120))]
    if kind == CAPS:
        return " ".join(w).upper()
    if kind == SIGNS:
        return " ".join(x + r.choice(["***", "%%%", "&&"]) for x in w)
    if kind == SAME:
        return " ".join(x for x in w[:5] for _ in range(20))
    return ". ".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8)) + "."


def corpus(n=600):
    r = random.Random(5)
    kinds = [r.choice([GOOD] * 6 + [CAPS, SIGNS, SAME]) for _ in range(n)]
    return [(i, text_of(r, k), None, 1) for i, k in enumerate(kinds)], kinds


def test_measures():
    m = Q.measures(pa.array(["AB cd cd 12", "", None, "x. y,"]))
    assert m["words"].tolist() == [4, 0, 0, 2]
    assert np.allclose(m["capitals"], [2 / 6, 0, 0, 0]) and np.allclose(m["repeats"], [1 / 4, 0, 0, 0])
    assert np.allclose(m["digits"], [2 / 11, 0, 0, 0]) and np.allclose(m["stops"], [0, 0, 0, 2 / 5])
    assert np.allclose(m["distinct"], [3 / 4, 0, 0, 1])


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    cast = np.zeros((20_000, len(Q.LABELLERS)), np.int8)
    for j, caught in ((1, 0.6), (2, 0.5), (3, 0.7)):
        cast[:, j] = -1 * ((~good & (rng.random(20_000) < caught)) | (good & (rng.random(20_000) < 0.004)))
    found, at, n = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    chance, accuracy = Q.estimate(found, n.astype(float))
    named = chance[at.ravel()] >= 0.5
    caught_once = (cast < 0).any(1)
    assert (named == ~caught_once).mean() > 0.98
    assert all(a > 0.9 for a in accuracy[1:4])


def test_quality_without_labels(spark):
    rows, kinds = corpus()
    extra = [(9000, None, "", 0), (9001, "", "", 0), (None, rows[0][1], "", 0), (3, rows[3][1], "", 0)]
    got = Q.quality(spark.createDataFrame(rows + extra, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    right = [by[i].predicted == (k == GOOD) for i, k in enumerate(kinds)]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[9000].score == by[9001].score and by[9001].n_bad == 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_scorer_learns_from_sample_alone(spark):
    rows, kinds = corpus()
    small = Q.Settings(sample_rows=150)
    got = {r.doc_id: r.predicted for r in Q.quality(spark.createDataFrame(rows, SCHEMA), settings=small).collect()}
    assert np.mean([got[i] == (k == GOOD) for i, k in enumerate(kinds)]) > 0.93


def test_empty(spark):
    assert Q.quality(spark.createDataFrame([], SCHEMA)).count() == 0
