import random
import zlib

import numpy as np
import pyarrow as pa

from fjordlake.llm import toxicity as X

SMALL = X.Shape(window=8, stride=4, toxic_rows=150, clean_rows=250, epochs=10)
DOCS = "doc_id long, text string, score string, lang string"


def test_windows_overlap_and_cover_whole_texts():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 8, 9, 21)] + [None]
    x = X.read_inputs(pa.array(texts), SMALL)
    assert np.bincount(x.row).tolist() == [1, 1, 1, 2, 5, 1]
    for r, n in enumerate((0, 1, 8, 9, 21, 0)):
        seen = {w for w in x.windows[x.row == r].ravel().tolist() if w >= 0}
        assert len(seen) == n


def test_gradients_are_those_of_the_loss():
    shape = X.Shape(window=5, stride=2, width=4, hidden=3, word_rows=64, char_rows=64)
    net = X.Network(shape)
    rng = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = rng.normal(0, 0.5, net.p[k].shape)
    x = X.read_inputs(pa.array(["a bb ccc dd e f g", "bb z", "ee ff gg hh ii"]), shape)
    y = (np.arange(len(x.windows)) % 2).astype(float)
    ones = np.ones(len(y))

    def loss():
        logit = net.run(net.projections(net.word_vectors(x)), x.windows).astype(float)
        return np.mean(np.log1p(np.exp(-np.where(y > 0, logit, -logit))))

    g, tables = net.gradients(x, x.windows, y, ones)
    for k, (rows, d) in tables.items():
        g[k] = np.zeros(net.p[k].shape)
        np.add.at(g[k], rows, d)
    for k, d in g.items():
        at = np.unravel_index(int(np.abs(d).argmax()), d.shape)
        old, eps = net.p[k][at], 1e-2
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * eps) - d[at]) < 2e-3 + 0.02 * abs(d[at]), k


def corpus(n=700):
    r = random.Random(11)
    plain = [a + b + c for a in "bdfgk" for b in "aeio" for c in ("n", "rt", "sm", "lon")]
    bad = ["vexoid", "grumble", "snarkle"]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(plain, k=r.choice([3, 10, 30, 60]))
        toxic = r.random() < 0.3
        if toxic:
            w.insert(r.randrange(len(w) + 1), r.choice(bad) + r.choice(["", "s", "ing"]))
        rows.append((i, " ".join(w).title() if i % 9 == 0 else " ".join(w), "x", None))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    truth = dict(labels)
    docs = spark.createDataFrame(rows + [(9000, None, "", ""), (9001, "", None, None), (None, "bart", "", "")], DOCS)
    known = spark.createDataFrame(labels + [(None, 1), (12345, 1), (9000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.toxicity(docs, known, shape=SMALL).collect()}
    assert len(got) == len(rows) + 3
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in truth if got[i].held_out} == set(held)
    right = [got[i].predicted == truth[i] for i in held]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[9000].predicted == 0 and got[9001].predicted == 0 and got[9000].score == got[9001].score


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(120)
    quick = X.Shape(window=8, stride=4, toxic_rows=20, clean_rows=30, epochs=2)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (
        {r.doc_id: r.score for r in X.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int"), shape=quick).collect()}
        for x in (labels, turned)
    )
    assert a == b


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.toxicity(docs, none).first().predicted == 0
    assert X.toxicity(spark.createDataFrame([], DOCS), none).count() == 0
    kept = X.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == 1
