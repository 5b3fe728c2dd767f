"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .text import ALNUM, chunks, mix, text_buffer, words

_BLOCK = 4096


@dataclass(frozen=True)
class Shape:
    """Sizes of the network and of its training; the bounds on the training sample are parameters too."""

    window: int = 32
    stride: int = 16
    width: int = 12
    hidden: int = 8
    word_rows: int = 1 << 15
    char_rows: int = 1 << 12
    toxic_rows: int = 600
    clean_rows: int = 1200
    most_chars: int = 20_000
    epochs: int = 14
    seed: int = 7


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Inputs:
    """Distinct words of some texts as rows of the input tables, and windows of them.

    ``windows`` holds word numbers, -1 past the end of a text; ``row`` tells whose each is.
    """

    first: np.ndarray
    second: np.ndarray
    grams: np.ndarray
    gram_word: np.ndarray
    windows: np.ndarray
    row: np.ndarray
    n_rows: int
    counts: np.ndarray = field(repr=False)


def read_inputs(column: pa.Array, shape: Shape) -> Inputs:
    """Words' hash rows, their character trigrams (ends marked), and all overlapping windows."""
    found = words(column, ALNUM)
    data, _ = text_buffer(column)
    hashes, at, number = np.unique(found.hashes, return_index=True, return_inverse=True)
    n, starts, ends = len(hashes), found.starts[at], found.ends[at]
    first = (hashes % np.uint64(shape.word_rows)).astype(np.int64)
    second = (mix(hashes) % np.uint64(shape.word_rows)).astype(np.int64)
    size = ends - starts
    gram_word = np.repeat(np.arange(n), size)
    place = np.arange(len(gram_word)) - (np.cumsum(size) - size)[gram_word] + starts[gram_word]
    lower = data.copy()
    upper = (lower >= 0x41) & (lower <= 0x5A)
    lower[upper] += 32
    padded = np.concatenate([[0], lower, [0]]).astype(np.uint64)
    before = np.where(place == starts[gram_word], np.uint64(1), padded[place])
    after = np.where(place + 1 == ends[gram_word], np.uint64(2), padded[place + 2])
    code = (before << np.uint64(16)) | (padded[place + 1] << np.uint64(8)) | after
    grams = (mix(code) % np.uint64(shape.char_rows)).astype(np.int64)
    counts = found.counts()
    many = np.maximum(1, -(-np.maximum(counts - shape.window, 0) // shape.stride) + 1)
    row = np.repeat(np.arange(len(counts)), many)
    begin = (np.arange(len(row)) - (np.cumsum(many) - many)[row]) * shape.stride
    inside = begin[:, None] + np.arange(shape.window)
    spot = np.minimum(found.rows[:-1][row][:, None] + inside, max(0, len(number) - 1))
    windows = np.where(inside < counts[row][:, None], number[spot] if len(number) else -1, -1)
    return Inputs(first, second, grams, gram_word, windows.astype(np.int32), row, len(counts), counts)


class Network:
    """Two gated recurrent layers, one each way, over the words of a window; attention pools their states."""

    def __init__(self, shape: Shape):
        self.shape = shape
        rng = np.random.default_rng(shape.seed)
        e, h = shape.width, shape.hidden
        draw = lambda *size, scale=0.3: rng.normal(0, scale, size).astype(np.float32)
        self.p = {
            "first": np.zeros((shape.word_rows, e // 2), np.float32),
            "second": np.zeros((shape.word_rows, e // 2), np.float32),
            "chars": draw(shape.char_rows, e, scale=0.05),
            "attend": draw(2 * h),
            "out": draw(2 * h),
            "bias": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            self.p[f"w{way}"] = draw(e, 3 * h)
            self.p[f"u{way}"] = draw(h, 3 * h)
            self.p[f"c{way}"] = np.zeros(3 * h, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def word_vectors(self, x: Inputs) -> np.ndarray:
        p = self.p
        out = np.concatenate([p["first"][x.first], p["second"][x.second]], axis=1)
        if len(x.grams):
            begin = np.flatnonzero(np.diff(x.gram_word, prepend=-1))
            size = np.diff(np.append(begin, len(x.grams)))
            out += np.add.reduceat(p["chars"][x.grams], begin, axis=0) / size[:, None].astype(np.float32)
        return out

    def projections(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Input sums of the gates per word; the last row is the end of a text, which keeps the state."""
        h = self.shape.hidden
        out = {}
        for way in ("f", "b"):
            rows = np.zeros((len(vectors) + 1, 3 * h), np.float32)
            rows[:-1] = vectors @ self.p[f"w{way}"] + self.p[f"c{way}"]
            rows[-1, :h] = 30.0
            out[way] = rows
        return out

    def run(self, projected, windows: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what the way back needs."""
        n, steps = windows.shape
        h = self.shape.hidden
        states = np.empty((steps, n, 2 * h), np.float32)
        kept = {"f": [None] * steps, "b": [None] * steps}
        for way, order, part in (("f", range(steps), slice(0, h)), ("b", range(steps - 1, -1, -1), slice(h, 2 * h))):
            table, u = projected[way], self.p[f"u{way}"]
            state = np.zeros((n, h), np.float32)
            for t in order:
                x = table[windows[:, t]]
                s = state @ u
                gates = x[:, : 2 * h] + s[:, : 2 * h]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
                if keep:
                    kept[way][t] = (state, z, r, new, s[:, 2 * h :])
                state = new + z * (state - new)
                states[t][:, part] = state
        mark = states @ self.p["attend"]
        mark[windows.T < 0] = -30.0
        mark -= mark.max(0)
        weight = np.exp(mark)
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, pooled, weight, states, kept) if keep else logit

    def text_logits(self, x: Inputs) -> np.ndarray:
        """The highest logit over all windows of each text."""
        projected = self.projections(self.word_vectors(x))
        parts = [self.run(projected, x.windows[a : a + _BLOCK]) for a in range(0, len(x.windows), _BLOCK)]
        best = np.full(x.n_rows, -np.inf, np.float32)
        if parts:
            np.maximum.at(best, x.row, np.concatenate(parts))
        return best

    def scores(self, column: pa.Array) -> np.ndarray:
        logits = self.text_logits(read_inputs(column, self.shape))
        return sigmoid(self.scale * logits.astype(float) + self.shift)

    def gradients(self, x: Inputs, windows: np.ndarray, target: np.ndarray, weight_of: np.ndarray):
        """Gradients of the weighted logistic loss; those of tables as (rows, values)."""
        p, h = self.p, self.shape.hidden
        vectors = self.word_vectors(x)
        projected = self.projections(vectors)
        logit, pooled, weight, states, kept = self.run(projected, windows, keep=True)
        n, steps = windows.shape
        d_logit = ((sigmoid(logit) - target) * weight_of / n).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nk,tnk->tn", d_pooled, states)
        d_mark = weight * (d_weight - (weight * d_weight).sum(0))
        g["attend"] = np.einsum("tn,tnk->k", d_mark, states)
        d_states = weight[:, :, None] * d_pooled[None] + d_mark[:, :, None] * p["attend"]
        d_vectors = np.zeros_like(vectors)
        for way, order, part in (("f", range(steps - 1, -1, -1), slice(0, h)), ("b", range(steps), slice(h, 2 * h))):
            u = p[f"u{way}"]
            d_table = np.zeros_like(projected[way])
            g[f"u{way}"] = np.zeros_like(u)
            back = np.zeros((n, h), np.float32)
            for t in order:
                state, z, r, new, s_new = kept[way][t]
                d = d_states[t][:, part] + back
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (state - new) * z * (1 - z)
                d_r = d_new * s_new * r * (1 - r)
                d_s = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"u{way}"] += state.T @ d_s
                back = d * z + d_s @ u.T
                np.add.at(d_table, windows[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
            d_table = d_table[:-1]
            g[f"w{way}"] = vectors.T @ d_table
            g[f"c{way}"] = d_table.sum(0)
            d_vectors += d_table @ p[f"w{way}"].T
        half = self.shape.width // 2
        size = np.bincount(x.gram_word, minlength=len(vectors)).astype(np.float32)
        spread = (d_vectors / np.maximum(size, 1)[:, None])[x.gram_word]
        tables = {"first": (x.first, d_vectors[:, :half]), "second": (x.second, d_vectors[:, half:]), "chars": (x.grams, spread)}
        return g, tables


def train(texts: list[str], toxic: list[int], shape: Shape) -> Network:
    """A network fitted to whole texts, of which each is as toxic as its most toxic window.

    Each epoch picks from every text the windows that the network finds most
    toxic, in the first epoch those with the highest log odds of words, and
    some others of clean texts, and takes Adam steps on them (Adagrad for the
    tables). At last a logistic curve over the texts' highest logits is
    fitted.
    """
    net = Network(shape)
    target = np.array(toxic, np.float32)
    if not len(texts) or target.min() == target.max():
        net.scale, net.shift = 0.0, 4.0 if len(texts) and target.min() > 0 else -4.0
        return net
    rng = np.random.default_rng(shape.seed)
    x = read_inputs(pa.array(texts, pa.large_string()), shape)
    owner = np.repeat(x.row[:, None], shape.window, axis=1)[x.windows >= 0]
    pairs = np.unique(owner.astype(np.int64) * (len(x.first) + 1) + x.windows[x.windows >= 0])
    of_word, of_row = pairs % (len(x.first) + 1), pairs // (len(x.first) + 1)
    yes = np.bincount(of_word, target[of_row], len(x.first))
    no = np.bincount(of_word, 1 - target[of_row], len(x.first))
    odds = np.log((yes + 0.5) / (target.sum() + 1)) - np.log((no + 0.5) / (len(target) - target.sum() + 1))
    odds = np.append(np.where(yes + no >= 3, odds, 0), 0)
    by_window = odds[x.windows].max(1)
    moment: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(shape.epochs):
        if epoch:
            projected = net.projections(net.word_vectors(x))
            by_window = np.concatenate([net.run(projected, x.windows[a : a + _BLOCK]) for a in range(0, len(x.windows), _BLOCK)])
        order = np.lexsort((-by_window, x.row))
        place = np.arange(len(order)) - np.searchsorted(x.row, x.row[order])
        clean = target[x.row[order]] == 0
        chosen = order[(place < 1) | (clean & ((place < 2) | (rng.random(len(order)) < 0.03)))]
        rng.shuffle(chosen)
        rate = 0.02 if epoch < shape.epochs * 2 // 3 else 0.005
        for a in range(0, len(chosen), 256):
            some = chosen[a : a + 256]
            used, local = np.unique(x.windows[some], return_inverse=True)
            local = local.reshape(len(some), -1)
            if used[0] < 0:
                used, local = used[1:], local - 1
            take = np.searchsorted(x.gram_word, used), np.searchsorted(x.gram_word, used, "right")
            spots = np.concatenate([np.arange(i, j) for i, j in zip(*take)]) if len(used) else np.empty(0, np.int64)
            part = Inputs(
                x.first[used], x.second[used], x.grams[spots], np.repeat(np.arange(len(used)), take[1] - take[0]),
                local, some, 0, x.counts,
            )
            y = target[x.row[some]]
            g, tables = net.gradients(part, local, y, np.where(y > 0, 2.0, 1.0))
            step += 1
            for k, d in g.items():
                m, v = moment[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            for k, (rows, d) in tables.items():
                which, at = np.unique(rows, return_inverse=True)
                total = np.zeros((len(which), d.shape[1]), np.float32)
                np.add.at(total, at, d)
                v = moment[k][1]
                v[which] += total * total
                net.p[k][which] -= 4 * rate * total / (np.sqrt(v[which]) + 1e-6)
    best = net.text_logits(x).astype(float)
    net.scale, net.shift = _curve(best, target.astype(float))
    return net


def _curve(logits: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, a little pulled to 1 and 0 (Newton's method)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        s = sigmoid(a * logits + b)
        g = np.array([((s - target) * logits).sum() + 0.5 * (a - 1), (s - target).sum() + 0.05 * b])
        w = s * (1 - s)
        hess = np.array([[(w * logits**2).sum() + 0.5, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.05]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -3, 3)
    return float(max(a, 0.05)), float(b)


def is_held_out(id_column, folds: int = 5):
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, shape: Shape, id_col: str, text_col: str, label_col: str) -> Network:
    """Trains on a bounded sample of labelled rows that are not held out.

    Of either label the rows of smallest hash of their id are taken, at most
    ``shape.toxic_rows`` and ``shape.clean_rows``, and of those the texts of
    up to ``shape.most_chars`` characters, whole.
    """
    own, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    known = labels.where(label.isNotNull() & own.isNotNull() & ~is_held_out(own))
    known = known.groupBy(own.alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    near = F.xxhash64("__id")
    sample = known.where("__y > 0").orderBy(near, "__id").limit(shape.toxic_rows)
    sample = sample.unionByName(known.where("__y = 0").orderBy(near, "__id").limit(shape.clean_rows))
    sample = F.broadcast(materialize(sample, "sample"))
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    # one text for each id, so that the sample is bounded however often an id repeats
    rows = texts.where(F.length("__text") <= shape.most_chars).join(sample, "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    rows = sorted((r["__id"], r["__y"], r["__text"]) for r in rows.collect())
    return train([t for _, _, t in rows], [int(y > 0) for _, y, _ in rows], shape)


def score(docs: DataFrame, network: Network, keep: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and a score from 0 to 1: that of the most toxic window of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(network)
    carried = list(dict.fromkeys([*keep, text_col]))
    names = [f"c{i}" for i in range(len(carried))]
    text = names[carried.index(text_col)]
    plain = docs.select(*[F.col(f"`{c}`") for c in carried]).toDF(*names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[: len(keep)]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, 1 << 20):
            scores = held.value.scores(part.column(text))
            columns = [part.column(c) for c in names[: len(keep)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*names[: len(keep)], "score"])

    return plain.mapInArrow(work, ", ".join([*fields, "score double"])).toDF(*keep, out)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    shape: Shape | None = None,
) -> DataFrame:
    """Scores every whole text; labels of rows whose crc32(id) is divisible by 5 are never used.

    Returns ``id_col, held_out, score, predicted`` per row. Null and empty
    texts are scored as one window without words. A null id counts as not
    held out. Rows that repeat are scored each for itself; with repeated
    labels the largest counts. Without labels of both kinds all scores are
    near 0, or near 1 if all labels are 1. Extra columns are ignored; an empty table gives none.
    """
    network = fit(docs, labels, shape or Shape(), id_col, text_col, label_col)
    return score(docs, network, [id_col], text_col).select(
        F.col(f"`{id_col}`"),
        is_held_out(F.col(f"`{id_col}`")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5."""
    columns = docs.columns
    network = fit(docs, labels, Shape(), id_col, text_col, "toxic")
    plain = [f"d{i}" for i in range(len(columns))]
    scored = score(docs.toDF(*plain), network, plain, plain[columns.index(text_col)], "__score")
    return scored.where("__score < 0.5").drop("__score").toDF(*columns)
