"""Text quality from weak labels: overlapping heuristics, their accuracies by expectation-maximisation, a linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .text import SPACE, chunks, distinct_by_row, mix, text_buffer, words

_NEVER = (np.inf, np.inf)
#: Name, measure, and its ranges for a vote for good and for bad; outside both it abstains.
#: Most know one kind of bad text each, so their silence says little and they never vote for good.
LABELLERS: list[tuple[str, str, tuple[float, float], tuple[float, float]]] = [
    ("length", "words", (30, np.inf), (-1, 3)),
    ("capitals", "capitals", _NEVER, (0.5, 1.1)),
    ("signs", "signs", _NEVER, (0.05, 1.1)),
    ("vocabulary", "distinct", _NEVER, (-1, 0.25)),
    ("repetition", "repeats", _NEVER, (0.08, 1.1)),
    ("word_length", "word_bytes", (3.0, 9.0), (12.0, np.inf)),
    ("sentences", "stops", (0.01, 0.1), (-1, 0.004)),
    ("digits", "digits", _NEVER, (0.2, 1.1)),
]
_N = len(LABELLERS)
_LEAST_PRECISION = 0.95


@dataclass(frozen=True)
class Settings:
    """Sizes of the scorer; the training sample is bounded by ``sample_rows`` texts of up to ``most_chars``."""

    buckets: int = 1 << 18
    sample_rows: int = 4000
    most_chars: int = 20_000
    epochs: int = 12
    seed: int = 3


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """What the labellers look at, per row. Shares are 0 for texts without words."""
    data, at = text_buffer(column)
    found = words(column, SPACE)
    n = found.counts()
    size = np.diff(at)

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(of, 1)

    upper = (data >= 0x41) & (data <= 0x5A)
    letter = upper | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    digit = (data >= 0x30) & (data <= 0x39)
    stop = (data == 0x2E) | (data == 0x2C)
    sign = ~letter & ~digit & ~stop & (data > 0x20)
    letters = share(letter, np.ones_like(size))
    row = found.row_of()
    _, starts = distinct_by_row(found.hashes, row, len(n))
    again = np.zeros(len(row), bool)
    again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (row[1:] == row[:-1])
    bulk = np.bincount(row, found.ends - found.starts, len(n))
    return {
        "words": n.astype(float),
        "capitals": share(upper, letters),
        "signs": share(sign, size),
        # texts of many words repeat some: their share is taken of 200 at most
        "distinct": np.diff(starts) / np.maximum(np.minimum(n, 200), 1),
        "repeats": np.bincount(row, again, len(n)) / np.maximum(n, 1),
        "word_bytes": bulk / np.maximum(n, 1),
        "stops": share(stop, size),
        "digits": share(digit, size),
    }


def votes(column: pa.Array) -> np.ndarray:
    """Rows x labellers: 1 for good, -1 for bad, 0 for no vote. Texts without words get one vote, that of their length."""
    seen = measures(column)
    out = np.zeros((len(column), _N), np.int8)
    for j, (_, name, good, bad) in enumerate(LABELLERS):
        x = seen[name]
        out[(x >= good[0]) & (x < good[1]), j] = 1
        out[(x >= bad[0]) & (x < bad[1]), j] = -1
    out[seen["words"] == 0, 1:] = 0
    return out


def patterns_of(cast: np.ndarray) -> np.ndarray:
    """One number for each row of votes."""
    return (cast.astype(np.int64) + 1) @ 3 ** np.arange(_N)


def estimate(cast: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good for each pattern of votes, and each labeller's accuracy where it votes.

    Expectation-maximisation over all texts, by pattern: labellers vote
    independently given the class, with their own chance of each vote; it
    begins with the votes, one for bad weighing as much as many for good, as
    most labellers find one kind of bad text each. The classes keep their
    names: a vote for good is held to be no likelier for bad texts, and votes
    for bad to be right in ``_LEAST_PRECISION`` of cases.
    """
    good = 1 / (1 + np.exp(3.0 * (cast < 0).sum(1) - 0.25 * (cast > 0).sum(1) - 1.0))
    chance = np.empty((2, _N, 3))
    for _ in range(rounds):
        prior = ((good * count).sum() + 1) / (count.sum() + 2)
        for c, weight in ((0, (1 - good) * count), (1, good * count)):
            for v in (-1, 0, 1):
                chance[c, :, v + 1] = ((cast == v) * weight[:, None]).sum(0) + 0.5
        chance /= chance.sum(2, keepdims=True)
        chance[0, :, 2] = np.minimum(chance[0, :, 2], chance[1, :, 2])
        most = chance[0, :, 0] * (1 - prior) / prior * (1 - _LEAST_PRECISION) / _LEAST_PRECISION
        chance[1, :, 0] = np.minimum(chance[1, :, 0], most)
        picked = np.log(chance[:, np.arange(_N)[None, :], cast + 1]).sum(2)
        new = 1 / (1 + np.exp(np.clip(picked[0] - picked[1] + np.log((1 - prior) / prior), -50, 50)))
        done = np.abs(new - good).max(initial=0) < 1e-6
        good = new
        if done:
            break
    right = ((cast == 1) * good[:, None] + (cast == -1) * (1 - good)[:, None]) * count[:, None]
    accuracy = right.sum(0) / np.maximum(((cast != 0) * count[:, None]).sum(0), 1)
    return good, accuracy


def features(column: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two kinds of hashed features, each a bucket and its row: byte trigrams; words, and one for a word said twice."""
    data, at = text_buffer(column)
    n_rows = len(at) - 1
    row = np.repeat(np.arange(n_rows), np.diff(at))
    code = data.astype(np.uint64)
    place = np.arange(max(0, len(data) - 2))
    place = place[row[place] == row[place + 2]] if len(place) else place
    code = code[place] | code[place + 1] << np.uint64(8) | code[place + 2] << np.uint64(16)
    found = words(column, SPACE)
    owner = found.row_of()
    again = np.flatnonzero((found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
    cut = np.uint64(buckets - 1)
    named = np.concatenate([found.hashes, np.full(len(again), np.uint64(7))])
    return [
        ((mix(code) & cut).astype(np.int64), row[place]),
        ((mix(named) & cut).astype(np.int64), np.concatenate([owner, owner[again]])),
    ]


class Scorer:
    """A logistic curve of the mean weights of a text's features of each kind."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.weights = np.zeros(settings.buckets)
        self.bias = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        total = np.full(n, self.bias)
        for bucket, row in features(column, self.settings.buckets):
            size = np.bincount(row, minlength=n) if len(row) else np.ones(n)
            total += np.bincount(row, self.weights[bucket], n) / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def fit(self, texts: list[str], target: np.ndarray) -> Scorer:
        """Adagrad on the logistic loss against chances of good."""
        if not texts:
            return self
        column = pa.array(texts, pa.large_string())
        n = len(texts)
        entries = []
        for bucket, row in features(column, self.settings.buckets):
            keys, count = np.unique(row * self.settings.buckets + bucket, return_counts=True)
            owner = keys // self.settings.buckets
            size = np.maximum(np.bincount(row, minlength=n), 1)
            entries.append((owner, keys % self.settings.buckets, count / size[owner]))
        owner, bucket, value = (np.concatenate(x) for x in zip(*entries))
        order = np.argsort(owner, kind="stable")
        owner, bucket, value = owner[order], bucket[order], value[order]
        start = np.searchsorted(owner, np.arange(n + 1))
        squares, bias_square = np.full(self.settings.buckets, 1e-8), 1e-8
        rng = np.random.default_rng(self.settings.seed)
        for _ in range(self.settings.epochs):
            for some in np.array_split(rng.permutation(n), max(1, n // 32)):
                spots = np.concatenate([np.arange(start[i], start[i + 1]) for i in some])
                local = np.repeat(np.arange(len(some)), start[some + 1] - start[some])
                b, v = bucket[spots], value[spots]
                logit = np.bincount(local, self.weights[b] * v, len(some)) + self.bias
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target[some]) / len(some)
                used, at = np.unique(b, return_inverse=True)
                g = np.bincount(at, error[local] * v)
                squares[used] += g * g
                self.weights[used] -= 4.0 * g / np.sqrt(squares[used])
                bias_square += error.sum() ** 2
                self.bias -= 0.3 * error.sum() / np.sqrt(bias_square)
        return self


def weak_labels(docs: DataFrame, text_col: str = "text") -> tuple[dict[int, float], dict[str, float]]:
    """Chance of good for each pattern of votes met, and the labellers' accuracies, from all texts.

    Only the counts of the patterns leave the tasks, at most 3 to the number of labellers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found, n = np.unique(patterns_of(votes(part.column("text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])

    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    rows = texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    found = np.array(sorted((r.pattern, r.n) for r in rows), np.int64).reshape(-1, 2)
    cast = (found[:, :1] // 3 ** np.arange(_N) % 3 - 1).astype(np.int8)
    good, accuracy = estimate(cast, found[:, 1].astype(float))
    return dict(zip(found[:, 0].tolist(), good.tolist())), dict(zip([x[0] for x in LABELLERS], accuracy.tolist()))


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """Scores every whole text by a scorer trained on weak labels; no human labels are used.

    Returns per row ``id_col, score`` (0 to 1, higher: better), ``predicted``
    (1 if the score is 0.5 or more), ``posterior`` (chance of good by the
    labellers alone), ``n_good`` and ``n_bad`` (votes). The scorer learns
    from the texts of smallest hash of their id, as many as the settings
    say; the labellers' accuracies come from all texts. Null and empty texts
    have no words: only their length is voted on and they score by the
    bias. Null ids are never in the sample. Rows that repeat are scored each
    for itself; extra columns are ignored; an empty table gives no rows.
    """
    settings = settings or Settings()
    chance, _ = weak_labels(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    short = rows.where(F.col("__id").isNotNull() & (F.length("__text") <= settings.most_chars))
    near = short.select("__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(settings.sample_rows)
    # one text for each id, so that the sample is bounded however often an id repeats
    sample = short.join(F.broadcast(materialize(near, "sample")), "__id").groupBy("__id").agg(F.min("__text").alias("__text"))
    texts = sorted((r["__id"], r["__text"]) for r in sample.collect())
    column = pa.array([t for _, t in texts], pa.large_string())
    target = np.array([chance.get(p, 0.5) for p in patterns_of(votes(column)).tolist()])
    scorer = Scorer(settings).fit([t for _, t in texts], target)
    held = docs.sparkSession.sparkContext.broadcast((scorer, chance))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer_, chance_ = held.value
        for part in chunks(batches, "__text", 2 << 20):
            text = part.column("__text")
            cast = votes(text)
            posterior = [chance_.get(p, 0.5) for p in patterns_of(cast).tolist()]
            columns = [
                part.column("__id"), pa.array(scorer_.scores(text)), pa.array(posterior, pa.float64()),
                pa.array((cast > 0).sum(1).astype(np.int32)), pa.array((cast < 0).sum(1).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "score", "posterior", "n_good", "n_bad"])

    kind = rows.schema["__id"].dataType.simpleString()
    scored = rows.mapInArrow(work, f"__id {kind}, score double, posterior double, n_good int, n_bad int")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select(F.col("__id").alias(id_col), "score", predicted, "posterior", "n_good", "n_bad")
